"""The cleaning pipeline for a training corpus: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir), where ``docs`` is a stored table, and works on all
rows of the one before.  All but the last keep the columns of ``documents``.  SQL cannot express trained scores, so there
is no ORACLE_SQL; the stages are tested against brute-force versions.

Empty tables give empty results; null ids and texts pass every filter (see the operators'
docstrings); other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.llm.decontaminate import drop_contaminated
from facetry.llm.disclosure import sanitise
from facetry.llm.kernels import keep
from facetry.llm.packing import pack_documents
from facetry.llm.token_groups import keep_one
from facetry.llm.toxicity import drop_toxic

ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word Jaccard similarity of 0.8 or more stays."""
    return keep_one(docs, size=5, percent=80, pin=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities and the terms that disclose them are replaced in the text."""
    clean = sanitise(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn(
            "n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
        )
    return clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in the packed sequences."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is stored before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
