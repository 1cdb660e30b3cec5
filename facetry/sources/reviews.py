"""Review tables: CSV, frames and the pipeline's own parquet output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetry.operators.prepare import canonicalize

MENTION_SCHEMA = (
    "review_id bigint, product string, rating double, date timestamp, sentence_id int, "
    "sentence string, doc_sentiment string, doc_compound double, aspect string, theme string, "
    "aspect_sentiment string, aspect_compound double"
)
REVIEW_SCHEMA = (
    "review_id bigint, text string, rating double, date timestamp, product string, "
    "doc_compound double, doc_sentiment string"
)


def read_csv(
    spark: SparkSession, path: str | Sequence[str], null_values: str = "", multi_line: bool = True
) -> DataFrame:
    """All columns as text; quoted commas and quotes are kept together.

    So are quoted line breaks, for which a file is read by one task.  Files without them
    can be split with ``multi_line=False``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
        .option("escape", '"').option("nullValue", null_values).csv(paths)
    )


def load_reviews(
    source: DataFrame | str, spark: SparkSession | None = None,
    columns: Mapping[str, str] | None = None, ids: str = "consecutive",
    date_formats: Sequence[str] = (), id_type: str = "bigint", multi_line: bool = True,
) -> DataFrame:
    """Canonical reviews from a CSV path or a frame.

    CSV values are text, so ``id_type`` states what the ids are; an id that does not
    fit is an error.  A frame keeps its own id type.
    """
    if isinstance(source, DataFrame):
        return canonicalize(source, columns, ids, date_formats)
    session = spark or SparkSession.active()
    rows = canonicalize(read_csv(session, source, multi_line=multi_line), columns, ids, date_formats, pin=False)
    return rows.withColumn("review_id", F.col("review_id").cast(id_type))


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Deal the rows out to as many tasks as the caller names; without a number, as they are.

    For inputs that cannot be split, such as one file with a single row group.  The rows
    are dealt by the number of their place, which needs no sort, unlike dealing them in turn,
    and spreads rows whose columns are all equal.  ``rows`` is a file scan: it repeats its places.
    """
    if partitions is None:
        return rows
    return rows.withColumn("_at", F.monotonically_increasing_id()).repartition(partitions, "_at").drop("_at")


#: Blocks of rows that a task gets, so that a block stays a part of what a task can read.
BLOCKS = 4


def deal(rows: DataFrame, partitions: int, by: Sequence[str], name: str = "_deal") -> DataFrame:
    """The same by a hash of columns, with the number of a row's block in ``name``.

    Rows that agree in the columns are in one block, and a block is in one task: what is
    worked out per block and brought back to its rows moves none of them again.
    """
    block = F.pmod(F.xxhash64(*by), F.lit(BLOCKS * partitions)).cast("int")
    return rows.withColumn(name, block).repartition(partitions, name)


def read_typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved table with its columns' own types and order.

    Values of partition folders are text like "007"; without a schema Spark would read a
    number.  The id keeps the type it was written with.
    """
    found = spark.read.parquet(path).schema
    fields = [
        found[f.name] if f.name == "review_id" and f.name in found.names else f
        for f in StructType.fromDDL(schema) if f.name in found.names
    ]
    return spark.read.schema(StructType(fields)).parquet(path).select(*(f.name for f in fields))


def load_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return read_typed(spark, f"{folder}/mentions.parquet", MENTION_SCHEMA)


def load_scored_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written next to the mentions; none written gives an empty table."""
    try:
        return spark.read.parquet(f"{folder}/reviews.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], REVIEW_SCHEMA)
