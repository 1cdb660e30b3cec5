"""The accumulating metrics table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.operators.evaluation import METRIC_KEYS, upsert_metrics


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """Newest version of the table, or None when nothing was written yet."""
    try:
        table = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    newest = table.agg(F.max("version").alias("version"))
    return table.join(F.broadcast(newest), "version")


def write_metrics(new: DataFrame, path: str) -> None:
    """Merge new metrics into the table as its next version.

    A version is a folder of its own, so the one being read is never overwritten and
    a failed write leaves the last good version in place.
    """
    existing = read_metrics(new.sparkSession, path)
    columns = [*METRIC_KEYS, "value"]
    if existing is None:
        merged = new.select(*columns).withColumn("version", F.lit(1))
    else:
        version = existing.agg(F.max("version").alias("v")).first()["v"]
        merged = upsert_metrics(existing.select(*columns), new.select(*columns)).withColumn(
            "version", F.lit(version + 1)
        )
    merged.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
