"""The same operators on streams.

Everything up to the mention table is row-local, so it runs unchanged on a streaming
frame without state.  Only the trend keeps state, bounded by its watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from facetry.functions.wordlists import SENTIMENTS
from facetry.plans.pipeline import Options, run

TREND_SCHEMA = "period timestamp, positive bigint, neutral bigint, negative bigint"
REVIEW_SCHEMA = "review_id bigint, text string, rating double, date timestamp, product string"


def read_review_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New parquet files of canonical reviews."""
    return (
        spark.readStream.schema(REVIEW_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def mention_stream(reviews: DataFrame, options: Options = Options()) -> DataFrame:
    return run(reviews, options).mentions


def weekly_trend(mentions: DataFrame, delay: str = "7 days") -> DataFrame:
    """Label counts per week, Monday first; weeks close ``delay`` after their end.

    Windows are aligned to the epoch, a Thursday; a start of four days moves them to
    Monday.
    """
    dated = mentions.filter(F.col("date").isNotNull() & F.col("aspect_sentiment").isNotNull())
    weeks = dated.withWatermark("date", delay).groupBy(F.window("date", "7 days", "7 days", "4 days"))
    counts = weeks.agg(*[F.count_if(F.col("aspect_sentiment") == s).alias(s) for s in SENTIMENTS])
    return counts.select(F.col("window.start").alias("period"), *SENTIMENTS)


def store_trend(trend: DataFrame, folder: str) -> DataStreamWriter:
    """Writer that stores the whole trend, open weeks too, after every batch.

    The state is one row per week, so each batch writes a table of that size into its own
    folder; a batch that is repeated after a failure overwrites its own.
    """
    trend.sparkSession.createDataFrame([], TREND_SCHEMA).write.mode("ignore").parquet(f"{folder}/trend/batch=-1")

    def write(weeks: DataFrame, batch: int) -> None:
        weeks.write.mode("overwrite").parquet(f"{folder}/trend/batch={batch}")

    return (
        trend.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/state")
    )


def read_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The trend after the newest batch; empty before the first."""
    stored = spark.read.schema(TREND_SCHEMA + ", batch bigint").parquet(f"{folder}/trend")
    newest = stored.agg(F.max("batch")).first()[0]
    return stored.filter(F.col("batch").eqNullSafe(F.lit(newest))).drop("batch")
