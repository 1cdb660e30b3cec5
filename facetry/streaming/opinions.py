"""Mixed reviews and the overview on a stream: what a batch changes, not the whole table.

A review is mixed as soon as two of its mentions differ in their label.  State is kept per
review: its rows so far and its first label, nothing that grows with the review.  Each
batch sends out one row per review it touched, and an overview is the sum of these rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE_SCHEMA = "review_id bigint, new_reviews bigint, new_mentions bigint, new_mixed bigint"
STATE_SCHEMA = "label string, mixed boolean, newest bigint"
PART_SCHEMA = "review_id bigint, n bigint, low string, high string, date timestamp"


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per review of an Arrow batch, so that a review with very many rows sends few."""
    for rows in batches:
        labels = rows["aspect_sentiment"].dropna().groupby(rows["review_id"])
        whole = rows.groupby("review_id")
        parts = pd.DataFrame({"n": whole.size(), "date": whole["date"].max()})
        yield parts.join(pd.DataFrame({"low": labels.min(), "high": labels.max()})).reset_index()[
            ["review_id", "n", "low", "high", "date"]
        ]


def _update(expires: bool):
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.exists
        label, was, newest = state.get if known else (None, False, 0)
        mixed, rows = was, 0
        for part in batches:
            rows += int(part["n"].sum())
            found = part.dropna(subset=["low"])
            if len(found):
                low, high = found["low"].min(), found["high"].max()
                label = low if label is None else label
                mixed = bool(mixed or low != high or low != label)
            if expires:
                newest = max(newest, int(part["date"].max().timestamp() * 1000))
        state.update((label, mixed, newest))
        if expires:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({
            "review_id": [key[0]], "new_reviews": [int(not known)], "new_mentions": [rows],
            "new_mixed": [int(mixed and not was)],
        })

    return update


def opinion_changes(mentions: DataFrame, expire: str | None = None) -> DataFrame:
    """``review_id, new_reviews, new_mentions, new_mixed`` per review and batch that touched it.

    ``mentions`` is a stream with ``review_id, aspect_sentiment`` and, with ``expire``, a
    ``date``.  Rows without an id belong to no review and are left out, as in
    ``summary.review_opinions``; a NULL label counts as a mention and never makes a review
    mixed.  Summed over all batches the rows equal the batch counts however the input is
    split.  Rows are combined where they are read, so a review is never gathered.

    With ``expire`` (such as "30 days") a review is forgotten once the newest date of the
    stream is that much after its own newest one, which bounds the state by the reviews of
    that span.  Rows older than that are dropped as late, as are rows without a date, and a
    review that returns counts anew.  Without it nothing is dropped or forgotten.
    """
    date = F.lit(None).cast("timestamp") if expire is None else F.col("date").cast("timestamp")
    rows = mentions.filter(F.col("review_id").isNotNull()).select(
        F.col("review_id").cast("bigint").alias("review_id"), "aspect_sentiment", date.alias("date")
    )
    if expire is not None:
        rows = rows.filter(F.col("date").isNotNull())
    parts = rows.mapInPandas(_combine, PART_SCHEMA)
    if expire is None:
        timeout = GroupStateTimeout.NoTimeout
    else:
        parts, timeout = parts.withWatermark("date", expire), GroupStateTimeout.EventTimeTimeout
    return parts.groupBy("review_id").applyInPandasWithState(
        _update(expire is not None), CHANGE_SCHEMA, STATE_SCHEMA, "update", timeout
    )


def store_overview(changes: DataFrame, folder: str) -> DataStreamWriter:
    """Writer that adds one row per batch to the overview: what the batch added.

    A batch that is repeated after a failure overwrites its own folder.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in (
            "new_reviews", "new_mentions", "new_mixed",
        )]).write.mode("overwrite").parquet(f"{folder}/overview/batch={batch}")

    return (
        changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/overview-state")
    )


def read_overview(spark: SparkSession, folder: str) -> DataFrame:
    """One row: reviews with mentions, mentions and mixed reviews after the newest batch."""
    kinds = "new_reviews bigint, new_mentions bigint, new_mixed bigint"
    stored = spark.read.schema(kinds).parquet(f"{folder}/overview")
    return stored.agg(
        F.coalesce(F.sum("new_reviews"), F.lit(0)).alias("reviews"), F.coalesce(F.sum("new_mentions"), F.lit(0)).alias("mentions"),
        F.coalesce(F.sum("new_mixed"), F.lit(0)).alias("mixed_reviews"),
    )
