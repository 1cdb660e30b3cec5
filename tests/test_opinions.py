"""Reviews, mentions and mixed reviews on a stream against the batch counts."""

import random

import pytest
from pyspark.sql import functions as F

from facetry.operators import summary
from facetry.streaming.opinions import opinion_changes, read_overview, store_overview

KINDS = "review_id bigint, aspect_sentiment string, date timestamp"


def streamed(spark, folder, parts, **options):
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in/b{i:02d}")
    stream = spark.readStream.schema(KINDS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store_overview(opinion_changes(stream, **options), folder).trigger(availableNow=True).start().awaitTermination()
    return tuple(read_overview(spark, folder).first())


@pytest.mark.parametrize("cuts", [1, 4])
def test_changes_sum_to_the_batch_counts(spark, tmp_path, cuts):
    rng = random.Random(cuts)
    # A third of the rows are one review; some have no id, some no label.
    rows = [
        (None if i % 17 == 0 else 0 if i % 3 == 0 else rng.randrange(1, 60), rng.choice(["positive", "positive", "neutral", None]), None)
        for i in range(400)
    ]
    rng.shuffle(rows)
    parts = [spark.createDataFrame(rows[k::cuts], KINDS) for k in range(cuts)]
    batch = summary.review_opinions(spark.createDataFrame(rows, KINDS)).agg(
        F.count("*"), F.sum("mentions"), F.count_if("mixed")
    ).first()
    assert streamed(spark, str(tmp_path), parts) == tuple(batch)


def test_expired_reviews_count_anew_and_late_rows_are_dropped(spark, tmp_path):
    days = [
        [(1, "positive", "2025-03-01"), (2, "negative", "2025-03-01"), (4, "neutral", None)],
        [(1, "negative", "2025-03-03"), (3, "positive", "2025-03-20")],
        [(3, "positive", "2025-03-21")],
        [(2, "positive", "2025-03-22"), (1, "positive", "2025-03-02")],
    ]
    parts = [spark.createDataFrame(d, "review_id bigint, aspect_sentiment string, day string").select(
        "review_id", "aspect_sentiment", F.col("day").cast("timestamp").alias("date")) for d in days]
    # Review 2 returns after it was forgotten; the late row of review 1 and the row without a date are dropped.
    assert streamed(spark, str(tmp_path), parts, expire="5 days") == (4, 6, 1)


def test_no_rows(spark, tmp_path):
    assert streamed(spark, str(tmp_path), [spark.createDataFrame([], KINDS)]) == (0, 0, 0)
