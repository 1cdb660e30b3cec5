"""Report tables over mention rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.wordlists import SENTIMENTS
from facetry.operators.joins import lookup_join

# First letter of a frequency code -> unit of date_trunc.
PERIODS = {"M": "month", "W": "week", "D": "day", "Q": "quarter", "Y": "year", "A": "year"}

_ROW_ORDER = ["review_id", "sentence_id", "aspect", "sentence"]


def _label_counts(extra=None):
    def hit(name):
        test = F.col("aspect_sentiment") == name
        return test if extra is None else test & extra

    return [F.count_if(hit(name)).alias(name) for name in SENTIMENTS]


def distribution(mentions: DataFrame, group_col: str = "aspect") -> DataFrame:
    """Unordered form of ``aspect_distribution``: one partial and one final aggregation."""
    known = mentions.filter(F.col("aspect_sentiment").isNotNull())
    # A test of the group before the grouping would be pushed below the projection that makes
    # it, and find the theme of every mention a second time.
    counts = known.groupBy(group_col).agg(
        *_label_counts(F.col("sentence").isNotNull()), F.count(group_col).alias("_known")
    ).filter(F.col("_known") > 0)
    total = F.col("positive") + F.col("neutral") + F.col("negative")
    return counts.select(
        group_col, *SENTIMENTS, total.alias("mentions"),
        F.try_divide(F.col("positive"), total).alias("pct_positive"),
        F.try_divide(F.col("negative"), total).alias("pct_negative"),
        F.try_divide(F.col("positive") - F.col("negative"), total).alias("net_score"),
    )


def aspect_distribution(mentions: DataFrame, group_col: str = "aspect") -> DataFrame:
    """Label counts, shares and net score per group, most mentioned first."""
    return distribution(mentions, group_col).orderBy(F.desc("mentions"), group_col)


def filter_mentions(dist: DataFrame, min_mentions: int) -> DataFrame:
    return dist.filter(F.col("mentions") >= min_mentions)


def _rank(mentions, group_col, k, min_mentions, net_order):
    kept = filter_mentions(distribution(mentions, group_col), min_mentions)
    return kept.orderBy(net_order, F.desc("mentions"), group_col).limit(k)


def top_loved(
    mentions: DataFrame, group_col: str = "aspect", k: int = 8, min_mentions: int = 2
) -> DataFrame:
    """Groups with the highest net score."""
    return _rank(mentions, group_col, k, min_mentions, F.desc_nulls_last("net_score"))


def top_hated(
    mentions: DataFrame, group_col: str = "aspect", k: int = 8, min_mentions: int = 2
) -> DataFrame:
    """Groups with the lowest net score."""
    return _rank(mentions, group_col, k, min_mentions, F.asc_nulls_last("net_score"))


def representative_quotes(
    mentions: DataFrame, group_col: str = "aspect", per_side: int = 1,
    tie_break: Sequence[str] | None = None,
) -> DataFrame:
    """The ``per_side`` highest (loved) and lowest (hated) rows of every group.

    The rows are read once, each for both sides; Spark cuts every task's (group, side)
    to ``per_side`` rows before the shuffle, so a popular group stays small.
    """
    ties = [c for c in (tie_break or _ROW_ORDER) if c in mentions.columns and c != group_col]
    columns = dict.fromkeys([group_col, "aspect_sentiment", "aspect_compound", "sentence", *ties])
    known = mentions.filter(F.col(group_col).isNotNull()).select(*columns)
    sides = known.withColumn("side", F.explode(F.array(F.lit("loved"), F.lit("hated"))))
    # Ascending for both sides: the loved one ranks by the negated score.
    height = F.when(F.col("side") == "loved", -F.col("aspect_compound")).otherwise(F.col("aspect_compound"))
    window = Window.partitionBy(group_col, "side").orderBy(F.asc_nulls_last(height), *ties)
    kept = sides.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= per_side)
    return kept.orderBy(group_col, F.desc("side"), "_rank").select(
        group_col, "side", "aspect_sentiment", "aspect_compound", "sentence"
    )


def quotes_of_side(quotes: DataFrame, side: str, group_col: str = "aspect") -> DataFrame:
    return quotes.filter(F.col("side") == side).select(group_col, "sentence", "aspect_compound")


def sentiment_by_rating(mentions: DataFrame) -> DataFrame:
    """Row counts per observed (rating, label)."""
    known = mentions.filter(F.col("rating").isNotNull() & F.col("aspect_sentiment").isNotNull())
    return known.groupBy("rating", "aspect_sentiment").agg(F.count("*").alias("count")).orderBy(
        "rating", "aspect_sentiment"
    )


def sentiment_over_time(mentions: DataFrame, freq: str = "ME") -> DataFrame:
    """Label counts per period, named by the start of the period; empty ones are absent."""
    unit = PERIODS.get(freq[:1].upper())
    if unit is None:
        raise ValueError(f"unknown frequency {freq!r}; it must start with one of {sorted(PERIODS)}")
    known = mentions.filter(F.col("date").isNotNull() & F.col("aspect_sentiment").isNotNull())
    kind = dict(mentions.dtypes)["date"]
    period = F.date_trunc(unit, "date")
    period = period.cast("timestamp_ntz") if kind == "timestamp_ntz" else period
    return known.groupBy(period.alias("period")).agg(*_label_counts()).orderBy("period")


def review_opinions(mentions: DataFrame) -> DataFrame:
    """``review_id, mentions, mixed``: whether a review holds more than one label.

    Two labels differ exactly when the smallest and the largest do, which needs no
    distinct and combines before the shuffle.
    """
    low, high = F.min("aspect_sentiment"), F.max("aspect_sentiment")
    return mentions.filter(F.col("review_id").isNotNull()).groupBy("review_id").agg(
        F.count("*").alias("mentions"), F.coalesce(low != high, F.lit(False)).alias("mixed")
    )


def mixed_review_count(mentions: DataFrame) -> DataFrame:
    return review_opinions(mentions).agg(F.count_if("mixed").alias("mixed_reviews"))


def mixed_rows(mentions: DataFrame) -> DataFrame:
    """Mention rows of mixed reviews; a review with very many rows is dealt over several tasks."""
    mixed = review_opinions(mentions).filter("mixed").select("review_id")
    return lookup_join(mentions, mixed, "review_id", "left_semi").select(*mentions.columns)


def overview(reviews: DataFrame, mentions: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: distinct reviews, mentions, distinct aspects, mixed reviews.

    Reviews come from their own table.  Mentions are read once and combined to one row per
    (review, aspect) in each task; each row then counts for its review and for its aspect.
    """
    names = ["reviews", "mentions", "distinct_aspects", "mixed_reviews"]
    count = F.approx_count_distinct if approximate else F.count
    n_reviews = reviews if approximate else reviews.select("review_id").distinct()
    pairs = mentions.groupBy("review_id", "aspect").agg(
        F.count("*").alias("_n"), F.min("aspect_sentiment").alias("_low"), F.max("aspect_sentiment").alias("_high")
    )
    # (kind, key): the review with its rows and labels, and the aspect alone.
    keys = pairs.select("_n", "_low", "_high", F.inline(F.array(
        F.struct(F.lit("review").alias("_kind"), F.col("review_id").cast("string").alias("_key")),
        F.struct(F.lit("aspect").alias("_kind"), F.col("aspect").cast("string").alias("_key")),
    )))
    parts = keys.groupBy("_kind", "_key").agg(
        F.sum("_n").alias("_n"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    review, known = F.col("_kind") == "review", F.col("_key").isNotNull()
    counts = parts.agg(
        F.lit(0).cast("bigint").alias("reviews"), F.coalesce(F.sum(F.when(review, F.col("_n"))), F.lit(0)).alias("mentions"),
        count(F.when(~review, F.col("_key"))).alias("distinct_aspects"),
        F.count_if(review & known & (F.col("_low") != F.col("_high"))).alias("mixed_reviews"),
    )
    rows = n_reviews.agg(count("review_id").alias("reviews")).select(
        "reviews", *[F.lit(0).cast("bigint").alias(n) for n in names[1:]]
    ).unionByName(counts)
    return rows.agg(*[F.sum(n).alias(n) for n in names])


def run_counts(reviews: DataFrame, sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: reviews, sentences, mentions."""
    def part(df, name):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")

    rows = part(reviews, "reviews").unionByName(part(sentences, "sentences")).unionByName(
        part(mentions, "mentions")
    )
    names = ["reviews", "sentences", "mentions"]
    return rows.agg(*[F.sum(F.when(F.col("name") == n, F.col("n"))).alias(n) for n in names])


def distribution_long(
    mentions: DataFrame, group_col: str = "aspect", min_mentions: int = 2
) -> DataFrame:
    """(group, label) rows, groups from the lowest to the highest net score."""
    kept = filter_mentions(distribution(mentions, group_col), min_mentions)
    long = kept.unpivot([group_col, "mentions", "net_score"], SENTIMENTS, "sentiment", "count")
    return long.orderBy("net_score", group_col, "sentiment")


def net_scores(mentions: DataFrame, group_col: str = "aspect", min_mentions: int = 2) -> DataFrame:
    """Groups from the lowest to the highest net score."""
    kept = filter_mentions(distribution(mentions, group_col), min_mentions)
    return kept.select(group_col, "mentions", "net_score").orderBy("net_score", group_col)


def trend_long(mentions: DataFrame, freq: str = "ME") -> DataFrame:
    """(period, label) rows of the trend."""
    return sentiment_over_time(mentions, freq).unpivot(["period"], SENTIMENTS, "sentiment", "count")
