import datetime as dt

import pytest
from pyspark.sql import functions as F

from facetry.operators import summary as S
from facetry.operators.joins import lookup_join

SCHEMA = (
    "review_id int, sentence_id int, aspect string, theme string, aspect_sentiment string, "
    "aspect_compound double, sentence string, rating double, date timestamp, product string"
)


@pytest.fixture(scope="module")
def mentions(spark):
    d = lambda m, x: dt.datetime(2026, m, x)
    return spark.createDataFrame(
        [
            (11, 0, "zipper", "closure", "negative", -0.8, "q1", 1.0, d(3, 3), "tent"),
            (11, 1, "fabric", "cloth", "neutral", 0.0, "q2", 1.0, d(3, 3), "tent"),
            (12, 0, "zipper", "closure", "positive", 0.35, "q3", 4.0, d(3, 20), "tent"),
            (13, 0, "fabric", "cloth", "positive", 0.9, "q4", 5.0, d(4, 2), "bag"),
            (13, 2, "fabric", "cloth", "positive", 0.7, "q5", 5.0, d(4, 2), "bag"),
            (14, 0, "zipper", "closure", "negative", -0.2, "q6", 2.0, d(4, 9), None),
            (15, 0, "fabric", "cloth", "positive", 0.55, "q7", 4.0, d(4, 30), "bag"),
        ],
        SCHEMA,
    )


def test_distribution(mentions):
    found = [(r["aspect"], r["mentions"], r["positive"], r["neutral"], r["negative"], r["net_score"], r["pct_positive"])
             for r in S.aspect_distribution(mentions).collect()]
    assert found == [("fabric", 4, 3, 1, 0, 0.75, 0.75), ("zipper", 3, 1, 0, 2, pytest.approx(-1 / 3), pytest.approx(1 / 3))]


def test_distribution_edge_rows(spark):
    rows = spark.createDataFrame(
        [(None, "positive", "s"), ("a", "conflict", "s"), ("b", "positive", None), ("b", "neutral", "s"), ("c", None, "s")],
        "aspect string, aspect_sentiment string, sentence string",
    )
    out = {r["aspect"]: r for r in S.aspect_distribution(rows).collect()}
    assert set(out) == {"a", "b"}
    assert (out["a"]["mentions"], out["a"]["net_score"]) == (0, None)
    assert (out["b"]["mentions"], out["b"]["positive"]) == (1, 0)


def test_loved_and_hated(mentions):
    assert S.top_loved(mentions).first()["aspect"] == "fabric"
    assert S.top_hated(mentions).first()["aspect"] == "zipper"
    assert [r["aspect"] for r in S.top_loved(mentions, min_mentions=4).collect()] == ["fabric"]
    assert S.top_loved(mentions, k=1).count() == 1


def test_quotes(mentions):
    out = S.representative_quotes(mentions).collect()
    assert [(r["aspect"], r["side"], r["sentence"]) for r in out] == [
        ("fabric", "loved", "q4"), ("fabric", "hated", "q2"), ("zipper", "loved", "q3"), ("zipper", "hated", "q1"),
    ]
    two = S.quotes_of_side(S.representative_quotes(mentions, per_side=2), "loved").collect()
    assert [r["sentence"] for r in two if r["aspect"] == "fabric"] == ["q4", "q5"]


def test_quotes_cut_groups_before_the_shuffle(mentions):
    plan = S.representative_quotes(mentions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Scan") == 1


def test_null_scores_come_last_on_both_sides(spark):
    rows = spark.createDataFrame(
        [("a", "x", None, "s0"), ("a", "x", 0.1, "s1")],
        "aspect string, aspect_sentiment string, aspect_compound double, sentence string",
    )
    assert {r["sentence"] for r in S.representative_quotes(rows).collect()} == {"s1"}


def test_rating_and_time(mentions):
    rated = {(r["rating"], r["aspect_sentiment"]): r["count"] for r in S.sentiment_by_rating(mentions).collect()}
    assert rated == {(1.0, "negative"): 1, (1.0, "neutral"): 1, (2.0, "negative"): 1, (4.0, "positive"): 2, (5.0, "positive"): 2}
    months = S.sentiment_over_time(mentions).collect()
    assert [(r["period"].month, r["positive"], r["neutral"], r["negative"]) for r in months] == [(3, 1, 1, 1), (4, 3, 0, 1)]
    assert months[0]["period"] == dt.datetime(2026, 3, 1)
    weeks = [r["period"].weekday() for r in S.sentiment_over_time(mentions, "W").collect()]
    assert set(weeks) == {0}
    with pytest.raises(ValueError, match="unknown frequency"):
        S.sentiment_over_time(mentions, "x")


def test_empty_inputs(mentions):
    none = mentions.limit(0)
    for out in (S.aspect_distribution(none), S.representative_quotes(none), S.sentiment_over_time(none),
                S.sentiment_by_rating(none), S.mixed_rows(none)):
        assert out.count() == 0
    assert tuple(S.overview(none.select("review_id"), none).first()) == (0, 0, 0, 0)
    assert tuple(S.run_counts(none, none, none).first()) == (0, 0, 0)


def test_mixed(mentions):
    assert S.mixed_review_count(mentions).first()["mixed_reviews"] == 1
    assert {r["sentence"] for r in S.mixed_rows(mentions).collect()} == {"q1", "q2"}


def test_overview(mentions):
    reviews = mentions.select("review_id")
    assert tuple(S.overview(reviews, mentions).first()) == (5, 7, 2, 1)
    assert tuple(S.overview(reviews, mentions, approximate=True).first()) == (5, 7, 2, 1)
    assert tuple(S.run_counts(reviews, mentions, mentions).first()) == (7, 7, 7)


def test_long_forms(mentions):
    long = S.distribution_long(mentions).collect()
    assert len(long) == 6 and long[0]["aspect"] == "zipper"
    assert {r["sentiment"] for r in long} == {"positive", "neutral", "negative"}
    assert S.trend_long(mentions).count() == 6
    assert [r["aspect"] for r in S.net_scores(mentions).collect()] == ["zipper", "fabric"]


@pytest.mark.parametrize("partitions", [1, 4, 64])
def test_results_do_not_depend_on_partitioning(spark, mentions, partitions):
    wide = mentions.crossJoin(spark.range(50)).withColumn("review_id", F.col("review_id") + F.col("id") * 10).drop("id")
    expected = sorted(map(str, S.aspect_distribution(wide).collect() + S.mixed_rows(wide).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        again = wide.repartition(partitions)
        assert sorted(map(str, S.aspect_distribution(again).collect() + S.mixed_rows(again).collect())) == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
@pytest.mark.parametrize("salts", [1, 7])
def test_lookup_join_equals_the_plain_join(spark, how, salts):
    # A third of the rows share one key, some keys are unknown, some are NULL.
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k")
    )
    table = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    if how == "left_semi":
        table = table.select("k")
    expected = sorted(map(tuple, rows.join(table, "k", how).collect()), key=str)
    got = lookup_join(rows, table, "k", how, salts=salts)
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_a_hot_key_is_split_below_an_aggregated_table(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    table = spark.range(0, 4_000).groupBy((F.col("id") % 40).alias("k")).agg(F.count("*").alias("v"))
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in zip(names, ["-1", "10KB", "10KB", "-1"]):
        spark.conf.set(n, value)
    try:
        got = lookup_join(rows, table, "k")
        assert got.filter(F.col("v").isNotNull()).count() == rows.filter("k < 40").count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line]
        # Both inputs of the join are shuffled on the key and the salt.
        assert len(joins) == 1 and plan.count("hashpartitioning(k") >= 2 and plan.count("_salt") >= 4
    finally:
        for n, value in before.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
