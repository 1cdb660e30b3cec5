import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from facetry.functions.wordlists import MENTION_COLUMNS
from facetry.functions.polarity import Lexicon
from facetry.operators.mentions import explode_mentions, mentions_by_table, noun_phrase_mentions
from facetry.operators.models import extractor_hook, scorer_hook
from facetry.plans.pipeline import Options, load_result, run
from facetry.sources.reviews import load_mentions, load_reviews, load_scored_reviews
from facetry.streaming.mentions import mention_stream, read_review_stream, weekly_trend


@pytest.fixture
def result(sample_reviews):
    return run(load_reviews(sample_reviews))


def test_end_to_end(result):
    assert result.reviews.count() == 3 and "doc_sentiment" in result.reviews.columns
    assert result.mentions.columns == MENTION_COLUMNS
    rows = result.mentions.collect()
    aspects = {r["aspect"] for r in rows}
    assert any("zipper" in a for a in aspects) and any("pockets" in a for a in aspects)
    labels = {}
    for r in rows:
        labels.setdefault(r["review_id"], set()).add(r["aspect_sentiment"])
    assert any(len(v) > 1 for v in labels.values())


def test_summary_helper(result):
    rows = result.aspect_summary("theme").collect()
    assert rows and all(r["mentions"] > 0 for r in rows)


def test_no_shuffle_before_the_summary(spark):
    reviews = spark.createDataFrame(
        [(1, "Great screen.", 5.0, None, "p")], "review_id int, text string, rating double, date timestamp, product string"
    )
    plan = run(reviews).mentions._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_save_and_load(result, tmp_path, spark):
    result.save(str(tmp_path / "out"), partition_by=["product"])
    again = load_result(spark, str(tmp_path / "out"))
    key = lambda df: sorted(map(str, df.select(*MENTION_COLUMNS).collect()))
    assert key(again.mentions) == key(result.mentions)
    assert load_mentions(spark, str(tmp_path / "out")).count() == result.mentions.count()
    assert load_scored_reviews(spark, str(tmp_path / "out")).count() == 3
    empty = load_scored_reviews(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and "doc_compound" in empty.columns


def test_empty_input(spark, result):
    none = run(load_reviews(spark.createDataFrame([(1, " ")], "review_id int, text string")))
    assert none.mentions.columns == MENTION_COLUMNS and none.mentions.count() == 0


@pytest.fixture
def hooks():
    """Factories made inside a function travel to the workers by value."""
    def extractor():
        return lambda texts: [[w for w in t.split() if len(w) > 5] for t in texts]

    def scorer():
        return lambda pairs: [("POS", 0.9) if len(a) % 2 else ("LABEL_0", -0.9) for _, a in pairs]

    def short():
        return lambda items: list(items)[:-1]

    return extractor, scorer, short


def test_model_hooks(sample_reviews, hooks):
    extractor, scorer, _ = hooks
    options = Options(extractor=extractor_hook("t", extractor, batch=2), scorer=scorer_hook("s", scorer, batch=2))
    rows = run(load_reviews(sample_reviews), options).mentions.collect()
    assert rows and {r["aspect_sentiment"] for r in rows} == {"positive", "negative"}
    assert all((r["aspect_compound"] > 0) == (len(r["aspect"]) % 2 == 1) for r in rows)


def test_wrong_number_of_predictions(spark, hooks):
    rows = spark.createDataFrame([("a b",), ("c",)], "sentence string")
    with pytest.raises(PySparkException, match="model returned"):
        explode_mentions(rows, extractor_hook("short", hooks[2])(F.col("sentence"))).collect()


def test_filter_reaches_the_scan_below_a_hook(spark, tmp_path, hooks):
    spark.range(10).selectExpr("id", "cast(id as string) sentence", "1 other").write.parquet(str(tmp_path / "s"))
    rows = spark.read.parquet(str(tmp_path / "s"))
    out = rows.withColumn("t", extractor_hook("t", hooks[0])(F.col("sentence"))).filter("id > 5").select("id", "t")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "other" not in plan.split("ReadSchema")[1]


def test_table_tags_equal_rule_tags(spark):
    text = ["The battery life is great but the screen is dim.", "Great camera and gorgeous display.", "", "one two three four five six",
            "screen and Screen and the screen protector"]
    rows = spark.createDataFrame(list(enumerate(text)), "sid int, sentence string")
    tags = spark.createDataFrame([("battery", "NN"), ("is", "VB")], "token string, tag string")
    expected = sorted((r["sid"], r["aspect"]) for r in noun_phrase_mentions(rows).collect())
    assert sorted((r["sid"], r["aspect"]) for r in mentions_by_table(rows, tags, ["sid"]).collect()) == expected


def test_streams(spark, sample_reviews, tmp_path):
    load_reviews(sample_reviews).write.parquet(str(tmp_path / "in"))
    stream = mention_stream(read_review_stream(spark, str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("mentions_out").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = run(load_reviews(sample_reviews)).mentions
    assert sorted(map(str, spark.table("mentions_out").collect())) == sorted(map(str, batch.collect()))

    trend = weekly_trend(mention_stream(read_review_stream(spark, str(tmp_path / "in"))), "0 days")
    query = trend.writeStream.format("memory").queryName("trend_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("trend_out").collect()
    assert rows and all(r["period"].weekday() == 0 for r in rows)
    assert sum(r["positive"] + r["neutral"] + r["negative"] for r in rows) == batch.count()


def test_partitioned_round_trip_keeps_types(spark, tmp_path):
    from facetry.plans.pipeline import load_result, run
    from facetry.sources.reviews import load_mentions

    texts = [("a7", "The lamp is nice but the cable is bad.", "007"), ("b9", "A good lamp.", "010")]
    frame = spark.createDataFrame(texts, "review_id string, text string, product string").selectExpr(
        "review_id", "text", "cast(null as double) rating", "cast(null as timestamp) date", "product"
    )
    result = run(frame)
    result.save(str(tmp_path), partition_by=["product"])
    for back in (load_result(spark, str(tmp_path)).mentions, load_mentions(spark, str(tmp_path))):
        assert back.dtypes == result.mentions.dtypes
        assert sorted(map(str, back.collect())) == sorted(map(str, result.mentions.collect()))


def test_limit_holds_for_each_data_set(spark):
    from facetry.operators.prepare import first_rows

    rows = spark.createDataFrame([("x", i) for i in range(5)] + [("y", i) for i in range(3)], "dataset string, id long")
    kept = first_rows(rows, ["id"], 2, per=["dataset"]).collect()
    assert sorted(map(tuple, kept)) == [("x", 0), ("x", 1), ("y", 0), ("y", 1)]


def test_dictionary_tables_replace_the_literals(spark):
    """Repeated ids, a repeated text and words that only the tables know."""
    reviews = spark.createDataFrame(
        [(7, "The zorp bleeps. A zorp glims."), (7, "The zorp bleeps. A zorp glims."), (8, "It bleeps."), (9, "Nothing.")],
        "review_id int, text string",
    )
    tags = [("zorp", "NN"), ("bleeps", "XX"), ("glims", "XX"), ("nothing", "XX"), ("the", "XX"), ("a", "XX"), ("it", "XX")]
    options = Options(
        valence_table=spark.createDataFrame([("bleeps", 3.0), ("glims", -3.0)], "token string, valence double"),
        tag_table=spark.createDataFrame(tags, "token string, tag string"),
        keyword_table=spark.createDataFrame([(1, "other", "zo"), (0, "gadget", "orp")], "priority int, theme string, keyword string"),
    )
    result = run(load_reviews(reviews), options)
    assert result.mentions.columns == MENTION_COLUMNS and result.reviews.count() == 4
    rows = sorted((r["review_id"], r["sentence_id"], r["aspect"], r["theme"], r["aspect_sentiment"]) for r in result.mentions.collect())
    one = [(7, 0, "zorp", "gadget", "positive"), (7, 1, "zorp", "gadget", "negative")]
    assert rows == sorted(one * 2)


def test_themes_by_table_do_not_move_texts_per_term(spark):
    """Every term's row was stored and joined with the sentence in it; now a sentence is one row until the end."""
    words = ["".join(chr(97 + (i // 26 ** k) % 26) for k in range(4)) for i in range(300)]
    rows = spark.createDataFrame([(1, "x", "of ".join(f"{w} " for w in words)), (2, "y", ""), (3, "z", "the")], "review_id int, product string, text string")
    table = spark.createDataFrame([(1, "other", "aa"), (0, "first", "baa")], "priority int, theme string, keyword string")
    reviews = load_reviews(rows)
    plain = run(reviews, Options(themes={"first": ["baa"], "other": ["aa"]})).mentions
    found = run(reviews, Options(keyword_table=table)).mentions
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count() > 200
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    last = [line for line in lines if "Generate" in line or "Join" in line][0]
    assert "Generate" in last


def test_values_of_lists(spark):
    """A token's every occurrence went to the tables and back; now a block's distinct ones do."""
    from facetry.operators.lists import lookup_lists

    rows = spark.createDataFrame(
        [(1, ["a", "b", None, "a"]), (1, ["a", "b", None, "a"]), (None, []), (3, None), (4, ["x", "c"])], "id int, words array<string>"
    ).withColumn("at", F.lit("2026-01-02 03:04:05").cast("timestamp"))
    tags = spark.createDataFrame([("a", "NN"), ("c", None), ("z", "VB")], "token string, value string")
    numbers = spark.createDataFrame([("b", 1.5), ("x", -0.1)], "token string, value double")
    found = lookup_lists(rows, {"tag": (F.col("words"), tags), "n": (F.reverse("words"), numbers)})
    assert found.dtypes == [*rows.dtypes, ("tag", "array<string>"), ("n", "array<double>")]
    got = sorted((r["id"] or 0, r["words"], r["tag"], r["n"]) for r in found.collect())
    one = (1, ["a", "b", None, "a"], ["NN", None, None, "NN"], [None, None, 1.5, None])
    assert got == [(0, [], [], []), one, one, (3, None, [], []), (4, ["x", "c"], [None, None], [None, -0.1])]
    assert {r["at"] for r in found.collect()} == {r["at"] for r in rows.collect()}


def test_stored_steps_give_the_same(spark):
    reviews = load_reviews(spark.createDataFrame(
        [(7, "The zorp bleeps. A zorp glims!"), (7, "The zorp bleeps. A zorp glims!"), (None, "It BLEEPS."), (9, "Nothing.")],
        "review_id int, text string"))
    tables = dict(
        valence_table=spark.createDataFrame([("bleeps", 3.0), ("glims", -3.0)], "token string, valence double"),
        tag_table=spark.createDataFrame([("zorp", "NN"), ("bleeps", "XX"), ("glims", "XX"), ("the", "XX")], "token string, tag string"),
        keyword_table=spark.createDataFrame([(0, "gadget", "orp")], "priority int, theme string, keyword string"),
    )
    plain = run(reviews, Options(lexicon=Lexicon(valence={"bleeps": 3.0, "glims": -3.0}), **{k: tables[k] for k in ("tag_table", "keyword_table")}))
    kept = run(reviews, Options(checkpoint=True, lexicon=Lexicon(valence={}), **tables))
    assert kept.mentions.count() > 3 and sorted(map(str, kept.mentions.collect())) == sorted(map(str, plain.mentions.collect()))
    assert sorted(map(str, kept.reviews.collect())) == sorted(map(str, plain.reviews.collect()))
    plan = kept.mentions._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "_pos" not in plan
