"""Steps whose work must grow with the length of a text and no faster."""

import random
import string

import pyspark.sql.functions as F

from facetry.functions.text import words
from facetry.operators.boundaries import period_counts
from facetry.operators.phrases import join_phrases
from facetry.plans import queries


def plain_words(text):
    found = [w for w in text.replace("\t", " ").replace(" ", " ").split(" ") if w]
    return [w.strip(string.punctuation) if len(w.strip(string.punctuation)) > 2 else w for w in found]


def test_words_without_a_step_per_word(spark):
    rng = random.Random(3)
    signs = [*"ab", "é", "😀", " ", " ", "\t", " ", *string.punctuation]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    texts += ["x" * 50_000 + "!" * 50_000, "!" * 50_000, "(" + "a-" * 40_000 + ")", "(ab)", "(abc)", "^abc]", r"\abc-"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = frame.select("t", words(F.col("t")).alias("w"))
    assert "btrim" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    for r in rows.collect():
        assert r["w"] == plain_words(r["t"]), r["t"]


def test_phrase_candidates_do_not_carry_their_text(spark):
    texts = spark.createDataFrame([(1, "A long, (long) way"), (2, None), (3, "way long")], "k int, text string")
    known = spark.createDataFrame([("long long", 1.0), ("long way", 2.0), ("a long long way", 1.0)], "phrase string, valence double")
    joined = join_phrases(texts, known, ["k"])
    assert {r["k"]: r["text"] for r in joined.collect()} == {1: "A long, (long) way", 2: None, 3: "way long"}
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate posexplode" in line or "Generate inline" in line]
    assert generators and not any("_w#" in line for line in generators)


def test_periods_are_counted_by_distinct_word(spark):
    texts = spark.createDataFrame([("etc. (etc.) etc Etc. 12. a.b",), (None,)], "text string")
    counts = period_counts(texts)
    assert {tuple(r) for r in counts.collect()} == {("etc", 3, 1), ("a.b", 0, 1)}
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [word") == 1


def test_gold_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "XML_ROWS", 4, raising=False)
    rows = spark.createDataFrame([(str(i), "text") for i in range(10)], "_id string, text string").coalesce(1)
    queries.write_gold(rows, str(tmp_path / "gold"))
    assert len(list((tmp_path / "gold").glob("part-*"))) == 3
