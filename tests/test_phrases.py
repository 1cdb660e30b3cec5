"""Phrases of a lexicon against a plain walk over the words."""

import random
import string

import pytest
from pyspark.errors import PySparkException

from facetry.functions.polarity import Lexicon
from facetry.operators import phrases
from facetry.operators.sentiment import compound_by_table

ENTRIES = [("worth every penny", 3.0), ("every penny counts twice", 1.0), ("every penny", -1.0), ("Not  Bad", 1.5), ("not bad", 1.2),
           ("single", 4.0), ("top notch", 2.5), (None, 1.0), ("x y", None)]


def walk(text):
    words, known = (text or "").split(), {" ".join(p.lower().split()) for p, v in ENTRIES if p and v is not None and len(p.split()) > 1}
    out, at = [], 0
    while at < len(words):
        for n in range(8, 1, -1):
            spelt = " ".join(words[at : at + n]).lower().strip(string.punctuation)
            if at + n <= len(words) and spelt in known and len(spelt.split()) == n:
                break
        else:
            n = 1
        out.append("_".join(words[at : at + n]))
        at += n
    return " ".join(out)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ENTRIES, "phrase string, valence double")


def test_phrases_equal_a_walk(spark, table):
    rng = random.Random(4)
    words = ["worth", "every", "Penny", "penny,", "counts", "twice!", "not", "bad.", "top", "(top", "notch)", "single", "a"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(300)] + ["every penny " * 50, None, ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["text"] for r in phrases.join_phrases(frame, table, ["id"]).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert " ".join((got[i] or "").split()) == walk(t)


def test_a_phrase_has_one_value(spark, table):
    lexicon = Lexicon(valence={}, boosters={"very": 0.293}, negations=["not"], contrasts=["but"])
    valence = spark.createDataFrame([("bad", -2.5), ("every", 9.0)], "token string, valence double")
    texts = ["this is not bad", "very top notch stuff!", "it was worth every penny but bad", "plain"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["compound"] for r in phrases.compound_with_phrases(frame, valence, table, ["id"], lexicon=lexicon).collect()}
    spelt = spark.createDataFrame([("notbad", 1.5), ("topnotch", 2.5), ("worthit", 3.0), ("bad", -2.5)], "token string, valence double")
    same = ["this is notbad", "very topnotch stuff!", "it was worthit but bad", "plain"]
    plain = compound_by_table(spark.createDataFrame(list(enumerate(same)), "id int, text string"), spelt, ["id"], lexicon=lexicon)
    assert got == {r["id"]: r["compound"] for r in plain.collect()} and got[0] > 0


def test_entries(spark, table):
    assert {(r["phrase"], r["valence"]) for r in phrases.entries(table).collect()} == {
        ("worth every penny", 3.0), ("every penny counts twice", 1.0), ("every penny", -1.0), ("not bad", 1.5), ("top notch", 2.5)}
    with pytest.raises(PySparkException, match="too long"):
        phrases.entries(table, most_words=3).collect()
    frame = spark.createDataFrame([(1, "worth every penny")], "id int, text string")
    assert phrases.join_phrases(frame, table.limit(0), ["id"]).first()["text"] == "worth every penny"
