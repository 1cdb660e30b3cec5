"""Tags in context against a plain search over all paths."""

import math
import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from facetry.operators import context_tags

CORPUS = "key string, pos int, token string, tag string"


def corpus(rng, n):
    """After "the" a word is a noun, after "to" a verb; half of the words are seen as both."""
    rows = []
    for i in range(n):
        pos = 0
        for _ in range(rng.randint(1, 4)):
            lead, tag = rng.choice([("the", "NN"), ("to", "VB")])
            for token, kind in ((lead, "DT" if tag == "NN" else "TO"), (rng.choice(["run", "walk", "plan", "cut"]), tag)):
                rows.append((f"s{i}", pos, token, kind))
                pos += 1
    return rows


def best_path(rows, tokens):
    """Every path, by counts with one added."""
    sentences = defaultdict(list)
    for key, pos, token, tag in rows:
        sentences[key].append((pos, token, tag))
    steps, emits, totals, before = Counter(), Counter(), Counter(), Counter()
    for words in sentences.values():
        last = ""
        for _, token, tag in sorted(words):
            steps[last, tag] += 1
            before[last] += 1
            emits[token, tag] += 1
            totals[tag] += 1
            last = tag
    tags = sorted(totals)

    def value(path):
        out, last = 0.0, ""
        for token, tag in zip(tokens, path):
            out += math.log((steps[last, tag] + 1) / (before[last] + len(tags)))
            out += math.log((emits[token, tag] + 1) / (totals[tag] + 1))
            last = tag
        return out

    return max(product(tags, repeat=len(tokens)), key=value), value


@pytest.fixture(scope="module")
def taught(spark):
    rows = corpus(random.Random(3), 60)
    frame = spark.createDataFrame(rows + [("s0", 99, None, "NN"), ("s0", 98, "run", None)], CORPUS)
    return rows, context_tags.count_tags(frame, ["key"])


def test_paths_are_best(spark, taught):
    rows, model = taught
    rng = random.Random(5)
    texts = [(i, [rng.choice(["the", "to", "run", "walk", "plan", "new"]) for _ in range(rng.randint(1, 6))]) for i in range(60)]
    frame = spark.createDataFrame(texts + [(100, []), (101, None)], "_key int, _tokens array<string>")
    found = {r["_key"]: tuple(r["tags"]) for r in context_tags.tag_sentences(frame, model).collect()}
    assert set(found) == {i for i, _ in texts}
    for i, tokens in texts:
        best, value = best_path(rows, tokens)
        assert value(found[i]) == pytest.approx(value(best), abs=1e-9)


def test_same_word_different_tag(spark, taught):
    frame = spark.createDataFrame([(1, ["the", "run", "to", "run"])], "_key int, _tokens array<string>")
    tagged = frame.join(context_tags.tag_sentences(frame, taught[1]), "_key")
    assert tagged.first()["tags"] == ["DT", "NN", "TO", "VB"]
    terms = tagged.select(context_tags.tagged_terms(F.col("_tokens"), F.col("tags")).alias("t")).first()["t"]
    assert terms == ["run"]


def test_runs_of_nouns(spark):
    row = spark.createDataFrame([(["Fine", "Battery", "Life", "is", "ab", "Battery", "life"], ["JJ", "NN", "NNS", "VB", "NN", "NN", "NN"])],
                                "w array<string>, t array<string>")
    assert row.select(context_tags.tagged_terms(F.col("w"), F.col("t")).alias("x")).first()["x"] == ["battery life", "ab battery life"]


def test_too_many_tags(spark):
    rows = [("s", i, "x", f"t{i}") for i in range(context_tags.MOST_TAGS + 1)]
    with pytest.raises(ValueError, match="at most"):
        context_tags.count_tags(spark.createDataFrame(rows, CORPUS), ["key"])


def test_sentences_of_one_key_are_one(spark, taught):
    """Rows that share a key are merged by places; with `keep` every row comes back beside its key's tags."""
    rows = [(1, ["the", "to"]), (1, ["run", "walk"]), (2, ["the", "plan"]), (3, []), (None, ["to"])]
    frame = spark.createDataFrame(rows, "_key int, _tokens array<string>").withColumn("n", F.size("_tokens"))
    found = {r["_key"]: len(r["tags"]) for r in context_tags.tag_sentences(frame, taught[1]).collect()}
    assert found == {1: 4, 2: 2, None: 1}
    kept = context_tags.tag_sentences(frame, taught[1], keep=["n"]).collect()
    assert sorted((r["_key"] or 0, r["n"], len(r["tags"])) for r in kept) == [(0, 1, 1), (1, 2, 4), (1, 2, 4), (2, 2, 2)]


def test_counts_from_rows_of_sentences(spark, taught):
    rows, model = taught
    frame = spark.createDataFrame(rows + [("s0", 99, None, "NN"), ("s0", 98, "run", None)], CORPUS).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("pos", "token", "tag"))).alias("words"))
    found = context_tags.count_tags(frame, ["key"], words="words")
    assert (found.tags, found.steps, found.unknown) == (model.tags, model.steps, model.unknown)
    assert sorted(found.emissions.collect()) == sorted(model.emissions.collect())


def test_no_token_is_moved_for_its_tag(spark, tmp_path):
    """What is sent is documents, counts and the distinct tokens of blocks, not a row per token."""
    from pyspark.sql import Row

    from facetry.plans import queries as Q

    text = "Alphabetical beta gamma delta. " * 40
    spark.createDataFrame([Row(doc_id=i, text=text, lang="en", source="a", n_chars=9) for i in range(40)]).write.parquet(
        str(tmp_path / "documents.parquet"))
    found = Q.context_mentions(spark, str(tmp_path))
    assert found.count() == 20 * 40
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("hashpartitioning(key") == 0
    assert "FlatMapCoGroupsInArrow" in plan
    assert sum(r["n"] for r in Q.context_tags(spark, str(tmp_path)).collect()) == 20 * 40 * 5
