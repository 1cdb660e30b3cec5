"""Trained tagger, saved models, learnt sentence ends, exact folds, nested merge."""

import json
import math
import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetry.functions.spans import token_offsets
from facetry.operators import boundaries, nested, tagger, training
from facetry.plans import evaluate, pipeline
from facetry.sources import models


# -- tagger -----------------------------------------------------------------

def test_best_path_is_best():
    rng, bits = np.random.default_rng(4), 4
    for _ in range(60):
        weights = tagger.empty_weights(bits)
        weights[:] = rng.integers(-4, 5, len(weights))
        sizes = rng.integers(0, 5, 5)
        features = rng.integers(0, 1 << bits, (sizes.sum(), tagger.WIDTH))
        found, at = tagger.best_paths(weights, features, sizes), 0
        for n in sizes.tolist():
            value = lambda p: weights[tagger.path_slots(features[at:at + n], np.array([n]), np.array(p, int))].sum()  # noqa: E731, B023
            if n:
                assert value(found[at:at + n]) == max(map(value, product(range(3), repeat=n)))
            at += n


def test_no_tokens_no_labels():
    none = np.zeros((0, tagger.WIDTH), np.int64)
    assert len(tagger.best_paths(tagger.empty_weights(3), none, np.zeros(3, np.int64))) == 0


@pytest.fixture(scope="module")
def taught(spark):
    """Terms are the word after "the" and a following word in capitals."""
    rng = random.Random(6)
    rows = []
    for i in range(300):
        words, labels = [], []
        while len(words) < 8:
            if rng.random() < 0.4:
                words += ["the", f"thing{rng.randint(0, 400)}"]
                labels += [0, 1]
                if rng.random() < 0.5:
                    words.append(rng.choice(["XL", "MK"]) + str(rng.randint(0, 9)))
                    labels.append(2)
            else:
                words.append(f"word{rng.randint(0, 400)}")
                labels.append(0)
        rows.append((i, " ".join(words), labels, "dev" if i % 5 == 0 else "train", None))
    rows += [(900, "", [], "train", "x"), (901, None, [], "train", "x"), (902, "the it", [-100, 1], "train", "x")]
    frame = spark.createDataFrame(rows, "sentence_id int, text string, labels array<int>, fold string, features string")
    return frame, tagger.fit_tagger(frame, ["sentence_id"], shards=3)


def test_features_are_kept_packed(spark, taught):
    """Shards held ten numbers a token as they are; they are the same after packing, in little more than the text's size."""
    texts = [t for t, in taught[0].select("text").collect()] + ["A a\u0130 B", "one"]
    rows = spark.createDataFrame([(t, [0] * len((t or "").split())) for t in texts], "text string, labels array<int>").coalesce(1)
    featured = rows.select(tagger.token_features(F.col("text"), 12).alias("features"), "labels")
    plain = featured.toArrow().to_batches()
    found = list(tagger._packed(tagger._pack(plain)))
    for batch, (features, sizes, labels) in zip(plain, found, strict=True):
        expected = tagger.unpacked(batch.column(0))
        assert np.array_equal(features, expected[0]) and np.array_equal(sizes, expected[1]) and len(labels) == len(features)
    stored = sum(b.nbytes for b in tagger._pack(plain))
    assert stored < 0.2 * sum(b.nbytes for b in plain)
    assert not list(tagger._packed(tagger._pack(featured.limit(0).toArrow().to_batches())))


def test_tagger_learns(spark, taught):
    frame, model = taught
    dev = model.add_labels(frame.filter("fold = 'dev'")).collect()
    assert sum(r["pred_labels"] == r["labels"] for r in dev) >= 0.95 * len(dev) and len(dev) == 60
    found = model.add_terms(spark.createDataFrame([("word1 the thing5 XL7 word2",), ("",), (None,)], "text string"))
    assert [r["pred_terms"] for r in found.collect()][:2] == [["thing5 xl7"], []]


def test_tagger_repeats(taught):
    frame, model = taught
    again = tagger.fit_tagger(frame.repartition(5), ["sentence_id"], shards=3)
    assert np.allclose(again.weights, model.weights, atol=1e-12)


def test_tagger_without_examples(spark, taught):
    frame, _ = taught
    model = tagger.fit_tagger(frame.limit(0), ["sentence_id"], epochs=1, shards=2)
    assert not model.weights.any()
    assert model.add_labels(spark.createDataFrame([("a b",)], "text string")).first()["pred_labels"] == [0, 0]


def test_token_words_follow_offsets(spark):
    texts = ["one  two", " a\tb c　d ", "", "é ß  x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", token_offsets(F.col("t")).alias("o"), tagger.token_words(F.col("t")).alias("w")).collect()
    for r in rows:
        assert [r["t"][o["start"]:o["end"]] for o in r["o"]] == r["w"]


def test_pipeline_takes_a_tagger(spark, taught):
    reviews = spark.createDataFrame([(1, "The thing1 works. I like the thing9 XL2 here.")], "review_id long, text string")
    full = reviews.selectExpr("review_id", "text", "1.0d rating", "timestamp'2026-01-01' date", "'p' product")
    rows = pipeline.run(full, pipeline.Options(tagger=taught[1])).mentions.collect()
    assert ("thing9 xl2", 1) in {(r["aspect"], r["sentence_id"]) for r in rows}


# -- saved models -----------------------------------------------------------

SCORES = "dataset string, metric string, value double"


def test_saved_tagger(spark, taught, tmp_path):
    frame, model = taught
    store, scores = str(tmp_path), spark.createDataFrame([("all", "f1", 0.9)], SCORES)
    assert models.available(spark, store, models.EXTRACTION, ["rules"]) == ["rules"]
    assert models.save_tagger(model, spark, store, "tagger", scores) == 1
    assert models.save_tagger(tagger.Tagger(model.weights * 2), spark, store, "tagger", scores.limit(0)) == 2
    assert np.array_equal(models.load_tagger(spark, store, "tagger", 1).weights, model.weights)
    assert np.array_equal(models.load_tagger(spark, store, "tagger").weights, model.weights * 2)
    assert models.available(spark, store, models.EXTRACTION, ["rules"]) == ["rules", "tagger"]
    assert models.available(spark, store, models.SENTIMENT, ["rules"]) == ["rules"]
    assert models.available(spark, store, models.EXTRACTION, ["rules"], ["tagger"]) == ["tagger"]
    with pytest.raises(ValueError, match="other"):
        models.available(spark, store, models.EXTRACTION, ["rules"], ["tagger", "other"])
    with pytest.raises(ValueError):
        models.load_tagger(spark, store, "tagger", 7)
    # A save that fails while writing leaves nothing to find.
    with pytest.raises(ZeroDivisionError):
        models._save(spark, store, models.EXTRACTION, "broken", scores, lambda path: 1 / 0)
    assert models.available(spark, store, models.EXTRACTION, []) == ["tagger"]
    assert {(r["name"], r["version"], r["value"]) for r in models.registry(spark, store).collect()} == {
        ("tagger", 1, 0.9), ("tagger", 1, None), ("tagger", 2, None)}


def test_matrix_of_stored_models(spark, taught, tmp_path):
    frame, model = taught
    store = str(tmp_path)
    terms = "array<struct<term:string,polarity:string,start:int,end:int>>"
    gold = spark.createDataFrame(
        [("d", str(i), f"the thing{i} is {w}", [(f"thing{i}", p, 4, 4 + len(f"thing{i}"))]) for i, (w, p) in enumerate(
            [("fine", "positive"), ("poor", "negative")] * 20)],
        f"dataset string, sentence_id string, text string, terms {terms}")
    pairs = training.nested_pair_examples(gold).withColumn("fold", F.lit("train"))
    classifier = training.fit_polarity(pairs, features=1 << 10, max_iter=5)
    models.save_tagger(model, spark, store, "tagger", spark.createDataFrame([], SCORES))
    models.save_classifier(classifier, spark, store, "linear", spark.createDataFrame([], SCORES))
    found = {(r["task"], r["model"], r["metric"]): r["value"] for r in evaluate.stored_matrix(gold, store).collect()}
    assert found["extraction", "tagger", "f1"] == 1.0 and found["sentiment", "linear", "accuracy"] == 1.0
    assert {m for _, m, _ in found} == {"baseline", "tagger", "linear"}
    bare = {r["model"] for r in evaluate.stored_matrix(gold, store + "/none").collect()}
    assert bare == {"baseline"}
    with pytest.raises(ValueError, match="absent"):
        evaluate.stored_matrix(gold, store, extractors=["absent"])
    reloaded = models.load_classifier(spark, store, "linear")
    read = lambda m: [(r["sentence_id"], r["y_pred"]) for r in training.predict_polarity(m, pairs).orderBy("sentence_id").collect()]
    assert read(reloaded) == read(classifier)


# -- sentence ends ----------------------------------------------------------

def abbreviated_texts(rng, n):
    """Sentences of which some hold one of three abbreviations before a name."""
    out, truth = [], []
    for _ in range(n):
        sentences = []
        for _ in range(rng.randint(1, 5)):
            words = [f"w{'abcdefghij'[rng.randint(0, 9)]}{'klmnopq'[rng.randint(0, 6)]}o" for _ in range(rng.randint(3, 7))]
            if rng.random() < 0.5:
                words.insert(rng.randint(1, len(words) - 1), rng.choice(["Abt.", "no.", "z.b."]) + " Kern")
            sentences.append(" ".join(words) + rng.choice([".", "!", "?"]))
        out.append("  ".join(sentences))
        truth.append(sentences)
    return out, truth


def test_learnt_sentence_ends(spark):
    train, _ = abbreviated_texts(random.Random(1), 300)
    held, truth = abbreviated_texts(random.Random(2), 80)
    table = boundaries.learn_abbreviations(spark.createDataFrame([(t,) for t in [*train, None, ""]], "text string"))
    learnt = {r["type"] for r in table.collect()}
    assert {"abt", "z.b"} <= learnt and all(len(t) <= 3 for t in learnt)
    rows = [(i, t, "x") for i, t in enumerate(held)] + [(500, held[0], "x"), (501, None, "x"), (502, "  ", "x"), (500, "One. Two.", "y")]
    frame = spark.createDataFrame(rows, "review_id int, text string, type string")
    found = {}
    for r in pipeline.learned_sentences(frame, table).collect():
        found.setdefault((r["review_id"], r["type"]), {})[r["sentence_id"]] = r["sentence"]
    right = sum([found[i, "x"][k] for k in sorted(found[i, "x"])] == t for i, t in enumerate(truth))
    assert right >= 0.95 * len(truth)
    assert found[500, "y"] == {0: "One.", 1: "Two."} and found[500, "x"] == found[0, "x"]
    assert not {k for k in found if k[0] in (501, 502)}


def test_scores_follow_the_formula(spark):
    texts = ["Mr. Abc went. Mr. Def ran", "abc. (Mr.) x.y. x.y. abc ... end", None]
    got = {r["type"]: r["score"] for r in boundaries.abbreviation_scores(
        boundaries.period_counts(spark.createDataFrame([(t,) for t in texts], "text string"))).collect()}
    dots, rest = Counter(), Counter()
    for w in " ".join(t or "" for t in texts).split():
        kind = re.sub(r"^[^a-z0-9]+|[^a-z0-9]+$", "", w.lower())
        if re.search("[a-z]", kind):
            (dots if re.search(r"[a-z0-9]\.[\"')\]]*$", w.lower()) else rest)[kind] += 1
    p = sum(dots.values()) / (sum(dots.values()) + sum(rest.values()))
    for kind in dots:
        d, r, inner = dots[kind], rest[kind], kind.count(".")
        like = lambda q: d * math.log(q) + r * math.log(1 - q)  # noqa: E731, B023
        size = len(kind) - inner
        assert got[kind] == pytest.approx(2 * (like(0.99) - like(p)) * math.exp(-size) * (inner + 1) * size ** -r)
    assert set(got) == set(dots)


# -- folds and nested documents ---------------------------------------------

@pytest.mark.parametrize("n", [1, 9, 10, 25, 400])
def test_exact_fold(spark, n):
    rows = [(i, g) for g in ("a", None) for i in range(n)] + [(7, "same")] * 30
    out = training.exact_fold(spark.createDataFrame(rows, "id int, g string"), ["id"], ["g"]).collect()
    assert sorted(map(str, ((r["id"], r["g"]) for r in out))) == sorted(map(str, rows))
    dev = Counter(r["g"] for r in out if r["fold"] == "dev")
    assert dev == {"a": max(1, n // 10), None: max(1, n // 10), "same": 3}
    whole = training.exact_fold(spark.createDataFrame(rows, "id int, g string"), ["id", "g"])
    assert whole.filter("fold = 'dev'").count() == max(1, len(rows) // 10)


def test_exact_fold_of_nothing(spark):
    assert training.exact_fold(spark.createDataFrame([], "id int"), ["id"]).collect() == []


def merged(a, b):
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return b
    return a | {k: merged(a[k], v) if k in a else v for k, v in b.items()}


def test_deep_merge(spark):
    rng = random.Random(9)

    def value(depth):
        if depth and rng.random() < 0.75:
            return {rng.choice(["a", 'b"c', "ü.x", ""]): value(depth - 1) for _ in range(rng.randint(0, 3))}
        return rng.choice([1, 2.5, "x", None, True, [1, {"z": {}}], {}])

    old, new = {i: value(4) for i in range(40)}, {i: value(4) for i in range(20, 60)}
    frame = lambda d: spark.createDataFrame([(k, json.dumps(v)) for k, v in d.items()], "id int, j string").selectExpr(
        "id", "parse_json(j) document")
    got = {r[0]: json.loads(r[1]) for r in nested.deep_merge(frame(old), frame(new)).selectExpr("id", "to_json(document)").collect()}
    assert got == {k: merged(old[k], new[k]) if k in old and k in new else old.get(k, new.get(k)) for k in {*old, *new}}
    assert nested.deep_merge(frame({}), frame({})).collect() == []


def test_learnt_ends_move_a_text_once(spark, tmp_path):
    """Texts were moved to the answers and back, and the answers once per salt."""
    texts = [f"Dr. Kern {i} said no. etc. was new.  \x01 Fine (a.m.) it is." for i in range(20)] + [None, " ", "Ends in Dr."]
    spark.createDataFrame(list(enumerate(texts)), "id int, text string").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    table = spark.createDataFrame([("dr",), ("etc",)], "type string")
    found = boundaries.sentences_by_table(rows, table)
    assert {r["id"]: r["_sentences"] for r in found.collect()} == {
        **{i: [f"Dr. Kern {i} said no.", "etc. was new.", "Fine (a.m.)", "it is."] for i in range(20)}, 20: None, 21: [], 22: ["Ends in Dr."],
    }
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in plan and "hashpartitioning(_key" not in plan
    assert len([line for line in plan.splitlines() if "Exchange hashpartitioning(_deal" in line and "Reused" not in line]) == 1
