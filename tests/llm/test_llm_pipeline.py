"""The corpus pipeline, stage by stage, against plain Python on planted documents."""

import random
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from facetry.llm import packing, toxicity

TOXIC = ["vilest", "scumlike", "hatework", "filthing"]
SIZE = 400


def planted(rng):
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "du", "ke", "lo", "mi", "ru") for b in ("gan", "mer", "sil", "tov", "wex") for c in ("a", "ed", "ing", "os", "um")]
    clean = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(clean(20))) for i in range(6)]
    docs, kinds = [], {}

    def add(kind, words):
        kinds[len(docs)] = kind
        docs.append((len(docs), " ".join(words)))

    for _ in range(SIZE):
        add("clean", clean(rng.randint(30, 80)))
    for _ in range(80):
        words = clean(40)
        for at in rng.sample(range(40), 6):
            words[at] = rng.choice(TOXIC)
        add("toxic", words)
    for i in range(25):
        words = docs[i][1].split()
        add("copy", words[:-1] + ["changed"] if i % 2 else words)
    for i, text in items:
        add("leak", clean(25) + text.split() + clean(10))
    for i in range(8):
        add("private", [*clean(20), f"person{i}.x@mail{i}.example.org", *clean(15)])
    return docs, kinds, items


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output, stored between the stages."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    docs, kinds, items = planted(random.Random(12))
    frame = [(i, t, "en", "s", len(t)) for i, t in docs] + [(None, None, None, None, None), (900, "", "en", "s", 0)]
    spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(i, 1, int(kinds[i] == "toxic")) for i in kinds if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    path, tables = f"{folder}/documents.parquet", {}
    for name, stage in corpus_pipeline.STAGES:
        before = spark.read.parquet(path)
        stage(spark, before, folder).write.parquet(f"{folder}/{name}")
        path = f"{folder}/{name}"
        tables[name] = (before.collect(), spark.read.parquet(path).collect())
    return tables, kinds, items, folder


def ids(rows):
    return {r["doc_id"] for r in rows}


def test_toxic_documents_go(stages, spark):
    (before, after), kinds = stages[0]["toxicity"], stages[1]
    gone = ids(before) - ids(after)
    toxic = {i for i, k in kinds.items() if k == "toxic"}
    assert gone <= toxic and len(gone) >= 0.95 * len(toxic)
    # Also those whose label was not given.
    assert {i for i in gone if i % 3 == 0}
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_scores_of_held_out_documents(stages, spark):
    _, kinds, _, folder = stages
    rows = toxicity.score_toxicity(
        spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(held) > 50 and all((kinds.get(r["doc_id"]) == "toxic") == bool(r["predicted"]) for r in held)


def test_one_of_each_group_stays(stages):
    before, after = stages[0]["near_duplicates"]
    sets = {}
    for r in before:
        w = (r["text"] or "").lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for a, b in combinations(sorted(i for i in sets if i is not None), 2):
        if sets[a] & sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {i: low if g == high else g for i, g in group.items()}
    assert ids(after) == {i for i, g in group.items() if i == g}
    assert len(after) == len(before) - 25


def test_benchmark_passages_go(stages):
    (before, after), items = stages[0]["decontamination"], stages[2]
    tests = [t.split() for _, t in items]
    leaked = set()
    for r in before:
        w = (r["text"] or "").split()
        for at in range(len(w) - 12):
            window = np.array(w[at : at + 13])
            if any((window == np.array(t[j : j + 13])).mean() >= 0.8 for t in tests for j in range(len(t) - 12)):
                leaked.add(r["doc_id"])
    assert len(leaked) == 6 and ids(before) - ids(after) == leaked


def test_personal_data_goes(stages):
    (before, after), kinds = stages[0]["personal_data"], stages[1]
    assert ids(before) == ids(after) and len(before) == len(after)
    text = {r["doc_id"]: r["text"] for r in before}
    for r in after:
        if r["text"] is not None:
            assert r["text"] == re.sub(r"\S+@\S+", "[EMAIL]", text[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    assert sum("[EMAIL]" in (r["text"] or "") for r in after) == sum(k == "private" for k in kinds.values()) == 8


def test_all_tokens_are_packed(stages):
    before, after = stages[0]["packing"]
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    sizes = {r["doc_id"]: len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before}
    assert {r["doc_id"]: r["length"] for r in after} == sizes
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= packing.CAPACITY
    assert len(bins) == -(-sum(sizes.values()) // packing.CAPACITY)
