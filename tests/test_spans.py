import random

import pytest
from pyspark.sql import functions as F

from facetry.functions.spans import bio_labels, decode_terms, token_offsets
from facetry.operators.spans import CELL, RANGE, filed_places, first_overlaps

KINDS = "tokens array<struct<start:int,end:int,special:int>>, spans array<struct<start:int,end:int>>"

TEXT = "Loose hinge pin on day two"
OFFSETS = [(0, 0, 1), (0, 5, 0), (6, 11, 0), (12, 15, 0), (16, 18, 0), (19, 22, 0), (23, 26, 0)]
TOKENS = "array<struct<start:int,end:int,special:int>>"
SPANS = "array<struct<start:int,end:int>>"


@pytest.mark.parametrize("spans,expected", [
    ([(6, 15)], [-100, 0, 1, 2, 0, 0, 0]),
    ([(0, 5), (6, 15), (19, 26)], [-100, 1, 1, 2, 0, 1, 2]),
    ([(14, 20)], [-100, 0, 0, 1, 2, 2, 0]),
    ([(5, 6), (26, 40)], [-100, 0, 0, 0, 0, 0, 0]),
    ([], [-100] + [0] * 6),
    (None, [-100] + [0] * 6),
])
def test_labels(one, spans, expected):
    assert one(bio_labels, OFFSETS, spans, schema=[TOKENS, SPANS]) == expected


@pytest.mark.parametrize("text,offsets,labels,expected", [
    (TEXT, OFFSETS, [-100, 0, 1, 2, 0, 0, 0], ["hinge pin"]),
    (TEXT, OFFSETS, [-100, 1, 1, 2, 0, 0, 1], ["loose", "hinge pin", "two"]),
    (TEXT, OFFSETS, [-100, 0, 0, 2, 2, 0, 0], ["pin on"]),
    ("Pin pin cap", [(0, 3, 0), (4, 7, 0), (8, 11, 0)], [1, 1, 0], ["pin"]),
    (TEXT, OFFSETS, [1, 0, 0, 0, 0, 0, 2], ["two"]),
    (TEXT, OFFSETS, [-100, 1, -100, 2, 2, 0, 0], ["loose", "pin on"]),
])
def test_decode(one, text, offsets, labels, expected):
    assert one(decode_terms, text, offsets, labels, schema=["string", TOKENS, "array<int>"]) == expected


@pytest.mark.parametrize("text", ["hinge   pin", " a b ", "", None, "é 😀x yz"])
def test_offsets(one, text):
    got = one(token_offsets, text)
    assert [(text or "")[t["start"]:t["end"]] for t in got] == (text or "").split()


def test_row_form_equals_brute_force(spark):
    rng = random.Random(5)
    tokens, spans, expected = [], [], {}
    for sid in ("hot", "b", "c"):
        at, n = 0, 400 if sid == "hot" else 30
        toks = []
        for pos in range(n):
            width = rng.choice([0, 1, 3, 9, 70])
            toks.append((sid, pos, at, at + width))
            at += width + rng.choice([0, 1, 5])
        gold = []
        for idx in range(n // 8):
            start = rng.randrange(at)
            gold.append((sid, idx, start, start + rng.choice([1, 10, 200])))
        for _, pos, s, e in toks:
            hits = [i for _, i, a, b in gold if s < b and e > a and s < e]
            expected[(sid, pos)] = min(hits, default=None)
        tokens += toks
        spans += gold
    kinds = "sid string, {} int, start int, end int"
    out = first_overlaps(
        spark.createDataFrame(tokens, kinds.format("pos")), spark.createDataFrame(spans, kinds.format("idx")), ["sid"], cell=16, wide=64
    )
    assert {(r["sid"], r["pos"]): r["span_idx"] for r in out.collect()} == expected


def expected_labels(tokens, spans):
    owners = [
        None if special or s == e else next((i for i, (a, b) in enumerate(spans) if s < b and e > a), -1)
        for s, e, special in tokens
    ]
    return [
        -100 if o is None else 0 if o < 0 else 2 if i and owners[i - 1] == o else 1 for i, o in enumerate(owners)
    ]


def test_labels_equal_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for n in (0, 1, 2, 7, 40, 150):
        at, tokens = 0, []
        for _ in range(n):
            width = rng.choice([0, 1, 4, 9])
            tokens.append((at, at + width, int(rng.random() < 0.1)))
            at += width + rng.choice([0, 1, 3])
        starts = [rng.randrange(at + 1) for _ in range(n // 2)]
        spans = [(a, a + rng.choice([0, 1, 6, 60])) for a in starts]
        rng.shuffle(tokens) if n == 40 else None
        rows.append((tokens, spans))
    frame = spark.createDataFrame(rows, KINDS)
    got = frame.select(bio_labels(frame["tokens"], frame["spans"]).alias("l")).collect()
    assert [r["l"] for r in got] == [expected_labels(t, s) for t, s in rows]


def test_no_tokens_no_labels(one):
    assert one(bio_labels, None, [(0, 1)], schema=[TOKENS, SPANS]) is None


def test_a_span_over_a_long_text_costs_one_entry_per_range(spark):
    n = 200_000
    tokens = spark.range(n // 10).select(
        F.lit("t").alias("sid"), F.col("id").cast("int").alias("pos"),
        (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 9).cast("int").alias("end"))
    spans = spark.createDataFrame(
        [("t", 7, 0, n), ("t", 3, 15, 150_003), ("t", 5, 4_096, 8_192), ("t", 1, 199_998, n + 50), ("t", 0, 40, 40), ("u", 0, 0, n)],
        "sid string, idx int, start int, end int")
    got = {r["pos"]: r["span_idx"] for r in first_overlaps(tokens, spans, ["sid"]).collect()}

    def owner(pos):
        a, b = pos * 10, pos * 10 + 9
        return min(i for i, s, e in [(7, 0, n), (3, 15, 150_003), (5, 4_096, 8_192), (1, 199_998, n + 50)] if a < e and b > s)

    assert got == {pos: owner(pos) for pos in range(n // 10)}
    # Whole ranges and less than one range of cells at each end.
    assert filed_places(spans.filter("sid = 't' and idx = 7"), ["sid"]).count() <= n // RANGE + RANGE // CELL


def test_no_spans_and_no_tokens(spark):
    kinds = "sid string, {} int, start int, end int"
    tokens = spark.createDataFrame([("a", 0, 0, 4), ("a", 1, 4, 4), (None, 2, None, 3)], kinds.format("pos"))
    none = spark.createDataFrame([], kinds.format("idx"))
    assert sorted((r["pos"], r["span_idx"]) for r in first_overlaps(tokens, none, ["sid"]).collect()) == [(0, None), (1, None), (2, None)]
    assert first_overlaps(tokens.limit(0), none, ["sid"]).count() == 0


def test_tokens_are_moved_once(spark):
    """Every token was moved again after the join; now only one that reaches over several ranges is, and still has one row."""
    tokens = spark.createDataFrame(
        [("a", 0, 0, 5), ("a", 0, 0, 5), ("a", 1, 60, 70), ("a", 2, 100, 300), (None, 3, 0, 5), (None, 3, 0, 5), ("a", 4, 7, 7), ("a", 5, None, 9), ("b", 0, 0, 5)],
        "sid string, pos int, start int, end int")
    spans = spark.createDataFrame([("a", 3, 2, 4), ("a", 1, 250, 260), ("a", 2, 110, 111), ("a", 5, 65, 66), (None, 0, 0, 9)], "sid string, idx int, start int, end int")
    found = first_overlaps(tokens, spans, ["sid"], cell=8, wide=64)
    got = sorted(found.collect(), key=lambda r: (r["sid"] or "", r["pos"]))
    assert [(r["sid"], r["pos"], r["span_idx"]) for r in got] == [
        (None, 3, None), ("a", 0, 3), ("a", 1, 5), ("a", 2, 1), ("a", 4, None), ("a", 5, None), ("b", 0, None)]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(sid") and found.schema["span_idx"].dataType == spans.schema["idx"].dataType
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "pos#" in line.split("hashpartitioning(")[1]]
    assert len(moved) <= 1
