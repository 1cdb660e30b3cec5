"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from facetry.llm import (
    decontaminate, disclosure, exchange, language, packing, revisits, run_index, suffix_trees, token_groups, topk, toxicity,
)

from facetry.llm.kernels import scan

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, batch int, grp string, row long, "
    "score double, tokens string, _terms string, toxic int, label long, embedding string"
)
TEXT = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen, call +1 415 555 0100 now."


def rows():
    texts = [(1, TEXT), (2, TEXT), (2, TEXT), (None, TEXT), (3, None), (4, ""), (5, " \n\t "), (6, "x"),
             (7, "word " * 30_000), (8, "z" * 200_000), (9, "é́   İ ß @ + 1.2.3.4 a@b.c"), (None, None)]
    return [(d, t, "en" if d != 6 else None, None, None, 1, "g", 2, 0.5, "t", "u", None, 7, "e") for d, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 0), (2, 0), (2, 0), (3, 1), (4, None), (None, 1), (99, 0), (6, 0), (7, 0), (8, 0), (9, 0)], "doc_id long, toxic int"
    )


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu"), (2, None), (None, "a b c d e"),
         (3, ""), (3, "")], "item_id long, text string",
    )


PER_ROW = {
    "suffix_trees": lambda d, l, i: suffix_trees.remove_repeats(d),
    "toxicity": lambda d, l, i: toxicity.score_toxicity(d, l),
    "disclosure": lambda d, l, i: disclosure.find_personal_data(d),
    "language": lambda d, l, i: language.identify_language(d),
    "run_index": lambda d, l, i: run_index.remove_repeated_bytes(d),
    "token_groups": lambda d, l, i: token_groups.link_documents(d),
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_per_document(name, odd, labels, items):
    out = PER_ROW[name](odd, labels, items).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in out), key=key) == sorted((r[0] for r in rows()), key=key)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_tables(name, none, labels, items):
    assert PER_ROW[name](none, labels.limit(0), items.limit(0)).collect() == []


def test_values_of_odd_rows(odd, labels):
    removed = {(r["doc_id"], r["n_removed"]) for r in suffix_trees.remove_repeats(odd).collect()}
    # Copies of document 1 go, those with equal ids alike; nothing repeats document 7 but itself.
    assert {(1, 0), (2, 20), (None, 20), (7, 0), (3, 0)} <= removed
    links = {(r["doc_id"], r["component_id"], r["n_links"]) for r in token_groups.link_documents(odd).collect()}
    assert {(1, 1, 3), (2, 1, 3), (None, 1, 3), (3, 3, 0), (4, 4, 0), (None, None, 0)} <= links
    spoken = {r["doc_id"]: r["lang_pred"] for r in language.identify_language(odd).collect()}
    assert spoken[3] == spoken[4] == spoken[5] == "und"


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(name, stage, spark, odd, none, labels, items, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    out = stage(spark, odd, str(tmp_path))
    assert out.count() > 0
    assert stage(spark, none, str(tmp_path)).count() == 0
    if name != "packing":
        assert out.columns == odd.columns


def test_near_duplicates_keep_one(odd):
    """Of four copies the first with the smallest id stays; rows without words stay."""
    left = [r["doc_id"] for r in token_groups.keep_one(odd).collect()]
    assert left.count(1) == 1 and 2 not in left and left.count(None) == 1 and len(left) == len(rows()) - 3


def test_keep_one_judges_rows(spark):
    """A unique text that shares its id with a copy stays, and so does one of some copies without ids."""
    other, third = (" ".join(f"{w}{i}" for i in range(40)) for w in ("other", "third"))
    near = TEXT + " once more"
    docs = [(1, TEXT, "a"), (2, near, "b"), (2, other, "c"), (None, third, "d"), (None, third + " end", "e"), (5, None, "f"), (5, "", "g"),
            (7, other, "h"), (2, other, "i")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, _row string").repartition(3, "_row")
    kept = {r["_row"] for r in token_groups.keep_one(frame).collect()}
    assert len(kept & {"c", "i"}) == 1 and len(kept & {"d", "e"}) == 1
    assert kept - {"c", "i", "d", "e"} == {"a", "f", "g"}


def test_dealt_batches_have_no_hot_ids(spark):
    """A third without ids, a third with one id, clumped ids, and repeated rows."""
    for ids in ([None] * 1000 + list(range(2000)), [7] * 1000 + list(range(2000)),
                [p * 2**33 + i for p in range(10) for i in range(300)], [i * 10**6 + i // 990 for i in range(3000)]):
        frame = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], "doc_id long, text string")
        sizes = [r["count"] for r in exchange.dealt(frame, 3000, 30).groupBy("batch").count().collect()]
        assert sum(sizes) == 3000 and max(sizes) <= 70 and len(sizes) == 100
    same = spark.createDataFrame([(None, "same")] * 3000, "doc_id long, text string").repartition(20)
    assert max(r["count"] for r in exchange.dealt(same, 3000, 30).groupBy("batch").count().collect()) <= 900


def test_packing_covers_every_row(odd, none):
    out = packing.pack_documents(odd).toPandas()
    assert (out["piece"] == 0).sum() == len(rows()) and (out["length"] <= packing.CAPACITY).all()
    assert packing.pack_documents(none).count() == 0


def test_decontaminate_odd(odd, none, items):
    assert decontaminate.find_overlaps(odd, items).count() == 0
    assert decontaminate.find_overlaps(none, items.limit(0)).count() == 0
    # Rows with the planted text overlap it, those without an id do not.
    planted = odd.sparkSession.createDataFrame([(9, TEXT)], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.find_overlaps(odd, planted).collect()) == [1, 2, 2]


def test_rows_without_an_id_are_held_out(odd, labels):
    for frame in (toxicity.score_toxicity(odd, labels), language.identify_language(odd)):
        assert all(r["held_out"] for r in frame.filter("doc_id is null").collect())
        assert frame.filter("held_out is null").count() == 0


def test_revisits_odd(spark):
    head = {"ETag": "W/\"a\"", "Server": "s"}
    rows = [
        (1, "http://a.b/x", "2024-01-01", "response", head), (2, "http://a.b/x", "2024-01-03", "REVISIT", {"etag": '"a"'}),
        (2, "http://a.b/x", "2024-01-03", "REVISIT", {"etag": '"a"'}), (3, "http://a.b/x", "2024-01-01", "revisit", {"etag": '"a"'}),
        (4, "http://a.b/x", "2024-01-04", "revisit", None), (5, None, "2024-01-04", "revisit", {}), (6, "http://a.b/x", None, "revisit", {}),
        (7, "", "2024-01-04", "revisit", {}), (None, "http://a.b/x", "2024-01-02", "response", head), (8, "http://a.b/x", "2024-01-05", None, None),
        (9, "http://a.b/" + "y" * 100_000, "2024-01-05", "revisit", None), (None, "http://a.b/x", "2024-01-06", "revisit", {"etag": "b"}),
    ]
    schema = "record_id long, url string, day string, kind string, headers map<string,string>"
    frame = spark.createDataFrame(rows, schema).withColumn("ts", F.col("day").cast("timestamp")).withColumns(
        {"c": F.lit(1), "rid": F.lit("x"), "status": F.lit(2), "earlier": F.lit(3), "response_id": F.lit(4)})
    got = sorted(((r["revisit_id"], r["status"], r["response_id"]) for r in revisits.resolve_revisits(frame).collect()), key=str)
    # Same time is not earlier; a repeated revisit gives its rows; a response without an id answers nothing.
    assert got == sorted([
        (2, "resolved", 1), (2, "resolved", 1), (3, "no_response", None), (4, "unchecked", 1), (5, "incomplete", None),
        (6, "incomplete", None), (7, "incomplete", None), (9, "no_response", None), (None, "mismatch", 1),
    ], key=str)
    assert revisits.resolve_revisits(frame.limit(0)).count() == 0


def test_top_k_odd(spark):
    v = spark.createDataFrame(
        [(0, [1.0, 0.0], "x"), (100, [0.5, float("nan")], "x"), (1, None, "x"), (2, [1.0, None], "x"), (3, [], "x"),
         (4, [0.5, 0.5], "x"), (4, [0.5, 0.5], "x"), (None, [1.0, 1.0], "x"), (5, [1.0], "x"), (0, [0.0, 1.0], "x")],
        "vec_id long, embedding array<float>, label string",
    )
    out = topk.top_k(v, v.where(F.col("vec_id") % 100 == 0)).collect()
    assert {r["vec_id"] for r in out} == {4} and len(out) == 4
    assert topk.top_k(v.limit(0), v.limit(0)).collect() == []


def test_toxicity_holds_only_known_features():
    """A task held a dense table of all hashed features twice, whatever the sample."""
    rows = [np.array([3, 900]), np.array([5], np.int64)]
    tracemalloc.start()
    seen, weights = toxicity.ftrl(rows, np.array([1.0, 0.0]))
    model = toxicity.Weights((seen, weights + 1))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.tolist() == [3, 5, 900, toxicity.DIMENSIONS]
    assert model[np.array([5, 900])].tolist() == [weights[1] + 1, weights[2] + 1] and model.intercept == weights[3] + 1
    assert most < 10 * toxicity.DIMENSIONS


def test_batches_of_long_texts_are_small(spark):
    """A task was sent 10,000 rows at once, whatever their length."""
    docs = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("word "), 10_000).alias("text"))
    sizes = lambda batch: iter([pa.RecordBatch.from_arrays([pa.array([batch.column(0).buffers()[2].size])], ["n"])])
    assert scan(docs, ["text"], sizes, "n long").agg(F.max("n")).first()[0] < 10_000_000
