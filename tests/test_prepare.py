import pytest
from pyspark.sql import functions as F

from facetry.functions.wordlists import CANONICAL_COLUMNS
from facetry.operators import prepare
from facetry.operators.sentences import explode_sentences
from facetry.sources.reviews import load_reviews, read_csv


def test_schema_and_types(spark):
    out = load_reviews(spark.createDataFrame([("a review", "5")], "text string, rating string"))
    assert out.columns == CANONICAL_COLUMNS
    row = out.first()
    assert (row["review_id"], row["rating"], row["date"], row["product"]) == (1, 5.0, None, None)


def test_missing_text_names_columns(spark):
    with pytest.raises(ValueError, match="Expected source column 'body'.*'stars'"):
        load_reviews(spark.createDataFrame([(1,)], "stars int"), columns={"text": "body"})


def test_bad_values_become_null(spark):
    rows = spark.createDataFrame(
        [("a", "x", "2024-13-01"), ("b", " 4.5 ", "2024-02-01"), ("c", "NaN", "01/03/2024"), ("d", None, None)],
        "text string, rating string, date string",
    )
    out = {r["text"]: r for r in load_reviews(rows, date_formats=["dd/MM/yyyy"]).collect()}
    assert [out[k]["rating"] for k in "abcd"] == [None, 4.5, None, None]
    assert [str(out[k]["date"])[:10] for k in "abcd"] == ["None", "2024-02-01", "2024-03-01", "None"]


def test_source_ids_survive_and_blank_texts_go(spark):
    rows = spark.createDataFrame([(7, "ok"), (8, "   "), (9, None)], "review_id int, text string")
    assert [r["review_id"] for r in load_reviews(rows).collect()] == [7]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_numbers_are_consecutive_in_any_partitioning(spark, parts):
    rows = spark.range(0, 1000, 1, parts).select(F.concat(F.lit("t"), "id").alias("text"))
    out = [(r["n"], r["text"]) for r in prepare.number_rows(rows, "n").collect()]
    assert sorted(out) == [(i + 1, f"t{i}") for i in range(1000)]


def test_numbers_are_given_before_blank_rows_go(spark):
    rows = spark.createDataFrame([("a",), (" ",), ("b",)], "text string").coalesce(1)
    assert [(r["review_id"], r["text"]) for r in load_reviews(rows).collect()] == [(1, "a"), (3, "b")]


def test_unique_ids(spark):
    rows = spark.range(0, 100, 1, 7).select(F.col("id").cast("string").alias("text"))
    assert load_reviews(rows, ids="unique").select("review_id").distinct().count() == 100


def test_csv_quotes_commas_and_line_breaks(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text(
        'review_id,product,rating,date,text\n'
        '1,EchoPhone,5,2026-01-12,"Great, really ""great"".\nNew line."\n'
        '2,EchoPhone,,bad,"x"\n3,Other,3,2026-01-14,\n'
    )
    out = load_reviews(str(path), spark).orderBy("review_id").collect()
    assert [r["review_id"] for r in out] == [1, 2]
    assert out[0]["text"] == 'Great, really "great".\nNew line.'
    assert (out[1]["rating"], out[1]["date"]) == (None, None)
    assert read_csv(spark, str(path)).count() == 3


def test_csv_without_ids_is_numbered(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("body\n" + "".join(f"text {i}\n" for i in range(50)))
    out = load_reviews(str(path), spark, {"text": "body"}).collect()
    assert sorted((r["review_id"], r["text"]) for r in out) == [(i + 1, f"text {i}") for i in range(50)]


def test_clean_reviews_drops_empty_rows(spark):
    rows = spark.createDataFrame([("real review", 1), ("   ", 2), ("<br>", 3), (None, 4)], "text string, id int")
    out = prepare.clean_reviews(rows)
    assert out.columns == ["text", "id"]
    assert [tuple(r) for r in out.collect()] == [("real review", 1)]


def test_filters_keep_missing_values(spark):
    rows = spark.createDataFrame(
        [("A", 1.0), ("B", 4.5), (None, 3.0), ("A", None)], "product string, rating double"
    )
    assert prepare.filter_products(rows, ["A"]).count() == 3
    assert prepare.filter_products(rows, []).count() == 4
    assert prepare.filter_ratings(rows, (2, 4.5)).count() == 3
    assert prepare.filter_ratings(rows, None).count() == 4
    assert [r["product"] for r in prepare.product_facets(rows).collect()] == ["A", "B"]
    assert tuple(prepare.rating_facet(rows).first()) == (1, 5)


def test_explode_sentences(spark, sample_reviews):
    reviews = load_reviews(sample_reviews)
    out = explode_sentences(reviews)
    assert out.columns == ["review_id", "rating", "date", "product", "sentence_id", "sentence"]
    rows = out.collect()
    assert len(rows) > 3 and all(r["sentence"] for r in rows)
    first = sorted(r["sentence_id"] for r in rows if r["sentence"] in ("Awful zipper on this tent.", "Good pockets, though!"))
    assert first == [0, 1]


def test_text_is_split_once(spark):
    """No optimizer rule may add a second evaluation of the sentence splitter."""
    rows = spark.createDataFrame([(1, "a. b.")], "review_id int, text string")
    plan = explode_sentences(prepare.clean_reviews(rows))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "size(filter(transform(split" not in plan


def test_first_rows(spark):
    rows = spark.range(10)
    assert [r["id"] for r in prepare.first_rows(rows, ["id"], 3).collect()] == [0, 1, 2]
    assert prepare.first_rows(rows, ["id"], None).count() == 10
