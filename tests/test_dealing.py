"""Work is spread over the cores whatever the files are like, and done once."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from facetry.functions import text as X
from facetry.operators import evaluation as E
from facetry.operators import summary as S
from facetry.operators.themes import add_theme_column
from facetry.plans import queries as Q


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def one_file(folder, rows: int) -> None:
    """Documents as one file with one row group, all rows equal but for the last."""
    ids = [None] * (rows - 1) + [7]
    texts = ["The same screen. Thatin der Apparat!"] * (rows - 1) + ["Another lens was broken."]
    pq.write_table(
        pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * rows,
                  "source": ["a"] * rows, "n_chars": [len(t) for t in texts]}), folder / "documents.parquet"
    )


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    one_file(tmp_path, 4000)
    rows = Q.texts(spark, str(tmp_path), "documents")
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars"] and rows.count() == 4000
    sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 4 * 4000 / len(sizes)


def test_summary_finds_themes_once(spark):
    rows = [("camera lens", "positive", "s"), ("tent", "negative", "s"), ("tent", None, "s"), (None, "positive", "s")]
    mentions = add_theme_column(spark.createDataFrame(rows, "aspect string, aspect_sentiment string, sentence string"))
    found = S.distribution(mentions, "theme")
    assert plan_of(found).count("touchscreen") == 1
    assert {r["theme"]: r["mentions"] for r in found.collect()} == {"camera": 1, "tent": 1}


def test_term_scores_read_the_documents_once(spark, tmp_path):
    one_file(tmp_path, 12)
    found = Q.extraction_scores(spark, str(tmp_path))
    assert plan_of(found).count("FileScan") == 1
    gold = spark.createDataFrame([("1", ["A ", "b"]), ("1", ["a", " "]), ("2", None)], "sentence_id string, terms array<string>")
    sides = F.array(F.col("terms"), F.array(F.lit("b"), F.lit("c"), F.lit(None).cast("string")))
    rows = lambda column: gold.select("sentence_id", F.explode_outer(column).alias("term"))
    assert E.list_scores(gold, sides).collect() == E.extraction_scores(rows(sides[0]), rows(sides[1])).collect()


def test_marks_and_spaces_as_before(one):
    assert one(X.words, "(a-b). --ab-- 'abc'\u2003x... \x1c!y!z! abc") == ["a-b", "--ab--", "abc", "x...", "y!z", "abc"]
    assert one(X.clean_text, "a\u00a0b  c \x85 d\n<i>www.x.y\thttps://q r") == "a b c d r"
    assert one(X.split_sentences, "No.\u2003Yes...\nso. \u00a0 End.") == ["No.", "Yes...\nso.", "End."]
