import random

import pytest
from pyspark.sql import functions as F

from facetry.functions.themes import assign_theme, normalize_term
from facetry.functions.wordlists import THEME_KEYWORDS
from facetry.operators.themes import add_theme_column, assign_themes, assign_themes_by_table


@pytest.mark.parametrize("term,expected", [
    ("Screens", "screen"), ("batteries", "battery"), ("cameras", "camera"), ("lens", "len"),
    ("cases", "cas"), ("boxes", "box"), ("watches", "watch"), ("glass", "glass"), ("gas", "gas"),
    ("ies", "ies"), ("series", "sery"), ("  Noise   Cancellations ", "noise cancellation"), ("", ""),
    ("buses lines", "buses line"), ("ses", "s"),
])
def test_normalize(one, term, expected):
    assert one(normalize_term, term) == expected


@pytest.mark.parametrize("term,theme", [
    ("display", "screen"), ("shipping", "delivery"), ("customer service", "service"),
    ("battery life", "battery"), ("keyboards", "keyboard"), ("software", "performance"),
    ("microwave", "sound"), ("outfit", "comfort"),
])
def test_assign(one, term, theme):
    assert one(assign_theme, term) == theme


def test_no_fallback(one):
    assert one(lambda c: assign_theme(c, fallback_to_term=False), "keyboards") == "other"


def test_add_column(spark):
    rows = spark.createDataFrame([("display",), ("shipping",), ("widget",), (None,)], "aspect string")
    got = [r["theme"] for r in add_theme_column(rows).collect()]
    assert got == ["screen", "delivery", "widget", None]
    assert add_theme_column(rows.limit(0)).columns == ["aspect", "theme"]


def test_table_form_equals_inline_form(spark):
    words = ["display", "shippings", "widget", "software", "microwave", "value for money", "x", None,
             "battery charge", "apps", "wearable", "premium strap", "", "customer fit"] * 3
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "id int, aspect string")
    table = spark.createDataFrame(
        [(p, t, k) for p, (t, ks) in enumerate(THEME_KEYWORDS.items()) for k in ks],
        "priority int, theme string, keyword string",
    )
    expected = {r["id"]: r["theme"] for r in add_theme_column(rows).collect()}
    got = assign_themes_by_table(rows, table)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    assert len(got.collect()) == len(words)
    assert {r["id"]: r["theme"] for r in got.collect()} == expected


def test_distinct_mapping(spark):
    rows = spark.createDataFrame([("display",), ("display",), ("widget",)], "aspect string")
    assert {tuple(r) for r in assign_themes(rows).collect()} == {("display", "screen"), ("widget", "widget")}


def test_many_keywords_equal_brute_force(spark):
    rng = random.Random(3)
    letters = "ab c"
    keywords = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"", "héß", "bo"})
    table = [(rng.randrange(40), f"t{rng.randrange(9)}", k) for k in keywords for _ in range(rng.choice([1, 1, 2]))]
    terms = ["".join(rng.choice("abcxyz ") for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["xxhéßxx", "BOX", "a" * 500]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "norm int, aspect string")
    known = spark.createDataFrame(table, "priority int, theme string, keyword string")
    normal = {r["norm"]: r["n"] for r in rows.select("norm", normalize_term(rows["aspect"]).alias("n")).collect()}
    got = assign_themes_by_table(rows, known, fallback_to_term=False)
    assert got.columns == ["norm", "aspect", "theme"]
    for r in got.collect():
        hits = [(p, t) for p, t, k in table if k and k in normal[r["norm"]]]
        assert r["theme"] == (min(hits)[1] if hits else "other"), r


def test_a_large_keyword_table(spark):
    known = spark.range(100_000).select(
        F.lit(1).alias("priority"), F.concat(F.lit("t"), F.col("id") % 7).alias("theme"), F.concat(F.lit("key"), F.col("id"), F.lit("x")).alias("keyword"))
    rows = spark.range(2_000).select(F.concat(F.lit("old key"), F.col("id") * 50, F.lit("x part")).alias("aspect"), "id")
    got = assign_themes_by_table(rows, known)
    assert got.count() == 2_000
    assert got.filter(F.col("theme") != F.concat(F.lit("t"), F.col("id") * 50 % 7)).count() == 0
