import pytest

from facetry.functions.terms import TagRules, aspect_terms, is_valid_term, lower_title_start
from facetry.functions.text import tokens


def test_noun_aspects(one):
    got = one(aspect_terms, "The battery life is great but the screen is dim.")
    assert got == ["battery life", "screen"]


def test_opinion_words_are_no_aspects(one):
    got = one(aspect_terms, "It is great and very fast.")
    assert "great" not in got and "fast" not in got


def test_leading_adjective(one):
    got = one(aspect_terms, "Great camera and gorgeous display.")
    assert "camera" in got and "great camera" not in got


def test_leading_acronym(one):
    assert any("gps" in a for a in one(aspect_terms, "GPS locks on quickly during runs."))


@pytest.mark.parametrize("value", ["", "   ", None])
def test_blank(one, value):
    assert one(aspect_terms, value) == []


def test_max_words_drops_long_runs(one):
    got = one(aspect_terms, "The customer service response time was slow.")
    assert all(len(a.split()) <= 4 for a in got)
    assert one(aspect_terms, "alpha beta gamma delta epsilon") == []


@pytest.mark.parametrize("first,expected", [
    ("Great phone", "great"), ("GPS phone", "GPS"), ("iPhone case", "iPhone"), ("I like", "i"),
    ("Wi-Fi works", "wi-fi"), ("McDonald food", "McDonald"), ("great Food", "great"),
])
def test_only_a_title_case_start_is_lowered(one, first, expected):
    assert one(lambda c: tokens(lower_title_start(c)), first)[0] == expected


@pytest.mark.parametrize("term,valid", [
    ("tv", False), ("thing", False), ("a b c d e", False), ("a b c d", False), ("battery", True),
    ("1a2b", True), ("123", False), ("ab cd ef gh", True), ("x1 y2", False),
])
def test_valid_terms(one, term, valid):
    assert one(is_valid_term, term) is valid


def test_repeats_keep_first_place(one):
    assert one(aspect_terms, "screen, battery, Screen") == ["screen", "battery"]


def test_rules_fast_noun_test_agrees_with_tags(spark):
    words = ["battery", "the", "quickly", "wonderful", "kindness", "happiness", "less", "bed", "42", ",",
             "Great", "great", "I", "movement", "ability", "usable", "rest", "GPS"]
    for rules in (TagRules(), TagRules(default="JJ"), TagRules(suffixes=[("tly", "NN"), ("ly", "RB")])):
        frame = spark.createDataFrame([(w,) for w in words], "w string")
        for row in frame.select(rules(frame["w"]).startswith("NN").alias("a"), rules.is_noun(frame["w"]).alias("b"), "w").collect():
            assert row["a"] == row["b"], row["w"]
