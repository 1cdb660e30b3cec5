import html

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from facetry.functions import text as X


def test_clean_removes_markup_urls_and_space(one):
    dirty = "<p>Tent\t&amp; tarp</p>  from http://camp.example/a?b=1 &lt;3   "
    assert one(X.clean_text, dirty) == "Tent & tarp from <3"
    assert one(X.clean_text, "see www.a.b/c?d=1 ok") == "see ok"


@pytest.mark.parametrize("value", [None, "", "   ", "<br>", " 　"])
def test_clean_blank(one, value):
    assert one(X.clean_text, value) == ""


def test_entities_are_decoded_before_tags_are_dropped(one):
    assert one(X.clean_text, "x &lt;b&gt;y&lt;/b&gt; z") == "x y z"
    assert one(X.clean_text, "a < b > c") == "a c"


@pytest.mark.parametrize("value", [
    "&amp;amp;", "&copy &copy; &copyx", "&#65;&#x41;&#X1F600;", "&notit; &notin;", "&foo; & &;",
    "&#128;&#x9f;&#0;&#xD800;&#x110000;&#99999999999999;", "&#1;a&#xfffe;", "&#13;", "a&lt", "&&amp;&",
    "&AMP;&Amp;", "&CounterClockwiseContourIntegral;", "&#00000000000000000065;", "&NotEqualTilde;", "&#;&#x;",
])
def test_entities_equal_the_html5_rules(one, value):
    assert one(X.unescape_entities, value) == html.unescape(value)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(
    ["&", "amp", "lt", ";", "#", "x", "65", "copy", "not", "in", " ", "a", "<", "1F600", "nbsp;", "&quot;"]
), max_size=12).map("".join), min_size=20, max_size=20))
def test_entities_random(spark, values):
    frame = spark.createDataFrame([(v,) for v in values], "t string")
    got = [r["o"] for r in frame.select(X.unescape_entities(frame["t"]).alias("o")).collect()]
    assert got == [html.unescape(v) for v in values]


def test_sentences(one):
    assert one(X.split_sentences, "Pegs bent? Yes! Both of them.  Sold.") == ["Pegs bent?", "Yes!", "Both of them.", "Sold."]
    assert one(X.split_sentences, "   ") == []
    assert one(X.split_sentences, None) == []


def test_sentence_guards(one):
    text = 'Dr. Smith paid J. Doe, e.g. twice... and left! "Really?" Yes. A...  Big one.'
    assert one(X.split_sentences, text) == [
        "Dr. Smith paid J. Doe, e.g. twice... and left!", '"Really?"', "Yes.", "A...", "Big one.",
    ]
    assert one(lambda c: X.split_sentences(c, []), "Dr. No") == ["Dr.", "No"]


def test_very_long_text_does_not_overflow(one):
    text = "a-b-" * 50_000 + " x. " + "word " * 50_000
    assert len(one(X.split_sentences, text)) == 2
    assert len(one(X.tokens, text)) > 50_000
    assert len(one(X.words, text)) == 50_002


def test_words_keep_emoticons(one):
    assert one(X.words, ' "Great," she said :) (ok) ') == ["Great", "she", "said", ":)", "(ok)"]


def test_tokens_separate_punctuation(one):
    assert one(X.tokens, "Isn't Wi-Fi great? Yes, 5 stars-") == [
        "Isn't", "Wi-Fi", "great", "?", "Yes", ",", "5", "stars", "-",
    ]
