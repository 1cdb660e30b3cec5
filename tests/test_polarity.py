import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from facetry.functions import polarity as P
from facetry.operators.sentiment import compound_by_table, document_sentiment


def reference_score(text, lexicon):
    """Plain brute-force version of the published method."""
    raw = text.split()
    words = []
    for w in raw:
        bare = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
        words.append(bare if len(bare) > 2 else w)
    low = [w.lower() for w in words]
    caps = [w.isupper() for w in words]
    mixed = any(caps) and not all(caps)
    turn = next((i for i, w in enumerate(low) if w in lexicon.contrasts), None)
    total = 0.0
    for i, w in enumerate(low):
        if w not in lexicon.valence or w in lexicon.boosters:
            continue
        v = lexicon.valence[w]
        if caps[i] and mixed:
            v += 0.733 if v > 0 else -0.733
        for d, decay in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i - d < 0 or low[i - d] in lexicon.valence:
                continue
            p = low[i - d]
            if p in lexicon.boosters:
                s = lexicon.boosters[p] + (0.733 if caps[i - d] and mixed else 0.0)
                v += (s if v >= 0 else -s) * decay
            if p in lexicon.negations or "n't" in p:
                v *= -0.74
        if turn is not None and i != turn:
            v *= 0.5 if i < turn else 1.5
        total += math.floor(v * 1e6 + 0.5) / 1e6
    bang = min(text.count("!"), 4) * 0.292
    q = text.count("?")
    extra = bang + (0.0 if q <= 1 else q * 0.18 if q <= 3 else 0.96)
    if abs(total) < 1e-9:
        return 0.0
    total += extra if total > 0 else -extra
    return round(total / math.sqrt(total * total + 15), 4)


TEXTS = [
    "Truly wonderful stitching, my sister would love it", "A horrible smell, we hate that shop", "", "   ",
    "Such an amazing tent", "not good", "The food is not very GOOD at all!!!", "VERY good",
    "It isn't really bad, but the awning is great??", "EXTREMELY ugly thing", "slightly good :)",
    "good but bad but good", "GREAT", "ALL CAPS GREAT BAD", "great????? bad", "without any good reason",
    "love hate love not hate", "Shipping was slow but the colour is excellent.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_compound_equals_brute_force(one, text):
    assert one(P.compound, text) == pytest.approx(reference_score(text, P.DEFAULT_LEXICON), abs=1e-9)


def test_compound_direction(one):
    assert one(P.compound, TEXTS[0]) > 0.05
    assert one(P.compound, TEXTS[1]) < -0.05
    assert one(P.compound, None) == 0.0


def test_table_form_equals_inline_form(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS + [None])), "id int, text string")
    lexicon = spark.createDataFrame(list(P.DEFAULT_LEXICON.valence.items()), "token string, valence double")
    inline = {r["id"]: r["c"] for r in rows.select("id", P.compound(F.col("text")).alias("c")).collect()}
    table = compound_by_table(rows, lexicon, ["id"])
    assert {r["id"]: r["compound"] for r in table.collect()} == inline


@pytest.mark.parametrize("score,label", [
    (0.5, "positive"), (-0.5, "negative"), (0.0, "neutral"), (0.05, "positive"), (-0.05, "negative"),
])
def test_labels(one, score, label):
    assert one(P.label_sentiment, score, schema="double") == label


def test_custom_threshold(one):
    assert one(lambda c: P.label_sentiment(c, positive_from=0.2), 0.1, schema="double") == "neutral"


@pytest.mark.parametrize("raw,label", [
    ("Positive", "positive"), ("NEGATIVE", "negative"), ("Neutral", "neutral"), ("POS", "positive"),
    ("neg", "negative"), ("LABEL_2", "positive"), ("LABEL_0", "negative"), (" LABEL_1 ", "neutral"),
])
def test_model_labels(one, raw, label):
    assert one(P.normalize_label, raw) == label


def test_unknown_model_label(one):
    with pytest.raises(PySparkException, match="Unrecognized sentiment label"):
        one(P.normalize_label, "mildly_annoyed")


def test_class_scores(one):
    out = one(P.class_scores, [1.0, 0.0, 2.0], schema="array<double>")
    e = [math.exp(x) for x in (1.0, 0.0, 2.0)]
    assert out["label"] == "positive"
    assert out["score"] == pytest.approx((e[2] - e[0]) / sum(e))
    assert one(P.class_scores, [1.0, 1.0, 1.0], schema="array<double>")["label"] == "negative"
    two = one(lambda c: P.class_scores(c, ["negative", "positive"]), [0.0, 3.0], schema="array<double>")
    assert two["label"] == "positive"


def test_document_sentiment(spark):
    rows = spark.createDataFrame([(1, "I love it"), (2, None)], "review_id int, text string")
    out = {r["review_id"]: r for r in document_sentiment(rows).collect()}
    assert out[1]["doc_sentiment"] == "positive"
    assert (out[2]["doc_compound"], out[2]["doc_sentiment"]) == (0.0, "neutral")
