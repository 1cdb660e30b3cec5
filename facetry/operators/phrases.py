"""Multi-word entries of a lexicon.

Words that spell an entry become one word of the text before it is scored, so the entry
has one value, its own words lose theirs, and boosters, negations and contrasts around it
act on it as on any word.  Of entries that overlap, the leftmost counts, and of those that
start together the longest.  Candidates meet the entries in an equi-join, so the table may
be of any size; only the set of entry lengths is read by the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.polarity import DEFAULT_LEXICON, Lexicon
from facetry.functions.text import OTHER_SPACE, PUNCTUATION, bind
from facetry.operators.joins import lookup_join
from facetry.operators.sentiment import compound_by_table

MOST_WORDS = 8
JOINT = "_"


def pieces(text: Column) -> Column:
    """White-space words with their punctuation."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{OTHER_SPACE}]", " "), " "), lambda w: w != "")


def spelling(words: Column) -> Column:
    """Words as an entry spells them: lower case, one space between, no punctuation around."""
    return F.btrim(F.lower(F.array_join(words, " ")), F.lit(PUNCTUATION))


def entries(phrases: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """``phrase, valence, n`` with normal spelling; entries of one word are no phrases.

    An entry longer than ``most_words`` is an error; of equal entries the largest value counts.
    """
    words = pieces(F.col("phrase"))
    rows = phrases.filter(F.col("phrase").isNotNull() & F.col("valence").isNotNull()).select(
        spelling(words).alias("phrase"), "valence", F.size(words).alias("n")
    ).filter("n > 1 and phrase <> ''")
    fits = F.when(F.col("n") > most_words, F.raise_error(F.concat(F.lit("entry too long: "), "phrase")).cast("int"))
    return rows.groupBy("phrase").agg(F.max("valence").alias("valence"), F.max(F.coalesce(fits, "n")).alias("n"))


def join_phrases(texts: DataFrame, phrases: DataFrame, keys: Sequence[str], text_col: str = "text") -> DataFrame:
    """``keys, text_col`` with the words of each entry joined by ``JOINT``; ``keys`` are unique.

    Texts without an entry stay as they are.
    """
    known = entries(phrases)
    lengths = sorted(r["n"] for r in known.select("n").distinct().collect())
    if not lengths:
        return texts.select(*keys, text_col)
    # Candidates are spelt in the row, so that what is exploded is as long as the text and no
    # candidate carries the words of its text.
    def of_words(w: Column) -> Column:
        def from_place(i: Column) -> Column:
            return F.array(*[F.struct(F.lit(n).alias("_n"), F.when(
                i + n <= F.size(w), spelling(F.array(*[F.get(w, i + k) for k in range(n)]))
            ).alias("phrase")) for n in lengths])

        return F.transform(w, lambda _, i: from_place(i))

    spots = texts.select(*keys, F.posexplode(bind(pieces(F.col(text_col)), of_words)).alias("_pos", "_g")).select(
        *keys, "_pos", F.inline("_g")
    ).filter(F.col("phrase").isNotNull())
    hits = lookup_join(spots, known.select("phrase", "n"), "phrase", "inner").filter("n = _n")
    found = hits.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", (-F.col("_n")).alias("_less")))).alias("_hits"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<int>").alias("inner"))

    def take(state: Column, hit: Column) -> Column:
        end = hit["_pos"] - hit["_less"]
        taken = F.struct(end.alias("free"), F.concat(state["inner"], F.sequence(hit["_pos"] + 1, end - 1)).alias("inner"))
        return F.when(hit["_pos"] >= state["free"], taken).otherwise(state)

    spans = found.select(*keys, F.aggregate("_hits", start, take, lambda s: s["inner"]).alias("_inner"))
    joined = F.array_join(F.transform(
        pieces(F.col(text_col)),
        lambda w, i: F.concat(F.when(F.array_contains("_inner", i), JOINT).when(i > 0, " ").otherwise(""), w),
    ), "")
    whole = texts.select(*keys, text_col).join(spans, list(keys), "left")
    return whole.select(*keys, F.when(F.col("_inner").isNull(), F.col(text_col)).otherwise(joined).alias(text_col))


def compound_with_phrases(
    texts: DataFrame, valence: DataFrame, phrases: DataFrame, keys: Sequence[str], text_col: str = "text",
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """``keys, compound`` from a word table (token, valence) and a phrase table (phrase, valence)."""
    own = entries(phrases).select(F.replace("phrase", F.lit(" "), F.lit(JOINT)).alias("token"), "valence")
    table = valence.select("token", "valence").unionByName(own)
    return compound_by_table(join_phrases(texts, phrases, keys, text_col), table, keys, text_col, lexicon)
