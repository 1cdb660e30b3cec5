"""Document and sentence sentiment on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.polarity import (
    DEFAULT_LEXICON,
    MICRO,
    Lexicon,
    compound,
    emphasis,
    is_capitals,
    label_sentiment,
    squash,
    to_micro,
    with_context,
)
from facetry.functions.text import bind, words
from facetry.functions.wordlists import (
    AFTER_CONTRAST,
    BEFORE_CONTRAST,
    BOOST_DECAY,
    CAPS_BOOST,
    NEGATIVE_FROM,
    POSITIVE_FROM,
)


def add_sentiment(
    rows: DataFrame,
    text_col: str,
    compound_col: str,
    label_col: str,
    lexicon: Lexicon = DEFAULT_LEXICON,
    positive_from: float = POSITIVE_FROM,
    negative_from: float = NEGATIVE_FROM,
) -> DataFrame:
    """Score a text column once and label the score."""
    scored = rows.withColumn(compound_col, compound(F.col(text_col), lexicon))
    return scored.withColumn(
        label_col, label_sentiment(F.col(compound_col), positive_from, negative_from)
    )


def document_sentiment(reviews: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Add ``doc_compound`` and ``doc_sentiment``, one score per whole review."""
    return add_sentiment(reviews, text_col, "doc_compound", "doc_sentiment", **options)


def sentence_sentiment(sentences: DataFrame, text_col: str = "sentence", **options) -> DataFrame:
    """Add ``aspect_compound`` and ``aspect_sentiment``.

    All aspects of a sentence share its score, so it is computed before the
    sentence is exploded into aspects.
    """
    return add_sentiment(sentences, text_col, "aspect_compound", "aspect_sentiment", **options)


def compound_by_table(
    rows: DataFrame,
    valences: DataFrame,
    keys: Sequence[str],
    text_col: str = "text",
    lexicon: Lexicon = DEFAULT_LEXICON,
) -> DataFrame:
    """``keys`` + ``compound`` with word valences from a table ``(token, valence)`` of any size.

    ``keys`` identify a row.  Only a word and its position travel to the join; Spark
    broadcasts a small table and splits the partitions of frequent words of a large
    one.  The words found come back to their text as one list of positions, where
    their neighbours are read from the text itself.  ``lexicon`` supplies the small
    word lists only.
    """
    lowered = F.transform(words(F.col(text_col)), F.lower)
    tokens = rows.select(*keys, F.posexplode_outer(lowered).alias("_pos", "token")).filter(F.col("token").isNotNull())
    found = tokens.join(valences.select("token", F.col("valence").cast("double").alias("_valence")), "token")
    hits = found.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_pos", "token", "_valence"))).alias("_hits")
    )
    texts = rows.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    total = F.coalesce(_scored_hits(F.col("_text"), F.col("_hits"), lexicon), F.lit(0)) / F.lit(MICRO)
    return texts.join(hits, list(keys), "left").select(
        *keys, squash(total, emphasis(F.col("_text"))).alias("compound")
    )


def compound_by_values(text: Column, values: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Compound score from the valence of each lower-case word of ``words(text)``, NULL for words without one."""
    def hits(low: Column) -> Column:
        known = F.transform(low, lambda t, i: F.when(
            F.get(values, i).isNotNull(), F.struct(i.alias("_pos"), t.alias("token"), F.get(values, i).alias("_valence"))
        ))
        return F.filter(known, lambda h: h.isNotNull())

    def score(t: Column) -> Column:
        found = F.when(F.exists(values, lambda v: v.isNotNull()), hits(F.transform(words(t), F.lower)))
        total = bind(found, lambda h: F.coalesce(_scored_hits(t, h, lexicon), F.lit(0))) / F.lit(MICRO)
        return bind(total, lambda x: bind(emphasis(t), lambda extra: squash(x, extra)))

    return bind(F.coalesce(text, F.lit("")), score)


def _scored_hits(text: Column, hits: Column, lexicon: Lexicon) -> Column:
    """Sum of the hits' valences in their context, in whole micro-units; NULL without hits.

    Hits are in the order of their positions, so the words with a valence among the
    last few of a text are among the last few hits.
    """
    def known(pos: Column, j: Column, distance: int) -> Column:
        hit = F.lit(False)
        for d in range(1, distance + 1):
            hit = hit | F.coalesce(F.get(hits, j - d)["_pos"] == pos - distance, F.lit(False))
        return hit

    def in_text(w: Column, low: Column, mixed: Column, turn: Column) -> Column:
        def one(h: Column, j: Column) -> Column:
            pos, start = h["_pos"], h["_valence"]
            value = start + F.when(
                mixed & is_capitals(F.get(w, pos)), F.when(start > 0, CAPS_BOOST).otherwise(-CAPS_BOOST)
            ).otherwise(0.0)

            def step(value: Column, d: int) -> Column:
                return bind(value, lambda v: with_context(
                    v, F.get(low, pos - d), F.get(w, pos - d), known(pos, j, d), mixed, d, lexicon,
                ))

            for d in range(1, len(BOOST_DECAY) + 1):
                value = step(value, d)
            side = (
                F.when((turn == 0) | (turn == pos + 1), 1.0).when(pos + 1 < turn, BEFORE_CONTRAST)
                .otherwise(AFTER_CONTRAST)
            )
            return F.when(h["token"].isin(*lexicon.boosters), F.lit(0).cast("bigint")).otherwise(to_micro(value * side))

        return F.aggregate(F.transform(hits, one), F.lit(0).cast("bigint"), lambda a, x: a + x)

    def with_flags(w: Column, low: Column) -> Column:
        mixed = F.exists(w, is_capitals) & F.exists(w, lambda t: ~is_capitals(t))
        turn = F.array_position(F.transform(low, lambda t: t.isin(*lexicon.contrasts)), F.lit(True))
        return bind(mixed, lambda flag: bind(turn, lambda pivot: in_text(w, low, flag, pivot)))

    return F.when(hits.isNotNull(), bind(
        words(text), lambda w: bind(F.transform(w, F.lower), lambda low: with_flags(w, low))
    ))
