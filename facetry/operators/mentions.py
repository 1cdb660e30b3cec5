"""Sentences to aspect mentions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions.terms import DEFAULT_RULES, TagRules, aspect_terms, is_valid_term, lower_title_start
from facetry.functions.text import bind, strip, tokens
from facetry.functions.wordlists import MAX_TERM_WORDS, MIN_TERM_LENGTH
from facetry.operators.joins import lookup_join


def explode_mentions(sentences: DataFrame, terms: Column, name: str = "aspect") -> DataFrame:
    """One row per (sentence, term) with all sentence columns; no terms, no row."""
    return sentences.select("*", F.explode_outer(terms).alias(name)).filter(F.col(name).isNotNull())


def noun_phrase_mentions(
    sentences: DataFrame,
    text_col: str = "sentence",
    is_noun: Callable[[Column], Column] = DEFAULT_RULES.is_noun,
    min_length: int = MIN_TERM_LENGTH,
    max_words: int = MAX_TERM_WORDS,
) -> DataFrame:
    """Mentions from noun runs, with in-row tag rules; no shuffle."""
    return explode_mentions(
        sentences, aspect_terms(F.col(text_col), is_noun, min_length, max_words)
    )


def tag_tokens(
    sentences: DataFrame, tags: DataFrame, keys: Sequence[str], text_col: str = "sentence",
    rules: TagRules = DEFAULT_RULES,
) -> DataFrame:
    """``keys, pos, token, tag`` with tags from a table ``(token, tag)`` of any size.

    Tokens the table lacks fall back to the rules.  Frequent tokens are dealt over several
    tasks, also when the table comes out of an aggregation on the token.
    """
    split = tokens(bind(strip(F.col(text_col)), lower_title_start))
    rows = sentences.select(*keys, F.posexplode_outer(split).alias("pos", "token")).filter(
        F.col("pos").isNotNull()
    )
    tagged = lookup_join(rows, tags.select("token", "tag"), "token")
    return tagged.select(*keys, "pos", "token", F.coalesce("tag", rules(F.col("token"))).alias("tag"))


def mentions_by_table(
    sentences: DataFrame, tags: DataFrame, keys: Sequence[str], text_col: str = "sentence",
    rules: TagRules = DEFAULT_RULES,
    min_length: int = MIN_TERM_LENGTH, max_words: int = MAX_TERM_WORDS,
) -> DataFrame:
    """``keys, term_pos, aspect`` from noun runs over table tags.

    ``keys`` identify a sentence, so a window group is the nouns of one text row.
    The windows and the aggregation share one exchange on the keys.
    """
    nouns = tag_tokens(sentences, tags, keys, text_col, rules).filter(
        F.col("tag").startswith("NN")
    )
    order = Window.partitionBy(*keys).orderBy("pos")
    runs = nouns.withColumn("_run", F.col("pos") - F.row_number().over(order))
    pieces = runs.groupBy(*keys, "_run").agg(
        F.min("pos").alias("term_pos"),
        F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("_tokens"),
    )
    terms = pieces.select(
        *keys, "term_pos",
        F.lower(F.array_join(F.transform("_tokens", lambda t: t["token"]), " ")).alias("aspect"),
    ).filter(is_valid_term(F.col("aspect"), min_length, max_words))
    return terms.groupBy(*keys, "aspect").agg(F.min("term_pos").alias("term_pos")).select(
        *keys, "term_pos", "aspect"
    )
