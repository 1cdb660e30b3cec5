"""Sentence ends learnt from the corpus: which words carry a period of their own.

A word counts as an abbreviation by the log-likelihood test of Kiss and Strunk (2006):
its periods must be far more frequent than chance, where short words, inner periods and
no occurrence without a period speak for it.  The counts are one aggregation over words
and one over their sums, so the table can be learnt from a corpus of any size; splitting
by the table is an equi-join on the words before candidate boundaries, once per block of texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import LETTERS, MARK, OTHER_SPACE, bind, sentence_boundary, strip
from facetry.operators.joins import in_blocks, lookup_join

#: Fixed values of the published method: likelihood of a period after an abbreviation, and the threshold.
AFTER_ABBREVIATION = 0.99
THRESHOLD = 0.3

CLOSERS = r"[\"'”’)\]]"


def word_type(word: Column) -> Column:
    """A word in lower case without the marks around it."""
    return F.lower(F.regexp_replace(word, f"^[^{LETTERS}]+|[^{LETTERS}]+$", ""))


def ends_in_period(word: Column) -> Column:
    """True for one period after a letter or digit, with closing marks or without."""
    return word.rlike(rf"[{LETTERS}]\.{CLOSERS}*$")


def period_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``type, with_period, without_period`` of all words that hold a letter."""
    plain = F.regexp_replace(F.coalesce(text_col, F.lit("")), f"[{OTHER_SPACE}]", " ")
    words = texts.select(F.explode_outer(F.split(plain, " ")).alias("word"))
    # The patterns are matched once per distinct word.
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    typed = counted.select(word_type(F.col("word")).alias("type"), ends_in_period(F.col("word")).alias("dot"), "n")
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("bigint")
    return typed.filter(F.col("type").rlike(r"\p{L}")).groupBy("type").agg(
        total(F.col("dot")).alias("with_period"), total(~F.col("dot")).alias("without_period")
    )


def abbreviation_scores(counts: DataFrame) -> DataFrame:
    """Adds ``score``; words never seen with a period score nothing."""
    # One row, which every task may hold.
    sums = counts.agg(
        F.sum("with_period").alias("_dots"), F.sum(F.col("with_period") + F.col("without_period")).alias("_words")
    ).withColumn("_all", F.lit(1))
    rows = counts.withColumn("_all", F.lit(1)).join(F.broadcast(sums), "_all")
    dots, rest, chance = F.col("with_period"), F.col("without_period"), F.col("_dots") / F.col("_words")

    def log_likelihood(p: Column) -> Column:
        # A corpus in which every word ends in a period leaves no chance to compare with.
        missed = F.when(rest == 0, 0.0).otherwise(rest * F.ln(F.greatest(1 - p, F.lit(1e-300))))
        return dots * F.ln(p) + missed

    ratio = 2 * (log_likelihood(F.lit(AFTER_ABBREVIATION)) - log_likelihood(chance))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = (F.length("type") - inner).cast("double")
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -rest)
    return rows.filter(dots > 0).select("type", "with_period", "without_period", score.alias("score"))


def learn_abbreviations(texts: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``type, with_period, without_period, score`` of the words taken as abbreviations."""
    return abbreviation_scores(period_counts(texts, text_col)).filter(F.col("score") >= threshold)


def sentences_by_table(rows: DataFrame, abbreviations: DataFrame, text_col: str = "text", name: str = "_sentences") -> DataFrame:
    """Adds ``name``, the sentences of a text in order; a NULL text has NULL.

    A text is cut at all candidate boundaries, then what follows an abbreviation is put
    back.  ``abbreviations`` has a unique column ``type``.  Texts go in blocks: only the
    distinct words before boundaries of a block are looked up, and those that are
    abbreviations come back to it, so a text is moved once and is cut in its row.
    """
    def pieces_of(text: Column) -> Column:
        return F.split(F.regexp_replace(text, sentence_boundary(()), "$0" + MARK), MARK)

    def kind(piece: Column) -> Column:
        # A pattern bound to the end would be tried from every character of a long piece.
        last = F.substring_index(F.regexp_replace(strip(piece), f"[{OTHER_SPACE}]", " "), " ", -1)
        return bind(last, lambda w: F.when(ends_in_period(w), word_type(w)))

    dealt = in_blocks(rows, name="_deal")
    asked = dealt.select(
        F.col("_deal").alias("_block"),
        F.explode_outer(F.array_distinct(F.transform(pieces_of(F.col(text_col)), kind))).alias("type"),
    ).filter(F.col("type").isNotNull()).distinct()
    # A block asks once, so no word has more rows than there are blocks.
    known = lookup_join(asked, abbreviations.select("type"), "type", "inner", salts=1)
    lists = known.groupBy("_block").agg(F.collect_set("type").alias("_known"))
    met = dealt.join(lists, F.col("_deal") == F.col("_block"), "left")

    def joined(pieces: Column, kinds: Column) -> Column:
        own = F.array_intersect(kinds, F.coalesce("_known", F.array().cast("array<string>")))
        return bind(own, lambda here: F.array_join(F.zip_with(
            pieces, kinds, lambda p, k: F.when(F.array_contains(here, k), p).otherwise(F.concat(p, F.lit(MARK)))
        ), ""))

    found = bind(pieces_of(F.col(text_col)), lambda p: bind(F.transform(p, kind), lambda k: joined(p, k)))
    sentences = F.filter(F.transform(F.split(found, MARK), strip), lambda s: s != "")
    return met.withColumn(name, sentences).select(*rows.columns, name)
