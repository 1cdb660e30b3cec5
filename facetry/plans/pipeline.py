"""Reviews to mentions, end to end."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetry.functions.polarity import DEFAULT_LEXICON, Lexicon, label_sentiment
from facetry.functions.terms import DEFAULT_RULES, aspect_terms, sentence_tokens
from facetry.functions.text import bind, words
from facetry.functions.wordlists import (
    DEFAULT_ABBREVIATIONS,
    MAX_TERM_WORDS,
    MENTION_COLUMNS,
    MIN_TERM_LENGTH,
    NEGATIVE_FROM,
    POSITIVE_FROM,
    THEME_KEYWORDS,
)
from facetry.operators import summary
from facetry.operators.boundaries import sentences_by_table
from facetry.operators.context_tags import tagged_terms
from facetry.operators.lists import lookup_lists
from facetry.operators.mentions import explode_mentions
from facetry.operators.prepare import clean_reviews
from facetry.operators.sentences import explode_sentences
from facetry.operators.sentiment import add_sentiment, compound_by_values
from facetry.operators.tagger import Tagger
from facetry.operators.themes import add_theme_column, assign_themes_by_table
from facetry.session import use_checkpoint_dir
from facetry.sources.reviews import load_mentions


@dataclass(frozen=True)
class Options:
    """What may vary.  ``extractor`` and ``scorer`` are the model hooks; without them
    noun runs and the lexicon are used.

    Dictionaries are written into the plan.  Each may be a table instead, of any size:
    ``valence_table`` (token, valence) in place of the lexicon's valences, ``tag_table``
    (token, tag) before the tag rules and in place of ``is_noun``, ``keyword_table``
    (priority, theme, keyword) in place of ``themes``, ``abbreviation_table`` (type) in
    place of ``abbreviations``.  ``tagger`` is a trained extractor.  Hooks come before it,
    and it before tables.

    A table step deals its rows in blocks, asks the table for the distinct words of a block
    and gives the answers to the rows where they are, so rows are moved once per step; steps
    follow each other, and each is read by its words and by its rows.  ``checkpoint`` stores
    the rows in front of each step under ``spark.checkpoint.dir``, compressed: every row is
    then worked out once, by a job that runs while the plan is made.
    """

    lexicon: Lexicon = DEFAULT_LEXICON
    is_noun: Callable[[Column], Column] = DEFAULT_RULES.is_noun
    extractor: Callable[[Column], Column] | None = None
    scorer: Callable[[Column, Column], Column] | None = None
    tagger: Tagger | None = None
    themes: Mapping[str, Sequence[str]] = field(default_factory=lambda: THEME_KEYWORDS)
    valence_table: DataFrame | None = None
    tag_table: DataFrame | None = None
    keyword_table: DataFrame | None = None
    abbreviation_table: DataFrame | None = None
    abbreviations: Sequence[str] = field(default_factory=lambda: DEFAULT_ABBREVIATIONS)
    min_term_length: int = MIN_TERM_LENGTH
    max_term_words: int = MAX_TERM_WORDS
    positive_from: float = POSITIVE_FROM
    negative_from: float = NEGATIVE_FROM
    checkpoint: bool = False


def stored(rows: DataFrame, options: Options) -> DataFrame:
    """The rows, written and read back if the options ask for it; a checkpoint would keep them uncompressed."""
    if not options.checkpoint:
        return rows
    spark = rows.sparkSession
    use_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/rows-{uuid.uuid4()}"
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def valences(options: Options) -> DataFrame:
    return options.valence_table.select("token", F.col("valence").cast("double").alias("value"))


def whole_reviews(rows: DataFrame) -> list[str]:
    """Columns by which the sentences of a review stay together; what they share then takes little room."""
    return [c for c in ("review_id", "product", "rating", "date", "doc_compound") if c in rows.columns]


def lowered(text_col: str) -> Column:
    return F.transform(words(F.col(text_col)), F.lower)


def with_sentiment(rows: DataFrame, text_col: str, prefix: str, options: Options, values: str | None = None) -> DataFrame:
    """Add ``<prefix>_compound`` and ``<prefix>_sentiment`` from the lexicon or its table.

    ``values``: a column of the words' valences, if they have been looked up.
    """
    names, bounds = (f"{prefix}_compound", f"{prefix}_sentiment"), (options.positive_from, options.negative_from)
    if options.valence_table is None:
        return add_sentiment(rows, text_col, *names, options.lexicon, *bounds)
    if values is None:
        rows, values = lookup_lists(stored(rows, options), {"_values": (lowered(text_col), valences(options))}), "_values"
    scored = rows.withColumn(names[0], compound_by_values(F.col(text_col), F.col(values), options.lexicon)).drop(values)
    return scored.withColumn(names[1], label_sentiment(F.col(names[0]), *bounds))


def scored_reviews(reviews: DataFrame, options: Options = Options()) -> DataFrame:
    """Clean canonical reviews with their document sentiment."""
    return with_sentiment(clean_reviews(reviews), "text", "doc", options)


def sentence_rows(scored: DataFrame, options: Options = Options()) -> DataFrame:
    if options.abbreviation_table is None:
        return explode_sentences(scored, abbreviations=options.abbreviations)
    return learned_sentences(scored, options.abbreviation_table, options=options)


def learned_sentences(
    reviews: DataFrame, abbreviations: DataFrame, text_col: str = "text", id_col: str = "review_id",
    options: Options = Options(),
) -> DataFrame:
    """``explode_sentences`` with a table of abbreviations."""
    split = sentences_by_table(stored(reviews, options), abbreviations, text_col)
    kept = [id_col] + [c for c in reviews.columns if c not in (id_col, text_col)]
    rows = split.select(*kept, F.posexplode_outer("_sentences").alias("sentence_id", "sentence"))
    return rows.filter(F.col("sentence_id").isNotNull())


def mention_rows(sentences: DataFrame, options: Options = Options()) -> DataFrame:
    """The mention table; without tables, rows never leave the task that holds their sentence."""
    values = None
    if options.extractor is not None:
        terms = options.extractor(F.col("sentence"))
    elif options.tagger is not None:
        sentences = options.tagger.add_terms(sentences, "sentence", "_terms")
        terms = F.col("_terms")
    elif options.tag_table is not None:
        # Tags and valences are looked up together, so that sentences are moved once for both.
        wanted = {"_tags": (sentence_tokens(F.col("sentence")), options.tag_table.select("token", F.col("tag").alias("value")))}
        if options.scorer is None and options.valence_table is not None:
            values = "_values"
            wanted[values] = lowered("sentence"), valences(options)
        sentences = lookup_lists(stored(sentences, options), wanted, whole_reviews(sentences))
        sentences = sentences.withColumn("_terms", table_terms(F.col("sentence"), F.col("_tags"), options)).drop("_tags")
        terms = F.col("_terms")
    else:
        terms = aspect_terms(
            F.col("sentence"), options.is_noun, options.min_term_length, options.max_term_words
        )
    if options.scorer is None:
        scored = with_sentiment(sentences, "sentence", "aspect", options, values)
        if options.keyword_table is not None:
            return themed_mentions(scored.withColumn("_terms", terms), options)
        mentions = explode_mentions(scored, terms)
    else:
        pairs = explode_mentions(sentences, terms)
        mentions = pairs.withColumn("_scored", options.scorer(F.col("sentence"), F.col("aspect")))
        mentions = mentions.withColumns({
            "aspect_sentiment": F.col("_scored.label"), "aspect_compound": F.col("_scored.score"),
        })
    if options.keyword_table is not None:
        return assign_themes_by_table(stored(mentions, options), options.keyword_table).select(*MENTION_COLUMNS)
    return add_theme_column(mentions, themes=options.themes).select(*MENTION_COLUMNS)


def themed_mentions(sentences: DataFrame, options: Options) -> DataFrame:
    """The mention table from sentences with ``_terms``, themes by the keyword table.

    Themes are found for the distinct terms and come back as a list beside the list of
    terms; a sentence becomes one row per term only at the end, so that no step stores or
    moves its text as often as it has terms.
    """
    rows = stored(sentences.select(*[c for c in MENTION_COLUMNS if c not in ("aspect", "theme")], "_terms"), options)
    terms = rows.select(F.explode_outer("_terms").alias("token")).filter(F.col("token").isNotNull()).distinct()
    themes = assign_themes_by_table(terms, options.keyword_table, "token", "value")
    found = lookup_lists(rows, {"_themes": (F.col("_terms"), themes)}, whole_reviews(rows)).withColumn(
        "_found", F.arrays_zip(F.col("_terms").alias("aspect"), F.col("_themes").alias("theme"))
    ).drop("_terms", "_themes")
    return found.select("*", F.explode("_found").alias("_f")).select("*", "_f.aspect", "_f.theme").select(*MENTION_COLUMNS)


def table_terms(sentence: Column, tags: Column, options: Options) -> Column:
    """The terms of a sentence in order, from noun runs over its tokens' tags; the rules tag tokens without one."""
    return bind(sentence_tokens(sentence), lambda split: tagged_terms(
        split, F.zip_with(split, tags, lambda w, t: F.coalesce(t, DEFAULT_RULES(w))), options.min_term_length, options.max_term_words
    ))


@dataclass(frozen=True)
class Result:
    """Three lazy tables."""

    reviews: DataFrame
    sentences: DataFrame
    mentions: DataFrame
    options: Options = Options()

    def aspect_summary(self, group_col: str = "aspect") -> DataFrame:
        return summary.aspect_distribution(self.mentions, group_col)

    def save(self, folder: str, partition_by: Sequence[str] = ()) -> dict[str, str]:
        """Write the three tables; returns their paths.

        Each table is derived from the one written before, so no text is cleaned or
        split twice and a lost executor costs at most the stage it was in.
        """
        spark = self.reviews.sparkSession
        paths = {n: f"{folder}/{n}.parquet" for n in ("reviews", "sentences", "mentions")}
        self.reviews.write.mode("overwrite").parquet(paths["reviews"])
        reviews = spark.read.parquet(paths["reviews"])
        sentence_rows(reviews, self.options).write.mode("overwrite").parquet(paths["sentences"])
        sentences = spark.read.parquet(paths["sentences"])
        mentions = mention_rows(sentences, self.options)
        if partition_by:  # else every task writes a file per value
            mentions = mentions.hint("rebalance", *partition_by)
        mentions.write.mode("overwrite").partitionBy(*partition_by).parquet(paths["mentions"])
        return paths


def run(reviews: DataFrame, options: Options = Options()) -> Result:
    """Canonical reviews to reviews, sentences and mentions; lazy unless ``options.checkpoint``."""
    scored = scored_reviews(reviews, options)
    sentences = sentence_rows(scored, options)
    return Result(scored, sentences, mention_rows(sentences, options), options)


def load_result(spark: SparkSession, folder: str, options: Options = Options()) -> Result:
    """Tables written by ``Result.save``."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    return Result(read("reviews"), read("sentences"), load_mentions(spark, folder), options)
