"""Aspects to themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.themes import assign_theme, normalize_term
from facetry.functions.wordlists import THEME_KEYWORDS
from facetry.operators.joins import lookup_join

# Characters of a keyword that its first lookup asks for.
HEAD = 3


def add_theme_column(
    mentions: DataFrame, aspect_col: str = "aspect", theme_col: str = "theme",
    themes: Mapping[str, Sequence[str]] = THEME_KEYWORDS, fallback_to_term: bool = True,
) -> DataFrame:
    """Add the theme of the aspect; row-local, no shuffle."""
    return mentions.withColumn(theme_col, assign_theme(F.col(aspect_col), fallback_to_term, themes))


def assign_themes(
    mentions: DataFrame, aspect_col: str = "aspect",
    themes: Mapping[str, Sequence[str]] = THEME_KEYWORDS,
) -> DataFrame:
    """``aspect, theme`` for the distinct aspects."""
    terms = mentions.select(aspect_col).filter(F.col(aspect_col).isNotNull()).distinct()
    return add_theme_column(terms, aspect_col, "theme", themes)


def match_keywords(terms: DataFrame, keywords: DataFrame, keys: Sequence[str] = ("norm",)) -> DataFrame:
    """``keys, theme``: best theme of the term ``norm`` by table ``(priority, theme, keyword)``.

    "Contains" becomes two equi-joins, like the first steps down a trie of the keywords.
    Every position of a term asks for its head, the ``HEAD`` characters that begin there;
    the table of heads answers with the lengths its keywords have.  Only these lengths are
    cut out at that position and looked up as keywords.  A term so makes one row per
    position, whatever lengths the other keywords have, and no term meets a keyword it
    does not contain.  Keywords shorter than a head have heads of their own length.
    """
    best = keywords.filter(F.length("keyword") > 0).groupBy("keyword").agg(
        F.min(F.struct("priority", "theme")).alias("_best")
    )
    # Rows of this table have a set of lengths, bounded by the longest keyword.
    heads = best.groupBy(F.substring("keyword", 1, HEAD).alias("_head")).agg(
        F.collect_set(F.length("keyword")).alias("_lengths")
    )
    # From a position near the end, or for short keywords, the shorter heads are asked too.
    at_position = F.transform(
        F.sequence(F.lit(1), F.length("norm")),
        lambda at: F.transform(
            F.array(*[F.lit(n) for n in range(1, HEAD + 1)]),
            lambda n: F.struct(at.alias("_at"), F.substring(F.col("norm"), at, n).alias("_head")),
        ),
    )
    asked = terms.filter(F.length("norm") > 0).select(
        *keys, *(["norm"] if "norm" not in keys else []),
        F.inline(F.array_distinct(F.flatten(at_position))),
    )
    found = lookup_join(asked, heads, "_head", "inner")
    fitting = F.filter("_lengths", lambda n: (n <= F.length("norm") - F.col("_at") + 1)
                       & ((n >= HEAD) | (n == F.length("_head"))))
    pieces = found.select(*keys, F.explode(F.transform(
        fitting, lambda n: F.substring(F.col("norm"), F.col("_at"), n)
    )).alias("keyword"))
    return lookup_join(pieces, best, "keyword", "inner").groupBy(*keys).agg(F.min("_best")["theme"].alias("theme"))


def assign_themes_by_table(
    mentions: DataFrame, keywords: DataFrame, aspect_col: str = "aspect", theme_col: str = "theme",
    fallback_to_term: bool = True,
) -> DataFrame:
    """Add the theme from a keyword table of any size; the lowest priority wins.

    Themes are found once per distinct term that has one and joined back, with popular
    aspects dealt over several tasks.  The mentions are read twice, for their terms and
    for their rows.
    """
    terms = mentions.select(F.col(aspect_col).alias("_term")).filter(F.col("_term").isNotNull()).distinct()
    normal = terms.withColumn("norm", normalize_term(F.col("_term")))
    table = match_keywords(normal, keywords, ["_term"]).select(
        F.col("_term").alias(aspect_col), F.col("theme").alias("_theme")
    )
    fallback = normalize_term(F.col(aspect_col)) if fallback_to_term else F.lit("other")
    return lookup_join(mentions, table, aspect_col).select(
        *mentions.columns,
        F.when(F.col(aspect_col).isNotNull(), F.coalesce("_theme", fallback)).alias(theme_col),
    )


def cluster_vectors(
    vectors: DataFrame, vector_col: str = "embedding", k: int = 8, seed: int = 42
) -> DataFrame:
    """Add ``cluster`` by k-means over ready-made vectors."""
    prepared = vectors.withColumn(
        "_features", array_to_vector(F.col(vector_col).cast("array<double>"))
    )
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(prepared)
    return model.transform(prepared).drop("_features")
