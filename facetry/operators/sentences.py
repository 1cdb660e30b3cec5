"""Reviews to sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions.text import split_sentences
from facetry.functions.wordlists import DEFAULT_ABBREVIATIONS


def explode_sentences(
    reviews: DataFrame,
    text_col: str = "text",
    id_col: str = "review_id",
    abbreviations: Sequence[str] = DEFAULT_ABBREVIATIONS,
) -> DataFrame:
    """One row per sentence: id, other columns, ``sentence_id`` from 0, ``sentence``.

    The outer generator followed by a filter drops blank texts; an inner one would
    make the optimizer add a size test that splits every text a second time.
    """
    kept = [id_col] + [c for c in reviews.columns if c not in (id_col, text_col)]
    split = F.posexplode_outer(split_sentences(F.col(text_col), abbreviations))
    return reviews.select(*kept, split.alias("sentence_id", "sentence")).filter(
        F.col("sentence_id").isNotNull()
    )
