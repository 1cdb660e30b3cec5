"""Term normalisation and theme lookup as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.text import SPACE_RUN, bind, strip
from facetry.functions.wordlists import THEME_KEYWORDS


def singular(word: Column) -> Column:
    """Suffix rules for the last word of a term; crude on purpose."""
    def cut(n: int) -> Column:
        return F.substring(word, F.lit(1), F.length(word) - n)

    return (
        F.when(word.endswith("ies") & (F.length(word) > 3), F.concat(cut(3), F.lit("y")))
        .when(word.endswith("es") & word.rlike("(s|x|z|ch|sh)es$"), cut(2))
        .when(word.endswith("s") & ~word.endswith("ss") & (F.length(word) > 3), cut(1))
        .otherwise(word)
    )


def normalize_term(term: Column) -> Column:
    """Lower-case, strip, collapse spaces, make the last word singular."""
    text = F.regexp_replace(strip(F.lower(term.cast("string"))), SPACE_RUN, " ")

    def last_singular(t: Column) -> Column:
        last = F.substring_index(t, " ", -1)
        head = F.substring(t, F.lit(1), F.length(t) - F.length(last))
        return F.concat(head, singular(last))

    return bind(text, last_singular)


def match_theme(normal: Column, themes: Mapping[str, Sequence[str]] = THEME_KEYWORDS) -> Column:
    """First theme, in dictionary order, with a keyword inside the normalised term.

    Keywords are written into the plan; a large set belongs into a table, see
    ``operators.themes.assign_themes_by_table``.
    """
    theme = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, keywords in themes.items():
        hit = F.lit(False)
        for keyword in keywords:
            hit = hit | normal.contains(keyword)
        theme = theme.when(hit, name)
    return theme


def assign_theme(
    term: Column, fallback_to_term: bool = True, themes: Mapping[str, Sequence[str]] = THEME_KEYWORDS
) -> Column:
    """Theme of a term; without a match the normalised term itself, or ``other``."""
    return bind(
        normalize_term(term),
        lambda n: F.coalesce(match_theme(n, themes), n if fallback_to_term else F.lit("other")),
    )
