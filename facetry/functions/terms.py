"""Aspect terms: token tags, noun runs and term validity, all inside the row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.text import MARK, TOKEN_PATTERN, bind, strip, tokens
from facetry.functions.wordlists import (
    DEFAULT_SUFFIX_TAGS,
    DEFAULT_TAGS,
    MAX_TERM_WORDS,
    MIN_TERM_LENGTH,
    NOISE_TERMS,
)

# Title case: every run of cased letters starts upper and goes on lower.
TITLE_CASE = (
    r"^[^\p{Lu}\p{Ll}]*\p{Lu}\p{Ll}*"
    r"(?:[^\p{Lu}\p{Ll}]+\p{Lu}\p{Ll}*)*+[^\p{Lu}\p{Ll}]*$"
)


@dataclass(frozen=True)
class TagRules:
    """Dictionary, then ordered suffix rules, then a default tag.

    Words are written into the plan; a large dictionary belongs into a table, see
    ``operators.mentions.mentions_by_table``.
    """

    words: Mapping[str, Sequence[str]] = field(default_factory=lambda: DEFAULT_TAGS)
    suffixes: Sequence[tuple[str, str]] = field(default_factory=lambda: DEFAULT_SUFFIX_TAGS)
    default: str = "NN"

    def __call__(self, token: Column) -> Column:
        """Tag of a token; a token without a letter is ``SYM``."""
        tag = F.when(~token.rlike(r"\p{L}"), "SYM")
        for name, members in self.words.items():
            tag = tag.when(token.isin(*members), name)
        for suffix, name in self.suffixes:
            tag = tag.when(token.endswith(suffix), name)
        return tag.otherwise(self.default)

    def is_noun(self, token: Column) -> Column:
        """Whether the tag starts with NN, as one hash-set test and the suffix rules."""
        other = [w for name, words in self.words.items() if not name.startswith("NN") for w in words]
        nouns = [w for name, words in self.words.items() if name.startswith("NN") for w in words]
        return (
            ~token.isin(*other)
            & (token.isin(*nouns) | self.noun_by_suffix(token))
            & token.rlike(r"\p{L}")
        )

    def noun_by_suffix(self, token: Column) -> Column:
        """Whether the suffix rules and the default alone make the token a noun.

        A rule that agrees with the default is tested only if a later rule with
        the other outcome could match the same token.
        """
        noun = self.default.startswith("NN")
        rules = [(suffix, name.startswith("NN")) for suffix, name in self.suffixes]
        overlaps = lambda a, b: a.endswith(b) or b.endswith(a)
        kept = [
            (suffix, outcome) for i, (suffix, outcome) in enumerate(rules)
            if outcome != noun
            or any(other != noun and overlaps(suffix, later) for later, other in rules[i + 1:])
        ]
        if all(outcome != noun for _, outcome in kept):
            hit = F.lit(False)
            for suffix, _ in kept:
                hit = hit | token.endswith(suffix)
            return ~hit if noun else hit
        verdict = F.when(F.lit(False), F.lit(False))
        for suffix, outcome in kept:
            verdict = verdict.when(token.endswith(suffix), outcome)
        return verdict.otherwise(noun)


DEFAULT_RULES = TagRules()


def lower_title_start(sentence: Column) -> Column:
    """Lower-case the first token when it is in title case; acronyms stay."""
    return bind(
        F.regexp_extract(sentence, f"^(?:{TOKEN_PATTERN})", 0),
        lambda first: F.when(
            first.rlike(TITLE_CASE),
            F.concat(F.lower(first), F.substring(sentence, F.length(first) + 1, F.length(sentence))),
        ).otherwise(sentence),
    )


def noun_runs(sentence: Column, is_noun: Callable[[Column], Column] = DEFAULT_RULES.is_noun) -> Column:
    """Maximal runs of nouns, lower-cased and joined by one space."""
    return token_runs(sentence_tokens(sentence), is_noun)


def sentence_tokens(sentence: Column) -> Column:
    """Tokens of a sentence, the first one lower-cased when it is in title case."""
    return tokens(bind(strip(sentence), lower_title_start))


def token_runs(split: Column, is_noun: Callable[[Column], Column]) -> Column:
    """``noun_runs`` of the tokens.

    Other tokens become a separator, so joining and splitting finds the runs in
    linear time without a nested regex.
    """
    kept = F.transform(split, lambda t: F.when(is_noun(t), t).otherwise(MARK))
    runs = F.split(F.lower(F.array_join(kept, " ")), MARK)
    return F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != "")


def is_valid_term(
    term: Column,
    min_length: int = MIN_TERM_LENGTH,
    max_words: int = MAX_TERM_WORDS,
    noise: Sequence[str] = NOISE_TERMS,
) -> Column:
    """Long enough, few enough words, not a noise word, two letters in some word."""
    n_words = F.length(term) - F.length(F.replace(term, F.lit(" "), F.lit(""))) + 1
    two_letters = term.rlike(r"\p{L}[^ \p{L}]*\p{L}")
    return (
        (F.length(term) >= min_length) & (n_words <= max_words) & ~term.isin(*noise) & two_letters
    )


def distinct_terms(terms: Column) -> Column:
    """Drop repeats; the first occurrence keeps its place."""
    return F.array_distinct(terms)


def aspect_terms(
    sentence: Column,
    is_noun: Callable[[Column], Column] = DEFAULT_RULES.is_noun,
    min_length: int = MIN_TERM_LENGTH,
    max_words: int = MAX_TERM_WORDS,
) -> Column:
    """Array of aspect terms of one sentence; blank gives an empty array."""
    return token_terms(sentence_tokens(sentence), is_noun, min_length, max_words)


def token_terms(
    split: Column,
    is_noun: Callable[[Column], Column] = DEFAULT_RULES.is_noun,
    min_length: int = MIN_TERM_LENGTH,
    max_words: int = MAX_TERM_WORDS,
) -> Column:
    """``aspect_terms`` of the tokens of a sentence, for callers that read them more than once."""
    valid = F.filter(token_runs(split, is_noun), lambda t: is_valid_term(t, min_length, max_words))
    return distinct_terms(valid)
