"""Rule-and-lexicon sentiment as one in-row expression.

The method is the published five-heuristic scorer: word valences, degree words
and negations in the three preceding words, capitals, the contrast word and
punctuation, normalised to [-1, 1].  The lexicon is data the caller supplies.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.text import bind, words
from facetry.functions.wordlists import (
    AFTER_CONTRAST,
    BEFORE_CONTRAST,
    BOOST_DECAY,
    CAPS_BOOST,
    CLASS_ORDER,
    DEFAULT_BOOSTERS,
    DEFAULT_CONTRASTS,
    DEFAULT_NEGATIONS,
    DEFAULT_VALENCE,
    EXCLAMATION_MAX,
    EXCLAMATION_STEP,
    LABEL_ALIASES,
    NEGATION_FACTOR,
    NEGATIVE_FROM,
    NORMALISER,
    POSITIVE_FROM,
    QUESTION_CAP,
    QUESTION_MAX,
    QUESTION_STEP,
)

MICRO = 1_000_000.0


@dataclass(frozen=True)
class Lexicon:
    """Lower-case words with valence, degree words, negations and contrast words.

    Words are written into the plan; many valences belong into a table, see
    ``operators.sentiment.compound_by_table``.
    """

    valence: Mapping[str, float] = field(default_factory=lambda: DEFAULT_VALENCE)
    boosters: Mapping[str, float] = field(default_factory=lambda: DEFAULT_BOOSTERS)
    negations: Sequence[str] = field(default_factory=lambda: DEFAULT_NEGATIONS)
    contrasts: Sequence[str] = field(default_factory=lambda: DEFAULT_CONTRASTS)


DEFAULT_LEXICON = Lexicon()


def lookup(word: Column, table: Mapping[str, float], default: float | None = None) -> Column:
    """Value of a word in a bounded dictionary, as hash-set tests grouped by value."""
    groups: dict[float, list[str]] = {}
    for key, value in table.items():
        groups.setdefault(float(value), []).append(key)
    result = F.when(F.lit(False), F.lit(None).cast("double"))
    for value, members in groups.items():
        result = result.when(word.isin(*members), F.lit(value))
    return result if default is None else result.otherwise(F.lit(default))


def is_capitals(word: Column) -> Column:
    """At least one letter and no lower-case letter."""
    return (word == F.upper(word)) & (word != F.lower(word))


def is_negation(word: Column, lexicon: Lexicon) -> Column:
    return word.isin(*lexicon.negations) | word.contains("n't")


def is_scored(word: Column, lexicon: Lexicon) -> Column:
    """Has a valence and is not a degree word."""
    hit = word.isin(*lexicon.valence)
    both = [b for b in lexicon.boosters if b in lexicon.valence]
    return hit & ~word.isin(*both) if both else hit


def with_context(
    valence: Column, lowered: Column, original: Column, known: Column, mixed_case: Column,
    distance: int, lexicon: Lexicon,
) -> Column:
    """Apply the word ``distance`` places before to a running valence.

    A word that has a valence itself, or that does not exist (NULL), changes nothing.
    """
    sign = F.when(valence < 0, -1.0).otherwise(1.0)
    boost = lookup(lowered, lexicon.boosters, 0.0)
    caps = F.when((boost != 0.0) & mixed_case & is_capitals(original), CAPS_BOOST).otherwise(0.0)
    boosted = valence + (boost + caps) * sign * F.lit(BOOST_DECAY[distance - 1])
    factor = F.when(is_negation(lowered, lexicon), NEGATION_FACTOR).otherwise(1.0)
    return F.when(lowered.isNull() | known, valence).otherwise(boosted * factor)


def to_micro(value: Column) -> Column:
    """Whole micro-units, so that sums do not depend on the order of rows."""
    return F.floor(value * F.lit(MICRO) + F.lit(0.5)).cast("bigint")


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of a score."""
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    def questions(n: Column) -> Column:
        return (
            F.when(n <= 1, 0.0).when(n <= QUESTION_MAX, n * F.lit(QUESTION_STEP))
            .otherwise(QUESTION_CAP)
        )

    return (
        F.least(count("!"), F.lit(EXCLAMATION_MAX)) * F.lit(EXCLAMATION_STEP)
        + questions(count("?"))
    )


def squash(total: Column, extra: Column) -> Column:
    """Add emphasis in the direction of the total and normalise to [-1, 1]."""
    def shaped(s: Column) -> Column:
        return F.round(s / F.sqrt(s * s + F.lit(NORMALISER)), 4)

    return F.when(total > 0, shaped(total + extra)).when(total < 0, shaped(total - extra)).otherwise(0.0)


def compound(text: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Compound score of a text in [-1, 1]; blank or NULL gives 0.0."""
    return bind(F.coalesce(text, F.lit("")), lambda t: _compound(t, lexicon))


def _compound(text: Column, lexicon: Lexicon) -> Column:

    def score(w: Column, low: Column, hits: Column) -> Column:
        mixed_case = F.exists(w, is_capitals) & F.exists(w, lambda t: ~is_capitals(t))
        turn = F.array_position(
            F.transform(low, lambda t: t.isin(*lexicon.contrasts)), F.lit(True)
        )

        def with_flags(flag: Column, pivot: Column) -> Column:
            def one(i: Column) -> Column:
                start = lookup(F.get(low, i), lexicon.valence)
                caps = F.when(
                    flag & is_capitals(F.get(w, i)), F.when(start > 0, CAPS_BOOST).otherwise(-CAPS_BOOST)
                ).otherwise(0.0)

                def step(value: Column, distance: int) -> Column:
                    return bind(
                        F.struct(
                            F.get(low, i - distance).alias("low"), F.get(w, i - distance).alias("word"),
                            value.alias("value"),
                        ),
                        lambda s: with_context(
                            s["value"], s["low"], s["word"], s["low"].isin(*lexicon.valence), flag,
                            distance, lexicon,
                        ),
                    )

                value = start + caps
                for distance in range(1, len(BOOST_DECAY) + 1):
                    value = step(value, distance)
                side = (
                    F.when((pivot == 0) | (pivot == i + 1), 1.0)
                    .when(i + 1 < pivot, BEFORE_CONTRAST).otherwise(AFTER_CONTRAST)
                )
                return to_micro(value * side)

            return F.aggregate(F.transform(hits, one), F.lit(0).cast("bigint"), lambda a, x: a + x)

        micro = bind(mixed_case, lambda flag: bind(turn, lambda pivot: with_flags(flag, pivot)))
        return F.when(F.size(hits) == 0, F.lit(0).cast("bigint")).otherwise(micro)

    def hit_positions(low: Column) -> Column:
        marked = F.transform(low, lambda t, i: F.when(is_scored(t, lexicon), i))
        return F.filter(marked, lambda i: i.isNotNull())

    total = bind(
        words(text),
        lambda w: bind(
            F.transform(w, F.lower),
            lambda low: bind(hit_positions(low), lambda hits: score(w, low, hits)),
        ),
    )
    return bind(total / F.lit(MICRO), lambda t: bind(emphasis(text), lambda extra: squash(t, extra)))


def label_sentiment(
    score: Column, positive_from: float = POSITIVE_FROM, negative_from: float = NEGATIVE_FROM
) -> Column:
    """positive / negative / neutral; both thresholds are inclusive, positive first."""
    return (
        F.when(score >= positive_from, "positive").when(score <= negative_from, "negative")
        .otherwise("neutral")
    )


def normalize_label(raw: Column) -> Column:
    """Map the spellings models use to the three labels; anything else is an error."""
    key = F.lower(F.trim(raw.cast("string")))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for label in dict.fromkeys(LABEL_ALIASES.values()):
        out = out.when(key.isin(*[k for k, v in LABEL_ALIASES.items() if v == label]), label)
    return out.otherwise(
        F.raise_error(F.concat(F.lit("Unrecognized sentiment label from model: "), F.coalesce(raw.cast("string"), F.lit("NULL"))))
    )


def class_scores(logits: Column, labels: Sequence[str] = CLASS_ORDER) -> Column:
    """``struct(label, score)`` from raw class scores: argmax and P(pos) - P(neg).

    Ties go to the first class; a class the model lacks counts as probability 0.
    """
    def probability(p: Column, name: str) -> Column:
        return F.get(p, F.lit(labels.index(name))) if name in labels else F.lit(0.0)

    def softmax(x: Column) -> Column:
        return bind(
            F.transform(x, lambda v: F.exp(v - F.array_max(x))),
            lambda e: bind(
                F.aggregate(e, F.lit(0.0), lambda a, v: a + v),
                lambda s: F.transform(e, lambda v: v / s),
            ),
        )

    names = F.array(*[F.lit(name) for name in labels])
    return bind(
        bind(logits.cast("array<double>"), softmax),
        lambda p: F.struct(
            F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int")).alias("label"),
            (probability(p, "positive") - probability(p, "negative")).alias("score"),
        ),
    )


__all__ = [
    "DEFAULT_LEXICON", "Lexicon", "class_scores", "compound", "has_text", "label_sentiment",
    "normalize_label",
]
