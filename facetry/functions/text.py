"""Text cleaning, sentence splitting and tokenising as native column expressions.

All functions take and return a ``Column``.  None of them shuffles or leaves the
JVM, so they can sit directly above a scan, in a batch or a streaming query.
"""

from __future__ import annotations

import json
import re
import string
from collections.abc import Callable, Sequence
from functools import reduce
from html.entities import html5
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetry.functions.wordlists import DEFAULT_ABBREVIATIONS

# Unicode white space written out, because `\s` is ASCII-only in Java regexes.
SPACE_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
SPACE = r"\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# The same without the blank, and runs that are not already one blank: most text has
# single blanks only, and leaving those alone saves most of the work.  A class of many
# ranges is tried range by range, so the printable characters are ruled out before it.
OTHER_SPACE = SPACE.replace(r"\s", r"\t\n\f\r")
ODD_SPACE = f"(?![ -~])[{OTHER_SPACE}]"
SPACE_RUN = f"(?![!-~])(?: (?![!-~])[{SPACE}]|{ODD_SPACE})[{SPACE}]*+"

# The patterns that decide what counts as markup, URL and word.
TAG_PATTERN = r"<[^>]+>"
URL_PATTERN = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
LETTERS = r"a-zA-Z0-9\p{L}\p{N}"
TOKEN_PATTERN = rf"[{LETTERS}]++(?:['\u2019\-]++[{LETTERS}]++)*+|(?! )[^{SPACE}{LETTERS}]"
PUNCTUATION = string.punctuation
_MARKS = re.sub(r"([\[\]\\^&-])", r"\\\1", PUNCTUATION)
# A word between blanks with three or more characters from its first to its last unmarked one.
# One without any mark would be replaced by itself, so it is passed over.
MARKED_WORD = rf"(?<![^ ])(?![^ {_MARKS}]++(?![^ ]))[{_MARKS}]*+([^ {_MARKS}][^ ]+[^ {_MARKS}])[{_MARKS}]*+(?![^ ])"

# U+0001 marks a boundary between replace and split; a single plain character
# lets `split` skip the regex engine.
MARK = "\x01"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is the only way to name an intermediate result inside one
    expression; writing the value twice would compute it twice.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def has_text(text: Column) -> Column:
    """True when the value holds at least one non-space character."""
    return text.isNotNull() & text.rlike(f"[^{SPACE}]")


# --------------------------------------------------------------------------
# HTML entities
# --------------------------------------------------------------------------

_ENTITY = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_ENTITY_TABLE = json.dumps(html5)
# Names that also count without a semicolon, at the start of a longer word.
_LEGACY = "^(" + "|".join(sorted((n for n in html5 if ";" not in n), key=len, reverse=True)) + ")"
_FREQUENT = ["amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;", "copy;", "middot;", "hellip;"]
# Numeric references 128..159 mean Windows-1252 characters.
_WINDOWS_1252 = "".join(bytes([c]).decode("cp1252", errors="ignore") or chr(c) for c in range(0x80, 0xA0))


def _code_point(code: Column) -> Column:
    """The character for a numeric reference, by the HTML5 rules."""
    dropped = (
        code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    )
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), "\ufffd")
        .when(code.between(0x80, 0x9F), F.substring(F.lit(_WINDOWS_1252), (code - 0x7F).cast("int"), F.lit(1)))
        .when(dropped, "")
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _numeric_reference(entity: Column) -> Column:
    digits = F.regexp_replace(entity, "^#[xX]?0*|;", "")
    number = F.when(F.lower(entity).startswith("#x"), F.conv(digits, 16, 10)).otherwise(digits)
    # More than ten digits lie past the last code point in either base.
    code = F.when(
        digits == "", F.lit(0).cast("bigint")
    ).when(F.length(digits) <= 10, number.cast("bigint"))
    return bind(code, _code_point)


def unescape_entities(text: Column) -> Column:
    """Decode named and numeric HTML entities; anything unknown stays as it is."""
    names = F.from_json(F.lit(_ENTITY_TABLE), "map<string,string>")

    def named(entity: Column) -> Column:
        value = F.when(entity == "", None)
        for name in _FREQUENT:
            value = value.when(entity == name, html5[name])
        return value.otherwise(F.try_element_at(names, entity))

    def decode(piece: Column) -> Column:
        def replaced(entity: Column) -> Column:
            rest = F.substring(piece, F.length(entity) + 1, F.length(piece))
            return F.coalesce(
                F.concat(
                    F.when(entity.startswith("#"), _numeric_reference(entity)).otherwise(named(entity)),
                    rest,
                ),
                bind(
                    F.regexp_extract(entity, _LEGACY, 1),
                    lambda prefix: F.when(
                        prefix != "",
                        F.concat(
                            F.try_element_at(names, prefix),
                            F.substring(piece, F.length(prefix) + 1, F.length(piece)),
                        ),
                    ),
                ),
                F.concat(F.lit("&"), piece),
            )

        return bind(F.regexp_extract(piece, _ENTITY, 1), replaced)

    decoded = F.array_join(
        F.transform(F.split(text, "&"), lambda piece, i: F.when(i == 0, piece).otherwise(decode(piece))), ""
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# --------------------------------------------------------------------------
# Cleaning, sentences, words
# --------------------------------------------------------------------------

def clean_text(text: Column) -> Column:
    """Unescape entities, drop tags and URLs, collapse white space, strip.

    Case and punctuation stay, because the sentence and sentiment rules use them.
    """
    def dropped(value: Column, signs: Sequence[str], pattern: str) -> Column:
        """Without the pattern's matches, each of which holds one of the signs."""
        def body(t: Column) -> Column:
            found = reduce(or_, [F.contains(t, F.lit(sign)) for sign in signs])
            return F.when(found, F.regexp_replace(t, pattern, " ")).otherwise(t)

        return bind(value, body)

    out = unescape_entities(F.coalesce(text.cast("string"), F.lit("")))
    out = dropped(out, ["<"], TAG_PATTERN)
    out = dropped(out, ["http", "www."], URL_PATTERN)
    return F.trim(F.regexp_replace(out, SPACE_RUN, " "))


def sentence_boundary(abbreviations: Sequence[str] = DEFAULT_ABBREVIATIONS) -> str:
    """Regex for the white space between two sentences.

    A boundary follows ``. ! ?`` and up to three closing quotes or brackets.  It is
    not taken after a listed abbreviation, after a single initial, or when an
    ellipsis runs on in lower case.
    """
    start = r"(?<![\p{L}\p{N}])"
    guards = rf"(?<!{start}[A-HJ-Z]\.)"
    if abbreviations:
        guards += rf"(?<!{start}(?:{'|'.join(re.escape(a) for a in abbreviations)})\.)"
    gap = f"[{SPACE}]++"
    # First of all the next character must not be a printable one other than the blank.
    return (
        rf"(?![!-~])(?<=[.!?][\"'”’)\]]{{0,3}}){guards}"
        rf"(?:(?<!\.\.){gap}|(?<=\.\.){gap}(?!\p{{Ll}}))"
    )


def split_sentences(text: Column, abbreviations: Sequence[str] = DEFAULT_ABBREVIATIONS) -> Column:
    """Array of stripped, non-empty sentences; blank or NULL text gives an empty array."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), sentence_boundary(abbreviations), MARK)
    return F.filter(F.transform(F.split(marked, MARK), strip), lambda s: s != "")


def words(text: Column) -> Column:
    """White-space words without surrounding punctuation.

    A word of two characters or fewer after stripping keeps its punctuation, so
    emoticons such as ``:)`` survive for the sentiment lexicon.
    """
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), ODD_SPACE, " ")
    return F.filter(F.split(F.regexp_replace(plain, MARKED_WORD, "$1"), " "), lambda w: w != "")


def tokens(sentence: Column) -> Column:
    """Words and single punctuation marks, in order."""
    return F.regexp_extract_all(F.coalesce(sentence, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))
