"""Page and query text to normalised terms, as built-in JVM expressions.

A term is made in this order: punctuation becomes white space, the text is split on white
space, each piece is lower-cased, put in Unicode form NFKD and stripped of combining marks.
The pieces are kept apart by ``\\n``, which no later step removes or produces, so every step
runs once on the whole text of a row and nothing is exploded until the terms are needed.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words besides white space.
PUNCTUATION = "’'/-,!?.*()"

# White space, with the four separators U+001C to U+001F.
WHITE_SPACE = r"\p{IsWhite_Space}\x1c-\x1f"

_SPLIT_PLAIN = f"[{WHITE_SPACE}]+"
_SPLIT_PUNCT = "[" + re.escape(PUNCTUATION) + WHITE_SPACE + "]+"


@cache
def combining_mark_pattern() -> str:
    """Regex of every character with a non-zero canonical combining class.

    Marks and characters unknown to the JVM are tested first: that rejects ordinary letters at
    once, so the long list of ranges only runs where it can match.
    """
    marks = [c for c in range(0x110000) if unicodedata.combining(chr(c))]
    ranges, start = [], marks[0]
    for here, following in zip(marks, marks[1:] + [None]):
        if following != here + 1:
            ranges.append(rf"\x{{{start:x}}}-\x{{{here:x}}}")
            start = following
    return r"[[\p{M}\p{Cn}]&&[" + "".join(ranges) + "]]+"


def fold(text: Column) -> Column:
    """Lower case, NFKD and no combining marks. ASCII text needs the first step only."""
    lowered = F.lower(text)
    decomposed = F.java_method(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), lowered, F.lit(True)
    )
    is_ascii = F.octet_length(lowered) == F.length(lowered)
    return F.when(is_ascii, lowered).otherwise(
        F.regexp_replace(decomposed, combining_mark_pattern(), "")
    )


def raw_tokens(text: Column, strip_punct: bool = True) -> Column:
    """Words of a text as written, in order; no empty words. NULL text has no words."""
    separators = _SPLIT_PUNCT if strip_punct else _SPLIT_PLAIN
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def terms(text: Column, strip_punct: bool = True) -> Column:
    """Normalised terms of a text, in order, repeats kept.

    A word made of combining marks only leaves nothing and is dropped.
    """
    separators = _SPLIT_PUNCT if strip_punct else _SPLIT_PLAIN
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), separators, "\n")
    return F.array_remove(F.split(fold(joined), "\n"), "")


def query_terms(query: Column, strip_punct: bool = False) -> Column:
    """Terms of a search query. Punctuation stays inside the words unless asked otherwise."""
    return terms(query, strip_punct)


def run_starts(sorted_terms: Column) -> Column:
    """Positions in a sorted term array where a new term begins."""
    return F.array_compact(
        F.transform(
            sorted_terms,
            lambda term, at: F.when((at == 0) | (term != F.get(sorted_terms, at - 1)), at),
        )
    )


def strip(text: Column) -> Column:
    """Text without white space at its ends, by the same white space that separates words."""
    return F.regexp_replace(text, rf"^[{WHITE_SPACE}]+|[{WHITE_SPACE}]+\z", "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
