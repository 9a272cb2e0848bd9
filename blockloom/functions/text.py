"""String helpers shared by all operators. All of them are JVM-side Columns."""

from __future__ import annotations

import re
import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Word characters: letters, numbers (so that one-half counts as one), underscore.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

# Item texts that are headings or nutrition lines, not items.
HEADING_ITEM = r"(?i)^for the "
NUTRITION_ITEM = r"(?i)^(calories|fat|saturated fat|carbohydrates|sugar|fiber|protein|sodium|cholesterol)[:\\-]\s*\d+"


@lru_cache(maxsize=1)
def digit_class() -> str:
    """Character class of everything str.isdigit() accepts, as ranges.

    Built from the interpreter's own Unicode tables; it is wider than Nd
    (superscripts, circled digits) and excludes fractions.
    """
    ranges: list[list[int]] = []
    for cp in range(sys.maxunicode + 1):
        if chr(cp).isdigit():
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[" + "".join(
        chr(lo) if lo == hi else f"{chr(lo)}-{chr(hi)}" for lo, hi in ranges
    ) + "]"


@lru_cache(maxsize=1)
def digit() -> str:
    """Regex for one digit; most characters are ruled out before the many ranges are tried."""
    return rf"[0-9]|(?=[^\x00-\x7f]){digit_class()}"


def strip(col: Column) -> Column:
    """Remove Unicode whitespace at both ends (plain trim() only removes U+0020)."""
    return F.btrim(col, F.lit(WHITESPACE))


def normalise(col: Column) -> Column:
    """Strip, then lowercase."""
    return F.lower(strip(col))


def is_digits(col: Column) -> Column:
    """Whole string is digits (and not empty)."""
    return col.rlike(f"^(?:{digit()})++\\z")


def count_digits(col: Column) -> Column:
    return F.char_length(col) - F.char_length(
        F.regexp_replace(col, F.lit(digit()), F.lit(""))
    )


def count_char(col: Column, char: str) -> Column:
    return F.char_length(col) - F.char_length(F.replace(col, F.lit(char), F.lit("")))


def any_of(words: list[str] | tuple[str, ...]) -> str:
    """Regex alternation of literal words."""
    return "|".join(re.escape(w) for w in words)


def whole_word(words: list[str] | tuple[str, ...]) -> str:
    """Regex that finds any of the words standing alone."""
    return f"(?:^|{NOT_WORD})(?:{any_of(words)})(?:{NOT_WORD}|\\z)"


def clean_items(items: Column) -> Column:
    """Strip and lowercase items; drop blank and digits-only ones (group counters)."""
    stripped = F.transform(F.coalesce(items, F.array().cast("array<string>")), strip)
    kept = F.filter(stripped, lambda i: (i != "") & ~is_digits(i))
    return F.transform(kept, F.lower)


def nonblank_items(items: Column) -> Column:
    """Lowercase items, dropping only nulls and empty strings (digits stay)."""
    present = F.filter(
        F.coalesce(items, F.array().cast("array<string>")),
        lambda i: i.isNotNull() & (i != ""),
    )
    return F.transform(present, F.lower)


def is_boilerplate_item(text: Column) -> Column:
    """True for sub-headings ("For the ...") and nutrition lines."""
    t = strip(text)
    return t.rlike(HEADING_ITEM) | t.rlike(NUTRITION_ITEM)


def contains_any(text: Column, items: Column) -> Column:
    """Some non-empty item is a substring of text; stops at the first hit."""
    return F.coalesce(
        F.exists(items, lambda i: (i != "") & F.contains(text, i)), F.lit(False)
    )
