"""Scalar Column helpers (T1-T16 of the survey), all built-in Spark expressions.

Nothing here is a Python UDF: every helper returns a Column that stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true, i.e.
# what str.strip() removes. Listed as code points in ascending order.
PY_WHITESPACE_CODEPOINTS = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0,
    0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
    0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)

PY_WHITESPACE = "".join(chr(cp) for cp in PY_WHITESPACE_CODEPOINTS)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` (all Unicode whitespace), null stays null.

    ``F.trim`` without a set strips spaces only, and Java's ``\\s`` misses most
    of the Unicode space characters, hence the explicit set. ``trim`` with a
    set compares whole code points and touches only the two ends, so it costs
    nothing on long texts (a regex scans the whole string).
    """
    return F.trim(col_(c), F.lit(PY_WHITESPACE))


def blank_if_null(c) -> Column:
    """``(x or "").strip()`` for a string column."""
    return F.coalesce(py_strip(c), F.lit(""))


def or_default(c, default) -> Column:
    """Python ``x or default`` for strings: null and '' fall back."""
    return F.coalesce(F.nullif(col_(c), F.lit("")), F.lit(default) if not isinstance(default, Column) else default)


def norm_title(c) -> Column:
    """Dedup title key: stripped and lower-cased; non-strings become ''."""
    return F.coalesce(F.lower(py_strip(c)), F.lit(""))


def year_of(date_str) -> Column:
    """T4: year of a date string as the reference reads it.

    ``int(s[:4])`` when the first (up to) four characters are all digits,
    else null. ``\\z`` (not ``$``) so a trailing newline does not match.
    """
    head = F.substring(col_(date_str), 1, 4)
    return F.when(head.rlike("^[0-9]{1,4}\\z"), head.cast("int"))


def year_passes(year: Column, lo, hi) -> Column:
    """Inclusive, null-tolerant year range. A null or zero year passes;
    a null/absent bound is unbounded."""
    lo_c = F.lit(lo).cast("int") if not isinstance(lo, Column) else lo
    hi_c = F.lit(hi).cast("int") if not isinstance(hi, Column) else hi
    unknown = year.isNull() | (year == 0)
    lo_ok = lo_c.isNull() | (lo_c == 0) | (year >= lo_c)
    hi_ok = hi_c.isNull() | (hi_c == 0) | (year <= hi_c)
    return unknown | (lo_ok & hi_ok)


def contains_ci(haystack, needle) -> Column:
    """T10 with T2: case-insensitive substring test."""
    n = needle if isinstance(needle, Column) else F.lit(needle)
    return F.contains(F.lower(col_(haystack)), F.lower(n))


def any_contains_ci(arr, needle) -> Column:
    """Some element of a string array contains the needle,
    case-insensitively. A null element is a non-match (the reference raises)."""
    n = needle if isinstance(needle, Column) else F.lit(needle)
    return F.coalesce(
        F.exists(col_(arr), lambda a: F.coalesce(F.contains(F.lower(a), F.lower(n)), F.lit(False))),
        F.lit(False),
    )


def minute_text(ts) -> Column:
    """``strftime('%Y-%m-%d %H:%M')``."""
    return F.date_format(col_(ts), "yyyy-MM-dd HH:mm")


def long_minute_text(ts) -> Column:
    """``strftime('%d %B %Y à %H:%M')``, the discussion list's format."""
    return F.date_format(col_(ts), "dd MMMM yyyy 'à' HH:mm")


def split_tokens(c, delimiter: str = ";") -> Column:
    """T5 + T1 + T2: split on a literal delimiter, strip, lower, drop empties."""
    import re

    parts = F.split(F.coalesce(col_(c), F.lit("")), re.escape(delimiter))
    return F.filter(F.transform(parts, lambda t: F.lower(py_strip(t))), lambda t: t != "")
