"""Null policy, missing-value words and number formatting shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that only say that there is no value (compared trimmed, lower case).
MISSING_WORDS = (
    "", "-", "--", "---", ".", "?", "na", "n/a", "n.a.", "n.a", "n / a", "#n/a", "nan", "null", "none", "nil",
    "empty", "unknown", "not available", "not applicable", "not provided", "not specified", "not reported",
    "not recorded", "not determined", "not collected", "not known", "missing", "undefined", "unspecified",
    "no value", "no data", "blank", "tbd", "(null)", "<na>", "(none)", "(blank)", "(empty)",
)

BLANKS = "[\\s\\p{Z}\\uFEFF\\u200B]+"


def squeezed(col: Column | str) -> Column:
    """Lower case, every run of white space one blank, no blank at the ends."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.lower(F.regexp_replace(c, BLANKS, " ")))


def is_missing(col: Column | str) -> Column:
    """True for null, blank and the words of ``MISSING_WORDS``; never null."""
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | squeezed(c).isin(*MISSING_WORDS)


def present(col: Column | str) -> Column:
    """The value itself, or null where it is missing."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~is_missing(c), c)


def is_measured(col: Column | str) -> Column:
    """True for a finite number above 0; never null (null, NaN, infinities and 0 are not measured)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce((c > 0) & (c < F.lit(float("inf"))), F.lit(False))


def measured(col: Column | str) -> Column:
    """The value as double where it is measured, else null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_measured(c), c.cast("double"))


def log2_rounded(col: Column, digits: int = 9) -> Column:
    """log2 of a positive sum, rounded so that the order of summation does not show."""
    return F.round(F.log2(col.cast("double")), digits)


def log2_positive(col: Column | str) -> Column:
    """log2 of positive finite values, null otherwise."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(is_measured(c), F.log2(c.cast("double")))
