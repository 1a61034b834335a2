"""Cleaning of identifiers and of words that stand for a missing value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space at the ends of a key.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Words that say that there is no value.
NO_VALUE_WORDS = (
    "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "undefined", "unknown",
    "keine", "unbekannt", "нет", "неизвестно",
)


def trimmed(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE_SPACE))


def has_value(c: Column | str) -> Column:
    """False for null, blank and the words of :data:`NO_VALUE_WORDS`; never null."""
    t = F.lower(trimmed(c))
    return F.coalesce((t != "") & ~t.isin(*NO_VALUE_WORDS), F.lit(False))


def unit_interval(c: Column | str) -> Column:
    """The number where it lies in 0..1, else null (also for NaN)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (c >= 0) & (c <= 1), c)
