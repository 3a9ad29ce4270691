"""Expressions for identifiers and idempotency keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and the zero-width space, as a Java character class.
OUTER = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]"


def clean_key(col: Column) -> Column:
    """Key without outer white space and letter case; null for a missing or blank one."""
    trimmed = F.lower(F.regexp_replace(col, f"^{OUTER}+|{OUTER}+$", ""))
    return F.when(F.length(trimmed) > 0, trimmed)


def effective_key(own: Column, outer: Column) -> Column:
    """The operation's own key, or the enclosing request's if the own is missing."""
    return F.coalesce(clean_key(own), clean_key(outer))


def identity128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a tuple of columns: 128 bits, enough for 10^15 identities.

    Lengths take part, so that ('a', 'bc') and ('ab', 'c') differ; a null differs from an empty string.
    """
    parts = [x for c in cols for x in (F.coalesce(F.length(c), F.lit(-1)), c)]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *reversed(parts))
