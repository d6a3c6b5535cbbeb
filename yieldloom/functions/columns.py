"""Column expressions that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def canonical(name: str | Column) -> Column:
    """One spelling of a tool or a line: upper case without outer blanks; null stays null."""
    return F.upper(F.trim(F.col(name) if isinstance(name, str) else name))


def number(name: str | Column) -> Column:
    """The value, or null where it is null or NaN."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(~F.isnan(c), c)


def rounded(name: str | Column, places: int) -> Column:
    """Rounded, ties up: what lies within 1e-9 below a tie counts as one, so that the order of summing doesn't decide."""
    return F.round((F.col(name) if isinstance(name, str) else name) + 1e-9, places)


def content_hash(columns: list[str]) -> Column:
    """64-bit hash of several columns. xxhash64 skips nulls, so where they stand is hashed too."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in columns])
    return F.xxhash64(*[F.col(c) for c in columns], nulls)


def between(name: str | Column, low: float, high: float) -> Column:
    """True only for a number inside the closed interval; false, never null, otherwise."""
    c = F.col(name) if isinstance(name, str) else name
    return F.coalesce(~F.isnan(c) & (c >= low) & (c <= high), F.lit(False))
