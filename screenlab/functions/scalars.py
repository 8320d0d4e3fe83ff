"""Numbers as column expressions; missing is NULL throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for a missing number.
MISSING = ("", "NA", "NaN", "nan")


def observed(x: Column) -> Column:
    """NaN becomes NULL, so that aggregates skip it."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def number(x: Column) -> Column:
    """Text to double; missing markers and text that is no number become NULL."""
    return F.when(x.isin(*MISSING), F.lit(None)).otherwise(x.try_cast("double"))


def binarised(x: Column) -> Column:
    """1 above zero, 0 otherwise, NULL where missing."""
    return F.when(x.isNotNull(), (x > 0).cast("int"))


def floored(x: Column, low: float = 0.0) -> Column:
    """At least ``low``; missing stays missing."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def ratio(x: Column, y: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(x, y)


def soft_threshold(x: Column, t: Column) -> Column:
    """Shrunk towards zero by ``t``."""
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def discount(rank: Column) -> Column:
    """1 / log2(rank + 1)."""
    return F.lit(0.6931471805599453) / F.log(rank + 1)


def copy_deviation(x: Column) -> Column:
    """|log2(max(x, 0.01) / 2)|."""
    return F.abs(F.log2(F.greatest(x, F.lit(0.01)) / 2))


def overlap(a: Column, b: Column, k: int) -> Column:
    """Share of ``k`` that two top-k lists have in common."""
    return F.size(F.array_intersect(a, b)) / F.lit(float(k))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all members; NULL if both are empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double"))


def hash_place(*parts: Column) -> Column:
    """The first 32 bits of the SHA-256 of the parts joined by ``|``, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")


def hash_key(*parts: Column) -> Column:
    """SHA-256 of the parts joined by ``|``: an order that depends on the parts alone."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def finite_below(x: Column, bound: float = 0.0) -> Column:
    """Whether a number is there and below ``bound``; missing and NaN are not."""
    return F.coalesce(x < bound, F.lit(False)) & F.coalesce(~F.isnan(x), F.lit(False))
