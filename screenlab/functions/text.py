"""Identifier and text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_symbol(x: Column) -> Column:
    """Trimmed, upper-cased, cut at the first ``|``."""
    return F.split_part(F.upper(F.trim(x)), F.lit("|"), F.lit(1))


def strip_suffix(x: Column) -> Column:
    """Upper-cased without a trailing parenthesised part: ``abc (12)`` is ``ABC``."""
    return F.upper(F.regexp_replace(F.trim(x), r"\s+\([^)]+\)$", ""))


def name_and_id(x: Column) -> Column:
    """``NAME (ID)`` as a struct; id is null where there is none."""
    found = F.regexp_extract(x, r"^(.*?)\s*\(([^)]+)\)$", 2)
    return F.struct(F.regexp_replace(x, r"\s*\([^)]+\)$", "").alias("name"), F.when(found != "", found).alias("id"))


def participant(x: Column, fields: int = 3) -> Column:
    """The first ``fields`` dash-separated fields; text with fewer stays as it is."""
    cut = F.split(x, "-")
    return F.when(F.size(cut) >= fields, F.array_join(F.slice(cut, 1, fields), "-")).otherwise(x)


def sample_code(x: Column) -> Column:
    """The first two characters of the fourth dash-separated field, null without one."""
    return F.substring(F.get(F.split(x, "-"), F.lit(3)), 1, 2)


def unpack(x: Column, separator: str = r"\|") -> Column:
    """A packed list as an array of its non-empty tokens; null gives an empty array."""
    return F.filter(F.split(F.coalesce(x, F.lit("")), separator), lambda t: t != "")


def pack(x: Column, separator: str = "|") -> Column:
    """Distinct tokens in order, packed."""
    return F.array_join(F.array_sort(F.array_distinct(x)), separator)


def strip_version(x: Column) -> Column:
    """An identifier without its version: ``E01.7`` is ``E01``."""
    return F.split_part(x, F.lit("."), F.lit(1))


def path_safe(x: Column) -> Column:
    """Percent-encoded for use as a path."""
    return F.regexp_replace(F.url_encode(x), r"\+", "%20")


def same_folded(x: Column, y: Column) -> Column:
    """Equal after trimming and lower-casing; null counts as empty."""
    return F.lower(F.trim(F.coalesce(x, F.lit("")))) == F.lower(F.trim(F.coalesce(y, F.lit(""))))
