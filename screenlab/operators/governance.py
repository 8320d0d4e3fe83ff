"""Content digests, manifests and checks of what was published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values as text, joined by ``|``; NULL is ``\\N``."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns]), 256)


def content_digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n_rows and a digest that does not depend on row order: SHA-256 over 256 sums of row digests.

    Rows are first folded by the leading byte of their digest, so the last step sees 256 rows a group at most.
    """
    by, d = by or [], row_digest(columns)
    part = df.select(*by, d.alias("d")).withColumn("b", F.substring("d", 1, 2))
    word = F.conv(F.substring("d", 3, 12), 16, 10).cast("decimal(38,0)")
    sums = part.groupBy(*by, "b").agg(F.count("*").alias("n"), F.sum(word).alias("s"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", F.concat_ws(":", "b", F.col("n").cast("string"), F.col("s").cast("string")).alias("t")))), lambda x: x["t"]), ",")
    return sums.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sha2(text, 256).alias("digest"))


def id_digest(df: DataFrame, by: list[str], key: str) -> DataFrame:
    """SHA-256 of a group's sorted distinct ids, one a line; for lists of ids."""
    return df.groupBy(*by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "\n"), 256).alias("digest"), F.count_distinct(key).alias("n"))


def differences(stored: DataFrame, again: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose stored and recomputed values differ, or that one side lacks."""
    rows = stored.select(*keys, F.col(value).alias("stored")).join(again.select(*keys, F.col(value).alias("again")), keys, "outer")
    same = F.coalesce(F.abs(F.col("stored") - F.col("again")) <= tolerance, F.col("stored").isNull() & F.col("again").isNull())
    return rows.filter(~same)


def missing_keys(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a complete grid has and the table lacks."""
    return expected.select(*keys).distinct().join(observed, keys, "left_anti")


def pins(stated: DataFrame, found: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Values stated beforehand beside those found, and whether they hold."""
    rows = stated.join(found, keys)
    return rows.select(*keys, "pinned", "found", (F.abs(F.col("found") - F.col("pinned")) <= tolerance).alias("holds"))


def order_kept(frozen: DataFrame, now: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` places of a frozen list beside the present ones, and whether they are the same."""
    rows = frozen.filter(F.col("frozen") <= n).join(now, key)
    return rows.select(key, "frozen", "now", (F.col("frozen") == F.col("now")).alias("same"))


def roll_up(df: DataFrame, keys: list[str], violation: str, tolerance: float) -> DataFrame:
    """How many certificates there are, their largest violation, and whether it is within the tolerance."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.max(violation).alias("worst")).withColumn("passed", F.col("worst") <= tolerance)


#: Fixed value: an absolute path of a machine - a drive, a home, or a folder under one of the usual roots.
ABSOLUTE_PATH = r"(?:^|[\s\"'=(:,\[])((?:[A-Za-z]:[\\/]|/(?:home|root|Users|mnt|data|tmp|var|opt|usr|etc|srv)/|file://|~/)[^\s\"',;)\]<>]*)"


def absolute_paths(df: DataFrame, columns: list[str]) -> DataFrame:
    """The row, column and path of every absolute path in text columns: what a publication must not hold."""
    found = [F.transform(F.regexp_extract_all(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(ABSOLUTE_PATH), F.lit(1)), lambda p, c=c: F.struct(F.lit(c).alias("column"), p.alias("path"))) for c in columns]
    return df.select("*", F.explode(F.concat(*found)).alias("__p")).select(*df.columns, "__p.column", "__p.path")
