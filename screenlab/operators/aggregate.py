"""Group summaries. NULL is missing and is skipped; empty groups give NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import counted_values


def collapsed(df: DataFrame, keys: list[str], value: str, how: str, order: str | None = None) -> DataFrame:
    """One value a key: mean, sum, max, or max_abs (the value of largest magnitude, the first by ``order`` on ties)."""
    v = F.col(value)
    if how == "max_abs":
        made = F.max_by(v, F.struct(F.abs(v), -F.col(order))) if order else F.max_by(v, F.struct(F.abs(v), v))
    else:
        made = {"mean": F.avg, "sum": F.sum, "max": F.max}[how](v)
    return df.groupBy(*keys).agg(made.alias(value))


def collapsed_by(df: DataFrame, keys: list[str], modality: str, value: str, how: dict[str, str], otherwise: str = "mean") -> DataFrame:
    """One value a key and modality: each modality by its own rule of ``collapsed``."""
    made = {"mean": F.avg, "sum": F.sum, "max": F.max}
    rule = F.coalesce(*[F.when(F.col(modality) == m, made[h](value)) for m, h in how.items()], F.when(~F.coalesce(F.col(modality).isin(*how), F.lit(False)), made[otherwise](value)))
    return df.groupBy(*keys, modality).agg(rule.alias(value))


def smd(df: DataFrame, keys: list[str], value: str, arm: Column, least: int = 3) -> DataFrame:
    """Standardised mean difference of the rows where ``arm`` holds against the others, pooled SD; NULL below ``least`` a side."""
    a, b = F.when(arm, F.col(value)), F.when(~arm, F.col(value))
    rows = df.groupBy(*keys).agg(*[f(x).alias(f"{n}_{s}") for s, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("v_a") + (F.col("n_b") - 1) * F.col("v_b")) / (F.col("n_a") + F.col("n_b") - 2))
    effect = F.when((F.col("n_a") >= least) & (F.col("n_b") >= least) & (pooled > 0), (F.col("m_a") - F.col("m_b")) / pooled)
    return rows.select(*keys, "n_a", "n_b", effect.alias("smd"))


def centred(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``value`` less its group mean; means are summed up by group first, so rows do not meet in the task of their group."""
    means = df.groupBy(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]).agg(F.avg(value).alias("__mean"))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], F.lit(True))
    return df.join(means, same).withColumn(value, F.col(value) - F.col("__mean")).select(*df.columns)


def leave_one_out_worst(df: DataFrame, keys: list[str], value: str, least: int = 3) -> DataFrame:
    """The largest mean left when one value is left out: that of all but the smallest."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count(v).alias("n"), ((F.sum(v) - F.min(v)) / (F.count(v) - 1)).alias("worst")).filter(F.col("n") >= least)


def cohort_summary(df: DataFrame, cohort: str, key: str, value: str, cut: float) -> DataFrame:
    """n, median and share at or below ``cut`` of each key in each cohort."""
    v = F.col(value)
    return df.groupBy(cohort, key).agg(F.count(v).alias("n"), F.median(v).alias("median"), F.avg(F.when(v.isNotNull(), (v <= cut).cast("double"))).alias("fraction"))


def macro_average(df: DataFrame, lineage: str, cluster: str, values: list[str]) -> DataFrame:
    """Means by three estimands: over rows, over clusters, and over lineages of their means over rows.

    Rows are read once, into sums by lineage and cluster, which the three estimands roll up.
    """
    sums = df.groupBy(lineage, cluster).agg(*[f(v).alias(f"__{n}{i}") for i, v in enumerate(values) for n, f in (("s", F.sum), ("n", F.count))])
    means = [F.try_divide(F.sum(f"__s{i}"), F.sum(f"__n{i}")).alias(v) for i, v in enumerate(values)]
    level = F.when((F.grouping(lineage) == 1) & (F.grouping(cluster) == 1), "row_weighted").when(F.grouping(cluster) == 1, "lineage_equal").otherwise("cluster_equal")
    rolled = sums.groupingSets([[], [F.col(lineage)], [F.col(cluster)]], F.col(lineage), F.col(cluster)).agg(level.alias("estimand"), *means)
    return rolled.groupBy("estimand").agg(*[F.avg(v).alias(v) for v in values])


def nested_average(df: DataFrame, levels: list[list[str]], value: str) -> DataFrame:
    """Means of means, one level after the other."""
    for level in levels:
        df = df.groupBy(*level).agg(F.avg(value).alias(value))
    return df


def empirical_percentile(df: DataFrame, groups: list[str], key: str, value: str) -> DataFrame:
    """Per cent of the group at or below the value, and add-one upper-tail p; NULLs are not counted."""
    rows = counted_values(df.select(*groups, key, value), groups, value, F.count(value))
    below, same, n = F.col("n_below"), F.col("n_same"), F.col("n_all")
    return rows.select(*groups, key, value, F.try_divide(100.0 * (below + same), n).alias("percentile"), ((1.0 + n - below) / (1 + n)).alias("p_upper"))


def argmax(df: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """The label of the largest value, the smallest label on ties."""
    return df.groupBy(*keys).agg(F.max(value).alias(value), F.min_by(label, F.struct(-F.col(value), F.col(label))).alias(label))


def pooled_rmse(df: DataFrame, keys: list[str], sse: str, n: str) -> DataFrame:
    """Root of summed squared errors over summed counts."""
    return df.groupBy(*keys).agg(F.sqrt(F.sum(sse) / F.sum(n)).alias("rmse"))


def by_scopes(df: DataFrame, scopes: dict[str, Column], keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates over overlapping scopes in one pass: a row counts in every scope whose condition holds."""
    member = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in scopes.items()]), lambda x: x.isNotNull())
    return df.withColumn("scope", F.explode(member)).groupBy("scope", *keys).agg(*aggregates)
