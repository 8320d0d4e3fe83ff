"""Moving between platforms and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import floored
from .metrics import pearson
from .ranking import average_ranks, top_k


def mean_shift(source: DataFrame, target: DataFrame, column: str, value: str) -> DataFrame:
    """Target mean less source mean of each column; 0 where one side lacks the column."""
    a = source.groupBy(column).agg(F.avg(value).alias("source_mean"))
    b = target.groupBy(column).agg(F.avg(value).alias("target_mean"))
    return a.join(b, column, "outer").withColumn("shift", F.coalesce(F.col("target_mean") - F.col("source_mean"), F.lit(0.0)))


def shifted(rows: DataFrame, shifts: DataFrame, column: str, value: str, low: float = 0.0) -> DataFrame:
    """Values moved by their column's shift, not below ``low``; missing stays missing."""
    return rows.join(shifts.select(column, "shift"), column, "left").withColumn(value, floored(F.col(value) + F.coalesce("shift", F.lit(0.0)), low)).drop("shift")


def platform_moments(a: DataFrame, b: DataFrame, row: str, column: str, value: str, least: int = 20) -> DataFrame:
    """n, means and SDs of each column over the cells that both platforms observed."""
    both = a.select(row, column, F.col(value).alias("va")).join(b.select(row, column, F.col(value).alias("vb")), [row, column]).filter("va IS NOT NULL AND vb IS NOT NULL")
    made = both.groupBy(column).agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.stddev_pop("va").alias("sd_a"), F.avg("vb").alias("mean_b"), F.stddev_pop("vb").alias("sd_b"))
    return made.filter((F.col("n") >= least) & (F.col("sd_a") > 1e-8) & (F.col("sd_b") > 1e-8))


def z_scored(rows: DataFrame, moments: DataFrame, column: str, value: str, side: str) -> DataFrame:
    """Values on the scale of one platform's moments."""
    return rows.join(moments.select(column, f"mean_{side}", f"sd_{side}"), column).withColumn("z", (F.col(value) - F.col(f"mean_{side}")) / F.col(f"sd_{side}")).drop(f"mean_{side}", f"sd_{side}")


def domain_distance(reference: DataFrame, other: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Of each row of ``other``: root mean squared z from the reference's centre, and the share of columns outside its 1-99 per cent range."""
    q = F.percentile(F.col(value), F.array(F.lit(0.01), F.lit(0.99)))
    about = reference.groupBy(column).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), q.alias("q")).filter("s > 1e-8")
    z, v = (F.col(value) - F.col("m")) / F.col("s"), F.col(value)
    outside = ((v < F.get("q", F.lit(0))) | (v > F.get("q", F.lit(1)))).cast("double")
    return other.join(about, column).groupBy(row).agg(F.count("*").alias("n"), F.sqrt(F.avg(z * z)).alias("distance"), F.avg(outside).alias("outside"))


def selection_frequency(df: DataFrame, by: list[str], entity: str, key: str, value: str, k: int) -> DataFrame:
    """How often each key is among the k strongest of an entity, over all entities of the group; never-selected keys have 0."""
    n = df.groupBy(*by).agg(F.count_distinct(entity).alias("__n"))
    picked = top_k(df, [*by, entity], value, key, k).groupBy(*by, key).agg(F.count("*").alias("__k"))
    return df.select(*by, key).distinct().join(picked, [*by, key], "left").join(n, by).select(*by, key, (F.coalesce("__k", F.lit(0)) / F.col("__n")).alias("frequency"))


def consensus(df: DataFrame, method: str, entity: str, key: str, value: str, k: int) -> DataFrame:
    """Keys in an entity's top k under every method."""
    m = df.agg(F.count_distinct(method).alias("m"))
    picked = top_k(df, [method, entity], value, key, k).groupBy(entity, key).agg(F.count_distinct(method).alias("n"))
    return picked.join(m, F.col("n") == F.col("m"), "left_semi").select(entity, key)


def cohort_stability(frequencies: DataFrame, cohort: str, key: str, first: str, second: str) -> DataFrame:
    """Rank agreement of two cohorts' frequencies over keys that either selects."""
    a = frequencies.filter(F.col(cohort) == first).select(key, F.col("frequency").alias("a"))
    b = frequencies.filter(F.col(cohort) == second).select(key, F.col("frequency").alias("b"))
    both = a.join(b, key).filter("a > 0 OR b > 0")
    return average_ranks(average_ranks(both, [], "a", "ra"), [], "b", "rb").agg(F.count("*").alias("n"), pearson(F.col("ra"), F.col("rb")).alias("spearman"))


def paired_difference(df: DataFrame, pair: list[str], arm: Column, value: str) -> DataFrame:
    """Mean where ``arm`` holds less the mean elsewhere, for pairs that have both."""
    rows = df.groupBy(*pair).agg(F.avg(F.when(arm, F.col(value))).alias("a"), F.avg(F.when(~arm, F.col(value))).alias("b"))
    return rows.filter("a IS NOT NULL AND b IS NOT NULL").select(*pair, (F.col("a") - F.col("b")).alias("difference"))


def z_against(rows: DataFrame, normal: DataFrame, column: str, value: str, floor: float = 0.25) -> DataFrame:
    """Deviation from the normal rows' mean over their sample SD, which counts as ``floor`` at least."""
    about = normal.groupBy(column).agg(F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    return rows.join(about, column).withColumn("z", (F.col(value) - F.col("m")) / F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(floor))).drop("m", "s")


def mapping_errors(mapped: DataFrame, truth: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Root mean squared and mean absolute error and correlation of each row over shared columns."""

    both = mapped.select(row, column, F.col(value).alias("m")).join(truth.select(row, column, F.col(value).alias("t")), [row, column])
    d = F.col("m") - F.col("t")
    return both.groupBy(row).agg(F.count("*").alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), pearson(F.col("m"), F.col("t")).alias("pearson"))


def recovery_audit(wanted: DataFrame, direct: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """How each wanted feature is found: direct, by one alias, by several (ambiguous), or not."""
    d = direct.select(key).distinct().withColumn("__d", F.lit(True))
    a = aliases.groupBy(key).agg(F.count_distinct("approved").alias("__n"), F.min("approved").alias("__a"))
    status = F.when(F.col("__d"), "direct").when(F.col("__n") == 1, "alias").when(F.col("__n") > 1, "ambiguous").otherwise("missing")
    return wanted.join(d, key, "left").join(a, key, "left").select(key, status.alias("status"), F.when(F.col("__d"), F.col(key)).when(F.col("__n") == 1, F.col("__a")).alias("source"))


def imputed(df: DataFrame, means: DataFrame, column: str, value: str) -> DataFrame:
    """Missing values replaced by a published mean of the column."""
    return df.join(means.select(column, F.col("mean").alias("__m")), column, "left").withColumn(value, F.coalesce(value, "__m")).drop("__m")


def event_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """1 where either table has a 1; pairs that neither has are absent."""
    return a.select(*keys, "hit").unionByName(b.select(*keys, "hit")).groupBy(*keys).agg(F.max("hit").alias("hit"))


def aligned(rows: DataFrame, scenario: str, column: str, value: str, means: DataFrame, low: float = 0.0) -> DataFrame:
    """Values of each scenario moved so that its column means are the model's, entities counting alike, and not below ``low``.

    ``means`` has column and mean. Missing values stay missing; a column that the model lacks goes.
    """
    own = rows.groupBy(scenario, column).agg(F.avg(value).alias("__own"))
    moved = rows.join(own, [scenario, column]).join(means.select(column, F.col("mean").alias("__to")), column)
    return moved.withColumn(value, floored(F.col(value) + F.col("__to") - F.col("__own"), low)).drop("__own", "__to")


def frozen_scores(rows: DataFrame, model: DataFrame, by: list[str], column: str, value: str) -> DataFrame:
    """by, target, score, n_used, missing, outside: a stored linear model on long rows, which it is not fitted to.

    ``model`` has column, target, mean, low, high, weight and the target's bias. A column that a row lacks, by
    NULL or by no row, stands at the model's mean; a target none of whose columns a row has gets no score.
    ``missing`` is the share of the target's columns without a value, ``outside`` that of the values beyond low and high.
    """
    size = model.groupBy("target").agg(F.count("*").alias("__n"))
    x = F.col(value)
    found = rows.filter(x.isNotNull()).select(*by, column, value).join(model, column)
    beyond = ((x < F.col("low")) | (x > F.col("high"))).cast("double")
    sums = found.groupBy(*by, "target").agg((F.max("bias") + F.sum((x - F.col("mean")) * F.col("weight"))).alias("score"), F.count("*").alias("n_used"), F.avg(beyond).alias("outside"))
    return sums.join(size, "target").select(*by, "target", "score", "n_used", (1 - F.col("n_used") / F.col("__n")).alias("missing"), "outside")
