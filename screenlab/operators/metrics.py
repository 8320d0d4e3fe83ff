"""Ranking metrics and model choice. Values are effects: lower is stronger, in truth and prediction alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import discount
from ..sources.publish import staged
from .ranking import average_rank, ordinal_rank
from .resample import bootstrap, drawn, interval


def pearson(x: Column, y: Column, least: float = 1e-12) -> Column:
    """Correlation as an aggregate; NULL if a side hardly varies."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    scale = n * F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(scale > least, n * F.covar_pop(x, y) / scale)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank agreement of each group over the rows where both are there; NULL if a side has no variance."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(by, x).alias("__x"), average_rank(by, y).alias("__y"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pearson(F.col("__x"), F.col("__y")).alias("spearman"))


def ranking_metrics(df: DataFrame, by: list[str], key: str, truth: str, predicted: str, k: int = 10, strong: float = 0.0) -> DataFrame:
    """n, ndcg, precision (truth at or below ``strong`` among the k predicted), overlap, spearman and regret of each group.

    Only keys with truth and prediction count; groups with fewer than ``k`` are left out; ndcg is NULL if no truth is below zero.
    """
    rows = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(*by, key, F.col(truth).alias("t"), F.col(predicted).alias("p"))
    for place, mean, value in (("rt", "at", "t"), ("rp", "ap", "p")):  # the sort by value and key serves the ranks by value
        rows = rows.withColumn(place, ordinal_rank(by, value, key)).withColumn(mean, average_rank(by, value))
    gain, inside = F.greatest(-F.col("t"), F.lit(0.0)), F.col("rp") <= k
    ideal = F.sum(F.when(F.col("rt") <= k, gain * discount(F.col("rt"))))
    best, chosen = F.avg(F.when(F.col("rt") <= k, F.col("t"))), F.avg(F.when(inside, F.col("t")))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(ideal > 0, F.sum(F.when(inside, gain * discount(F.col("rp")))) / ideal).alias("ndcg"),
        (F.count_if(inside & (F.col("t") <= strong)) / k).alias("precision"),
        (F.count_if(inside & (F.col("rt") <= k)) / k).alias("overlap"),
        pearson(F.col("at"), F.col("ap")).alias("spearman"),
        (chosen - best).alias("regret"),
    ).filter(F.col("n") >= k)


def scope_metrics(df: DataFrame, scope: list[str], target: str, truth: str, predicted: str, baseline: str) -> DataFrame:
    """Mean squared error, R2 against the scope's mean, gain over a baseline, and the median of the targets' correlations (3 rows or more)."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    t, p, b = F.col(truth), F.col(predicted), F.col(baseline)
    total = F.sum(t * t) - F.sum(t) * F.sum(t) / F.count(t)
    whole = rows.groupBy(*scope).agg(F.count("*").alias("n"), F.avg((t - p) * (t - p)).alias("mse"), F.when(total > 0, 1 - F.sum((t - p) * (t - p)) / total).alias("r2"), F.when(F.sum((t - b) * (t - b)) > 0, 1 - F.sum((t - p) * (t - p)) / F.sum((t - b) * (t - b))).alias("gain"))
    each = rows.groupBy(*scope, target).agg(F.count("*").alias("__n"), pearson(t, p).alias("__r")).filter("__n >= 3")
    return whole.join(each.groupBy(*scope).agg(F.median("__r").alias("median_pearson")), scope, "left")


def paired_deltas(df: DataFrame, entity: list[str], method: str, reference: str, values: list[str], flipped: tuple[str, ...] = ("regret",)) -> DataFrame:
    """Each method less the reference on the same entity; the sign of ``flipped`` values turned, so that more is better."""
    r = df.filter(F.col(method) == reference).select(*entity, *[F.col(v).alias(f"__{v}") for v in values])
    rows = df.filter(F.col(method) != reference).join(r, entity)
    return rows.select(*entity, method, *[((F.col(f"__{v}") - F.col(v)) if v in flipped else (F.col(v) - F.col(f"__{v}"))).alias(f"d_{v}") for v in values])


def direction_counts(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """How many values are positive, zero and negative."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count_if(v > 0).alias("positive"), F.count_if(v == 0).alias("zero"), F.count_if(v < 0).alias("negative"))


def verdict(low: Column, high: Column) -> Column:
    """Where an interval lies."""
    return F.when(low > 0, "above").when(high < 0, "below").otherwise("crosses")


def choose_lowest(df: DataFrame, by: list[str], option: str, loss: str) -> DataFrame:
    """The option of least loss, the smaller one on ties."""
    return df.groupBy(*by).agg(F.min_by(option, F.struct(loss, option)).alias(option), F.min(loss).alias(loss))


def choose_highest(df: DataFrame, by: list[str], option: str, score: str, simplicity: str) -> DataFrame:
    """The option of highest score, the simplest on ties."""
    return df.groupBy(*by).agg(F.min_by(option, F.struct(-F.col(score), F.col(simplicity), F.col(option))).alias(option), F.max(score).alias(score))


def stability(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, 5th and 95th percentile and positive share over repeats."""
    q = F.percentile(F.col(value), F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    rows = df.groupBy(*by).agg(q.alias("q"), F.avg((F.col(value) > 0).cast("double")).alias("positive"))
    return rows.select(*by, F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(0)).alias("q05"), F.get("q", F.lit(2)).alias("q95"), "positive")


def group_summary(df: DataFrame, by: list[str], group: str, value: str, draws: int, seed: str) -> DataFrame:
    """Mean, median and positive share of a value over groups, each counting once, with bootstrap bounds of the mean over groups.

    Rows of one group are averaged first; groups without a value are left out.
    """
    per = df.groupBy(*by, group).agg(F.avg(value).alias("__v")).filter("__v IS NOT NULL")
    made = per.groupBy(*by).agg(F.median("__v").alias("median"), F.avg((F.col("__v") > 0).cast("double")).alias("positive"))
    return made.join(bootstrap(per, by, group, F.avg("__v"), draws, seed).withColumnRenamed("estimate", "mean"), by)


def scope_gains(predictions: DataFrame, scopes: DataFrame, entity: str, option: str, method: str, reference: str, stratum: str, draws: int, seed: str) -> DataFrame:
    """scope, option, method, n, r2, delta_r2, ci_low, boot_median, ci_high: every method and option over every scope of held-out rows.

    ``predictions`` has truth and predicted on the training rows' scale, so R2 is against their mean; ``scopes`` has
    scope, entity and stratum, and an entity may be in several. ``delta_r2`` is over the reference method under the same
    option; its bounds come from entities drawn inside strata. Errors are summed by entity first, so draws meet a row
    an entity, method and option, whatever the number of targets. Rows without truth or prediction go; an entity
    without rows is in no ``n``; where the truth does not vary from 0 R2 is NULL.
    """
    t, p = F.col("truth"), F.col("predicted")
    known = predictions.filter(t.isNotNull() & p.isNotNull())
    each = known.groupBy(entity, option, method).agg(F.sum((t - p) * (t - p)).alias("__sse"), F.sum(t * t).alias("__sst"))
    own = each.filter(F.col(method) == reference).select(entity, option, F.col("__sse").alias("__rse"), F.col("__sst").alias("__rst"))
    each = staged(each.join(own, [entity, option]), "scopes")
    r2 = 1 - F.try_divide(F.sum("__sse"), F.sum("__sst"))
    delta = r2 - (1 - F.try_divide(F.sum("__rse"), F.sum("__rst")))
    by = ["scope", option, method]
    points = scopes.select("scope", entity).distinct().join(each, entity).groupBy(*by).agg(F.count("*").alias("n"), r2.alias("r2"), delta.alias("delta_r2"))
    times = drawn(scopes.select("scope", stratum, entity).distinct(), ["scope", stratum], entity, draws, seed)
    bounds = interval(times.join(each, entity).groupBy(*by, "draw").agg(delta.alias("stat")), by)
    return points.join(bounds, by, "left")


def target_gains(predictions: DataFrame, scopes: DataFrame, entity: str, option: str, method: str, reference: str, target: str) -> DataFrame:
    """scope, option, method, target, r2 and delta_r2 over the reference under the same option, by target."""
    t, p = F.col("truth"), F.col("predicted")
    rows = predictions.filter(t.isNotNull() & p.isNotNull()).join(scopes.select("scope", entity).distinct(), entity)
    made = rows.groupBy("scope", option, target, method).agg((1 - F.try_divide(F.sum((t - p) * (t - p)), F.sum(t * t))).alias("r2"))
    base = F.max(F.when(F.col(method) == reference, F.col("r2"))).over(Window.partitionBy("scope", option, target))  # a row a method
    return made.withColumn("delta_r2", F.col("r2") - base)


def row_number_of(by: list[str], *order: Column | str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def gate(n: Column, median: Column, positive: Column, least: int, share: float) -> Column:
    """go if there are enough repeats, their median is above zero, and enough of them are positive; stop otherwise."""
    return F.when((n >= least) & (median > 0) & (positive >= share), "go").otherwise("stop")


def selected_effects(df: DataFrame, by: list[str], key: str, truth: str, predicted: str, k: int, strong: float) -> DataFrame:
    """Mean truth of the ``k`` lowest by prediction and by truth, and the share of the predicted ones below ``strong``; groups of fewer are left out."""
    rows = df.filter(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).withColumns({"__rp": ordinal_rank(by, predicted, key), "__rt": ordinal_rank(by, truth, key)})
    t, chosen = F.col(truth), F.col("__rp") <= k
    made = rows.groupBy(*by).agg(F.count("*").alias("__n"), F.avg(F.when(chosen, t)).alias("selected"), F.avg(F.when(F.col("__rt") <= k, t)).alias("oracle"), (F.count_if(chosen & (t < strong)) / F.lit(float(k))).alias("precision"))
    return made.filter(F.col("__n") >= k).drop("__n")
