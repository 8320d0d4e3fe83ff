"""Cohort evidence: recovery classes, burdens, paired directions, scenarios, quality modes, tiers and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite_below
from ..sources.publish import staged
from .ranking import ordinal_rank, top_k, top_lists
from .resample import bootstrap, drawn, fused_interval, interval


def recovery_classes(wanted: DataFrame, measured: DataFrame, aliases: DataFrame, approved: DataFrame, key: str) -> DataFrame:
    """One of five states of each wanted feature.

    A measured one was observed before (``seen``) or is recovered now; of the others, an alias of several
    approved names is ambiguous unless it is approved itself, and a name is unresolved or approved but not measured.
    """
    have = measured.select(key).distinct().withColumn("__m", F.lit(True))
    several = aliases.groupBy(key).agg((F.count_distinct("approved") > 1).alias("__several"))
    named = approved.select(key).distinct().withColumn("__a", F.lit(True))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = (
        F.when(yes("__m") & F.col("seen"), "retained")
        .when(yes("__m"), "recovered")
        .when(yes("__several") & ~yes("__a"), "ambiguous")
        .when(~yes("__a"), "unresolved")
        .otherwise("not_measured")
    )
    return reduce(lambda a, b: a.join(b, key, "left"), [have, several, named], wanted).select(key, status.alias("status"))


def burdens(events: DataFrame, entity: str, key: str, effect: str, functional: list[str]) -> DataFrame:
    """Distinct keys with a functional event of each entity, and how many of its events are not functional; entities without one have 0."""
    works = F.coalesce(F.col(effect).isin(*functional), F.lit(False))
    return events.groupBy(entity).agg(F.count_distinct(F.when(works, F.col(key))).alias("burden"), F.count_if(~works).alias("n_other"))


def dominance(union: DataFrame, part: DataFrame, keys: list[str], value: str = "hit") -> DataFrame:
    """Keys whose part exceeds the union, or that the union lacks; a union has none."""
    u = union.select(*keys, F.col(value).alias("__u"))
    return part.groupBy(*keys).agg(F.max(value).alias("part")).join(u, keys, "left").filter(F.col("__u").isNull() | (F.col("__u") < F.col("part"))).select(*keys, "part", F.col("__u").alias("union"))


def called_median(df: DataFrame, entity: str, value: str, called: Column) -> DataFrame:
    """Median over the called rows of each entity, NULL where none is called."""
    return df.groupBy(entity).agg(F.median(F.when(called, F.col(value))).alias("median"), F.count_if(F.coalesce(called, F.lit(False))).alias("n_called"))


def mapped_delta(cells: DataFrame, mapping: DataFrame, probe: str, target: str, value: str, arm: Column) -> DataFrame:
    """Mean over a target's probes of the difference of probe means between two arms; probes that one arm lacks are left out."""
    means = cells.groupBy(probe).agg(F.avg(F.when(arm, F.col(value))).alias("a"), F.avg(F.when(~arm, F.col(value))).alias("b"))
    deltas = means.filter("a IS NOT NULL AND b IS NOT NULL").join(mapping.select(probe, target).distinct(), probe)
    return deltas.groupBy(target).agg(F.count("*").alias("n_probes"), F.avg(F.col("a") - F.col("b")).alias("delta"))


def direction_test(pairs: DataFrame, by: list[str], key: str, difference: str, expected: Column, draws: int, seed: str) -> DataFrame:
    """Median difference of each group's pairs with its bootstrap bounds, and whether these confirm a direction named beforehand."""
    points = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.median(difference).alias("median"))
    bounds = interval(drawn(pairs, by, key, draws, seed).groupBy(*by, "draw").agg(F.median(difference).alias("stat")), by)
    rows = points.join(bounds, by).withColumn("expected", expected)
    low, high = F.round("ci_low", 9), F.round("ci_high", 9)
    verdict = F.when((F.col("expected") > 0) & (low > 0) | (F.col("expected") < 0) & (high < 0), "confirmed").when((F.col("expected") > 0) & (high < 0) | (F.col("expected") < 0) & (low > 0), "opposite").otherwise("open")
    return rows.withColumn("verdict", verdict)


def candidate_summary(df: DataFrame, by: list[str], entity: str, key: str, value: str, k: int) -> DataFrame:
    """Mean, tenth percentile and mean place of each key over entities, and how often it is among an entity's ``k`` lowest."""
    ranked = df.filter(F.col(value).isNotNull()).withColumn("__r", ordinal_rank([*by, entity], value, key))
    return ranked.groupBy(*by, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(F.col(value), F.lit(0.1)).alias("q10"), F.avg("__r").alias("mean_place"), (F.count_if(F.col("__r") <= k) / F.count("*")).alias("frequency"))


def scenario_overlaps(scenarios: DataFrame, scenario: str, reference: str, entity: str, key: str, value: str, k: int) -> DataFrame:
    """Share of the reference scenario's ``k`` lowest keys that each other scenario keeps, by entity."""
    lists = top_lists(scenarios, [scenario, entity], value, key, k)
    ref = lists.filter(F.col(scenario) == reference).select(entity, F.col("top").alias("__ref"))
    rows = lists.filter(F.col(scenario) != reference).join(ref, entity)
    return rows.select(scenario, entity, (F.size(F.array_intersect("top", "__ref")) / F.lit(float(k))).alias("overlap"))


def quality_modes(cells: DataFrame, modes: dict[str, Column], by: list[str], *aggregates: Column) -> DataFrame:
    """The same summary under several quality rules: a cell counts in every mode that it passes."""
    passed = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in modes.items()]))
    return cells.withColumn("mode", F.explode(passed)).groupBy("mode", *by).agg(*aggregates)


def equal_donors(df: DataFrame, keys: list[str], donor: str, value: str, detected: str, least_cells: int) -> DataFrame:
    """Donors with enough cells counted alike: their number, median, least and most of their means, and their mean detection."""
    per = df.groupBy(*keys, donor).agg(F.count("*").alias("__n"), F.avg(value).alias("__v"), F.avg(detected).alias("__d")).filter(F.col("__n") >= least_cells)
    return per.groupBy(*keys).agg(F.count("*").alias("n_donors"), F.median("__v").alias("median"), F.min("__v").alias("least"), F.max("__v").alias("most"), F.avg("__d").alias("detection"))


def tiers(df: DataFrame, key: str, scope: str, value: str, scopes: list[str], strong: int, some: int) -> DataFrame:
    """A where at least ``strong`` scopes have a negative mean and the first one has, B where ``some`` have, exploratory otherwise."""
    means = df.groupBy(key).pivot(scope, scopes).agg(F.avg(value))
    negative = reduce(Column.__add__, [finite_below(F.col(f"`{s}`")).cast("int") for s in scopes])
    tier = F.when((negative >= strong) & finite_below(F.col(f"`{scopes[0]}`")), "A").when(negative >= some, "B").otherwise("exploratory")
    return means.select(key, negative.cast("long").alias("n_negative"), tier.alias("tier"))


def coverage_by(base: DataFrame, rows: DataFrame, by: str, entity: str, wanted: int) -> DataFrame:
    """Entities of each group that have rows, all groups of ``base`` with 0 where there are none, and whether there are enough."""
    n = rows.groupBy(by).agg(F.count_distinct(entity).alias("n"))
    made = base.select(by).distinct().join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return made.withColumn("enough", F.col("n") >= wanted)


def audited(frozen: DataFrame, adjudicated: DataFrame, key: str, classes: list[str], label: str) -> DataFrame:
    """One row: keys that either side lacks, and counts by class, of an adjudication that must cover a frozen list."""
    both = frozen.select(key, F.lit(True).alias("__f")).join(adjudicated.select(key, label, F.lit(True).alias("__a")), key, "outer")
    f, a = F.col("__f").isNotNull(), F.col("__a").isNotNull()
    return both.agg(F.count_if(f & ~a).alias("not_adjudicated"), F.count_if(a & ~f).alias("not_frozen"), *[F.count_if(f & a & (F.col(label) == c)).alias(f"n_{c}") for c in classes])


def selected_often(picks: DataFrame, by: list[str], members: str, tracked: list[str], event: str) -> DataFrame:
    """How often tracked keys are in a run's member list, and how often they are its event, over the runs of each group."""
    rows = picks.withColumn("key", F.explode(F.array(*[F.lit(t) for t in tracked])))
    return rows.groupBy(*by, "key").agg(F.count("*").alias("n_runs"), F.avg(F.array_contains(F.col(members), F.col("key")).cast("double")).alias("as_node"), F.avg(F.coalesce(F.col(event) == F.col("key"), F.lit(False)).cast("double")).alias("as_event"))


def held_mapping_errors(a: DataFrame, b: DataFrame, row: str, column: str, value: str, folds: int) -> DataFrame:
    """Errors of a mean-shift mapping on rows that it was not fitted on, by fold: standardised RMSE and MAE, and mean row correlation.

    Fold of a row: its id modulo ``folds``. Errors are divided by the target's SD over the fitting rows;
    columns whose SD there is NULL or 0 do not count. Sums of all rows less those of the fold give the fits.
    """
    from .metrics import pearson

    both = a.select(row, column, F.col(value).alias("x")).join(b.select(row, column, F.col(value).alias("y")), [row, column]).withColumn("fold", F.pmod(F.col(row), F.lit(folds)))
    sums = both.groupBy(column, "fold").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("y").alias("vy"))
    other = sums.select(column, F.col("fold").alias("__f"), *[F.col(c).alias(f"o_{c}") for c in ("n", "mx", "my", "vy")])
    fits = sums.select(column, "fold").join(other, column).filter("fold <> __f")  # a row a column and pair of folds
    n, mean = F.sum("o_n"), lambda c: F.sum(F.col(f"o_{c}") * F.col("o_n")) / F.sum("o_n")
    within = F.sum(F.col("o_n") * (F.col("o_vy") + F.col("o_my") * F.col("o_my"))) / n
    fit = fits.groupBy(column, "fold").agg((mean("my") - mean("mx")).alias("shift"), F.sqrt(F.greatest(within - mean("my") * mean("my"), F.lit(0.0))).alias("sd")).filter("sd > 1e-6")
    d = both.join(fit, [column, "fold"]).withColumn("m", F.col("x") + F.col("shift")).withColumn("d", (F.col("m") - F.col("y")) / F.col("sd"))
    each = d.groupBy("fold", row).agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("q"), F.sum(F.abs("d")).alias("a"), pearson(F.col("m"), F.col("y")).alias("r"))
    return each.groupBy("fold").agg(F.sum("n").alias("n"), F.sqrt(F.sum("q") / F.sum("n")).alias("rmse"), (F.sum("a") / F.sum("n")).alias("mae"), F.avg("r").alias("pearson"))


def top_frequency(df: DataFrame, by: list[str], entity: str, key: str, value: str, k: int) -> DataFrame:
    """How many entities of a group have each key among their ``k`` lowest."""
    return top_k(df, [*by, entity], value, key, k).groupBy(*by, key).agg(F.count("*").alias("n"))


def split_evidence(cells: DataFrame, splits: DataFrame, entity: str, column: str, value: str, case: str, draws: int, seed: str, fit: str = "train", used: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Evidence of cases over normals for each split and column, without a look at what is locked.

    ``case`` tells an entity's case rows from its normal ones; ``splits`` has entity and split. Rows of splits that are not
    ``used``, and of entities without a split, go before anything is worked out. The reference of a column is the
    mean of the normals of split ``fit`` alone, for every split. ``median`` and ``above`` are of all cases less the
    reference, the paired columns of entities with both. A column without a reference, or a split without a case
    of it, has no row; two cases, or two normals, of one entity and column are an error; NULL values are absent.
    """
    rows = cells.filter(F.col(value).isNotNull()).join(splits.filter(F.col("split").isin(*used)).select(entity, "split"), entity)
    is_case = F.coalesce(F.col(case), F.lit(False))
    one = lambda arm: F.when(F.count_if(arm) > 1, F.raise_error(F.lit("an entity has two values of one arm and column")).cast("double")).otherwise(F.max(F.when(arm, F.col(value))))
    wide = staged(rows.groupBy("split", entity, column).agg(one(is_case).alias("__x"), one(~is_case).alias("__y")), "evidence")
    reference = wide.filter(F.col("split") == fit).groupBy(column).agg(F.round(F.avg("__y"), 9).alias("__r")).filter("__r IS NOT NULL")
    over = F.col("__x") - F.col("__r")
    points = wide.filter("__x IS NOT NULL").join(reference, column).groupBy("split", column).agg(F.count("*").alias("n"), F.median(over).alias("median"), F.avg((over > 0).cast("double")).alias("above"))
    pairs = wide.filter("__x IS NOT NULL AND __y IS NOT NULL").select("split", column, entity, (F.col("__x") - F.col("__y")).alias("__d"))
    paired = bootstrap(pairs, ["split", column], entity, F.median("__d"), draws, seed, bounds=fused_interval).withColumnsRenamed({"n": "n_pairs", "estimate": "paired_median"})
    return points.join(paired, ["split", column], "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0)))


def split_audit(cells: DataFrame, splits: DataFrame, entity: str, case: str, used: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """Entities with cases and with normals in each split, those without a split under ``none``, and whether the split is used."""
    is_case = F.coalesce(F.col(case), F.lit(False))
    have = cells.groupBy(entity).agg(F.bool_or(is_case).alias("__x"), F.bool_or(~is_case).alias("__y"))
    rows = have.join(splits.select(entity, "split"), entity, "left").withColumn("split", F.coalesce("split", F.lit("none")))
    return rows.groupBy("split").agg(F.count_if("__x").alias("n_case"), F.count_if("__y").alias("n_normal"), F.count_if(F.col("__x") & F.col("__y")).alias("n_pairs")).withColumn("used", F.col("split").isin(*used))
