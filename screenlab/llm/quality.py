"""Quality rules whose cut-offs bound the share of good documents that they reject.

Each rule holds one measure of a text against a cut-off; more is worse. For every stratum, rule and
candidate cut-off, the rejected among the labelled good holdout documents are counted, and the exact
(Clopper-Pearson) upper bound of the false rejection rate is taken at a level divided among all rules of
the stratum (Bonferroni). The candidates of a rule are tested in a fixed order, from the highest down, up
to the first that fails, which needs no further division, so the chosen cut-offs hold together. A rule takes
the last cut-off whose bound is within the rule's share of the allowed rate, and none if the first fails.

Dividing both the level and the rate leaves small strata without cut-offs, so ``joint_cutoffs`` tests all rules
of a stratum together instead, along one chain of cut-off vectors that a part of the labels fixes.
"""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import kept, staged

#: Fixed value: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """The five counts of ``MEASURES``; null text is empty."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    spaces = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    chars = len(text or "") - spaces
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = len(lines) - len(set(lines))
    again = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        upto = 0
        for i, w in enumerate(windows):
            if seen[w] > 1:
                again += i + 3 - max(i, upto)
                upto = i + 3
    return n, chars, symbols, repeated, again


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and the counts of each whole text.

    Null and empty texts count 0 throughout; repeated rows give repeated results, an empty table an empty
    one; columns in ``keep`` that are named like a count are left out.
    """
    source = docs.select(*[docs[c] for c in kept(keep, list(MEASURES))], docs[text].alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def rows(batches):
        for batch in batches:
            made = list(zip(*(measure(t.as_py()) for t in batch.column(batch.num_columns - 1)))) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(m, pa.int64()) for m in made)], names=schema.names)

    return source.mapInArrow(rows, schema)


def base_failed() -> Column:
    """Too short, or over half of the words in repeated three-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_values() -> dict[str, Column]:
    """What each rule measures, from 0 upwards."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "repeats": F.col("n_repeat_words") / n,
        "lines": F.col("n_dup_lines") / n,
        "long_words": F.col("word_chars") / n / 100,
    }


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the rate at which ``k`` or fewer of ``n`` have probability ``level``; 1 if nothing was seen."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if _tail(k, n, mid) > level:
            low = mid
        else:
            high = mid
    return high


def _tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for a binomial, k below its mean: terms downwards from k until they no longer count."""
    if p >= 1:
        return 0.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if p > 0 else float(k == 0)
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p) if p > 0 else 0
        i -= 1
    return total


def choose(rejected: list[int], good: int, rate: float, level: float) -> int | None:
    """The last safe step going down from the highest, of the rejected good documents at each step; None if the first fails."""
    safe = None
    for step in range(len(rejected) - 1, -1, -1):
        if upper_bound(rejected[step], good, level) > rate:
            break
        safe = step
    return safe


def cutoff_table(counts: DataFrame, good: Column, stratum: Column, rate: float = 0.05, level: float = 0.05, steps: int = 64) -> DataFrame:
    """stratum, rule, cutoff from the rows of ``measured`` for which ``good`` holds and the base rules pass.

    ``rate`` is the share of a stratum's good documents that all its rules may reject together, ``level`` the
    chance that any cut-off of the stratum breaks its part of it; both are divided among the rules. Strata
    are not divided further: each has its own guarantee at ``level``. Candidates are ``steps`` fixed values
    from 1/200 up on a geometric scale, so they do not depend on the labels. A stratum's and rule's
    histogram of ``steps`` numbers is one small task's work, however many strata there are. A null stratum
    counts as the empty one; repeated rows count as often as they stand; no good rows give no cut-offs.
    """
    rules, grid = rule_values(), candidates(steps)
    rows = counts.filter(~base_failed() & good).select(F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum"), F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), v.alias("value")) for r, v in rules.items()])).alias("x")).select("stratum", "x.rule", "x.value")
    # number of candidates below the value: a document is rejected by exactly those
    over = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g < F.col("value")))
    histogram = rows.groupBy("stratum", "rule", over.alias("over")).agg(F.count("*").alias("n"))
    share = len(rules)

    def cut(group: pa.Table) -> pa.Table:
        n = [0] * (steps + 1)
        for over, k in zip(group.column("over").to_pylist(), group.column("n").to_pylist()):
            n[over] += k
        step = choose([sum(n[k + 1 :]) for k in range(steps)], sum(n), rate / share, level / share)
        return group.select(["stratum", "rule"]).slice(0, 0 if step is None else 1).append_column("cutoff", pa.array([] if step is None else [grid[step]], pa.float64()))

    return histogram.groupBy("stratum", "rule").applyInArrow(cut, "stratum string, rule string, cutoff double")


def fit_cutoffs(counts: DataFrame, good: Column, stratum: Column, **options) -> dict[tuple[str, str], float]:
    """``cutoff_table`` on the driver, by (stratum, rule): for few strata."""
    return {(r["stratum"], r["rule"]): r["cutoff"] for r in cutoff_table(counts, good, stratum, **options).collect()}


#: Steps of a joint chain: first so many candidates above all good documents of the fitting part, then at so large a share of them.
MARGINS = (8, 4, 0)
SHARES = (1 / 400, 1 / 200, 1 / 100, 1 / 50, 1 / 25)


def joint_cutoffs(counts: DataFrame, good: Column, fit: Column, stratum: Column, rate: float = 0.05, level: float = 0.05, steps: int = 64) -> DataFrame:
    """stratum, rule, cutoff: all rules of a stratum tested together, so that few labels suffice.

    ``good`` is NULL for rows without a label, ``fit`` tells which labelled rows fix the order of tests; the others are
    tested on. From the fitting part's good rows comes a chain of cut-off vectors, each rule no looser than a step
    before: ``MARGINS`` candidates above all of them, then above all but each of ``SHARES``. The chain is tested on the
    other part in that order, each step for what all rules together reject of its good rows (Clopper-Pearson at
    ``level`` against ``rate``), up to the first that fails: a fixed sequence, which needs no division. Of the steps
    that hold, the one is taken that rejects most bad less good rows of the fitting part, the loosest on ties; the
    guarantee holds for all of them at once. A chain is some fifty numbers a stratum, and one small task's work.

    A null stratum is the empty one; repeated rows count as often as they stand; a stratum without good rows in
    both parts, and an empty table, give no cut-offs.
    """
    values, grid = rule_values(), candidates(steps)
    rules = list(values)
    below = lambda v: F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g < v))
    over = F.array(*[below(v) for v in values.values()])
    named = F.coalesce(stratum.cast("string"), F.lit("")).alias("stratum")
    rows = staged(counts.filter(~base_failed() & good.isNotNull()).select(named, good.alias("good"), F.coalesce(fit, F.lit(False)).alias("fit"), over.alias("over")), "labelled")
    histogram = rows.filter("good AND fit").select("stratum", F.posexplode("over").alias("rule", "over")).groupBy("stratum", "rule", "over").agg(F.count("*").alias("n"))

    def chain(group: pa.Table) -> pa.Table:
        n = [[0] * (steps + 1) for _ in rules]
        for rule, at, k in zip(*(group.column(c).to_pylist() for c in ("rule", "over", "n"))):
            n[rule][at] += k
        above = [[sum(x[k + 1 :]) for k in range(steps + 1)] for x in n]
        least = lambda share: [next(k for k in range(steps + 1) if a[k] <= share * sum(x)) for a, x in zip(above, n)]
        made = [[min(steps, k + m) for k in least(0)] for m in MARGINS] + [least(share) for share in SHARES]
        return pa.table({"stratum": group.column("stratum")[:1], "chain": pa.array([made], pa.list_(pa.list_(pa.int32())))})

    chains = staged(histogram.groupBy("stratum").applyInArrow(chain, "stratum string, chain array<array<int>>"), "chains")
    rejects = lambda c: F.exists(F.zip_with("over", c, lambda o, k: o > k), lambda x: x)
    passed = F.size(F.filter("chain", lambda c: ~rejects(c)))  # the first so many steps, as each is no looser than the one before
    found = rows.join(chains, "stratum").groupBy("stratum", "good", "fit", passed.alias("passed")).agg(F.count("*").alias("n"))

    def pick(group: pa.Table) -> pa.Table:
        counted = list(zip(*(group.column(c).to_pylist() for c in ("good", "fit", "passed", "n"))))
        lost = lambda g, f, step: sum(n for good, fit, passed, n in counted if good == g and fit == f and passed <= step)
        length = len(MARGINS) + len(SHARES)
        best = None
        for step in range(length):
            if upper_bound(lost(True, False, step), lost(True, False, length), level) > rate:
                break
            gain = lost(False, True, step) - lost(True, True, step)
            if best is None or gain > best[0]:
                best = (gain, step)
        return pa.table({"stratum": group.column("stratum").slice(0, 0 if best is None else 1), "step": pa.array([] if best is None else [best[1]], pa.int32())})

    picked = found.groupBy("stratum").applyInArrow(pick, "stratum string, step int").join(chains, "stratum")
    cut = picked.select("stratum", F.posexplode(F.get("chain", F.col("step"))).alias("at", "k")).filter(F.col("k") < steps)
    return cut.select("stratum", F.array(*[F.lit(r) for r in rules])[F.col("at")].alias("rule"), F.array(*[F.lit(g) for g in grid])[F.col("k")].alias("cutoff"))


def candidates(steps: int) -> list[float]:
    """Cut-offs tried, from 0.005 to 4."""
    return [0.005 * 800 ** (k / (steps - 1)) for k in range(steps)]


def judged(counts: DataFrame, cutoffs: DataFrame | dict[tuple[str, str], float], stratum: Column, keep: list[str]) -> DataFrame:
    """``keep``, the counts, base_failed and kept: false if the base rules or a cut-off of the stratum reject.

    A stratum without safe cut-offs (too few labels, or none) is judged by the base rules alone. Repeated
    rows give repeated results, an empty table an empty one; columns in ``keep`` that are named like a
    result are left out. Cut-offs are joined by stratum, one row each: broadcast if they are small.
    """
    if isinstance(cutoffs, dict):
        cutoffs = counts.sparkSession.createDataFrame([(s, r, c) for (s, r), c in cutoffs.items()], "stratum string, rule string, cutoff double")
    rules = rule_values()
    wide = cutoffs.groupBy(F.col("stratum").alias("__stratum")).agg(*[F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in rules])
    rows = counts.withColumn("__stratum", F.coalesce(stratum.cast("string"), F.lit(""))).join(wide, "__stratum", "left")
    rejected = reduce(Column.__or__, [F.coalesce(value > F.col(f"__{rule}"), F.lit(False)) for rule, value in rules.items()])
    return rows.select(*kept(keep, [*MEASURES, "base_failed", "kept"]), *MEASURES, base_failed().alias("base_failed"), (~base_failed() & ~rejected).alias("kept"))
