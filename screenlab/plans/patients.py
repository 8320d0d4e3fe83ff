"""Transfer, counts, evidence and audits over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, counts, evidence, metrics, ranking, relational, transfer
from ..sources.tables import event_counts, held_out_predictions, labelled_cells, screen_cells, table
from .evaluation import metric_rows
from .register import EVENT_SQL, METRIC_SQL, PRED_SQL, Register, as_sql, cell_sql, six
from .screening import _draws

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_CELL = "WITH " + cell_sql()
_TWO = "WITH " + cell_sql() + ", " + cell_sql("l_tax", "tax")
_EVENTS = "WITH " + EVENT_SQL
_METRIC = "WITH " + METRIC_SQL
_PARTS = "lineitem JOIN part ON l_partkey = p_partkey"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))


@register("WITH w AS (SELECT DISTINCT p_brand || '#' || CAST(p_size AS VARCHAR) AS k, p_size % 2 = 0 AS seen FROM part), d AS (SELECT DISTINCT p_brand || '#' || CAST(p_size AS VARCHAR) AS k FROM part WHERE p_partkey % 5 = 0), a AS (SELECT p_brand || '#' || CAST(p_size AS VARCHAR) AS k, count(DISTINCT p_type) > 1 AS several FROM part WHERE p_partkey % 5 IN (1, 2) GROUP BY k), o AS (SELECT DISTINCT p_brand || '#' || CAST(p_size AS VARCHAR) AS k FROM part WHERE p_partkey % 5 = 3) SELECT w.k, CASE WHEN d.k IS NOT NULL AND seen THEN 'retained' WHEN d.k IS NOT NULL THEN 'recovered' WHEN coalesce(several, false) AND o.k IS NULL THEN 'ambiguous' WHEN o.k IS NULL THEN 'unresolved' ELSE 'not_measured' END AS status FROM w LEFT JOIN d ON w.k = d.k LEFT JOIN a ON w.k = a.k LEFT JOIN o ON w.k = o.k")
def recovery_classes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("#", "p_brand", F.col("p_size").cast("string")).alias("k"), F.col("p_type").alias("approved"), (F.col("p_size") % 2 == 0).alias("seen"))
    return cohorts.recovery_classes(p.select("k", "seen").distinct(), p.filter("p_partkey % 5 = 0"), p.filter("p_partkey % 5 IN (1, 2)"), p.filter("p_partkey % 5 = 3"), "k")


@register("SELECT l_suppkey, count(DISTINCT CASE WHEN l_returnflag IN ('A', 'R') THEN l_partkey END) AS burden, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS n_other FROM lineitem GROUP BY l_suppkey")
def event_burden(spark, sf):
    return cohorts.burdens(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey", "l_returnflag", ["A", "R"])


@register("WITH p AS (SELECT l_suppkey, l_partkey % 50 AS bin, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS part FROM lineitem GROUP BY ALL), u AS (SELECT l_suppkey, l_partkey % 50 AS bin, max(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS u FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) SELECT p.l_suppkey, p.bin, part, u AS \"union\" FROM p LEFT JOIN u ON p.l_suppkey = u.l_suppkey AND p.bin = u.bin WHERE u IS NULL OR u < part")
def dominance_breaks(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("bin"), "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("hit"), (F.col("l_quantity") > 45).cast("int").alias("large"))
    union = rows.filter("l_linestatus = 'O'").groupBy("l_suppkey", "bin").agg(F.max("large").alias("hit"))
    return cohorts.dominance(union, rows, ["l_suppkey", "bin"])


@register("SELECT o_custkey, round(median(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS median, count(*) FILTER (o_orderstatus = 'F') AS n_called FROM orders GROUP BY o_custkey")
def called_median(spark, sf):
    return cohorts.called_median(table(spark, sf, "orders"), "o_custkey", "o_totalprice", F.col("o_orderstatus") == "F").withColumn("median", six("median", 4))


@register(f"WITH m AS (SELECT l_partkey, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY l_partkey) SELECT p_brand, count(*) AS n_probes, round(avg(a - b), 6) AS delta FROM m JOIN part ON l_partkey = p_partkey WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY p_brand")
def mapped_delta(spark, sf):
    mapping = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return cohorts.mapped_delta(table(spark, sf, "lineitem"), mapping, "l_partkey", "p_brand", "l_quantity", F.col("l_returnflag") == "R").withColumn("delta", six("delta"))


_PAIRS = f"x AS (SELECT p_brand, l_suppkey, round(avg(l_quantity) FILTER (l_returnflag = 'R') - avg(l_quantity) FILTER (l_returnflag <> 'R'), 9) AS difference FROM {_PARTS} GROUP BY ALL HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag <> 'R') > 0)"


@register(f"WITH {_PAIRS}, " + _draws("p_brand", "l_suppkey", "x", "direction", "p_brand", 50) + ", p AS (SELECT p_brand, count(*) AS n, median(difference) AS median FROM x GROUP BY p_brand), s AS (SELECT p_brand, draw, median(difference) AS stat FROM d GROUP BY ALL), q AS (SELECT p_brand, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM s GROUP BY p_brand), e AS (SELECT p.p_brand, n, median, round(lo, 9) AS lo, round(hi, 9) AS hi, CASE WHEN len(p.p_brand) % 2 = 0 THEN 1 ELSE -1 END AS expected FROM p JOIN q ON p.p_brand = q.p_brand) SELECT p_brand, n, round(median, 4) AS median, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, CASE WHEN (expected > 0 AND lo > 0) OR (expected < 0 AND hi < 0) THEN 'confirmed' WHEN (expected > 0 AND hi < 0) OR (expected < 0 AND lo > 0) THEN 'opposite' ELSE 'open' END AS verdict FROM e")
def paired_direction(spark, sf):
    pairs = transfer.paired_difference(_lines(spark, sf), ["p_brand", "l_suppkey"], F.col("l_returnflag") == "R", "l_quantity").withColumn("difference", six("difference", 9))
    expected = F.when(F.char_length("p_brand") % 2 == 0, 1).otherwise(-1)
    made = cohorts.direction_test(pairs, ["p_brand"], "l_suppkey", "difference", expected, 50, "direction")
    # the SQL's bounds have nine digits before they have four
    return made.select("p_brand", "n", as_sql("median", 4).alias("median"), *[as_sql(as_sql(c, 9), 4).alias(c) for c in ("ci_low", "ci_high")], "verdict")


@register(_CELL + ", r AS (SELECT *, row_number() OVER (PARTITION BY lineage, row_id ORDER BY value, col_id) AS r FROM cell) SELECT lineage, col_id, count(*) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.1), 9) AS q10, round(avg(r), 6) AS mean_place, round(count(*) FILTER (r <= 10) / count(*)::DOUBLE, 6) AS frequency FROM r GROUP BY ALL")
def candidate_summary(spark, sf):
    made = cohorts.candidate_summary(labelled_cells(spark, sf), ["lineage"], "row_id", "col_id", "value", 10)
    return made.select("lineage", "col_id", "n", six("mean", 9).alias("mean"), six("q10", 9).alias("q10"), six("mean_place").alias("mean_place"), six("frequency").alias("frequency"))


@register(_CELL + ", f AS (SELECT col_id, count(*) FILTER (value < 0.03) / nullif(count(*) FILTER (value < 0.06), 0)::DOUBLE AS f FROM cell GROUP BY col_id) SELECT col_id, round(f, 9) AS f, row_number() OVER (ORDER BY round(f, 9) DESC NULLS LAST, col_id) AS place FROM f")
def missing_last_order(spark, sf):
    v = F.col("value")
    f = screen_cells(spark, sf).groupBy("col_id").agg(F.round(F.try_divide(F.count_if(v < 0.03).cast("double"), F.count_if(v < 0.06).cast("double")), 9).alias("f"))
    return ranking.places_missing_last(f, "f", "col_id").select("col_id", "f", "place")


_SHIFT = "s AS (SELECT a.col_id, coalesce(avg_t - avg_c, 0) AS shift FROM (SELECT col_id, avg(value) AS avg_c FROM cell GROUP BY col_id) a LEFT JOIN (SELECT col_id, avg(value) AS avg_t FROM tax GROUP BY col_id) b ON a.col_id = b.col_id)"


@register(_TWO + f", {_SHIFT}, dr AS (SELECT s_suppkey AS row_id, CASE WHEN s_acctbal < 5000 THEN 1 ELSE 0 END AS own FROM supplier), u AS (SELECT m || '/' || d AS scenario, cell.row_id, cell.col_id, round(CASE m WHEN 'shift' THEN greatest(value + shift, 0) ELSE value END - 0.001 * CASE d WHEN 'own' THEN own * (len(cell.col_id) % 3) ELSE 0 END, 9) AS value FROM cell JOIN s ON cell.col_id = s.col_id JOIN dr ON dr.row_id = cell.row_id, (VALUES ('shift'), ('plain')) t(m), (VALUES ('own'), ('neutral')) v(d)), l AS (SELECT scenario, row_id, list(col_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY scenario, row_id ORDER BY value, col_id) AS r FROM u) WHERE r <= 10 GROUP BY ALL) SELECT x.scenario, x.row_id, len(list_intersect(x.top, y.top)) / 10.0::DOUBLE AS overlap FROM l x JOIN l y ON x.row_id = y.row_id AND x.scenario <> 'plain/neutral' AND y.scenario = 'plain/neutral'")
def input_sensitivity(spark, sf):
    """Two mappings times two driver sources, against the plain scores with neutral drivers."""
    cells = screen_cells(spark, sf)
    shift = transfer.mean_shift(cells, screen_cells(spark, sf, "l_tax"), "col_id", "value").select("col_id", "shift")
    drivers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.when(F.col("s_acctbal") < 5000, 1).otherwise(0).alias("own"))
    rows = cells.join(shift, "col_id").join(drivers, "row_id")
    mapped = {"shift": F.greatest(F.col("value") + F.col("shift"), F.lit(0.0)), "plain": F.col("value")}
    driver = {"own": F.col("own") * (F.char_length("col_id") % 3), "neutral": F.lit(0)}
    cases = F.explode(F.array(*[F.struct(F.lit(f"{m}/{d}").alias("scenario"), F.round(x - 0.001 * y, 9).alias("value")) for m, x in mapped.items() for d, y in driver.items()])).alias("c")
    return cohorts.scenario_overlaps(rows.select("row_id", "col_id", cases).select("row_id", "col_id", "c.*"), "scenario", "plain/neutral", "row_id", "col_id", "value", 10)


@register(_TWO + ", j AS (SELECT a.row_id, a.col_id, a.row_id % 3 AS fold, a.value AS x, b.value AS y FROM cell a JOIN tax b ON a.row_id = b.row_id AND a.col_id = b.col_id), h AS (SELECT DISTINCT fold AS held FROM j), f AS (SELECT held, col_id, avg(y) - avg(x) AS shift, stddev_pop(y) AS sd FROM j JOIN h ON fold <> held GROUP BY ALL), k AS (SELECT held AS fold, f.col_id, shift, sd FROM f WHERE sd > 1e-6), e AS (SELECT j.fold, row_id, x + shift AS m, y, (x + shift - y) / sd AS d FROM j JOIN k ON j.fold = k.fold AND j.col_id = k.col_id), r AS (SELECT fold, row_id, count(*) AS n, sum(d * d) AS q, sum(abs(d)) AS a, CASE WHEN var_pop(m) > 0 AND var_pop(y) > 0 THEN corr(m, y) END AS r FROM e GROUP BY ALL) SELECT fold, CAST(sum(n) AS BIGINT) AS n, round(sqrt(sum(q) / sum(n)), 5) AS rmse, round(sum(a) / sum(n), 5) AS mae, round(avg(r), 5) AS pearson FROM r GROUP BY fold")
def mapping_cross_validation(spark, sf):
    made = cohorts.held_mapping_errors(screen_cells(spark, sf), screen_cells(spark, sf, "l_tax"), "row_id", "col_id", "value", 3)
    return made.withColumns({c: six(c, 5) for c in ("rmse", "mae", "pearson")})


@register("SELECT o_orderkey, round(o_totalprice - s, 2) AS difference, n FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - s) > 0.005 OR n > 7")
def recomputed_totals(spark, sf):
    """Orders whose stored total is not what their lines sum up to, or that have too many lines."""
    sums = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"))
    rows = table(spark, sf, "orders").join(sums, "o_orderkey").filter((F.abs(F.col("o_totalprice") - F.col("s")) > 0.005) | (F.col("n") > 7))
    return rows.select("o_orderkey", six(F.col("o_totalprice") - F.col("s"), 2).alias("difference"), "n")


@register(_EVENTS + ", d AS (SELECT feature, label, cell % 10 AS donor, count(*) AS n, avg(count) AS v, avg(CASE WHEN count > 1 THEN 1.0::DOUBLE ELSE 0 END) AS det FROM counts GROUP BY ALL HAVING count(*) >= 2) SELECT feature, label, count(*) AS n_donors, round(median(v), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most, round(avg(det), 6) AS detection FROM d GROUP BY ALL")
def equal_donor_summary(spark, sf):
    rows = event_counts(spark, sf).withColumn("donor", F.col("cell") % 10).withColumn("seen", (F.col("count") > 1).cast("double"))
    return cohorts.equal_donors(rows, ["feature", "label"], "donor", "count", "seen", 2).withColumns({c: six(c) for c in ("median", "least", "most", "detection")})


_QUALITY = "q AS (SELECT cell, min(label) AS label, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS detected, coalesce(sum(count) FILTER (starts_with(feature, 'p')), 0)::DOUBLE / sum(count) AS marked_share FROM counts GROUP BY cell)"


@register(_EVENTS + f", {_QUALITY}, m AS (SELECT 'author' AS mode, * FROM q WHERE cell % 7 <> 0 UNION ALL SELECT 'extra', * FROM q WHERE cell % 7 <> 0 AND detected >= 4 AND marked_share <= 0.25) SELECT mode, label, count(*) AS n, round(avg(total), 6) AS mean_total, round(median(marked_share), 6) AS marked FROM m GROUP BY ALL")
def quality_sensitivity(spark, sf):
    c = event_counts(spark, sf)
    q = counts.quality(c, "cell", "feature", "count", F.col("feature").startswith("p")).join(c.groupBy("cell").agg(F.min("label").alias("label")), "cell")
    author = F.col("cell") % 7 != 0
    modes = {"author": author, "extra": author & (F.col("detected") >= 4) & (F.col("marked_share") <= 0.25)}
    return cohorts.quality_modes(q, modes, ["label"], F.count("*").alias("n"), six(F.avg("total")).alias("mean_total"), six(F.median("marked_share")).alias("marked"))


@register(_CELL + ", g AS (SELECT lineage AS scenario, col_id, avg(value) AS m FROM cell WHERE lineage <> 'EUROPE' GROUP BY ALL), e AS (SELECT col_id, avg(value) AS m FROM cell WHERE lineage = 'EUROPE' GROUP BY col_id), u AS (SELECT 'none' AS scenario, row_id, col_id, round(value, 9) AS value FROM cell WHERE lineage = 'EUROPE' UNION ALL SELECT scenario, row_id, cell.col_id, round(greatest(value + g.m - e.m, 0), 9) FROM cell JOIN e ON e.col_id = cell.col_id JOIN g ON g.col_id = cell.col_id WHERE lineage = 'EUROPE'), l AS (SELECT scenario, row_id, list(col_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY scenario, row_id ORDER BY value, col_id) AS r FROM u) WHERE r <= 10 GROUP BY ALL) SELECT x.scenario, x.row_id, len(list_intersect(x.top, y.top)) / 10.0::DOUBLE AS overlap FROM l x JOIN l y ON x.row_id = y.row_id AND x.scenario <> 'none' AND y.scenario = 'none'")
def scenario_alignment(spark, sf):
    """Rows of one lineage moved to the means of every other, and how many of their lowest columns stay."""
    cells = labelled_cells(spark, sf)
    means = cells.groupBy("lineage", "col_id").agg(F.avg("value").alias("m"))
    own, rows = means.filter("lineage = 'EUROPE'").select("col_id", F.col("m").alias("e")), cells.filter("lineage = 'EUROPE'").select("row_id", "col_id", "value")
    moved = rows.join(own, "col_id").join(means.filter("lineage <> 'EUROPE'").withColumnRenamed("lineage", "scenario"), "col_id").select("scenario", "row_id", "col_id", F.round(F.greatest(F.col("value") + F.col("m") - F.col("e"), F.lit(0.0)), 9).alias("value"))
    plain = rows.select(F.lit("none").alias("scenario"), "row_id", "col_id", F.round("value", 9).alias("value"))
    return cohorts.scenario_overlaps(moved.unionByName(plain), "scenario", "none", "row_id", "col_id", "value", 10)


@register("WITH c AS (SELECT l_suppkey, p_brand, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 1 ELSE 0 END) AS b FROM " + _PARTS + " GROUP BY ALL) SELECT l_suppkey, count(*) FILTER (p_brand <> 'Brand#1' AND a = 0 AND b = 0) AS n_both_zero, count(*) FILTER (p_brand <> 'Brand#1') AS n, round(avg(CASE WHEN p_brand <> 'Brand#1' THEN log2((a + 1) / (b + 1)::DOUBLE) END), 6) AS mean_ratio FROM c GROUP BY l_suppkey")
def paired_log_ratios(spark, sf):
    hit = lambda f: F.sum(F.when((F.col("l_returnflag") == f) & (F.col("l_quantity") > 40), 1).otherwise(0))
    c = _lines(spark, sf).groupBy("l_suppkey", "p_brand").agg(hit("R").alias("a"), hit("A").alias("b"))
    here = F.col("p_brand") != "Brand#1"
    a, b = F.when(here, F.col("a")), F.when(here, F.col("b"))
    return c.groupBy("l_suppkey").agg(F.count_if((a == 0) & (b == 0)).alias("n_both_zero"), F.count(a).alias("n"), six(F.avg(counts.log_ratio(a, b))).alias("mean_ratio"))


#: Rules of the evidence flags, in words that both SQL dialects know.
_FLAGS = {
    "labelled": "quality IS NOT NULL",
    "good": "quality = 1",
    "toxic": "toxic = 1",
    "long": "n_chars > 2000",
    "short": "n_chars < 200",
    "english": "lang = 'en'",
    "no_lang": "lang IS NULL",
    "first_source": "source = 'src0'",
    "clean_good": "quality = 1 AND toxic = 0",
    "conflict": "quality = 1 AND toxic = 1",
    "common_source": "n_source > 20",
    "even": "doc_id % 2 = 0",
}


@register("WITH s AS (SELECT source, count(*) AS n_source FROM documents GROUP BY source) SELECT d.doc_id, " + ", ".join(f"coalesce({sql}, false) AS is_{n}" for n, sql in _FLAGS.items()).replace("doc_id % 2", "d.doc_id % 2").replace("source = 'src0'", "d.source = 'src0'") + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN s ON d.source = s.source")
def evidence_matrix(spark, sf):
    """The frozen list with all evidence joined and twelve flags; no score, no new order."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = evidence.assembled(d, "doc_id", [table(spark, sf, "labels")]).join(d.groupBy("source").agg(F.count("*").alias("n_source")), "source", "left")
    return rows.select("doc_id", *[F.coalesce(F.expr(rule), F.lit(False)).alias(f"is_{n}") for n, rule in _FLAGS.items()])


@register("WITH f AS (SELECT doc_id FROM documents WHERE n_chars > 300), a AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'against' WHEN quality = 1 THEN 'for' ELSE 'open' END AS class FROM labels), j AS (SELECT f.doc_id AS f, a.doc_id AS a, class FROM f FULL JOIN a ON f.doc_id = a.doc_id) SELECT count(*) FILTER (f IS NOT NULL AND a IS NULL) AS not_adjudicated, count(*) FILTER (a IS NOT NULL AND f IS NULL) AS not_frozen, " + ", ".join(f"count(*) FILTER (f IS NOT NULL AND a IS NOT NULL AND class = '{c}') AS n_{c}" for c in ("for", "against", "open")) + " FROM j")
def adjudication_audit(spark, sf):
    rules = [("against", F.col("toxic") == 1), ("for", F.col("quality") == 1)]
    judged = table(spark, sf, "labels").select("doc_id", evidence.first_match(rules, "open").alias("class"))
    return cohorts.audited(table(spark, sf, "documents").filter("n_chars > 300").select("doc_id"), judged, "doc_id", ["for", "against", "open"], "class")


@register("WITH x AS (SELECT s_nationkey, s_suppkey, s_acctbal - 4500 AS v, s_suppkey % 3 = 0 AS outer_set FROM supplier), " + _draws("s_nationkey", "s_suppkey", "x", "screen", "CAST(s_nationkey AS VARCHAR)") + ", p AS (SELECT s_nationkey, count(*) AS n, avg(v) AS mean, CASE WHEN count(*) >= 3 THEN (sum(v) - min(v)) / (count(*) - 1) END AS worst, avg(v) FILTER (outer_set) AS outer_mean FROM x GROUP BY s_nationkey), s AS (SELECT s_nationkey, draw, avg(v) AS stat FROM d GROUP BY ALL), q AS (SELECT s_nationkey, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM s GROUP BY s_nationkey) SELECT p.s_nationkey, n, round(mean, 4) AS mean, round(worst, 4) AS worst, round(outer_mean, 4) AS outer_mean, CASE WHEN n >= 2 THEN round(lo, 3) END AS ci_low, CASE WHEN n >= 2 THEN round(hi, 3) END AS ci_high FROM p JOIN q ON p.s_nationkey = q.s_nationkey")
def residual_evidence(spark, sf):
    """Residual mean with its bootstrap bounds (none below two rows), leave-one-out worst mean, and the mean of an outer subset."""
    from ..operators import resample

    v = F.col("v")
    x = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") - 4500).alias("v"), (F.col("s_suppkey") % 3 == 0).alias("o"))
    p = x.groupBy("s_nationkey").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.when(F.count(v) >= 3, (F.sum(v) - F.min(v)) / (F.count(v) - 1)).alias("worst"), F.avg(F.when(F.col("o"), v)).alias("outer_mean"))
    bounds = resample.bootstrap(x, ["s_nationkey"], "s_suppkey", F.avg("v"), 100, "screen").select("s_nationkey", "ci_low", "ci_high")
    guarded = {c: F.when(F.col("n") >= 2, F.round(c, 3)) for c in ("ci_low", "ci_high")}
    return p.join(bounds, "s_nationkey").withColumns({c: six(c, 4) for c in ("mean", "worst", "outer_mean")} | guarded)


@register("SELECT p_brand, " + ", ".join(f"coalesce(bool_or(l_quantity > 49) FILTER (l_suppkey = {k}), false) AS s{k}" for k in (1, 2, 3)) + f" FROM {_PARTS} GROUP BY p_brand")
def binary_table(spark, sf):
    rows = _lines(spark, sf).filter("l_suppkey IN (1, 2, 3)").select("p_brand", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), "l_quantity")
    wide = relational.pivoted(rows, ["p_brand"], "s", ["s1", "s2", "s3"], F.bool_or(F.col("l_quantity") > 49))
    return table(spark, sf, "part").select("p_brand").distinct().join(_lines(spark, sf).select("p_brand").distinct(), "p_brand", "left_semi").join(wide, "p_brand", "left").select("p_brand", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("s1", "s2", "s3")])


@register("WITH k AS (SELECT DISTINCT n_name FROM nation), c AS (SELECT n_name, count(DISTINCT s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 8000 GROUP BY n_name) SELECT k.n_name, coalesce(n, 0) AS n, coalesce(n, 0) >= 2 AS enough FROM k LEFT JOIN c ON k.n_name = c.n_name")
def coverage_by_group(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 8000").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return cohorts.coverage_by(table(spark, sf, "nation"), s, "n_name", "s_suppkey", 2)


@register("WITH m AS (SELECT l_suppkey, r_name, avg(l_discount - 0.05) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL), c AS (SELECT l_suppkey, count(*) FILTER (round(v, 12) < 0) AS n_negative, coalesce(bool_or(round(v, 12) < 0) FILTER (r_name = 'ASIA'), false) AS first FROM m GROUP BY l_suppkey) SELECT l_suppkey, n_negative, CASE WHEN n_negative >= 4 AND first THEN 'A' WHEN n_negative >= 2 THEN 'B' ELSE 'exploratory' END AS tier FROM c")
def tiered_candidates(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "r_name").agg(F.round(F.avg(F.col("l_discount") - 0.05), 12).alias("v"))
    return cohorts.tiers(rows, "l_suppkey", "r_name", "v", ["ASIA", "AFRICA", "AMERICA", "EUROPE", "MIDDLE EAST"], 4, 2)


@register("WITH e AS (SELECT user_id % 20 AS run, list(DISTINCT event_type) AS members, arg_max(event_type, (value, event_id)) AS event FROM events WHERE value > 12 GROUP BY ALL) SELECT run % 4 AS method, key, count(*) AS n_runs, round(avg(CASE WHEN list_contains(members, key) THEN 1.0::DOUBLE ELSE 0 END), 6) AS as_node, round(avg(CASE WHEN event = key THEN 1.0::DOUBLE ELSE 0 END), 6) AS as_event FROM e, (VALUES ('click'), ('error'), ('absent')) t(key) GROUP BY ALL")
def tracked_frequency(spark, sf):
    runs = table(spark, sf, "events").filter("value > 12").groupBy((F.col("user_id") % 20).alias("run")).agg(F.collect_set("event_type").alias("members"), F.max_by("event_type", F.struct("value", "event_id")).alias("event"))
    made = cohorts.selected_often(runs.withColumn("method", F.col("run") % 4), ["method"], "members", ["click", "error", "absent"], "event")
    return made.withColumns({c: six(c) for c in ("as_node", "as_event")})


@register("WITH g AS (SELECT p_brand AS a, l_returnflag AS f, sum(l_quantity * l_discount) AS v FROM " + _PARTS + " GROUP BY ALL), s AS (SELECT a, sum(v) FILTER (f = 'A') AS one, sum(v) FILTER (f = 'R') AS two, sum(v) FILTER (f IN ('A', 'R')) + max(v) FILTER (f = 'N') / 100 AS pair FROM g GROUP BY a) SELECT a, round(pair - one - two, 4) AS beyond FROM s")
def pair_non_additivity(spark, sf):
    from ..operators.graph import non_additivity

    g = _lines(spark, sf).groupBy(F.col("p_brand").alias("a"), F.col("l_returnflag").alias("f")).agg(F.sum(F.col("l_quantity") * F.col("l_discount")).alias("v"))
    of = lambda *f: F.sum(F.when(F.col("f").isin(*f), F.col("v")))
    s = g.groupBy("a").agg(of("A").alias("one"), of("R").alias("two"), (of("A", "R") + of("N") / 100).alias("pair"))
    return s.select("a", six(non_additivity(F.col("pair"), F.col("one"), F.col("two")), 4).alias("beyond"))


@register(_METRIC + ", m AS (SELECT lineage, count(*) AS n, avg(spearman) AS mean, median(spearman) AS median, avg(CASE WHEN spearman > 0 THEN 1.0::DOUBLE WHEN spearman IS NOT NULL THEN 0 END) AS positive FROM metric GROUP BY lineage) SELECT lineage, n, round(mean, 6) AS mean, round(median, 6) AS median, round(positive, 6) AS positive, CASE WHEN n < 5 THEN 'stop' WHEN round(median, 6) > 0 AND round(positive, 6) >= 0.75 THEN 'go' ELSE 'stop' END AS gate FROM m")
def stability_gate(spark, sf):
    """Summary of each lineage's repeats and the decision that a rule written beforehand takes on it."""
    v = F.col("spearman")
    m = metric_rows(spark, sf).groupBy("lineage").agg(F.count("*").alias("n"), six(F.avg(v)).alias("mean"), six(F.median(v)).alias("median"), six(F.avg((v > 0).cast("double"))).alias("positive"))
    return m.withColumn("gate", metrics.gate(F.col("n"), F.col("median"), F.col("positive"), 5, 0.75))


@register(_METRIC + ", s AS (SELECT lineage, avg(ndcg) AS ndcg FROM metric GROUP BY lineage), a AS (SELECT lineage, CASE WHEN lineage = 'ASIA' THEN ndcg + 0.01 ELSE ndcg END AS stored FROM s WHERE lineage <> 'AFRICA') SELECT coalesce(a.lineage, s.lineage) AS lineage, round(stored, 6) AS stored, round(ndcg, 6) AS again FROM a FULL JOIN s ON a.lineage = s.lineage WHERE a.lineage IS NULL OR abs(stored - ndcg) > 1e-9")
def altered_summary_found(spark, sf):
    """A stored summary with one changed and one missing row against what the rows of the metric give."""
    from ..operators.governance import differences

    again = metric_rows(spark, sf).groupBy("lineage").agg(F.avg("ndcg").alias("ndcg"))
    stored = again.filter("lineage <> 'AFRICA'").withColumn("ndcg", F.col("ndcg") + F.when(F.col("lineage") == "ASIA", 0.01).otherwise(0.0))
    return differences(stored, again, ["lineage"], "ndcg", 1e-9).withColumns({c: six(c) for c in ("stored", "again")})


_PINS = [("customer", "n", 1500.0), ("supplier", "n", 100.0), ("nation", "n", 25.0), ("region", "n", 5.0), ("supplier", "mean_key", 49.5)]


@register("WITH v AS (SELECT 'customer' AS item, 'n' AS what, count(*)::DOUBLE AS found FROM customer UNION ALL SELECT 'supplier', 'n', count(*) FROM supplier UNION ALL SELECT 'nation', 'n', count(*) FROM nation UNION ALL SELECT 'region', 'n', count(*) FROM region UNION ALL SELECT 'supplier', 'mean_key', avg(s_suppkey) FROM supplier), p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in _PINS) + ") t(item, what, pinned)) SELECT item, what, pinned, found, abs(found - pinned) <= 1e-9 AS holds FROM p JOIN v USING (item, what)")
def pinned_values(spark, sf):
    """Values stated beforehand against what the tables give."""
    from ..operators.governance import pins

    found = None
    for name in ("customer", "supplier", "nation", "region"):
        row = table(spark, sf, name).agg(F.count("*").cast("double").alias("found")).select(F.lit(name).alias("item"), F.lit("n").alias("what"), "found")
        found = row if found is None else found.unionByName(row)
    mean = table(spark, sf, "supplier").agg(F.avg("s_suppkey").alias("found")).select(F.lit("supplier").alias("item"), F.lit("mean_key").alias("what"), "found")
    return pins(spark.createDataFrame(_PINS, "item string, what string, pinned double"), found.unionByName(mean), ["item", "what"], 1e-9)


@register("WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank FROM part GROUP BY p_brand), g AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) FILTER (p_partkey % 10 <> 0) DESC, p_brand) AS rank FROM part GROUP BY p_brand) SELECT f.p_brand, f.rank AS frozen, g.rank AS now, f.rank = g.rank AS same FROM f JOIN g ON f.p_brand = g.p_brand WHERE f.rank <= 20")
def frozen_order(spark, sf):
    """The first twenty places of a frozen list, and where its members stand now."""
    from ..operators.governance import order_kept

    p = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("a"), F.count_if(F.col("p_partkey") % 10 != 0).alias("b"))
    frozen = ranking.category_places(p.withColumn("t", F.lit("x")), "t", ["x"], F.desc("a"), "p_brand").select("p_brand", F.col("place").alias("frozen"))
    now = ranking.category_places(p.withColumn("t", F.lit("x")), "t", ["x"], F.desc("b"), "p_brand").select("p_brand", F.col("place").alias("now"))
    return order_kept(frozen, now, "p_brand", 20)


@register("SELECT p_brand, p_size % 5 AS grid, count(*) AS n, max(p_retailprice) AS worst, max(p_retailprice) <= 1900 AS passed FROM part GROUP BY ALL")
def certificate_roll_up(spark, sf):
    """Largest violation by fold and grid point, with the pass rule."""
    from ..operators.governance import roll_up

    p = table(spark, sf, "part").select("p_brand", (F.col("p_size") % 5).alias("grid"), F.col("p_retailprice").alias("violation"))
    return roll_up(p, ["p_brand", "grid"], "violation", 1900.0)


@register(_METRIC + ", c AS (SELECT lineage, n % 3 AS option, avg(ndcg) AS score FROM metric GROUP BY ALL), b AS (SELECT lineage, arg_min(option, (-round(score, 9), option)) AS best FROM c GROUP BY lineage) SELECT lineage, best, CASE WHEN lineage = 'EUROPE' THEN 9 ELSE best END AS stored, lineage <> 'EUROPE' AS follows FROM b")
def selection_follows_rule(spark, sf):
    """Stored choices, one of them altered, against the choice that the stated rule takes."""
    c = metric_rows(spark, sf).groupBy("lineage", (F.col("n") % 3).alias("option")).agg(F.round(F.avg("ndcg"), 9).alias("score"))
    best = metrics.choose_highest(c, ["lineage"], "option", "score", "option").select("lineage", F.col("option").alias("best"))
    stored = best.withColumn("stored", F.when(F.col("lineage") == "EUROPE", 9).otherwise(F.col("best")))
    return stored.select("lineage", "best", F.col("stored").cast("long").alias("stored"), (F.col("stored") == F.col("best")).alias("follows"))


@register(_METRIC + ", k AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY round(spearman, 9), row_id) AS p, count(*) OVER (PARTITION BY lineage) AS size FROM metric WHERE spearman IS NOT NULL), t AS (SELECT lineage, avg(regret) FILTER (p > 2 * size / 3.0::DOUBLE) - avg(regret) FILTER (p <= size / 3.0::DOUBLE) AS contrast, count(*) AS n FROM k GROUP BY lineage) SELECT lineage, n, round(contrast, 6) AS contrast FROM t")
def tertile_contrast(spark, sf):
    """Mean regret of the most stable third less that of the least stable third."""
    rows = metric_rows(spark, sf).filter("spearman IS NOT NULL").withColumn("s", F.round("spearman", 9))
    k = ranking.placed(rows, ["lineage"], "s", "row_id")
    third = F.col("size") / 3.0
    made = F.avg(F.when(F.col("place") > 2 * third, F.col("regret"))) - F.avg(F.when(F.col("place") <= third, F.col("regret")))
    return k.groupBy("lineage").agg(F.count("*").alias("n"), six(made).alias("contrast"))


@register("WITH " + PRED_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY predicted, col_id) AS rp, row_number() OVER (PARTITION BY row_id ORDER BY truth, col_id) AS rt FROM pred WHERE truth IS NOT NULL AND predicted IS NOT NULL) SELECT row_id, round(avg(truth) FILTER (rp <= 10), 6) AS selected, round(avg(truth) FILTER (rt <= 10), 6) AS oracle, round(count(*) FILTER (rp <= 10 AND truth < -0.005) / 10.0::DOUBLE, 6) AS precision FROM r GROUP BY row_id HAVING count(*) >= 10")
def selected_and_oracle(spark, sf):
    """Mean truth of the predicted and of the true ten lowest, and the share of binary hits among the predicted."""
    made = metrics.selected_effects(held_out_predictions(labelled_cells(spark, sf)), ["row_id"], "col_id", "truth", "predicted", 10, -0.005)
    return made.withColumns({c: six(c) for c in ("selected", "oracle", "precision")})


@register("WITH " + PRED_SQL + ", w AS (SELECT lineage, count(*) AS n, 1 - sum((truth - predicted) ** 2) / sum(truth * truth) AS gain FROM pred WHERE truth IS NOT NULL AND predicted IS NOT NULL AND ends_with(col_id, 'ECONOMY') GROUP BY lineage) SELECT lineage, n, round(gain, 4) AS gain FROM w")
def scoped_gain(spark, sf):
    """Gain over a baseline on a subset of targets."""
    pred = held_out_predictions(labelled_cells(spark, sf)).filter(F.col("col_id").endswith("ECONOMY")).withColumn("zero", F.lit(0.0))
    return metrics.scope_metrics(pred, ["lineage"], "col_id", "truth", "predicted", "zero").select("lineage", "n", six("gain", 4).alias("gain"))
