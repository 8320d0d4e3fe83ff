"""Evidence without a look at what is locked, stored models and kernels on rows from elsewhere, summaries over groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, kernels, metrics, split, transfer
from ..sources.publish import staged
from ..sources.tables import exact_sum, labelled_cells, suppliers, table
from .duals import _SQL as _BOUGHT
from .duals import _tables as _bought
from .evaluation import metric_rows
from .register import METRIC_SQL, Register, as_sql, cell_sql, six
from .screening import _HASH, _draws, _q

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_ARMS_SQL = f"""arms AS (SELECT o_custkey AS customer, p_brand AS brand, l_returnflag = 'R' AS is_case, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(*) AS v
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('R', 'A') GROUP BY ALL
), sp AS (SELECT c_custkey AS customer, CASE WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) THEN 'train' WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) + greatest(round_even(n * 0.2::DOUBLE, 0), 1) THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT c_custkey, {_HASH.format('c_mktsegment', 'evidence', 'c_custkey', 'c_custkey')} AS p, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer))"""


def _arms(spark, sf):
    """Customers by what they return (cases) and keep (normals) of each brand, and their splits inside segments."""
    o, p = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("customer")), table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    line = table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("R", "A")).select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_returnflag") == "R").alias("is_case"))
    rows = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(p, line["l_partkey"] == p["p_partkey"])
    cells = rows.groupBy("customer", "brand", "is_case").agg((exact_sum(F.col("l_quantity")) / F.count("*")).alias("v"))
    splits = split.hash_split(table(spark, sf, "customer"), "c_custkey", "c_mktsegment", "evidence").select(F.col("c_custkey").alias("customer"), "split")
    return cells, splits


@register(f"""WITH {_ARMS_SQL}, w AS (SELECT split, customer, brand, max(v) FILTER (is_case) AS x, max(v) FILTER (NOT is_case) AS y FROM arms JOIN sp USING (customer) WHERE split <> 'test' GROUP BY ALL
), ref AS (SELECT brand, round(avg(y), 9) AS r FROM w WHERE split = 'train' GROUP BY brand
), points AS (SELECT split, brand, count(*) AS n, round(median(x - r), 6) AS median, round(avg(CASE WHEN x > r THEN 1.0::DOUBLE ELSE 0 END), 6) AS above FROM w JOIN ref USING (brand) WHERE x IS NOT NULL AND r IS NOT NULL GROUP BY ALL
), pr AS (SELECT split || '/' || brand AS grp, customer, x - y AS gap FROM w WHERE x IS NOT NULL AND y IS NOT NULL
), {_draws('grp', 'customer', 'pr', 'paired', 'grp')}, s AS (SELECT grp, draw, median(gap) AS stat FROM d GROUP BY ALL
), bounds AS (SELECT grp, {_q('stat', 6)} FROM s GROUP BY grp), pp AS (SELECT grp, count(*) AS n_pairs, round(median(gap), 6) AS paired_median FROM pr GROUP BY grp)
SELECT split, brand, points.n, median, above, coalesce(n_pairs, 0) AS n_pairs, paired_median, ci_low, boot_median, ci_high FROM points LEFT JOIN pp ON pp.grp = split || '/' || brand LEFT JOIN bounds ON bounds.grp = pp.grp""")
def split_evidence(spark, sf):
    """What customers return against what those of the training split keep, for each brand, in the two splits that are not locked."""
    made = cohorts.split_evidence(*_arms(spark, sf), "customer", "brand", "v", "is_case", 100, "paired")
    return made.withColumns({c: as_sql(c) for c in ("median", "above", "paired_median", "ci_low", "boot_median", "ci_high")})


@register(f"""WITH {_ARMS_SQL}, h AS (SELECT customer, bool_or(is_case) AS x, bool_or(NOT is_case) AS y FROM arms GROUP BY customer)
SELECT coalesce(split, 'none') AS split, count(*) FILTER (x) AS n_case, count(*) FILTER (y) AS n_normal, count(*) FILTER (x AND y) AS n_pairs, coalesce(split, 'none') IN ('train', 'validation') AS used FROM h LEFT JOIN sp USING (customer) GROUP BY ALL""")
def split_evidence_audit(spark, sf):
    """Who is in the splits of ``split_evidence``, and who is left out of it."""
    return cohorts.split_audit(*_arms(spark, sf), "customer", "is_case")


_SCENARIO_SQL = """line AS (SELECT l_suppkey AS donor, r_name AS lineage, p_brand AS brand, l_returnflag = 'R' AS other, CAST(l_discount AS DECIMAL(12,2)) AS d, CAST(l_tax AS DECIMAL(12,2)) AS t
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), fit AS (SELECT donor, brand, CAST(sum(d) AS DOUBLE) / count(*) AS x, CAST(sum(t) AS DOUBLE) / count(*) AS y FROM line WHERE lineage <> 'EUROPE' GROUP BY ALL
), model AS (SELECT brand, avg(x) AS mean, min(x) AS low, max(x) AS high, avg(y) AS bias, count(*) * covar_pop(x, y) / (count(*) * var_pop(x) + 0.01) AS weight FROM fit GROUP BY brand
), prof AS (SELECT donor, brand, CAST(sum(d) FILTER (NOT other) AS DOUBLE) / count(*) FILTER (NOT other) AS a, CAST(sum(d) FILTER (other) AS DOUBLE) / count(*) FILTER (other) AS b, CAST(sum(d) AS DOUBLE) / count(*) AS whole FROM line WHERE lineage = 'EUROPE' GROUP BY ALL
), scn AS (SELECT donor, brand, 'pure' AS scenario, a AS v FROM prof UNION ALL SELECT donor, brand, 'all', whole FROM prof UNION ALL SELECT donor, brand, 'mix_' || CAST(f AS VARCHAR), (100 - f) / 100.0::DOUBLE * a + f / 100.0::DOUBLE * b FROM prof, (SELECT unnest([25, 50, 75]) AS f)
), own AS (SELECT scenario, brand, avg(v) AS own FROM scn GROUP BY ALL
), mv AS (SELECT scenario, donor, scn.brand, greatest(v + model.mean - own, 0) AS v FROM scn JOIN own USING (scenario, brand) JOIN model USING (brand) WHERE v IS NOT NULL
), sc AS (SELECT scenario, donor, brand AS target, round(bias + (v - mean) * weight, 9) AS score, CASE WHEN v < low - 1e-9 OR v > high + 1e-9 THEN 1.0::DOUBLE ELSE 0 END AS outside FROM mv JOIN model USING (brand))"""


def _scenario_scores(spark, sf):
    """Suppliers of one region in five mixtures of what they sell, scored by a model of all other regions that is stored first."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    who = suppliers(spark, sf).select(F.col("row_id").alias("donor"), "lineage")
    rows = line.join(part, line["l_partkey"] == part["p_partkey"]).join(who, line["l_suppkey"] == who["donor"])
    other = F.col("l_returnflag") == "R"
    each = staged(
        rows.groupBy("donor", "lineage", "brand").agg(
            F.try_divide(exact_sum(F.when(~other, F.col("l_discount"))), F.count_if(~other)).alias("a"),
            F.try_divide(exact_sum(F.when(other, F.col("l_discount"))), F.count_if(other)).alias("b"),
            (exact_sum(F.col("l_discount")) / F.count("*")).alias("whole"),
            (exact_sum(F.col("l_tax")) / F.count("*")).alias("y"),
        ),
        "profiles",
    )
    x, y, n = F.col("whole"), F.col("y"), F.count("*")
    slope = n * F.covar_pop(x, y) / (n * F.var_pop(x) + 0.01)
    fitted = each.filter("lineage <> 'EUROPE'").groupBy("brand").agg(F.avg(x).alias("mean"), (F.min(x) - 1e-9).alias("low"), (F.max(x) + 1e-9).alias("high"), slope.alias("weight"), F.avg(y).alias("bias"))
    model = staged(fitted.withColumn("target", F.col("brand")), "model")
    mixed = [F.struct(F.lit(f"mix_{f}").alias("scenario"), ((100 - f) / 100 * F.col("a") + f / 100 * F.col("b")).alias("v")) for f in (25, 50, 75)]
    all_ = F.array(F.struct(F.lit("pure").alias("scenario"), F.col("a").alias("v")), F.struct(F.lit("all").alias("scenario"), F.col("whole").alias("v")), *mixed)
    scenarios = each.filter("lineage = 'EUROPE'").select("donor", "brand", F.explode(all_).alias("s")).select("s.scenario", "donor", "brand", "s.v")
    moved = transfer.aligned(scenarios, "scenario", "brand", "v", model)
    return transfer.frozen_scores(moved, model, ["scenario", "donor"], "brand", "v").withColumn("score", F.round("score", 9))


@register(f"WITH {_SCENARIO_SQL} SELECT scenario, donor, count(*) AS n, round(avg(score), 7) AS mean_score, round(min(score), 7) AS least, round(avg(outside), 6) AS outside FROM sc GROUP BY ALL")
def scenario_scores(spark, sf):
    """Each donor's scores under each scenario in short, and how often its values are beyond what the model saw."""
    made = _scenario_scores(spark, sf).groupBy("scenario", "donor")
    return made.agg(F.count("*").alias("n"), six(F.avg("score"), 7).alias("mean_score"), six(F.min("score"), 7).alias("least"), six(F.avg("outside")).alias("outside"))


@register(f"WITH {_SCENARIO_SQL}, l AS (SELECT scenario, donor, list(target) AS top FROM (SELECT *, row_number() OVER (PARTITION BY scenario, donor ORDER BY score, target) AS r FROM sc) WHERE r <= 10 GROUP BY ALL) SELECT x.scenario, x.donor, len(list_intersect(x.top, y.top)) / 10.0::DOUBLE AS overlap FROM l x JOIN l y ON x.donor = y.donor AND x.scenario <> 'pure' AND y.scenario = 'pure'")
def scenario_score_overlap(spark, sf):
    """How many of a donor's ten lowest scores stay when its profile is a mixture."""
    return cohorts.scenario_overlaps(_scenario_scores(spark, sf), "scenario", "pure", "donor", "target", "score", 10)


@register(_BOUGHT + """, e AS (SELECT id, lineage, lineage <> 'EUROPE' AS train, CASE WHEN lineage <> 'EUROPE' THEN lineage END AS cat, CASE WHEN lineage <> 'EUROPE' THEN CASE WHEN ends_with(id, 'BUILDING') THEN 1.0::DOUBLE ELSE 0 END END AS flag FROM entity
), all_cells AS (SELECT id, 'category' AS block, 'category=' || c AS col, CASE WHEN cat = c THEN 1.0::DOUBLE ELSE 0 END AS v FROM e, (SELECT DISTINCT cat AS c FROM e WHERE cat IS NOT NULL)
  UNION ALL SELECT id, 'flag', 'building', coalesce(flag, 0) FROM e UNION ALL SELECT id, 'mean', 'mean', avg(v) FROM cell GROUP BY id UNION ALL SELECT id, 'parts', CAST(col AS VARCHAR), v FROM cell
), m AS (SELECT block, col, avg(v) AS m FROM all_cells JOIN e USING (id) WHERE train GROUP BY ALL
), s AS (SELECT block, col, any_value(m) AS m, sqrt(sum((v - m) * (v - m)) / (SELECT count(*) FROM e WHERE train)) AS sd FROM all_cells JOIN e USING (id) JOIN m USING (block, col) WHERE train GROUP BY ALL HAVING sd > 1e-8
), z AS (SELECT block, id, train, col, (v - m) / sd AS z FROM s JOIN all_cells USING (block, col) JOIN e USING (id)
), k AS (SELECT a.block, a.id AS id_a, b.id AS id_b, sum(a.z * b.z) AS dot FROM z a JOIN z b ON a.block = b.block AND a.col = b.col AND NOT a.train AND b.train GROUP BY ALL
), u AS (SELECT block, count(*) AS used FROM s GROUP BY block)
SELECT u.block, a.id AS id_a, b.id AS id_b, round(coalesce(dot, 0), 4) + 0.0::DOUBLE AS dot, used FROM u JOIN e a ON NOT a.train JOIN e b ON b.train LEFT JOIN k ON k.block = u.block AND k.id_a = a.id AND k.id_b = b.id""")
def external_kernel(spark, sf):
    """Entities of one region against those of the others, by block: categories and flags that they lack are neutral, means and parts observed."""
    cells, _, groups = _bought(spark, sf)
    train = F.col("lineage") != "EUROPE"
    rows = staged(groups.select("id", "lineage").distinct().withColumns({"train": train, "category": F.when(train, F.col("lineage")), "building": F.when(train, F.col("id").endswith("BUILDING").cast("double"))}), "entities")
    annotation = kernels.annotation_cells(rows, "id", "category", "train", ["building"])
    parts = cells.select("id", F.lit("parts").alias("block"), F.col("col").cast("string").alias("column"), F.col("v").alias("value"))
    made = kernels.external_kernels(annotation.unionByName(kernels.row_mean_cells(parts, "id", "value", "mean")).unionByName(parts), rows, "id", "train")
    far = rows.filter("NOT train").select(F.col("id").alias("id_a"))
    near = rows.filter("train").select(F.col("id").alias("id_b"))
    return made.join(F.broadcast(far), "id_a", "left_semi").join(F.broadcast(near), "id_b", "left_semi").select("block", "id_a", "id_b", (six("dot", 4) + 0.0).alias("dot"), "used")


@register("WITH " + METRIC_SQL + ", per AS (SELECT lineage, cluster, avg(round(ndcg - overlap, 9)) AS v FROM metric WHERE ndcg IS NOT NULL GROUP BY ALL), " + _draws("lineage", "cluster", "per", "groups", "lineage") + f", s AS (SELECT lineage, draw, avg(v) AS stat FROM d GROUP BY ALL), q AS (SELECT lineage, {_q('stat', 6)} FROM s GROUP BY lineage) SELECT lineage, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS positive, any_value(ci_low) AS ci_low, any_value(boot_median) AS boot_median, any_value(ci_high) AS ci_high FROM per JOIN q USING (lineage) GROUP BY lineage")
def cross_group_summary(spark, sf):
    """What one metric has over another: mean, median and positive share over nations that count alike, with bootstrap bounds, by region."""
    rows = metric_rows(spark, sf).withColumn("gain", F.round(F.col("ndcg") - F.col("overlap"), 9))
    made = metrics.group_summary(rows, ["lineage"], "cluster", "gain", 100, "groups")
    return made.withColumns({c: six(c) for c in ("mean", "median", "positive", "ci_low", "boot_median", "ci_high")})


_HOLDOUT_SQL = cell_sql() + ", " + cell_sql("l_tax", "tax") + """, rws AS (SELECT cell.row_id, cell.lineage, cell.cluster, cell.col_id, cell.value * 100 AS a, CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0 END AS b, tax.value * 100 AS y
  FROM cell JOIN supplier ON s_suppkey = cell.row_id JOIN tax ON tax.row_id = cell.row_id AND tax.col_id = cell.col_id
), m AS (SELECT col_id, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, stddev_pop(y) AS sy, count(*) * var_pop(a) AS aa, count(*) * var_pop(b) AS bb, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb
  FROM rws WHERE lineage <> 'EUROPE' GROUP BY col_id HAVING count(*) >= 3 AND stddev_pop(y) > 1e-6
), mo AS (SELECT *, CASE method WHEN 'background' THEN 0 WHEN 'own' THEN ay / (aa + alpha) ELSE (ay * (bb + alpha) - yb * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) END AS wa, CASE method WHEN 'background' THEN yb / (bb + alpha) WHEN 'own' THEN 0 ELSE (yb * (aa + alpha) - ay * ab) / ((aa + alpha) * (bb + alpha) - ab * ab) END AS wb
  FROM m, (SELECT unnest([1, 10, 100]) AS alpha), (SELECT unnest(['background', 'own', 'both']) AS method)
), pr AS (SELECT method, alpha, row_id, cluster, col_id, (y - my) / sy AS truth, (wa * (a - ma) + wb * (b - mb)) / sy AS predicted FROM rws JOIN mo USING (col_id) WHERE lineage = 'EUROPE'
), ent AS (SELECT DISTINCT row_id, cluster, b FROM rws WHERE lineage = 'EUROPE'
), scp AS (SELECT 'region' AS scope, row_id, cluster FROM ent UNION ALL SELECT 'rich', row_id, cluster FROM ent WHERE b = 1 UNION ALL SELECT 'nation', row_id, cluster FROM ent WHERE cluster = 'GERMANY')"""


def _holdout(spark, sf):
    """Predictions of three ridges by target and penalty for a region held out, and the scopes of its suppliers."""
    rich = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") > 5000).cast("double").alias("b"))
    tax = labelled_cells(spark, sf, "l_tax").select("row_id", "col_id", (F.col("value") * 100).alias("y"))
    rows = staged(labelled_cells(spark, sf).withColumn("a", F.col("value") * 100).drop("value").join(rich, "row_id").join(tax, ["row_id", "col_id"]), "holdout")
    a, b, y, n = F.col("a"), F.col("b"), F.col("y"), F.count("*")
    sums = {"aa": n * F.var_pop(a), "bb": n * F.var_pop(b), "ab": n * F.covar_pop(a, b), "ay": n * F.covar_pop(a, y), "yb": n * F.covar_pop(b, y)}
    state = rows.filter("lineage <> 'EUROPE'").groupBy("col_id").agg(n.alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(y).alias("my"), F.stddev_pop(y).alias("sy"), *[c.alias(k) for k, c in sums.items()]).filter("n >= 3 AND sy > 1e-6")
    state = state.withColumn("alpha", F.explode(F.array(F.lit(1), F.lit(10), F.lit(100))))
    aa, bb, ab, ay, yb = F.col("aa") + F.col("alpha"), F.col("bb") + F.col("alpha"), F.col("ab"), F.col("ay"), F.col("yb")
    det, zero = aa * bb - ab * ab, F.lit(0.0)
    fits = {"background": (zero, yb / bb), "own": (ay / aa, zero), "both": ((ay * bb - yb * ab) / det, (yb * aa - ay * ab) / det)}
    model = state.withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), u.alias("wa"), v.alias("wb")) for k, (u, v) in fits.items()]))).select("col_id", "ma", "mb", "my", "sy", "alpha", "f.*")
    held = rows.filter("lineage = 'EUROPE'")
    predicted = (F.col("wa") * (a - F.col("ma")) + F.col("wb") * (b - F.col("mb"))) / F.col("sy")
    made = held.join(model, "col_id").select("row_id", "col_id", "method", "alpha", ((y - F.col("my")) / F.col("sy")).alias("truth"), predicted.alias("predicted"))
    scope = F.filter(F.array(F.lit("region"), F.when(b == 1, "rich"), F.when(F.col("cluster") == "GERMANY", "nation")), lambda x: x.isNotNull())
    return staged(made, "predictions"), held.select("row_id", "cluster", F.explode(scope).alias("scope")).distinct()


@register("WITH " + _HOLDOUT_SQL + ", e AS (SELECT method, alpha, row_id, sum((truth - predicted) * (truth - predicted)) AS sse, sum(truth * truth) AS sst FROM pr GROUP BY ALL), sg AS (SELECT scope, scope || '/' || cluster AS grp, row_id FROM scp), " + _draws("grp", "row_id", "sg", "scopes", "grp") + f""", s AS (SELECT d.scope, d.draw, e.method, e.alpha, (1 - sum(e.sse) / sum(e.sst)) - (1 - sum(r.sse) / sum(r.sst)) AS stat FROM d JOIN e USING (row_id) JOIN e r ON r.row_id = e.row_id AND r.alpha = e.alpha AND r.method = 'background' GROUP BY ALL
), q AS (SELECT scope, method, alpha, {_q('stat', 6)} FROM s GROUP BY ALL
), p AS (SELECT scope, e.method, e.alpha, count(*) AS n, round(1 - sum(e.sse) / sum(e.sst), 6) AS r2, round((1 - sum(e.sse) / sum(e.sst)) - (1 - sum(r.sse) / sum(r.sst)), 6) + 0.0::DOUBLE AS delta_r2 FROM scp JOIN e USING (row_id) JOIN e r ON r.row_id = e.row_id AND r.alpha = e.alpha AND r.method = 'background' GROUP BY ALL)
SELECT p.scope, p.method, p.alpha, n, r2, delta_r2, ci_low + 0.0::DOUBLE AS ci_low, boot_median + 0.0::DOUBLE AS boot_median, ci_high + 0.0::DOUBLE AS ci_high FROM p JOIN q ON q.scope = p.scope AND q.method = p.method AND q.alpha = p.alpha""")
def holdout_scopes(spark, sf):
    """Three methods under three penalties on three scopes of a region that is held out: R2, its gain over the background, and bounds."""
    made = metrics.scope_gains(*_holdout(spark, sf), "row_id", "alpha", "method", "background", "cluster", 100, "scopes")
    return made.withColumns({"r2": six("r2"), **{c: six(c) + 0.0 for c in ("delta_r2", "ci_low", "boot_median", "ci_high")}})


@register("WITH " + _HOLDOUT_SQL + """, g AS (SELECT scope, method, alpha, col_id, CASE WHEN sum(truth * truth) <> 0 THEN 1 - sum((truth - predicted) * (truth - predicted)) / sum(truth * truth) END AS r2 FROM pr JOIN scp USING (row_id) GROUP BY ALL)
SELECT g.scope, g.method, g.alpha, count(*) AS n_targets, count(*) FILTER (round(g.r2 - r.r2, 6) > 0) AS n_better, round(median(g.r2 - r.r2), 5) + 0.0::DOUBLE AS median_gain FROM g JOIN g r ON g.scope = r.scope AND g.alpha = r.alpha AND g.col_id = r.col_id AND r.method = 'background' WHERE g.method <> 'background' GROUP BY ALL""")
def holdout_target_gains(spark, sf):
    """How many targets a method predicts better than the background, and its median gain, by scope and penalty."""
    each = metrics.target_gains(*_holdout(spark, sf), "row_id", "alpha", "method", "background", "col_id").filter("method <> 'background'")
    return each.groupBy("scope", "method", "alpha").agg(F.count("*").alias("n_targets"), F.count_if(F.round("delta_r2", 6) > 0).alias("n_better"), (six(F.median("delta_r2"), 5) + 0.0).alias("median_gain"))
