"""Held-out evaluation: the flagship, its summaries, model choice and estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, governance, linalg, metrics, transfer
from ..sources.publish import staged
from ..sources.tables import held_out_predictions, labelled_cells, table
from .register import METRIC_SQL, PRED_SQL, Register, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
VALUES = ("ndcg", "precision", "overlap", "spearman", "regret")
_METRIC = "WITH " + METRIC_SQL
_ROUNDED = ", ".join(f"round({v}, 6) AS {v}" for v in VALUES)


def _steady(x):
    """Six digits of a value that may stand at a half: twelve first, so that the order of summation decides nothing."""
    return six(six(x, 12))


def metric_rows(spark, sf):
    """Ranking metrics of each held-out row."""
    pred = held_out_predictions(labelled_cells(spark, sf))
    return metrics.ranking_metrics(pred, ["row_id", "lineage", "cluster"], "col_id", "truth", "predicted")


@register(_METRIC + f" SELECT row_id, lineage, cluster, n, {_ROUNDED} FROM metric")
def ranking_metrics(spark, sf):
    return metric_rows(spark, sf).withColumns({v: _steady(v) for v in VALUES})


@register(_METRIC + f" SELECT lineage, count(*) AS n, " + ", ".join(f"round(avg({v}), 6) AS {v}" for v in VALUES) + " FROM metric GROUP BY lineage")
def lineage_summary(spark, sf):
    return metric_rows(spark, sf).groupBy("lineage").agg(F.count("*").alias("n"), *[six(F.avg(v)).alias(v) for v in VALUES])


@register(_METRIC + ", " + ", ".join(f"{t} AS (SELECT {', '.join(f'avg({v}) AS {v}' for v in VALUES)} FROM metric GROUP BY {g})" for t, g in (("l", "lineage"), ("c", "cluster"))) + " " + " UNION ALL ".join(f"SELECT '{n}' AS estimand, {', '.join(f'round(avg({v}), 6) AS {v}' for v in VALUES)} FROM {t}" for n, t in (("row_weighted", "metric"), ("lineage_equal", "l"), ("cluster_equal", "c"))))
def macro_average(spark, sf):
    return aggregate.macro_average(metric_rows(spark, sf), "lineage", "cluster", list(VALUES)).withColumns({v: six(v) for v in VALUES})


@register("WITH " + PRED_SQL + ", t AS (SELECT lineage, col_id, count(*) AS n, CASE WHEN var_pop(truth) > 0 AND var_pop(predicted + row_id * 1e-3) > 0 THEN corr(truth, predicted + row_id * 1e-3) END AS r FROM pred WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), m AS (SELECT lineage, median(r) AS r FROM t GROUP BY lineage), w AS (SELECT lineage, count(*) AS n, avg((truth - predicted - row_id * 1e-3) ** 2) AS mse, 1 - sum((truth - predicted - row_id * 1e-3) ** 2) / (sum(truth * truth) - sum(truth) * sum(truth) / count(*)) AS r2, 1 - sum((truth - predicted - row_id * 1e-3) ** 2) / sum(truth * truth) AS gain FROM pred WHERE truth IS NOT NULL AND predicted IS NOT NULL GROUP BY lineage) SELECT w.lineage, n, round(mse, 6) AS mse, round(r2, 4) AS r2, round(gain, 4) AS gain, round(r, 6) AS median_pearson FROM w LEFT JOIN m ON w.lineage = m.lineage")
def scope_metrics(spark, sf):
    pred = held_out_predictions(labelled_cells(spark, sf)).withColumn("predicted", F.col("predicted") + F.col("row_id") * 1e-3).withColumn("zero", F.lit(0.0))
    made = metrics.scope_metrics(pred, ["lineage"], "col_id", "truth", "predicted", "zero")
    return made.withColumns({"mse": six("mse"), "r2": six("r2", 4), "gain": six("gain", 4), "median_pearson": six("median_pearson")})


def _methods(spark, sf):
    """The metrics of two methods: the column mean, and its reverse."""
    pred = held_out_predictions(labelled_cells(spark, sf))
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), p.alias("predicted")) for m, p in (("mean", F.col("predicted")), ("reverse", -F.col("predicted")))])).alias("m")
    both = pred.select("row_id", "lineage", "cluster", "col_id", "truth", methods).select("m.*", "row_id", "lineage", "cluster", "col_id", "truth")
    return staged(metrics.ranking_metrics(both, ["method", "row_id", "lineage", "cluster"], "col_id", "truth", "predicted"), "methods")


def _two_sql() -> str:
    two = METRIC_SQL.replace("PARTITION BY row_id", "PARTITION BY method, row_id").replace("FROM pred WHERE", "FROM (SELECT 'mean' AS method, * FROM pred UNION ALL SELECT 'reverse', * REPLACE (-predicted AS predicted) FROM pred) WHERE").replace("metric AS (SELECT row_id", "metric AS (SELECT method, row_id")
    return "WITH " + two


@register(_two_sql() + " SELECT a.row_id, a.method, " + ", ".join(f"round(a.{v} - b.{v}, 6) AS d_{v}" for v in VALUES[:-1]) + ", round(b.regret - a.regret, 6) AS d_regret FROM metric a JOIN metric b ON a.row_id = b.row_id WHERE a.method = 'reverse' AND b.method = 'mean'")
def paired_deltas(spark, sf):
    made = metrics.paired_deltas(_methods(spark, sf), ["row_id"], "method", "mean", list(VALUES))
    return made.select("row_id", "method", *[_steady(f"d_{v}").alias(f"d_{v}") for v in VALUES])


@register(_two_sql() + ", d AS (SELECT a.lineage, round(a.overlap - b.overlap, 6) AS d FROM metric a JOIN metric b ON a.row_id = b.row_id WHERE a.method = 'reverse' AND b.method = 'mean') SELECT lineage, count(*) FILTER (d > 0) AS positive, count(*) FILTER (d = 0) AS zero, count(*) FILTER (d < 0) AS negative FROM d GROUP BY lineage")
def direction_counts(spark, sf):
    made = metrics.paired_deltas(_methods(spark, sf), ["row_id", "lineage"], "method", "mean", ["overlap"]).withColumn("d", six("d_overlap"))
    return metrics.direction_counts(made, ["lineage"], "d")


@register(_METRIC + ", x AS (SELECT lineage, quantile_cont(spearman, 0.05) AS lo, quantile_cont(spearman, 0.95) AS hi FROM metric GROUP BY lineage) SELECT lineage, round(lo, 6) AS low, round(hi, 6) AS high, CASE WHEN lo > 0 THEN 'above' WHEN hi < 0 THEN 'below' ELSE 'crosses' END AS verdict FROM x")
def interval_verdict(spark, sf):
    q = metric_rows(spark, sf).groupBy("lineage").agg(F.percentile("spearman", F.lit(0.05)).alias("low"), F.percentile("spearman", F.lit(0.95)).alias("high"))
    return q.select("lineage", six("low").alias("low"), six("high").alias("high"), metrics.verdict(F.col("low"), F.col("high")).alias("verdict"))


_ALPHAS = (1.0, 10.0, 100.0, 1000.0)
_LINE = "(SELECT p_brand AS brand, l_linestatus AS fold, l_quantity AS x, l_discount * 100 AS y FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _lines(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_brand").alias("brand"), F.col("l_linestatus").alias("fold"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))


@register(f"SELECT brand, count(*) AS n, round(sxy / (sxx + 10), 6) AS slope, round(my - sxy / (sxx + 10) * mx, 6) AS intercept FROM (SELECT brand, x, y, count(*) OVER w AS c FROM {_LINE} WINDOW w AS (PARTITION BY brand)) JOIN (SELECT brand, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, avg(x) AS mx, avg(y) AS my FROM {_LINE} GROUP BY brand) USING (brand) GROUP BY brand, sxy, sxx, mx, my")
def ridge_one_feature(spark, sf):
    return linalg.ridge_line(_lines(spark, sf), ["brand"], "x", "y", 10.0).withColumns({"slope": six("slope"), "intercept": six("intercept")})


@register(f"WITH f AS (SELECT brand, fold, alpha, sxy / (sxx + alpha) AS slope, my - sxy / (sxx + alpha) * mx AS intercept FROM (SELECT brand, fold, sum(x * y) - sum(x) * sum(y) / count(*) AS sxy, sum(x * x) - sum(x) * sum(x) / count(*) AS sxx, avg(x) AS mx, avg(y) AS my FROM {_LINE} GROUP BY ALL), (SELECT unnest([{', '.join(f'{a}::DOUBLE' for a in _ALPHAS)}]) AS alpha)), s AS (SELECT f.brand, alpha, round(sum((y - slope * x - intercept) ** 2), 4) AS sse FROM f JOIN {_LINE} l ON l.brand = f.brand AND l.fold <> f.fold GROUP BY ALL) SELECT brand, arg_min(alpha, (sse, alpha)) AS alpha, round(min(sse), 2) AS sse FROM s GROUP BY brand")
def alpha_choice(spark, sf):
    sse = linalg.line_errors(_lines(spark, sf), ["brand"], "fold", "x", "y", list(_ALPHAS)).withColumn("sse", six("sse", 4))
    return metrics.choose_lowest(sse, ["brand"], "alpha", "sse").withColumn("sse", six("sse", 2))


@register("SELECT label AS held, dim, round(mean, 5) AS mean, round(sd, 5) AS sd, sd > 1e-8 AS kept FROM (SELECT h.label, dim, avg(v) AS mean, stddev_pop(v) AS sd FROM (SELECT DISTINCT label FROM embeddings) h JOIN (SELECT label AS l, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS dim FROM embeddings) e ON e.l <> h.label GROUP BY ALL)")
def standardise_train_only(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    made = linalg.held_out_scalers(rows, "vec_id", "label", "dim", "v")
    return made.select("held", F.col("dim").cast("long").alias("dim"), six("mean", 5).alias("mean"), six("sd", 5).alias("sd"), "kept")


_DOT = "list_sum(list_transform(range(len(a.embedding)), lambda i: a.embedding[i + 1]::DOUBLE * b.embedding[i + 1]::DOUBLE))"


@register(f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_DOT}, 5) AS dot FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0")
def gram_block(spark, sf):
    e = table(spark, sf, "embeddings")
    return linalg.gram(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", digits=5)


@register(f"WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings), c AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, b.label AS t, round({_DOT} / (a.norm * b.norm), 9) AS cos FROM n a, n b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT id_a, round(avg(t), 6) AS prediction, count(t) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY cos DESC, id_b) AS r FROM c) WHERE r <= 5 GROUP BY id_a")
def knn_residual(spark, sf):
    e = table(spark, sf, "embeddings")
    return linalg.knn_mean(e.filter("vec_id % 20 = 0"), e, "vec_id", "embedding", "label", 5).withColumn("prediction", six("prediction"))


@register("WITH " + PRED_SQL + " SELECT a.row_id AS id_a, b.row_id AS id_b, round(sum(a.value * b.value), 6) AS dot FROM cell a JOIN cell b ON a.col_id = b.col_id WHERE a.row_id % 20 = 0 GROUP BY ALL")
def feature_kernel_all(spark, sf):
    """The kernel of a long table over every lineage: ids divisible by 20 against all rows."""
    return linalg.gram_by_features(labelled_cells(spark, sf), "row_id", "col_id", "value", F.col("row_id") % 20 == 0).withColumn("dot", six("dot"))


def _fit(method: str):
    def query(spark, sf):
        e = table(spark, sf, "embeddings").withColumns({"t1": F.col("label").cast("double"), "t2": F.sin(F.col("label").cast("double")), "t3": F.when(F.col("vec_id") % 7 != 0, F.get("embedding", F.lit(0)).cast("double")) if method == "kernel_ridge" else F.get("embedding", F.lit(0)).cast("double")})
        made = linalg.cross_fitted(e, "vec_id", "label", "embedding", ["t1", "t2", "t3"], method)
        return made.withColumn("prediction", six("prediction"))

    query.__name__ = {"kernel_ridge": "masked_kernel_ridge", "component_ridge": "pcr_ridge", "reduced_rank": "reduced_rank_ridge", "elastic_net": "elastic_net"}[method]
    return query


for _m in linalg.SOLVERS:
    register()(_fit(_m))


@register("SELECT row_id, target, round(sum((value - mean) / sd * loading * beta) + bias, 9) AS prediction FROM (SELECT row_id, col_id, value, (col_id % 5)::DOUBLE AS mean, 1.0::DOUBLE + col_id AS sd, pc, (col_id + pc) / 10.0::DOUBLE AS loading, target, (pc - 1.5::DOUBLE) * target AS beta, target * 0.5::DOUBLE AS bias FROM (SELECT s_suppkey AS row_id, unnest([0, 1, 2]) AS col_id, unnest([s_acctbal / 1000, s_nationkey::DOUBLE, (s_suppkey % 7)::DOUBLE]) AS value FROM supplier), (SELECT unnest([1, 2]) AS pc), (SELECT unnest([1, 2, 3]) AS target)) GROUP BY row_id, target, bias")
def pcr_predict(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), F.posexplode(F.array(F.col("s_acctbal") / 1000, F.col("s_nationkey").cast("double"), (F.col("s_suppkey") % 7).cast("double"))).alias("col_id", "value"))
    fitted = spark.createDataFrame([(c, float(c % 5), 1.0 + c, True) for c in range(3)], "col_id int, mean double, sd double, kept boolean")
    loadings = spark.createDataFrame([(c, p, (c + p) / 10) for c in range(3) for p in (1, 2)], "col_id int, pc int, loading double")
    betas = spark.createDataFrame([(p, t, (p - 1.5) * t) for p in (1, 2) for t in (1, 2, 3)], "pc int, target int, beta double")
    targets = spark.createDataFrame([(t, t * 0.5) for t in (1, 2, 3)], "target int, bias double")
    return linalg.predict(s, fitted, loadings, betas, targets).withColumn("prediction", six(F.col("prediction"), 9))


@register("WITH " + PRED_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) AS rank FROM cell), k AS (SELECT lineage, col_id, count(*) FILTER (rank <= 10) AS k FROM r GROUP BY ALL), n AS (SELECT lineage, count(DISTINCT row_id) AS n FROM cell GROUP BY lineage), f AS (SELECT k.lineage, col_id, k / n::DOUBLE AS f FROM k JOIN n ON k.lineage = n.lineage), j AS (SELECT a.col_id, a.f AS x, b.f AS y FROM f a JOIN f b ON a.col_id = b.col_id WHERE a.lineage = 'ASIA' AND b.lineage = 'EUROPE' AND (a.f > 0 OR b.f > 0)), q AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM j) SELECT count(*) AS n, round(CASE WHEN var_pop(rx) > 0 AND var_pop(ry) > 0 THEN corr(rx, ry) END, 6) AS spearman FROM q")
def cohort_stability(spark, sf):
    f = transfer.selection_frequency(labelled_cells(spark, sf), ["lineage"], "row_id", "col_id", "value", 10)
    return transfer.cohort_stability(f, "lineage", "col_id", "ASIA", "EUROPE").withColumn("spearman", six("spearman"))


@register("SELECT CAST(NULL AS VARCHAR) AS lineage, CAST(NULL AS DOUBLE) AS stored, CAST(NULL AS DOUBLE) AS again WHERE false")
def recompute_summary(spark, sf):
    rows = metric_rows(spark, sf)
    stored = rows.groupBy("lineage").agg(F.avg("ndcg").alias("ndcg"))
    again = rows.groupBy("lineage").agg((F.sum("ndcg") / F.count("ndcg")).alias("ndcg"))
    return governance.differences(stored, again, ["lineage"], "ndcg")
