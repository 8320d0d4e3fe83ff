"""Features, scalers, tuned estimators, stored models and certificates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators, linalg, resample
from ..sources.publish import staged
from ..sources.tables import labelled_cells, table
from .register import Register, cell_sql, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_CELL = "WITH " + cell_sql()


@register(_CELL + ", t AS (SELECT col_id, avg(value) AS mean, stddev_pop(value) AS sd FROM cell WHERE lineage <> 'ASIA' GROUP BY col_id) SELECT col_id, round(mean, 9) AS mean, round(sd, 9) AS sd, round(sd, 9) > 0.0015 AS kept, round(CASE WHEN round(sd, 9) > 0.0015 THEN sd ELSE 1 END, 9) AS sd_or_one FROM t")
def scaler_variants(spark, sf):
    """One fit, three uses: columns without spread dropped, or kept with SD 1; missing values imputed later or left."""
    made = linalg.scaler(labelled_cells(spark, sf).filter("lineage <> 'ASIA'"), [], "col_id", "value")
    return made.select("col_id", six("mean", 9).alias("mean"), six("sd", 9).alias("sd"), (six("sd", 9) > 0.0015).alias("kept"), six(F.when(six("sd", 9) > 0.0015, F.col("sd")).otherwise(1.0), 9).alias("sd_or_one"))


_FLAG_SQL = ", ".join(f"CASE WHEN s_suppkey % {k} = 0 THEN 1.0::DOUBLE ELSE 0 END AS flag_{k}" for k in (2, 3, 5, 7, 11))


@register(f"WITH m AS (SELECT l_suppkey, avg(l_quantity) AS m FROM lineitem GROUP BY l_suppkey), w AS (SELECT s_suppkey, s_nationkey, {_FLAG_SQL}, round(m, 6) AS modality_mean FROM supplier LEFT JOIN m ON s_suppkey = l_suppkey), t AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey % 4 <> 0) SELECT s_suppkey, 'nation=' || CAST(s_nationkey AS VARCHAR) AS feature, 1.0::DOUBLE AS value FROM w WHERE s_nationkey IN (SELECT s_nationkey FROM t) UNION ALL SELECT s_suppkey, feature, value FROM (UNPIVOT (SELECT s_suppkey, flag_2, flag_3, flag_5, flag_7, flag_11, modality_mean FROM w) ON flag_2, flag_3, flag_5, flag_7, flag_11, modality_mean INTO NAME feature VALUE value)")
def annotation_features(spark, sf):
    """Indicators of the training rows' categories, five flags, and the mean of a modality by row."""
    s = table(spark, sf, "supplier").withColumn("nation", F.col("s_nationkey").cast("string"))
    hot = linalg.one_hot(s, "s_suppkey", "nation", F.col("s_suppkey") % 4 != 0)
    flags = {f"flag_{k}": (F.col("s_suppkey") % k == 0).cast("double") for k in (2, 3, 5, 7, 11)}
    means = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(six(F.avg("l_quantity")).alias("modality_mean"))
    wide = s.select("s_suppkey", *[c.alias(n) for n, c in flags.items()]).join(means, "s_suppkey", "left")
    return hot.unionByName(wide.unpivot(["s_suppkey"], [*flags, "modality_mean"], "feature", "value").filter("value IS NOT NULL"))


@register("WITH x AS (SELECT c_custkey, c_acctbal AS a, c_custkey % 10 AS b, CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0 END AS context FROM customer), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(context) AS mc FROM x WHERE c_custkey % 5 <> 0) SELECT c_custkey, round(a - ma, 5) AS a, round(b - mb, 5) AS b, round((a - ma) * (context - mc), 5) + 0.0::DOUBLE AS a_context, round((b - mb) * (context - mc), 5) + 0.0::DOUBLE AS b_context FROM x, m")
def interaction_features(spark, sf):
    """A block centred on training rows, and its products with a centred context."""
    x = table(spark, sf, "customer").select("c_custkey", F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 10).alias("b"), (F.col("c_mktsegment") == "BUILDING").cast("double").alias("context"))
    made = linalg.with_interactions(x, ["a", "b"], ["context"], F.col("c_custkey") % 5 != 0)
    return made.select("c_custkey", *[(six(c, 5) + 0.0).alias(c) for c in ("a", "b", "a_context", "b_context")])


@register(_CELL + ", c AS (SELECT row_id, CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0 END AS context FROM (SELECT s_suppkey AS row_id, s_acctbal FROM supplier)) SELECT cell.row_id, col_id AS target, round(value * 1000, 6) AS own, context, round(value * 1000 * context, 6) AS both FROM cell JOIN c ON c.row_id = cell.row_id")
def own_features(spark, sf):
    """For each row and target: the target's own value, the context, and their product."""
    context = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") > 5000).cast("double").alias("context"))
    rows = labelled_cells(spark, sf).join(context, "row_id")
    return rows.select("row_id", F.col("col_id").alias("target"), six(F.col("value") * 1000).alias("own"), "context", six(F.col("value") * 1000 * F.col("context")).alias("both"))


_TARGETS = ["t1", "t3"]


def _rows(spark, sf):
    """Whole vectors, and targets from other tables: the length of the document of that id, its quality (which most lack), and noise."""
    d = table(spark, sf, "documents").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("n_chars").alias("n"))
    q = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("vec_id")).agg(F.max("quality").cast("double").alias("t2"))
    e = table(spark, sf, "embeddings").join(d, "vec_id", "left").join(q, "vec_id", "left")
    noise = F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000.0
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.log1p(F.coalesce("n", F.lit(0))).alias("t1"), "t2", noise.alias("t3"))


def _states(spark, sf):
    """Products by label, worked out once: every fit below reads these alone."""
    return staged(linalg.moments(_rows(spark, sf), "label", "v", _TARGETS), "moments")


def _nested(spark, sf):
    rows, targets = staged(_rows(spark, sf), "vectors"), ["t1", "t2", "t3"]
    groups = linalg.target_masks(rows, targets)
    return staged(estimators.nested_errors(staged(linalg.moments(rows, "label", "v", targets, groups), "moments"), "label", groups, list(estimators.GRIDS)), "nested")


@register()
def nested_tuning(spark, sf):
    """Four estimators and the mean, tuned inside each outer group on all other groups, refitted and measured on it."""
    made = estimators.tuned(_nested(spark, sf))
    return made.select("outer", "method", "option", six("inner_mse", 5).alias("inner_mse"), "n", six("sse", 3).alias("sse"))


@register()
def option_scan(spark, sf):
    """Every option of every estimator on each outer group."""
    return estimators.scan_options(_nested(spark, sf)).withColumn("mse", six("mse", 5))


def _model(spark, sf, rank: int = 8, alpha: float = 1.0):
    return staged(estimators.component_model(linalg.others(_states(spark, sf), "label"), "label", len(_TARGETS), rank, alpha), f"model-{rank}")


@register()
def stored_model(spark, sf):
    """The component model of each held-out label as tables hold it; loadings are left out, as their order among equals is free."""
    return _model(spark, sf).filter("kind IN ('mean', 'sd', 'bias', 'n')").withColumn("value", six("value", 5))


@register()
def stored_model_predictions(spark, sf):
    """Held-out rows by the model that was written and read back."""
    return estimators.predicted(_model(spark, sf), _rows(spark, sf), "vec_id", "label", "v").withColumn("prediction", six("prediction", 5))


@register()
def stored_model_domain(spark, sf):
    made = estimators.domain(_model(spark, sf), _rows(spark, sf), "vec_id", "label", "v", 2.0)
    return made.withColumns({c: six(c, 5) for c in ("missing", "outside", "residual")})


@register()
def rank_refits(spark, sf):
    """Predictions of rank 2, 8 and 24 models: the change from the first to the last in ordered parts."""
    by = ["label", "vec_id", "target"]
    made = [estimators.predicted(_model(spark, sf, r), _rows(spark, sf), "vec_id", "label", "v") for r in (2, 8, 24)]
    parts = estimators.refit_parts(made[0], {"to_8": made[1], "to_24": made[2]}, by, "prediction")
    return estimators.cross_products(parts, ["label", "target"], ["to_8", "to_24"]).withColumns({"product": six("product", 5), "miss": six("miss", 9)})


@register()
def subspace_angles(spark, sf):
    """Leading components of each held-out fit against those of the fit without label 0."""
    return estimators.subspaces(_model(spark, sf, 24), "label", 0).withColumn("cosine", six("cosine", 5))


def _net(spark, sf):
    states = staged(linalg.others(_states(spark, sf), "label"), "others")
    return states, staged(estimators.net_fits(states, "label", len(_TARGETS), [0.2, 0.05, 0.01]), "net")


@register()
def net_certificates(spark, sf):
    """Elastic-net paths of each held-out fit, with certificates worked out again from what was stored."""
    return estimators.certified(_net(spark, sf)[1], "label", 0.5, 1e-8).select("label", "alpha", "n_targets", "n_active", "passed")


@register()
def net_audit(spark, sf):
    """The stored weights against the training data's own products, and after one more refinement."""
    made = estimators.net_recertified(*_net(spark, sf), "label", len(_TARGETS), 0.5)
    return made.select("label", "target", "alpha", (F.col("violation") <= 1e-8).alias("holds"), (F.col("refined") <= 1e-8).alias("refined_holds"), six("moved", 6).alias("moved"))


@register()
def paired_refit_parts(spark, sf):
    """What moves the predictions of label 0 in 20 cluster bootstraps of the others: mean products of the four ordered parts."""
    rows = staged(_rows(spark, sf).withColumn("cluster", F.col("vec_id") % 50), "vectors")
    train = rows.filter("label <> 0")
    times = resample.drawn(train.select("label", "cluster").distinct(), ["label"], "cluster", 20, "paired").groupBy("label", "cluster", "draw").agg(F.count("*").alias("w"))
    base = linalg.moments(train.withColumn("draw", F.lit(-1)), "draw", "v", _TARGETS)
    draws = linalg.moments(train.join(times, ["label", "cluster"]), "draw", "v", _TARGETS, weight="w")
    refits = staged(estimators.paired_refits(base, draws, "draw", len(_TARGETS), 8, 10.0), "refits")
    parts = estimators.refit_decomposition(refits, rows.filter("label = 0"), "draw", "vec_id", "v")
    made = estimators.cross_products(parts, ["target"], ["coefficients", "components", "scaling", "reference"])
    return made.select("target", "a", "b", six("product", 7).alias("product"), (F.col("miss") < 1e-10).alias("adds_up"))


@register("""WITH c AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), o AS (SELECT label, i, min(x) AS lo, max(x) AS hi FROM c GROUP BY ALL
), b AS (SELECT a.label, a.i, min(o.lo) AS low, max(o.hi) AS high FROM o a JOIN o ON o.i = a.i AND o.label <> a.label GROUP BY ALL)
SELECT c.label, vec_id, count(*) AS n, 0.0::DOUBLE AS missing, round(avg(CASE WHEN x < low OR x > high THEN 1.0::DOUBLE ELSE 0 END), 6) AS outside, round(max(greatest(low - x, x - high, 0) / (high - low)), 6) AS excess FROM c JOIN b ON b.label = c.label AND b.i = c.i GROUP BY c.label, vec_id""")
def domain_outside(spark, sf):
    """How far each row is beyond the ranges of the rows that its held-out model is fitted on."""
    cells = table(spark, sf, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    made = estimators.outside_bounds(cells, estimators.domain_bounds(cells, "label", "i", "x"), "label", "vec_id", "i", "x")
    return made.withColumns({c: six(c) for c in ("missing", "outside", "excess")})
