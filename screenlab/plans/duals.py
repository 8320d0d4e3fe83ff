"""Kernels and tuned estimators where columns outnumber rows: nations' market segments by the parts they buy.

There are 125 entities (a nation's customers of one segment) whatever the size of the tables; columns are
parts and grow with them. Targets are the discounts got on each brand and type, which some entities lack.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels
from ..sources.publish import staged
from ..sources.tables import exact_sum, table
from .register import Register, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_SQL = """WITH line AS (SELECT n_name || '/' || c_mktsegment AS id, r_name AS lineage, n_name AS cluster, l_partkey, CAST(l_quantity AS DECIMAL(12,2)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), cell AS (SELECT id, lineage, l_partkey AS col, CAST(sum(q) AS DOUBLE) AS v FROM line GROUP BY ALL
), entity AS (SELECT DISTINCT id, lineage FROM line)"""


def _tables(spark, sf):
    """Cells (what an entity buys of a part), targets (its mean discount on a brand and type) and groups."""
    c, n, r = table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region")
    who = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # fixed tables of 25 and 5 rows
    who = who.select("c_custkey", F.concat_ws("/", "n_name", "c_mktsegment").alias("id"), F.col("r_name").alias("lineage"), F.col("n_name").alias("cluster"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    line = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(who, F.col("o_custkey") == F.col("c_custkey"))
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("t"))
    sums = staged(line.groupBy("id", "lineage", "cluster", "l_partkey").agg(exact_sum(F.col("l_quantity")).alias("v"), exact_sum(F.col("l_discount")).alias("d"), F.count("*").alias("n")), "bought")
    targets = sums.join(p, sums["l_partkey"] == p["p_partkey"]).groupBy("id", "t").agg((F.sum(F.col("d").cast("decimal(18,2)")).cast("double") / F.sum("n")).alias("y"))
    return sums.select("id", F.col("l_partkey").alias("col"), "v"), targets, sums.select("id", "lineage", "cluster").distinct()


@register(_SQL + """, held AS (SELECT DISTINCT lineage AS held FROM entity), size AS (SELECT held, count(*) AS n FROM held JOIN entity ON lineage <> held GROUP BY held
), m AS (SELECT held, col, avg(v) AS m FROM held JOIN cell ON lineage <> held GROUP BY ALL
), s AS (SELECT held, col, any_value(m) AS m, sqrt(sum((v - m) * (v - m)) / any_value(n)) AS sd FROM m JOIN size USING (held) JOIN cell USING (col) WHERE lineage <> held GROUP BY ALL
), z AS (SELECT held, id, col, (v - m) / sd AS z FROM s JOIN cell USING (col) WHERE sd > 1e-8
), k AS (SELECT a.held, a.id AS id_a, b.id AS id_b, sum(a.z * b.z) AS dot FROM z a JOIN z b ON a.held = b.held AND a.col = b.col AND a.id <= b.id GROUP BY ALL)
SELECT h.held, a.id AS id_a, b.id AS id_b, round(coalesce(dot, 0), 4) + 0.0::DOUBLE AS dot FROM held h JOIN entity a ON true JOIN entity b ON a.id <= b.id LEFT JOIN k ON k.held = h.held AND k.id_a = a.id AND k.id_b = b.id""")
def fold_kernel(spark, sf):
    """The kernel of all entities for each region held out, summed over blocks of parts, scaled without that region."""
    cells, _, groups = _tables(spark, sf)
    folds = kernels.group_folds(groups, "id", "lineage")
    names = spark.createDataFrame([(k, n) for k, (n, _) in enumerate(folds.names)], "fold int, held string")
    made = kernels.kernel_pairs(kernels.fold_kernels(cells, folds, "id", "col", "v"), folds)
    return made.join(F.broadcast(names), "fold").select("held", "id_a", "id_b", (six("dot", 4) + 0.0).alias("dot"))


@register()
def dual_ridge(spark, sf):
    """Kernel ridge of every region by all others; the side is chosen by shape, here the dual one."""
    cells, targets, groups = _tables(spark, sf)
    made = kernels.ridge_by_shape(cells, targets, groups, "id", "lineage", "col", "v", "t", "y", 100.0)
    return made.select("held", "id", "target", six("predicted").alias("predicted"))


def _tuned(spark, sf):
    cells, targets, groups = _tables(spark, sf)
    folds = kernels.nested_folds(groups, "id", "lineage", "cluster", 3)
    tiles = staged(kernels.fold_kernels(cells, folds, "id", "col", "v"), "kernels")
    made = staged(kernels.dual_predictions(tiles, targets, folds, "id", "t", "y", kernels.OPTIONS), "predictions")
    return kernels.tuned_by_ndcg(made, folds, groups, "id", "lineage")


@register()
def ndcg_tuning(spark, sf):
    """Options of nearest neighbours, kernel ridge and component ridge by the lineage-equal NDCG of linked inner folds."""
    return _tuned(spark, sf)[0].withColumn("score", six("score"))


@register()
def ndcg_tuned_metrics(spark, sf):
    """What each method's best option gives on the region held out, by entity."""
    made = _tuned(spark, sf)[1]
    return made.select("outer", "method", "entity", "option", "n", *[six(c).alias(c) for c in ("ndcg", "precision", "overlap", "spearman", "regret")])
