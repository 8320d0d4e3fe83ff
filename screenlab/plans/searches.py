"""Module searches with set rewards, their controls, and fits with nuisance columns, over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graph, linalg, modules
from ..sources.publish import staged
from ..sources.tables import exact_sum, labelled_cells, table
from .register import Register, cell_sql, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql

_ALPHA, _BUDGET, _PENALTY, _BEAM = 10.0, 4, 0.005, 6


def _brands(spark, sf) -> list[str]:
    """Brands stand for genes: 25, whatever the number of parts."""
    return [r[0] for r in table(spark, sf, "part").select("p_brand").distinct().filter("p_brand IS NOT NULL").orderBy("p_brand").collect()]


def _vectors(spark, sf, brands: list[str]):
    """Customers by what they buy of each brand; the target is the logarithm of what they pay, nuisance their balance, context the segment."""
    o, part = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "part").select("p_partkey", "p_brand")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    line = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])
    each = line.groupBy("o_custkey", "p_brand").agg(exact_sum(F.col("l_quantity")).alias("q"), F.sum(F.col("paid").cast("decimal(18,4)")).cast("double").alias("paid"))
    bought = each.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "q"))).alias("m"), F.sum(F.col("paid").cast("decimal(18,4)")).cast("double").alias("paid"))
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("context"))
    x = F.transform(F.array(*[F.lit(b) for b in brands]), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    rows = c.join(bought, c["c_custkey"] == bought["o_custkey"])
    return staged(rows.select("c_custkey", (F.col("c_custkey") % 5).alias("fold"), "context", F.array(F.col("c_acctbal").cast("double")).alias("c"), x.alias("x"), F.log1p("paid").alias("y")), "customers")


def _edges(rows, brands: list[str]):
    """Each brand and the two that are bought with it most (by correlation over customers)."""
    state = linalg.moments(rows.select(F.lit(0).alias("k"), "x"), "k", "x", []).first()  # brands squared
    near = []
    if state is not None:
        cross = np.array(state["cross"]).reshape(len(brands), len(brands))
        size = np.sqrt(np.maximum(np.diag(cross), 1e-300))
        r = np.round(cross / np.outer(size, size), 9)
        near = [(a, b) for i, a in enumerate(brands) for _, b in sorted((-r[i, j], b) for j, b in enumerate(brands) if j != i)[:2]]
    return staged(graph.canonical_edges(rows.sparkSession.createDataFrame(near, "a string, b string"), "a", "b"), "edges")


def _genes(spark, brands: list[str]):
    return spark.createDataFrame([(g, k) for k, g in enumerate(brands)], "gene string, place int")


def _setting(spark, sf, draws: int):
    """Brands, edges, genes and each draw's products by fold."""
    brands = _brands(spark, sf)
    rows = _vectors(spark, sf, brands)
    products = modules.shuffled_products(rows, "c_custkey", "context", "fold", "c", "x", "y", draws, "module-null", 1, _ALPHA)
    return brands, _edges(rows, brands), _genes(spark, brands), staged(products, "products")


def _search(brands, edges, genes, products):
    return modules.search(edges, genes, products, brands, 1, _ALPHA, _BUDGET, _PENALTY, _BEAM, {"fixed": "place", "static": "reward"})[0]


def _shown(found):
    return found.select("method", F.array_join("chosen", ",").alias("chosen"), F.array_join("nodes", ",").alias("nodes"), six("objective").alias("objective"), six("reward").alias("reward"))


@register()
def module_search(spark, sf):
    """Greedy, beam and two fixed-priority searches for brands that explain what is paid together, beyond nuisance, on held-out customers."""
    return _shown(_search(*_setting(spark, sf, 0)))


@register()
def module_null_controls(spark, sf):
    """All searches repeated whole on 100 shuffles of the customers' brands inside segments."""
    made = modules.null_comparison(_search(*_setting(spark, sf, 100)), 100)
    return made.withColumns({c: six(c) for c in ("reward", "null_mean", "null_best")})


@register()
def module_random_controls(spark, sf):
    """Random connected sets of the size of the beam's module, and their rewards beside its own."""
    brands, edges, genes, products = _setting(spark, sf, 0)
    beam = _search(brands, edges, genes, products).filter("method = 'beam'").select("chosen", "reward").first()  # one row
    size = len(beam["chosen"]) if beam else 1
    drawn = staged(graph.random_growth(edges, genes, "gene", size, 50, "module-random"), "controls").withColumnRenamed("draw", "control")
    scored = modules.set_rewards(drawn.select(F.lit(0).alias("draw"), "members").distinct(), products, brands, 1, _ALPHA)
    return drawn.join(scored, "members").select("control", F.array_join("members", ",").alias("members"), six("reward").alias("reward"), (F.col("reward") >= (beam["reward"] if beam else 0.0)).alias("reaches_beam"))


@register()
def module_synergy(spark, sf):
    """What each pair of brands brings beyond the sum of both alone."""
    brands, _, genes, products = _setting(spark, sf, 0)
    sets = genes.select(F.array("gene").alias("members")).unionByName(genes.select(F.col("gene").alias("a")).join(F.broadcast(genes.select(F.col("gene").alias("b"))), F.col("a") < F.col("b")).select(F.array("a", "b").alias("members")))  # pairs of 25 brands
    scored = staged(modules.set_rewards(sets.withColumn("draw", F.lit(0)), products, brands, 1, _ALPHA), "rewards")
    alone = scored.filter(F.size("members") == 1).select(F.col("members")[0].alias("g"), "reward")
    pairs = scored.filter(F.size("members") == 2).select(F.col("members")[0].alias("a"), F.col("members")[1].alias("b"), F.col("reward").alias("both"))
    return pairs.join(alone.toDF("a", "one"), "a").join(alone.toDF("b", "two"), "b").select("a", "b", six("both").alias("both"), six(F.col("both") - F.col("one") - F.col("two")).alias("synergy"))


@register("""WITH r AS (SELECT c_mktsegment, CAST(c_nationkey AS DOUBLE) AS z, c_acctbal / 1000 AS x, sum(CAST(o_totalprice AS DECIMAL(14,2)))::DOUBLE / 100000 AS y FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey, c_acctbal
), s AS (SELECT c_mktsegment, count(*) * var_pop(z) AS zz, count(*) * var_pop(x) AS xx, count(*) * covar_pop(x, z) AS xz, count(*) * covar_pop(x, y) AS xy, count(*) * covar_pop(z, y) AS zy FROM r GROUP BY c_mktsegment)
SELECT c_mktsegment, round((xy - xz * zy / (zz + 5)) / (xx - xz * xz / (zz + 5) + 5), 8) AS weight FROM s""")
def partialled_slopes(spark, sf):
    """What a customer's balance says about its orders' total once its nation is taken out, in each segment."""
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    total = o.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("y"))
    rows = c.join(total, c["c_custkey"] == total["o_custkey"]).select("c_mktsegment", F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000).alias("v"), (F.col("y") / 100000).alias("y"))
    made = modules.partial_fits(linalg.moments(rows, "c_mktsegment", "v", ["y"]), "c_mktsegment", 1, 1, 5.0)
    return made.select("c_mktsegment", six("weight", 8).alias("weight"))


_OWN = cell_sql() + ", " + cell_sql("l_tax", "tax") + """, d AS (SELECT cell.col_id, cell.value * 100 AS a, CASE WHEN s_acctbal > 5000 THEN 1.0::DOUBLE ELSE 0 END AS b, tax.value * 100 AS y FROM cell JOIN supplier ON s_suppkey = cell.row_id JOIN tax ON tax.row_id = cell.row_id AND tax.col_id = cell.col_id
), m AS (SELECT col_id, count(*) AS n, count(*) * var_pop(a) + 1 AS aa, count(*) * var_pop(b) + 1 AS bb, count(*) * var_pop(a * b) + 1 AS cc, count(*) * covar_pop(a, b) AS ab, count(*) * covar_pop(a, a * b) AS ac, count(*) * covar_pop(b, a * b) AS bc,
  count(*) * covar_pop(a, y) AS ay, count(*) * covar_pop(b, y) AS yb, count(*) * covar_pop(a * b, y) AS cy FROM d GROUP BY col_id
), det AS (SELECT *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det FROM m)"""


@register("WITH " + _OWN + """
SELECT col_id, n::DOUBLE AS n, round((ay * (bb * cc - bc * bc) - ab * (yb * cc - bc * cy) + ac * (yb * bc - bb * cy)) / det, 7) AS own,
  round((aa * (yb * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - yb * ac)) / det, 7) AS context,
  round((aa * (bb * cy - yb * bc) - ab * (ab * cy - yb * ac) + ay * (ab * bc - bb * ac)) / det, 7) AS both FROM det""")
def per_target_ridge(spark, sf):
    """For each target a ridge on its own design: its own value, a context, and their product; no loop over targets."""
    context = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), (F.col("s_acctbal") > 5000).cast("double").alias("b"))
    tax = labelled_cells(spark, sf, "l_tax").select("row_id", "col_id", (F.col("value") * 100).alias("y"))
    rows = labelled_cells(spark, sf).select("row_id", "col_id", (F.col("value") * 100).alias("a")).join(context, "row_id").join(tax, ["row_id", "col_id"])
    design = rows.select("col_id", F.array("a", "b", F.col("a") * F.col("b")).alias("v"), "y")
    fits = linalg.fitted(linalg.moments(design, "col_id", "v", ["y"]), "col_id", 1, "ridge", scaled=False)
    n = design.groupBy("col_id").agg(F.count("*").cast("double").alias("n"))
    w = lambda k: six(F.col("weights")[0][k], 7)
    return fits.join(n, "col_id").select("col_id", "n", w(0).alias("own"), w(1).alias("context"), w(2).alias("both"))
