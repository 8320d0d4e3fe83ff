"""Screening cells: summaries, ranks, splits, bootstraps, transfer and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import overlap
from ..operators import aggregate, counts, ranking, resample, split, transfer
from ..sources.tables import event_counts, labelled_cells, screen_cells, suppliers, table
from .register import EVENT_SQL, Register, cell_sql, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_CELL = "WITH " + cell_sql()


@register(_CELL + " SELECT row_id, col_id, lineage, cluster, round(value * 1000, 9) AS value FROM cell")
def screen_cell_values(spark, sf):
    return labelled_cells(spark, sf).withColumn("value", six(F.col("value") * 1000, 9))


@register("SELECT l_suppkey, p_brand, arg_max(v, (abs(v), -k)) AS v FROM (SELECT l_suppkey, p_brand, CAST(round((l_discount - 0.05) * 100) AS BIGINT) AS v, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS k FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY ALL")
def collapse_max_abs(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select("l_suppkey", "p_brand", F.round((F.col("l_discount") - 0.05) * 100).cast("long").alias("v"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("k"))
    return aggregate.collapsed(rows, ["l_suppkey", "p_brand"], "v", "max_abs", "k")


_SMD = """SELECT p_brand, n_a, n_b, CASE WHEN n_a >= 3 AND n_b >= 3 THEN round((m_a - m_b) / sqrt(((n_a - 1) * v_a + (n_b - 1) * v_b) / (n_a + n_b - 2)), 6) END AS smd FROM (
  SELECT p_brand, count(*) FILTER (l_returnflag = 'R') AS n_a, count(*) FILTER (l_returnflag <> 'R') AS n_b, avg(v) FILTER (l_returnflag = 'R') AS m_a, avg(v) FILTER (l_returnflag <> 'R') AS m_b,
    var_samp(v) FILTER (l_returnflag = 'R') AS v_a, var_samp(v) FILTER (l_returnflag <> 'R') AS v_b FROM x GROUP BY p_brand)"""


@register("WITH x AS (SELECT p_brand, l_returnflag, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey) " + _SMD)
def smd_effect(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return aggregate.smd(rows, ["p_brand"], "l_quantity", F.col("l_returnflag") == "R").withColumn("smd", six("smd"))


@register("WITH x AS (SELECT p_brand, l_returnflag, l_quantity - avg(l_quantity) OVER (PARTITION BY s_nationkey) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) " + _SMD)
def context_adjusted_smd(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = aggregate.centred(rows.select("p_brand", "l_returnflag", "s_nationkey", "l_quantity"), ["s_nationkey"], "l_quantity")
    return aggregate.smd(rows, ["p_brand"], "l_quantity", F.col("l_returnflag") == "R").withColumn("smd", six("smd"))


@register(_CELL + " SELECT col_id, count(*) AS n, round((sum(value) - min(value)) / (count(*) - 1), 6) AS worst FROM cell GROUP BY col_id HAVING count(*) >= 3")
def leave_one_out_worst(spark, sf):
    return aggregate.leave_one_out_worst(screen_cells(spark, sf), ["col_id"], "value").withColumn("worst", six("worst"))


@register(_CELL + " SELECT lineage, col_id, count(*) AS n, round(median(value), 6) AS median, round(avg(CASE WHEN value <= 0.045 THEN 1.0::DOUBLE ELSE 0 END), 6) AS fraction FROM cell GROUP BY ALL")
def cohort_dependency_summary(spark, sf):
    return aggregate.cohort_summary(labelled_cells(spark, sf), "lineage", "col_id", "value", 0.045).withColumns({"median": six("median"), "fraction": six("fraction")})


@register("SELECT s_nationkey, s_suppkey, s_acctbal, round(100.0::DOUBLE * count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY s_nationkey), 6) AS percentile, round((1.0::DOUBLE + count(*) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) / (1 + count(*) OVER (PARTITION BY s_nationkey)), 6) AS p_upper FROM supplier")
def empirical_percentile(spark, sf):
    return aggregate.empirical_percentile(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal").withColumns({"percentile": six("percentile"), "p_upper": six("p_upper")})


_AVG_RANK = "rank() OVER (PARTITION BY c_nationkey ORDER BY b) - 1 + (count(*) OVER (PARTITION BY c_nationkey, b) - 1) / 2.0::DOUBLE"


@register(f"SELECT c_custkey, {_AVG_RANK} AS average_rank FROM (SELECT *, floor(c_acctbal / 500) AS b FROM customer)")
def average_rank(spark, sf):
    rows = table(spark, sf, "customer").withColumn("b", F.floor(F.col("c_acctbal") / 500))
    return ranking.average_ranks(rows.select("c_custkey", "c_nationkey", "b"), ["c_nationkey"], "b", "average_rank").select("c_custkey", "average_rank")


@register(f"SELECT c_custkey, round(p, 6) AS percentile, CASE WHEN p <= 1 / 3::DOUBLE THEN 'low' WHEN p > 2 / 3::DOUBLE THEN 'high' ELSE 'middle' END AS tertile FROM (SELECT c_custkey, ({_AVG_RANK} + 1) / count(*) OVER (PARTITION BY c_nationkey) AS p FROM (SELECT *, floor(c_acctbal / 500) AS b FROM customer))")
def percentile_tertile(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 500).alias("b"))
    rows = ranking.percentile_ranks(rows, ["c_nationkey"], "b", "p")
    return rows.select("c_custkey", six("p").alias("percentile"), ranking.tertile(F.col("p")).alias("tertile"))


_RANKED = _CELL + ", r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) AS rank FROM cell)"


@register(_RANKED + " SELECT row_id, col_id, rank FROM r WHERE rank <= 10")
def topk_per_row(spark, sf):
    return ranking.top_k(screen_cells(spark, sf), ["row_id"], "value", "col_id", 10).select("row_id", "col_id", F.col("rank").cast("long").alias("rank"))


@register(_RANKED + ", e AS (SELECT row_id, max(value) FILTER (rank = 10) AS k, max(value) FILTER (rank = 11) AS k1 FROM r GROUP BY row_id) SELECT row_id, round(max(k1 - k), 6) AS gap, count(*) FILTER (abs(value - k) <= 0.002512345) AS near, bool_or(k1 = k) AS tied FROM r JOIN e USING (row_id) GROUP BY row_id")
def boundary_gap_k(spark, sf):
    cells = screen_cells(spark, sf)
    made = ranking.boundary_gap(cells, ["row_id"], "value", "col_id", 10, 0.002512345)
    return made.withColumn("gap", six("gap"))


@register(_CELL + ", other AS (SELECT l_suppkey AS row_id, p_brand || '/' || p_type AS col_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) AS rank FROM cell) SELECT r.row_id, round(avg(CASE WHEN o.col_id IS NULL THEN 0.0::DOUBLE ELSE 1 END), 6) AS covered FROM r LEFT JOIN other o ON r.row_id = o.row_id AND r.col_id = o.col_id WHERE rank <= 10 GROUP BY r.row_id")
def topk_label_coverage(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    labelled = lines.select(F.col("l_suppkey").alias("row_id"), F.concat_ws("/", "p_brand", "p_type").alias("col_id"), F.lit(1.0).alias("y")).distinct()
    top = ranking.top_k(screen_cells(spark, sf), ["row_id"], "value", "col_id", 10)
    return top.join(labelled, ["row_id", "col_id"], "left").groupBy("row_id").agg(six(F.avg(F.coalesce("y", F.lit(0.0)))).alias("covered"))


@register(_RANKED + ", l AS (SELECT lineage, row_id, list(col_id) AS top FROM r WHERE rank <= 10 GROUP BY ALL) SELECT a.lineage, count(*) AS n_pairs, round(avg(len(list_intersect(a.top, b.top)) / len(list_distinct(a.top || b.top))::DOUBLE), 6) AS jaccard FROM l a JOIN l b ON a.lineage = b.lineage AND a.row_id < b.row_id GROUP BY a.lineage")
def overlap_jaccard(spark, sf):
    lists = ranking.top_lists(labelled_cells(spark, sf), ["lineage", "row_id"], "value", "col_id", 10)
    return ranking.mean_pairwise_jaccard(lists, "lineage", "row_id").withColumn("jaccard", six("jaccard"))


_HASH = "row_number() OVER (PARTITION BY {} ORDER BY sha256('{}|' || CAST({} AS VARCHAR)), {})"


@register(f"SELECT s_suppkey, CASE WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) THEN 'train' WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) + greatest(round_even(n * 0.2::DOUBLE, 0), 1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT s_suppkey, {_HASH.format('s_nationkey', 'seed', 's_suppkey', 's_suppkey')} AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)")
def hash_split(spark, sf):
    return split.hash_split(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "seed").select("s_suppkey", "split")


_SUPPLIERS = "s AS (SELECT s_suppkey AS row_id, r_name AS lineage, n_name AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@register(f"WITH {_SUPPLIERS}, h AS (SELECT DISTINCT lineage AS held FROM s) SELECT held, row_id, CASE WHEN lineage = held THEN 'test' ELSE 'train' END AS role FROM s, h")
def group_holdout_splits(spark, sf):
    return split.group_holdout(suppliers(spark, sf), "row_id", "lineage", "cluster")


@register(f"WITH {_SUPPLIERS}, k AS (SELECT row_id, lineage, row_id % 40 AS cluster FROM s), h AS (SELECT DISTINCT lineage AS held FROM k) SELECT held, row_id, CASE WHEN lineage = held THEN 'test' WHEN EXISTS (SELECT 1 FROM k x WHERE x.lineage = h.held AND x.cluster = k.cluster) THEN 'purged' ELSE 'train' END AS role FROM k, h")
def purged_holdout_splits(spark, sf):
    return split.group_holdout(suppliers(spark, sf).withColumn("cluster", F.col("row_id") % 40), "row_id", "lineage", "cluster")


@register("SELECT CAST(NULL AS VARCHAR) AS held, CAST(NULL AS BIGINT) AS cluster, CAST(0 AS BIGINT) AS n WHERE false")
def split_leaks(spark, sf):
    s = suppliers(spark, sf).withColumn("cluster", F.col("row_id") % 40)
    return split.leaks(split.group_holdout(s, "row_id", "lineage", "cluster"), s, "row_id", "cluster")


@register(f"SELECT c_custkey, ({_HASH.format('c_mktsegment', 'fold', 'c_custkey', 'c_custkey')} - 1) % 5 AS fold FROM customer")
def round_robin_folds(spark, sf):
    rows = split.round_robin(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 5, "fold")
    return rows.select("c_custkey", F.col("fold").cast("long").alias("fold"))


_LINKED = """WITH RECURSIVE link AS (SELECT DISTINCT conv_id AS g, CASE WHEN role = 'assistant' THEN md5(text) END AS c FROM conversations
), edge AS (SELECT DISTINCT a.g AS x, b.g AS y FROM link a JOIN link b ON a.c = b.c), reach AS (
  SELECT DISTINCT g AS x, g AS y FROM link UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
), named AS (SELECT x AS conv_id, min(y) AS component FROM reach GROUP BY x
), size AS (SELECT component, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, component) AS place FROM named JOIN conversations USING (conv_id) GROUP BY component
), deal AS (SELECT 0::BIGINT AS place, CAST(NULL AS BIGINT) AS component, -1 AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
  UNION ALL SELECT s.place, s.component, list_position(d.load, list_min(d.load)) - 1, list_transform(d.load, lambda v, i: CASE WHEN i = list_position(d.load, list_min(d.load)) THEN v + s.n ELSE v END) FROM deal d JOIN size s ON s.place = d.place + 1
) SELECT n.conv_id, n.component, CAST(d.fold AS INTEGER) AS fold FROM named n JOIN deal d USING (component)"""


@register(_LINKED)
def balanced_folds(spark, sf):
    """Five folds of conversations of about equal rows; conversations that share an assistant's text stay together."""
    c = table(spark, sf, "conversations").withColumn("c", F.when(F.col("role") == "assistant", F.md5(F.encode("text", "utf-8"))))
    return split.balanced_folds(c, "conv_id", "c", 5)


def _draws(groups: str, key: str, source: str, seed: str, name: str = "''", draws: int = 100) -> str:
    over = f"PARTITION BY {groups}" if groups else ""
    keep = f"{groups}, " if groups else ""
    match = f"b.g = n.g AND " if groups else ""
    g = f"{groups} AS g, " if groups else ""
    return f"""n AS (SELECT *, {g}row_number() OVER ({over} ORDER BY {key}) - 1 AS pos, count(*) OVER ({over}) AS size FROM {source}
), b AS (SELECT {"g, " if groups else ""}draw, CAST('0x' || substr(sha256('{seed}|' || {name} || '|' || CAST(draw AS VARCHAR) || '|' || CAST(pos AS VARCHAR)), 1, 8) AS BIGINT) % size AS pos, pos AS slot FROM n, range({draws}) t(draw)
), d AS (SELECT n.*, b.draw, b.slot FROM b JOIN n ON {match}b.pos = n.pos)"""


def _q(x: str, digits: int = 3) -> str:
    return f"round(quantile_cont({x}, 0.025), {digits}) AS ci_low, round(quantile_cont({x}, 0.5), {digits}) AS boot_median, round(quantile_cont({x}, 0.975), {digits}) AS ci_high"


def _bounds(*more: str) -> dict:
    return {c: six(c, 3) for c in (*more, "ci_low", "boot_median", "ci_high")}


@register("WITH " + _draws("c_mktsegment", "c_custkey", "customer", "boot", "c_mktsegment") + f", p AS (SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 3) AS estimate FROM customer GROUP BY ALL), s AS (SELECT c_mktsegment, draw, avg(c_acctbal) AS stat FROM d GROUP BY ALL) SELECT c_mktsegment, any_value(p.n) AS n, any_value(p.estimate) AS estimate, {_q('stat')} FROM s JOIN p USING (c_mktsegment) GROUP BY c_mktsegment")
def bootstrap_mean(spark, sf):
    sums, mean = resample.mean_sums("c_acctbal")
    return resample.bootstrap(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", mean, 100, "boot", sums).withColumns(_bounds("estimate"))


@register("WITH " + _draws("s_nationkey", "s_suppkey", "supplier", "boot", "CAST(s_nationkey AS VARCHAR)") + f", p AS (SELECT s_nationkey, count(*) AS n, round(median(s_acctbal), 3) AS estimate FROM supplier GROUP BY ALL), s AS (SELECT s_nationkey, draw, median(s_acctbal) AS stat FROM d GROUP BY ALL) SELECT s_nationkey, any_value(p.n) AS n, any_value(p.estimate) AS estimate, {_q('stat')} FROM s JOIN p USING (s_nationkey) GROUP BY s_nationkey")
def bootstrap_median(spark, sf):
    return resample.bootstrap(table(spark, sf, "supplier"), ["s_nationkey"], "s_suppkey", F.median("s_acctbal"), 100, "boot").withColumns(_bounds("estimate"))


@register("WITH " + _draws("c_nationkey", "c_custkey", "customer", "boot", "CAST(c_nationkey AS VARCHAR)") + f", p AS (SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal) / sum(abs(c_acctbal)), 6) AS estimate FROM customer GROUP BY ALL), s AS (SELECT c_nationkey, draw, sum(c_acctbal) / sum(abs(c_acctbal)) AS stat FROM d GROUP BY ALL) SELECT c_nationkey, any_value(p.n) AS n, any_value(p.estimate) AS estimate, {_q('stat', 6)} FROM s JOIN p USING (c_nationkey) GROUP BY c_nationkey")
def bootstrap_ratio(spark, sf):
    made = resample.bootstrap(table(spark, sf, "customer"), ["c_nationkey"], "c_custkey", F.sum("v") / F.sum("size"), 100, "boot", {"v": F.col("c_acctbal"), "size": F.abs("c_acctbal")})
    return made.withColumns({c: six(c) for c in ("estimate", "ci_low", "boot_median", "ci_high")})


@register("WITH x AS (SELECT *, c_nationkey < 12 AS arm, c_mktsegment || '/' || CASE WHEN c_nationkey < 12 THEN 'true' ELSE 'false' END AS grp FROM customer), " + _draws("grp", "c_custkey", "x", "boot", "grp") + f", m AS (SELECT c_mktsegment, arm, draw, avg(c_acctbal) AS m FROM d GROUP BY ALL), s AS (SELECT c_mktsegment, draw, max(m) FILTER (arm) - max(m) FILTER (NOT arm) AS stat FROM m GROUP BY ALL) SELECT c_mktsegment, {_q('stat')} FROM s GROUP BY c_mktsegment")
def bootstrap_difference(spark, sf):
    rows = table(spark, sf, "customer").withColumn("arm", F.col("c_nationkey") < 12)
    return resample.bootstrap_difference(rows, ["c_mktsegment"], "c_custkey", "c_acctbal", "arm", 100, "boot").withColumns(_bounds())


@register("WITH " + _draws("c_mktsegment", "c_custkey", "customer", "boot", "c_mktsegment") + f", m AS (SELECT c_mktsegment, draw, avg(c_acctbal) AS m FROM d GROUP BY ALL), s AS (SELECT draw, avg(m) AS stat FROM m GROUP BY draw) SELECT {_q('stat')} FROM s")
def bootstrap_strata(spark, sf):
    return resample.bootstrap_strata(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "c_acctbal", 100, "boot").withColumns(_bounds())


@register("WITH " + _draws("c_mktsegment", "c_custkey", "customer", "boot", "c_mktsegment") + ", m AS (SELECT c_mktsegment, draw, avg(c_acctbal) AS m FROM d GROUP BY ALL), " + "so AS (SELECT DISTINCT c_mktsegment FROM customer), " + _draws("", "c_mktsegment", "so", "boot/strata").replace("n AS (", "n2 AS (").replace("b AS (", "b2 AS (").replace("d AS (", "d2 AS (").replace("FROM n,", "FROM n2,").replace("FROM b JOIN n ON b.pos = n.pos", "FROM b2 b JOIN n2 n ON b.pos = n.pos") + f", s AS (SELECT d2.draw, avg(m) AS stat FROM d2 JOIN m USING (c_mktsegment, draw) GROUP BY d2.draw) SELECT {_q('stat')} FROM s")
def bootstrap_hierarchical(spark, sf):
    return resample.bootstrap_hierarchical(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "c_acctbal", 100, "boot").withColumns(_bounds())


@register("WITH k AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer), " + _draws("c_mktsegment", "c_nationkey", "k", "boot", "c_mktsegment", 20) + " SELECT c_mktsegment, draw, count(*) AS n FROM d JOIN customer USING (c_mktsegment, c_nationkey) GROUP BY ALL")
def bootstrap_cluster(spark, sf):
    rows = resample.cluster_bootstrap(table(spark, sf, "customer"), "c_mktsegment", "c_nationkey", 20, "boot")
    return rows.groupBy("c_mktsegment", F.col("draw").cast("long").alias("draw")).agg(F.count("*").alias("n"))


@register(f"WITH {_SUPPLIERS}, z AS (SELECT lineage, cluster, count(*) AS size FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lineage, size ORDER BY cluster) AS a, row_number() OVER (PARTITION BY lineage, size ORDER BY sha256('perm|' || cluster), cluster) AS b FROM z) SELECT r.lineage, r.cluster, r.size, d.cluster AS donor, r.cluster <> d.cluster AS moved FROM r JOIN r d ON r.lineage = d.lineage AND r.size = d.size AND r.a = d.b")
def block_permutation(spark, sf):
    return resample.block_permutation(suppliers(spark, sf), "lineage", "cluster", "perm")


_TWO = "WITH " + cell_sql() + ", " + cell_sql("l_tax", "tax")


@register(_TWO + " SELECT coalesce(a.col_id, b.col_id) AS col_id, round(source_mean, 6) AS source_mean, round(target_mean, 6) AS target_mean, round(coalesce(target_mean - source_mean, 0), 6) AS shift FROM (SELECT col_id, avg(value) AS source_mean FROM cell GROUP BY col_id) a FULL JOIN (SELECT col_id, avg(value) AS target_mean FROM tax GROUP BY col_id) b ON a.col_id = b.col_id")
def mean_shift_map(spark, sf):
    made = transfer.mean_shift(screen_cells(spark, sf), screen_cells(spark, sf, "l_tax"), "col_id", "value")
    return made.select("col_id", *[six(c).alias(c) for c in ("source_mean", "target_mean", "shift")])


@register(_TWO + " SELECT a.col_id, count(*) AS n, round(avg(a.value), 6) AS mean_a, round(stddev_pop(a.value), 6) AS sd_a, round(avg(b.value), 6) AS mean_b, round(stddev_pop(b.value), 6) AS sd_b FROM cell a JOIN tax b ON a.row_id = b.row_id AND a.col_id = b.col_id GROUP BY a.col_id HAVING count(*) >= 20")
def paired_platform_moments(spark, sf):
    made = transfer.platform_moments(screen_cells(spark, sf), screen_cells(spark, sf, "l_tax"), "row_id", "col_id", "value")
    return made.select("col_id", "n", *[six(c).alias(c) for c in ("mean_a", "sd_a", "mean_b", "sd_b")])


@register(_CELL + ", a AS (SELECT col_id, avg(value) AS m, stddev_pop(value) AS s, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM cell WHERE lineage = 'ASIA' GROUP BY col_id HAVING stddev_pop(value) > 1e-8) SELECT row_id, count(*) AS n, round(sqrt(avg(((value - m) / s) * ((value - m) / s))), 6) AS distance, round(avg(CASE WHEN value < lo OR value > hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS outside FROM cell JOIN a USING (col_id) WHERE lineage <> 'ASIA' GROUP BY row_id")
def domain_distance(spark, sf):
    cells = labelled_cells(spark, sf)
    made = transfer.domain_distance(cells.filter("lineage = 'ASIA'"), cells.filter("lineage <> 'ASIA'"), "row_id", "col_id", "value")
    return made.withColumns({"distance": six("distance"), "outside": six("outside")})


@register(_RANKED + ", k AS (SELECT lineage, col_id, count(*) AS k FROM r WHERE rank <= 10 GROUP BY ALL), n AS (SELECT lineage, count(DISTINCT row_id) AS n FROM cell GROUP BY lineage) SELECT c.lineage, c.col_id, round(coalesce(k, 0) / n::DOUBLE, 6) AS frequency FROM (SELECT DISTINCT lineage, col_id FROM cell) c JOIN n ON c.lineage = n.lineage LEFT JOIN k ON c.lineage = k.lineage AND c.col_id = k.col_id")
def selection_frequency(spark, sf):
    return transfer.selection_frequency(labelled_cells(spark, sf), ["lineage"], "row_id", "col_id", "value", 10).withColumn("frequency", six("frequency"))


@register(_TWO + ", u AS (SELECT 'a' AS method, * FROM cell UNION ALL SELECT 'b', * FROM tax), r AS (SELECT *, row_number() OVER (PARTITION BY method, row_id ORDER BY value, col_id) AS rank FROM u) SELECT row_id, col_id FROM r WHERE rank <= 30 GROUP BY ALL HAVING count(DISTINCT method) = 2")
def consensus_top(spark, sf):
    both = screen_cells(spark, sf).withColumn("method", F.lit("a")).unionByName(screen_cells(spark, sf, "l_tax").withColumn("method", F.lit("b")))
    return transfer.consensus(both, "method", "row_id", "col_id", "value", 30)


@register(_TWO + ", u AS (SELECT 'a' AS method, * FROM cell UNION ALL SELECT 'b', * FROM tax), l AS (SELECT method, row_id, list(col_id) AS top FROM (SELECT *, row_number() OVER (PARTITION BY method, row_id ORDER BY value, col_id) AS rank FROM u) WHERE rank <= 10 GROUP BY ALL) SELECT x.row_id, len(list_intersect(x.top, y.top)) / 10.0::DOUBLE AS overlap FROM l x JOIN l y ON x.row_id = y.row_id AND x.method = 'a' AND y.method = 'b'")
def mapping_overlap(spark, sf):
    a = ranking.top_lists(screen_cells(spark, sf), ["row_id"], "value", "col_id", 10)
    b = ranking.top_lists(screen_cells(spark, sf, "l_tax"), ["row_id"], "value", "col_id", 10).withColumnRenamed("top", "other")
    return a.join(b, "row_id").select("row_id", overlap(F.col("top"), F.col("other"), 10).alias("overlap"))


@register("SELECT l_suppkey, p_brand, round(a - b, 6) AS difference FROM (SELECT l_suppkey, p_brand, avg(l_quantity) FILTER (l_returnflag = 'R') AS a, avg(l_quantity) FILTER (l_returnflag <> 'R') AS b FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) WHERE a IS NOT NULL AND b IS NOT NULL")
def paired_difference(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return transfer.paired_difference(rows, ["l_suppkey", "p_brand"], F.col("l_returnflag") == "R", "l_quantity").withColumn("difference", six("difference"))


@register(_CELL + ", m AS (SELECT col_id, avg(value) AS m, stddev_samp(value) AS s FROM cell WHERE lineage = 'EUROPE' GROUP BY col_id) SELECT row_id, col_id, round((value - m) / greatest(coalesce(s, 0), 0.25::DOUBLE), 6) AS z FROM cell JOIN m USING (col_id) WHERE lineage <> 'EUROPE'")
def z_against_normal(spark, sf):
    cells = labelled_cells(spark, sf)
    made = transfer.z_against(cells.filter("lineage <> 'EUROPE'"), cells.filter("lineage = 'EUROPE'"), "col_id", "value")
    return made.select("row_id", "col_id", six("z").alias("z"))


_EVENTS = "WITH " + EVENT_SQL


@register(_EVENTS + ", s AS (SELECT label, feature, CAST(sum(count) AS BIGINT) AS count, count(*) FILTER (count > 0) AS detected FROM counts GROUP BY ALL) SELECT *, round(1e6 * count / sum(count) OVER (PARTITION BY label), 4) AS cpm FROM s")
def pseudobulk_counts(spark, sf):
    sums = counts.group_counts(event_counts(spark, sf), ["label"], "feature", "count")
    return sums.withColumn("cpm", six(counts.cpm(sums, ["label"]), 4))


@register(_EVENTS + ", g AS (SELECT *, unnest(list_filter(['all', label, CASE WHEN label <> 'g0' THEN 'non_g0' END], lambda x: x IS NOT NULL)) AS \"group\" FROM counts) SELECT \"group\", feature, CAST(sum(count) AS BIGINT) AS count, count(*) FILTER (count > 0) AS detected FROM g GROUP BY ALL")
def overlapping_groups(spark, sf):
    return counts.group_counts(counts.overlapping(event_counts(spark, sf), F.col("label"), "g0"), ["group"], "feature", "count")


@register(_EVENTS + " SELECT cell, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS detected, round(coalesce(sum(count) FILTER (starts_with(feature, 'p')), 0)::DOUBLE / sum(count), 6) AS marked_share FROM counts GROUP BY cell")
def cell_quality(spark, sf):
    return counts.quality(event_counts(spark, sf), "cell", "feature", "count", F.col("feature").startswith("p")).withColumn("marked_share", six("marked_share"))


@register(_EVENTS + ", s AS (SELECT label, feature, sum(count)::DOUBLE AS c FROM counts GROUP BY ALL), p AS (SELECT feature, max(c) FILTER (label = 'g0') AS a, max(c) FILTER (label = 'g1') AS b FROM s GROUP BY feature) SELECT feature, fraction, round(log2((1 - fraction) * a + fraction * b + 1), 6) AS profile FROM p, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS fraction)")
def mixture_profiles(spark, sf):
    sums = counts.group_counts(event_counts(spark, sf), ["label"], "feature", "count")
    p = sums.groupBy("feature").agg(F.max(F.when(F.col("label") == "g0", F.col("count"))).cast("double").alias("a"), F.max(F.when(F.col("label") == "g1", F.col("count"))).cast("double").alias("b"))
    return counts.mixtures(p, ["feature"], "a", "b").withColumn("profile", six("profile"))


@register(_EVENTS + ", m AS (SELECT DISTINCT feature FROM counts WHERE feature <> 'click'), e AS (SELECT DISTINCT c.cell, f.feature FROM counts c, (SELECT DISTINCT feature FROM counts) f) SELECT e.cell, e.feature, m.feature IS NOT NULL AS present, CASE WHEN m.feature IS NOT NULL THEN coalesce(c.count, 0)::DOUBLE END AS count FROM e LEFT JOIN m ON e.feature = m.feature LEFT JOIN counts c ON c.cell = e.cell AND c.feature = e.feature")
def presence_vs_zero(spark, sf):
    c = event_counts(spark, sf)
    return counts.presence_or_zero(c.select("cell").distinct(), c.select("feature").distinct(), c.filter("feature <> 'click'").select("feature").distinct(), c.select("cell", "feature", F.col("count").cast("double").alias("count")), ["cell", "feature"], "feature", "count")


@register("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark, sf):
    from ..streaming.counts import windowed_counts

    w = windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", six("total", 4).alias("total"))


@register("SELECT s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 4) AS centred FROM supplier")
def group_centred(spark, sf):
    return aggregate.centred(table(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal").select("s_suppkey", six("s_acctbal", 4).alias("centred"))
