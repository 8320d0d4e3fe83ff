"""Filters, masks, sets, identities, and resampling by strata over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import finite_below
from ..operators import aggregate, counts, filters, ranking, relational, resample, split
from ..sources.tables import event_counts, labelled_cells, screen_cells, suppliers, table
from .register import EVENT_SQL, Register, cell_sql, six
from .screening import _draws, _q

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_CELL = "WITH " + cell_sql()
_EVENTS = "WITH " + EVENT_SQL


@register(_CELL + ", n AS (SELECT count(DISTINCT row_id) AS n FROM cell) SELECT col_id, count(*) AS n, round(count(*) / any_value(n.n)::DOUBLE, 6) AS share FROM cell, n WHERE value IS NOT NULL GROUP BY col_id HAVING count(*) >= 0.9 * any_value(n.n)")
def covered_columns(spark, sf):
    return filters.covered(screen_cells(spark, sf), "row_id", "col_id", "value", 0.9).withColumn("share", six("share"))


@register("WITH e AS (SELECT DISTINCT p_partkey AS key, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 20), n AS (SELECT floor(count(DISTINCT l_suppkey) * 0.15::DOUBLE) AS most FROM lineitem) SELECT key, count(*) AS n FROM e, n WHERE key NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY key, most HAVING count(*) >= 3 AND count(*) <= most")
def count_window_keys(spark, sf):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "key")
    parts = table(spark, sf, "part").withColumnRenamed("p_partkey", "key")
    events = lines.filter("l_quantity > 20").join(parts, "key", "left_semi")
    return filters.count_window(events, "key", "l_suppkey", 3, 0.15, lines, parts.filter("p_size < 10"))


@register(_EVENTS + ", q AS (SELECT cell, CAST(sum(count) AS BIGINT) AS total, count(*) FILTER (count > 0) AS detected, coalesce(sum(count) FILTER (starts_with(feature, 'p')), 0)::DOUBLE / sum(count) AS share FROM counts GROUP BY cell) SELECT cell, total, detected FROM q WHERE detected >= 4 AND share <= 0.2 AND cell % 11 <> 0")
def cells_that_pass(spark, sf):
    cells = counts.quality(event_counts(spark, sf), "cell", "feature", "count", F.col("feature").startswith("p"))
    return filters.passing(cells, 4, 0.2, F.col("cell") % 11 != 0).select("cell", "total", "detected")


@register("SELECT s_suppkey, coalesce(v < 0, false) AS below FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN 'nan'::DOUBLE ELSE s_acctbal END AS v FROM supplier)")
def finite_below_zero(spark, sf):
    v = F.when(F.col("s_suppkey") % 5 == 0, F.lit(None)).when(F.col("s_suppkey") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("s_acctbal"))
    return table(spark, sf, "supplier").select("s_suppkey", finite_below(v).alias("below"))


@register(_CELL + ", m AS (SELECT row_id, col_id, row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) AS rank FROM cell WHERE NOT ends_with(col_id, 'PROMO')) SELECT c.row_id, c.col_id, m.rank FROM cell c LEFT JOIN m ON c.row_id = m.row_id AND c.col_id = m.col_id")
def masked_rank(spark, sf):
    made = filters.masked_ranks(screen_cells(spark, sf), ["row_id"], "value", "col_id", ~F.col("col_id").endswith("PROMO"))
    return made.select("row_id", "col_id", F.col("rank").cast("long").alias("rank"))


@register("SELECT c.c_custkey, r.place FROM customer c LEFT JOIN (SELECT c_custkey, row_number() OVER (ORDER BY -c_acctbal, c_custkey) AS place FROM customer WHERE c_acctbal > 0) r ON c.c_custkey = r.c_custkey")
def eligible_rank(spark, sf):
    return ranking.eligible_places(table(spark, sf, "customer").withColumn("v", -F.col("c_acctbal")), F.col("c_acctbal") > 0, "v", "c_custkey").select("c_custkey", "place")


@register("WITH t AS (SELECT p_brand, count(*) FILTER (p_size > 25) AS big, count(*) AS n FROM part GROUP BY p_brand), c AS (SELECT p_brand, big, CASE WHEN big > 0.52 * n THEN 'A' WHEN big > 0.48 * n THEN 'B' ELSE 'exploratory' END AS tier FROM t) SELECT p_brand, tier, big, row_number() OVER (ORDER BY CASE tier WHEN 'A' THEN 0 WHEN 'B' THEN 1 ELSE 2 END, big DESC, p_brand) AS place FROM c")
def category_first_order(spark, sf):
    t = table(spark, sf, "part").groupBy("p_brand").agg(F.count_if(F.col("p_size") > 25).alias("big"), F.count("*").alias("n"))
    tier = F.when(F.col("big") > 0.52 * F.col("n"), "A").when(F.col("big") > 0.48 * F.col("n"), "B").otherwise("exploratory")
    rows = t.withColumn("tier", tier)
    return ranking.category_places(rows, "tier", ["A", "B", "exploratory"], F.desc("big"), "p_brand").select("p_brand", "tier", "big", "place")


@register(_CELL + ", m AS (SELECT col_id, avg(value) AS mean FROM cell GROUP BY col_id), w AS (SELECT lineage AS target, col_id, avg(value) AS weight FROM cell GROUP BY ALL), c AS (SELECT w.target, cell.col_id, avg(abs((value - mean) * weight)) AS size, avg((value - mean) * weight) AS signed FROM cell JOIN m USING (col_id) JOIN w ON w.col_id = cell.col_id WHERE cell.lineage = 'EUROPE' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(size, 12) DESC, col_id) AS place FROM c) SELECT target, col_id, round(size, 9) AS size, round(signed, 9) AS signed, place FROM r WHERE place <= 10")
def top_contributions(spark, sf):
    cells = labelled_cells(spark, sf)
    weights = cells.groupBy(F.col("lineage").alias("target"), "col_id").agg(F.avg("value").alias("weight"))
    about = cells.groupBy("col_id").agg(F.avg("value").alias("mean"))
    centred = cells.filter("lineage = 'EUROPE'").join(about, "col_id").select("row_id", "col_id", (F.col("value") - F.col("mean")).alias("value"))
    made = ranking.top_contributions(centred, weights, "col_id", "target", 10)
    return made.select("target", "col_id", six("size", 9).alias("size"), six("signed", 9).alias("signed"), F.col("place").cast("long").alias("place"))


_LISTS = "l AS (SELECT l_suppkey, list(DISTINCT l_partkey ORDER BY l_partkey) FILTER (l_returnflag = 'R' AND l_quantity > 30) AS r, list(DISTINCT l_partkey ORDER BY l_partkey) FILTER (l_quantity > 40) AS q FROM lineitem GROUP BY l_suppkey)"


def _two_lists(spark, sf):
    sets = [F.array_sort(F.collect_set(F.when(c, F.col("l_partkey")))) for c in ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 30), F.col("l_quantity") > 40)]
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(sets[0].alias("r"), sets[1].alias("q"))


@register(f"WITH {_LISTS}, b AS (SELECT l_suppkey, coalesce(r[1:5], []) AS r, coalesce(q[1:5], []) AS q FROM l) SELECT l_suppkey, array_to_string(r || list_filter(q, lambda x: NOT list_contains(r, x)), ';') AS members FROM b")
def ordered_union_lists(spark, sf):
    joined = filters.ordered_union(F.slice("r", 1, 5), F.slice("q", 1, 5))
    return _two_lists(spark, sf).select("l_suppkey", F.array_join(F.transform(joined, lambda x: x.cast("string")), ";").alias("members"))


@register(f"WITH {_LISTS} SELECT l_suppkey, CASE WHEN len(r) >= 80 AND len(q) >= 80 THEN len(list_intersect(r[1:80], q[1:80])) / 80.0::DOUBLE END AS overlap FROM l")
def full_list_overlap(spark, sf):
    return _two_lists(spark, sf).select("l_suppkey", filters.full_overlap(F.col("r"), F.col("q"), 80).alias("overlap"))


@register("WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49), b AS (SELECT DISTINCT s_suppkey AS k FROM supplier), j AS (SELECT a.k AS x, b.k AS y FROM a FULL JOIN b ON a.k = b.k), c AS (SELECT count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS \"both\", count(*) FILTER (y IS NULL) AS left_only, count(*) FILTER (x IS NULL) AS right_only FROM j) SELECT *, left_only = 0 AND right_only = 0 AS equal, left_only = 0 AS subset FROM c")
def key_set_agreement(spark, sf):
    a = table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_suppkey").alias("k"))
    return filters.set_agreement(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k")


@register("SELECT source, string_agg(lang || '=' || CAST(n AS VARCHAR), ';' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) GROUP BY source")
def value_counts(spark, sf):
    return filters.counts_text(table(spark, sf, "documents").filter("lang IS NOT NULL"), ["source"], "lang")


@register("SELECT s_nationkey, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM (SELECT s_nationkey, CASE WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) THEN 'train' WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) + greatest(round_even(n * 0.2::DOUBLE, 0), 1) THEN 'validation' ELSE 'test' END AS split FROM (SELECT s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('seed|' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier)) GROUP BY s_nationkey")
def split_sizes(spark, sf):
    rows = split.hash_split(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "seed")
    return relational.pivoted(rows, ["s_nationkey"], "split", ["train", "validation", "test"], F.count(F.lit(1))).na.fill(0)


@register(_CELL + " SELECT col_id AS row_id, row_id AS col_id, round(value * 1000, 9) AS value FROM cell")
def transposed_cells(spark, sf):
    return relational.transposed(screen_cells(spark, sf)).withColumn("value", six(F.col("value") * 1000, 9))


@register("SELECT l_suppkey, p_brand, modality, round(CASE WHEN any_value(modality) = 'quantity' THEN max(v) ELSE avg(v) END, 6) AS value FROM (SELECT l_suppkey, p_brand, 'quantity' AS modality, l_quantity::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey UNION ALL SELECT l_suppkey, p_brand, 'tax', l_tax FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_suppkey, p_brand, modality")
def modality_collapse(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = relational.unpivoted(lines.select("l_suppkey", "p_brand", F.col("l_quantity").cast("double").alias("quantity"), F.col("l_tax").cast("double").alias("tax")), ["l_suppkey", "p_brand"], ["quantity", "tax"], "modality")
    return aggregate.collapsed_by(long, ["l_suppkey", "p_brand"], "modality", "value", {"quantity": "max"}).withColumn("value", six("value"))


@register(_CELL + ", a AS (SELECT lineage, cluster, row_id, avg(value) AS v FROM cell GROUP BY ALL), b AS (SELECT lineage, cluster, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT lineage, avg(v) AS v FROM b GROUP BY ALL) SELECT round(avg(v), 9) AS value FROM c")
def nested_means(spark, sf):
    levels = [["lineage", "cluster", "row_id"], ["lineage", "cluster"], ["lineage"], []]
    return aggregate.nested_average(labelled_cells(spark, sf), levels, "value").withColumn("value", six("value", 9))


@register("SELECT c_custkey, n, c_mktsegment FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey")
def joined_one_to_one(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return relational.checked_join(o, table(spark, sf, "customer"), ["c_custkey"], "inner", "one_to_one").select("c_custkey", "n", "c_mktsegment")


@register("SELECT n_name, s_suppkey, s_acctbal FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def joined_one_to_many(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return relational.checked_join(n, table(spark, sf, "supplier"), ["s_nationkey"], "inner", "one_to_many").select("n_name", "s_suppkey", "s_acctbal")


@register("WITH m AS (SELECT l_suppkey, p_brand, l_linestatus, avg(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT a.l_suppkey, a.p_brand, round(a.v, 6) AS first, round(b.v, 6) AS second, round(a.v - b.v, 6) AS difference FROM m a JOIN m b ON a.l_suppkey = b.l_suppkey AND a.p_brand = b.p_brand WHERE a.l_linestatus = 'O' AND b.l_linestatus = 'F'")
def paired_states(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    means = lines.groupBy("l_suppkey", "p_brand", "l_linestatus").agg(F.avg("l_quantity").alias("v"))
    return filters.paired_states(means, ["l_suppkey", "p_brand"], "l_linestatus", "O", "F", "v").withColumns({c: six(c) for c in ("first", "second", "difference")})


@register("WITH u AS (SELECT p_name AS source, p_brand AS target FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_name, min(p_brand) FROM part WHERE p_partkey % 2 = 1 GROUP BY p_name) SELECT source, CASE WHEN count(DISTINCT target) = 1 THEN min(target) END AS target, count(DISTINCT target) AS n_targets, count(DISTINCT target) > 1 AS conflict FROM u GROUP BY source")
def two_way_identity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("source"), F.col("p_brand").alias("target"))
    backward = p.filter("p_partkey % 2 = 1").groupBy("source").agg(F.min("target").alias("target"))
    return filters.two_way_identity(p.filter("p_partkey % 2 = 0"), backward, "source", "target")


@register(_CELL + """, d AS (SELECT col_id, sha256(CAST(row_id AS VARCHAR)) AS d FROM cell), b AS (SELECT col_id, substr(d, 1, 1) AS b, count(*) AS k, sum(CAST(('0x' || substr(d, 3, 12)) AS BIGINT)) AS s FROM d GROUP BY ALL)
SELECT col_id, sha256(string_agg(b || ':' || CAST(k AS VARCHAR) || ':' || CAST(s AS VARCHAR), ',' ORDER BY b)) AS mask, CAST(sum(k) AS BIGINT) AS n FROM b GROUP BY col_id""")
def observed_masks(spark, sf):
    return filters.mask_groups(screen_cells(spark, sf), "row_id", "col_id", "value")


@register("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey::DOUBLE END AS value, s_name AS label FROM supplier")
def json_round_trip(spark, sf):
    v = F.when(F.col("s_suppkey") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("s_nationkey").cast("double"))
    packed = table(spark, sf, "supplier").select("s_suppkey", "s_name", filters.finite_json(value=v).alias("j"))
    return packed.select("s_suppkey", F.from_json("j", "value double")["value"].alias("value"), F.col("s_name").alias("label"))


@register("WITH " + _draws("c_mktsegment", "c_custkey", "customer", "ratio", "c_mktsegment") + f", s AS (SELECT draw, sum(c_acctbal) / sum(abs(c_acctbal)) AS stat FROM d GROUP BY draw) SELECT {_q('stat', 6)} FROM s")
def bootstrap_ratio_strata(spark, sf):
    return resample.bootstrap_pooled(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", F.sum("v") / F.sum("size"), 100, "ratio", {"v": F.col("c_acctbal"), "size": F.abs("c_acctbal")}).withColumns({c: six(c) for c in ("ci_low", "boot_median", "ci_high")})


_DIFF = "x AS (SELECT s_suppkey, s_nationkey, r, n FROM (SELECT l_suppkey, avg(l_quantity) FILTER (l_returnflag = 'R') AS r, avg(l_quantity) FILTER (l_returnflag <> 'R') AS n FROM lineitem GROUP BY l_suppkey) JOIN supplier ON l_suppkey = s_suppkey WHERE r IS NOT NULL AND n IS NOT NULL)"


@register(f"WITH {_DIFF}, " + _draws("s_nationkey", "s_suppkey", "x", "paired", "CAST(s_nationkey AS VARCHAR)").replace("n AS (SELECT *, s_nationkey", "n AS (SELECT s_suppkey, s_nationkey, r - n AS diff, s_nationkey") + f", s AS (SELECT draw, avg(diff) AS stat FROM d GROUP BY draw) SELECT {_q('stat', 6)} FROM s")
def bootstrap_paired_strata(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("arm", F.when(F.col("l_returnflag") == "R", "r").otherwise("n"))
    wide = relational.pivoted(lines, ["l_suppkey"], "arm", ["r", "n"], F.avg("l_quantity")).dropna(subset=["r", "n"])
    rows = wide.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_nationkey", (F.col("r") - F.col("n")).alias("diff"))
    sums, mean = resample.mean_sums("diff")
    return resample.bootstrap_pooled(rows, "s_nationkey", "s_suppkey", mean, 100, "paired", sums).withColumns({c: six(c) for c in ("ci_low", "boot_median", "ci_high")})


@register("WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal, r_name AS lineage FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), a AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY s_suppkey) AS p FROM s), b AS (SELECT draw, lineage, s_acctbal, row_number() OVER (PARTITION BY draw, lineage ORDER BY sha256('null' || CAST(draw AS VARCHAR) || '|' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS p FROM s, range(20) t(draw)), m AS (SELECT draw, s_nationkey, avg(b.s_acctbal) AS m FROM a JOIN b ON a.lineage = b.lineage AND a.p = b.p GROUP BY ALL) SELECT draw, arg_min(s_nationkey, (round(m, 4), s_nationkey)) AS chosen, round(min(m), 4) AS score FROM m GROUP BY draw")
def null_selection(spark, sf):
    rows = suppliers(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_nationkey", "s_acctbal"), "row_id")
    shuffled = resample.shuffled_values(rows, "lineage", "row_id", "s_acctbal", 20, "null")
    means = shuffled.groupBy("draw", "s_nationkey").agg(F.avg("s_acctbal").alias("m"))
    return means.groupBy("draw").agg(F.min_by("s_nationkey", F.struct(F.round("m", 4), "s_nationkey")).alias("chosen"), six(F.min("m"), 4).alias("score"))


@register("WITH f AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256('frozen|' || CAST(s_suppkey AS VARCHAR)), s_suppkey) AS p, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier), g AS (SELECT s_suppkey, CASE WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) THEN 'train' WHEN p <= greatest(round_even(n * 0.6::DOUBLE, 0), 1) + greatest(round_even(n * 0.2::DOUBLE, 0), 1) THEN 'validation' ELSE 'test' END AS split FROM f) SELECT split, count(*) AS n, count(*) FILTER (l_suppkey IS NULL) AS n_missing, round(avg(q), 6) AS mean FROM g LEFT JOIN (SELECT l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY l_suppkey) ON s_suppkey = l_suppkey GROUP BY split")
def frozen_split_replay(spark, sf):
    """The split table is written once and read back; what is measured joins the stored rows."""
    from ..sources.publish import staged

    frozen = staged(split.hash_split(table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "frozen").select("s_suppkey", "split"), "split")
    q = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_quantity").alias("q"))
    return split.replayed(frozen, q, "s_suppkey").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("q").isNull()).alias("n_missing"), six(F.avg("q")).alias("mean"))


@register("SELECT split_part(p_name, ' ', 1) AS id, string_agg(DISTINCT p_brand, ';' ORDER BY p_brand) AS targets, count(DISTINCT p_brand) AS n FROM part GROUP BY split_part(p_name, ' ', 1)")
def id_map_lists(spark, sf):
    rows = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("id"), "p_brand")
    return rows.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ";").alias("targets"), F.count_distinct("p_brand").alias("n"))


@register("SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS size FROM customer")
def places_in_few_groups(spark, sf):
    """Places inside groups that each hold a large share of all rows, by ranges of the value."""
    return ranking.placed(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_custkey").select("c_custkey", "place", F.col("size"))


@register("SELECT c_nationkey, count(*) AS n, CASE WHEN count(*) >= 2 THEN round(avg(c_acctbal), 4) END AS mean, CASE WHEN count(*) >= 2 THEN round(stddev_samp(c_acctbal) / sqrt(count(*)), 4) END AS error FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey")
def guarded_mean(spark, sf):
    v = F.col("c_acctbal")
    rows = table(spark, sf, "customer").filter(v > 9000).groupBy("c_nationkey").agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.stddev_samp(v).alias("s"))
    enough = lambda x: F.when(F.col("n") >= 2, F.round(x, 4))
    return rows.select("c_nationkey", "n", enough(F.col("m")).alias("mean"), enough(F.col("s") / F.sqrt("n")).alias("error"))
