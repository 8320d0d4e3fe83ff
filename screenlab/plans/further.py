"""More queries: scopes, blocks, features, audits, claims and controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, counts, evidence, graph, linalg, metrics, ranking, resample, split, transfer
from ..sources.tables import event_counts, held_out_predictions, labelled_cells, screen_cells, suppliers, table
from .evaluation import metric_rows
from .register import EVENT_SQL, METRIC_SQL, PRED_SQL, Register, cell_sql, six
from .relations import nation_edges

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql
_CELL = "WITH " + cell_sql()
_METRIC = "WITH " + METRIC_SQL


@register("WITH x AS (SELECT *, unnest(list_filter(['all', CASE WHEN l_quantity > 25 THEN 'large' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END], lambda x: x IS NOT NULL)) AS scope FROM lineitem) SELECT scope, l_linestatus, count(*) AS n, round(avg(l_discount), 6) AS mean FROM x GROUP BY ALL")
def overlapping_scopes(spark, sf):
    scopes = {"all": F.lit(True), "large": F.col("l_quantity") > 25, "returned": F.col("l_returnflag") == "R"}
    return aggregate.by_scopes(table(spark, sf, "lineitem"), scopes, ["l_linestatus"], F.count("*").alias("n"), six(F.avg("l_discount")).alias("mean"))


@register("WITH f AS (SELECT p_brand, l_linestatus, sum((l_discount - 0.05) ** 2) AS sse, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL) SELECT p_brand, round(sqrt(sum(sse) / sum(n)), 6) AS rmse FROM f GROUP BY p_brand")
def pooled_rmse(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    folds = rows.groupBy("p_brand", "l_linestatus").agg(F.sum(F.pow(F.col("l_discount") - 0.05, F.lit(2))).alias("sse"), F.count("*").alias("n"))
    return aggregate.pooled_rmse(folds, ["p_brand"], "sse", "n").withColumn("rmse", six("rmse"))


@register("SELECT l_suppkey, CAST(least(count(*) FILTER (l_returnflag = 'A'), 1) AS INT) AS a, CAST(least(count(*) FILTER (l_returnflag = 'N'), 1) AS INT) AS n, CAST(least(count(*) FILTER (l_returnflag = 'R'), 1) AS INT) AS r, bool_and(l_quantity >= 1) AS all_positive, bool_or(l_quantity > 49) AS any_large FROM lineitem GROUP BY l_suppkey")
def clipped_crosstab(spark, sf):
    have = lambda f: F.least(F.count_if(F.col("l_returnflag") == f), F.lit(1)).cast("int")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(have("A").alias("a"), have("N").alias("n"), have("R").alias("r"), F.bool_and(F.col("l_quantity") >= 1).alias("all_positive"), F.bool_or(F.col("l_quantity") > 49).alias("any_large"))


@register(_METRIC + ", x AS (SELECT lineage, k, round(avg(ndcg) - k * 0.001, 6) AS score FROM metric, (SELECT unnest([1, 2, 3]) AS k) GROUP BY lineage, k) SELECT lineage, arg_min(k, (-score, k)) AS k, max(score) AS score FROM x GROUP BY lineage")
def choose_by_score(spark, sf):
    rows = metric_rows(spark, sf).withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).groupBy("lineage", "k").agg(six(F.avg("ndcg") - F.first("k") * 0.001).alias("score"))
    return metrics.choose_highest(rows, ["lineage"], "k", "score", "k")


@register(_METRIC + " SELECT lineage, round(quantile_cont(spearman, 0.5), 6) AS median, round(quantile_cont(spearman, 0.05), 6) AS q05, round(quantile_cont(spearman, 0.95), 6) AS q95, round(avg(CASE WHEN spearman > 0 THEN 1.0::DOUBLE WHEN spearman IS NOT NULL THEN 0 END), 6) AS positive FROM metric GROUP BY lineage")
def metric_stability(spark, sf):
    return metrics.stability(metric_rows(spark, sf), ["lineage"], "spearman").withColumns({c: six(c) for c in ("median", "q05", "q95", "positive")})


@register(_METRIC + ", r AS (SELECT lineage, rank() OVER (PARTITION BY lineage ORDER BY o) + (count(*) OVER (PARTITION BY lineage, o) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY lineage ORDER BY g) + (count(*) OVER (PARTITION BY lineage, g) - 1) / 2.0::DOUBLE AS y FROM (SELECT lineage, round(overlap, 9) AS o, round(regret, 9) AS g FROM metric)) SELECT lineage, count(*) AS n, round(CASE WHEN var_pop(x) > 0 AND var_pop(y) > 0 THEN corr(x, y) END, 6) AS spearman FROM r GROUP BY lineage")
def metric_association(spark, sf):
    rows = metric_rows(spark, sf).select("lineage", F.round("overlap", 9).alias("o"), F.round("regret", 9).alias("g"))
    return metrics.spearman(rows, ["lineage"], "o", "g").withColumn("spearman", six("spearman"))


_DOTS = "list_sum(list_transform(range({a}, {b}), lambda i: x.embedding[i + 1]::DOUBLE * y.embedding[i + 1]::DOUBLE))"


@register("SELECT x.vec_id AS id_a, y.vec_id AS id_b, round(" + _DOTS.format(a=0, b=16) + " + " + _DOTS.format(a=32, b=64) + ", 5) AS dot FROM embeddings x, embeddings y WHERE x.vec_id % 20 = 0")
def block_sum(spark, sf):
    e = table(spark, sf, "embeddings")
    e = e.select("vec_id", *[F.slice("embedding", a + 1, n).alias(name) for name, a, n in (("first", 0, 16), ("second", 16, 16), ("rest", 32, 32))])
    return linalg.summed_gram(e.filter("vec_id % 20 = 0"), e, "vec_id", ["first", "rest"], digits=5)


_PERM = "z AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY sha256('kernel|' || CAST(vec_id AS VARCHAR)), vec_id) AS b FROM embeddings), p AS (SELECT x.vec_id AS row_id, y.vec_id AS donor FROM z x JOIN z y ON x.label = y.label AND x.a = y.b)"


@register(f"WITH {_PERM} SELECT p.row_id AS id_a, q.row_id AS id_b, round(" + _DOTS.format(a=0, b=64) + ", 5) AS dot FROM p JOIN embeddings x ON x.vec_id = p.donor, p q JOIN embeddings y ON y.vec_id = q.donor WHERE p.row_id % 20 = 0")
def permuted_kernel_all(spark, sf):
    """The kernel as if each row had the vector of a donor of its label: ids divisible by 20 against all rows."""
    e = table(spark, sf, "embeddings")
    donors = resample.block_permutation(e, "label", "vec_id", "kernel").select(F.col("vec_id").alias("row_id"), "donor")
    return linalg.permuted_block(e.filter("vec_id % 20 = 0"), e, donors, "vec_id", "embedding", digits=5)


@register("SELECT s_suppkey, 'n_name=' || n_name AS feature, 1.0::DOUBLE AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN (SELECT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 3 <> 0)")
def one_hot_features(spark, sf):
    s = suppliers(spark, sf).select(F.col("row_id").alias("s_suppkey"), F.col("cluster").alias("n_name"))
    return linalg.one_hot(s, "s_suppkey", "n_name", F.col("s_suppkey") % 3 != 0)


@register("SELECT s_nationkey AS target, round(max(CASE WHEN w <> 0 THEN abs(g - 0.5 * sign(w)) ELSE greatest(abs(g) - 0.5, 0) END), 6) AS violation, count(*) FILTER (w <> 0) AS n_active FROM (SELECT s_nationkey, (s_suppkey % 3 - 1)::DOUBLE AS w, s_acctbal / 10000 AS g FROM supplier) GROUP BY s_nationkey")
def optimality_certificate(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("target"), (F.col("s_suppkey") % 3 - 1).cast("double").alias("weight"), (F.col("s_acctbal") / 10000).alias("slope"))
    return linalg.certificate(s, 0.5).withColumn("violation", six("violation"))


@register("SELECT col_id, target, round(sum(loading * beta), 6) AS weight FROM (SELECT p_partkey % 11 AS col_id, p_size % 4 AS pc, avg(p_retailprice) / 1000 AS loading FROM part GROUP BY ALL) l JOIN (SELECT s_nationkey AS target, s_suppkey % 4 AS pc, avg(s_acctbal) / 1000 AS beta FROM supplier GROUP BY ALL) b ON l.pc = b.pc GROUP BY ALL")
def linear_attribution(spark, sf):
    loadings = table(spark, sf, "part").groupBy((F.col("p_partkey") % 11).alias("col_id"), (F.col("p_size") % 4).alias("pc")).agg((F.avg("p_retailprice") / 1000).alias("loading"))
    betas = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("target"), (F.col("s_suppkey") % 4).alias("pc")).agg((F.avg("s_acctbal") / 1000).alias("beta"))
    return linalg.attribution(loadings, betas).withColumn("weight", six("weight"))


@register()
def bootstrap_refit(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("t", F.sin(F.col("vec_id").cast("double")))
    return linalg.refit_stability(e.withColumn("cluster", F.col("vec_id") % 50), "label", "cluster", "vec_id", "embedding", "t", F.col("label") == 0, 10, "refit")


@register("WITH " + cell_sql() + ", " + cell_sql("l_tax", "tax") + ", m AS (SELECT a.col_id, coalesce(avg_t - avg_c, 0) AS shift FROM (SELECT col_id, avg(value) AS avg_c FROM cell GROUP BY col_id) a LEFT JOIN (SELECT col_id, avg(value) AS avg_t FROM tax GROUP BY col_id) b ON a.col_id = b.col_id), x AS (SELECT cell.row_id, greatest(cell.value + shift, 0) AS m, tax.value AS t FROM cell JOIN m ON cell.col_id = m.col_id JOIN tax ON cell.row_id = tax.row_id AND cell.col_id = tax.col_id) SELECT row_id, count(*) AS n, round(sqrt(avg((m - t) * (m - t))), 6) AS rmse, round(avg(abs(m - t)), 6) AS mae, round(CASE WHEN var_pop(m) > 0 AND var_pop(t) > 0 THEN corr(m, t) END, 5) AS pearson FROM x GROUP BY row_id")
def mapping_errors(spark, sf):
    cells, tax = screen_cells(spark, sf), screen_cells(spark, sf, "l_tax")
    mapped = transfer.shifted(cells, transfer.mean_shift(cells, tax, "col_id", "value"), "col_id", "value")
    return transfer.mapping_errors(mapped, tax, "row_id", "col_id", "value").withColumns({"rmse": six("rmse"), "mae": six("mae"), "pearson": six("pearson", 5)})


@register("WITH w AS (SELECT DISTINCT p_brand || '#' || CAST(p_size AS VARCHAR) AS k FROM part), d AS (SELECT DISTINCT p_brand || '#' || CAST(p_size AS VARCHAR) AS k FROM part WHERE p_partkey % 3 = 0), a AS (SELECT p_brand || '#' || CAST(p_size AS VARCHAR) AS k, count(DISTINCT p_type) AS n, min(p_type) AS t FROM part WHERE p_partkey % 3 = 1 GROUP BY k) SELECT w.k, CASE WHEN d.k IS NOT NULL THEN 'direct' WHEN n = 1 THEN 'alias' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN d.k IS NOT NULL THEN w.k WHEN n = 1 THEN t END AS source FROM w LEFT JOIN d ON w.k = d.k LEFT JOIN a ON w.k = a.k")
def recovery_audit(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("#", "p_brand", F.col("p_size").cast("string")).alias("k"), F.col("p_type").alias("approved"))
    return transfer.recovery_audit(p.select("k").distinct(), p.filter("p_partkey % 3 = 0"), p.filter("p_partkey % 3 = 1"), "k")


@register("SELECT l_suppkey, l_partkey % 50 AS bin, CAST(max(CASE WHEN l_returnflag = 'R' OR l_quantity > 45 THEN 1 ELSE 0 END) AS INT) AS hit FROM lineitem GROUP BY ALL")
def event_union(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("bin"), (F.col("l_returnflag") == "R").cast("int").alias("r"), (F.col("l_quantity") > 45).cast("int").alias("q"))
    return transfer.event_union(rows.withColumnRenamed("r", "hit"), rows.withColumnRenamed("q", "hit"), ["l_suppkey", "bin"])


@register("WITH " + EVENT_SQL + " SELECT label AS donor, feature, CAST(sum(count) AS BIGINT) AS count, string_agg(DISTINCT CAST(cell AS VARCHAR), ';' ORDER BY CAST(cell AS VARCHAR)) AS samples FROM counts GROUP BY ALL")
def donor_roll_up(spark, sf):
    return counts.rolled_up(event_counts(spark, sf).withColumnRenamed("label", "donor"), "cell", "donor", ["feature"], "count")


@register("WITH " + EVENT_SQL + ", d AS (SELECT feature, cell % 20 AS donor, avg(count) AS v FROM counts GROUP BY ALL) SELECT feature, count(*) AS n_donors, round(median(v), 6) AS median, round(min(v), 6) AS least, round(max(v), 6) AS most FROM d GROUP BY feature")
def donor_summary(spark, sf):
    rows = event_counts(spark, sf).withColumn("donor", F.col("cell") % 20)
    return counts.donor_summary(rows, ["feature"], "donor", "count").withColumns({c: six(c) for c in ("median", "least", "most")})


@register("WITH m AS (SELECT source, avg(quality) AS q, avg(toxic) AS t, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source) SELECT source, CASE WHEN q >= 0.8 AND t < 0.2 THEN 'supported' WHEN q < 0.6 THEN 'contradicted' ELSE 'open' END AS verdict, printf('%d of %d', CAST(floor(q * 1000 + 1e-6) AS INT), n) AS basis FROM m")
def claims(spark, sf):
    m = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.count("*").alias("n"))
    rules = [("supported", (F.col("q") >= 0.8) & (F.col("t") < 0.2)), ("contradicted", F.col("q") < 0.6)]
    return m.select("source", evidence.first_match(rules, "open").alias("verdict"), F.format_string("%d of %d", F.floor(F.col("q") * 1000 + 1e-6), "n").alias("basis"))


@register("WITH s AS (SELECT s_suppkey AS row_id, r_name AS lineage FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), h AS (SELECT DISTINCT lineage AS held FROM s) SELECT held, CASE WHEN lineage = held THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(s_acctbal), 4) AS mean FROM s, h JOIN supplier ON true WHERE s_suppkey = row_id GROUP BY ALL")
def replayed_splits(spark, sf):
    frozen = split.group_holdout(suppliers(spark, sf), "row_id", "lineage", "cluster")
    rows = frozen.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_acctbal"), "row_id")
    return rows.groupBy("held", "role").agg(F.count("*").alias("n"), six(F.avg("s_acctbal"), 4).alias("mean"))


@register("WITH r AS (SELECT lineage, cluster, row_id, row_number() OVER (PARTITION BY lineage ORDER BY row_id) AS a, row_number() OVER (PARTITION BY lineage ORDER BY sha256('null|' || CAST(row_id AS VARCHAR)), row_id) AS b FROM (SELECT s_suppkey AS row_id, r_name AS lineage, n_name AS cluster FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)) SELECT x.lineage, x.row_id AS row_id, CAST(1 AS BIGINT) AS size, y.row_id AS donor, x.row_id <> y.row_id AS moved FROM r x JOIN r y ON x.lineage = y.lineage AND x.a = y.b")
def shuffled_control(spark, sf):
    return resample.block_permutation(suppliers(spark, sf), "lineage", "row_id", "null")


@register()
def random_modules(spark, sf):
    nodes = table(spark, sf, "supplier").select(F.format_string("n%02d", "s_nationkey").alias("node")).distinct()
    return graph.random_growth(nation_edges(spark, sf), nodes, "node", 5, 20, "control").select("draw", F.concat_ws(",", "members").alias("members"))


@register(_CELL + ", r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value, col_id) AS rank FROM cell), p AS (SELECT lineage, col_id, row_number() OVER (PARTITION BY lineage ORDER BY count(*) DESC, col_id) AS place FROM r WHERE rank <= 10 GROUP BY lineage, col_id) SELECT col_id, count(DISTINCT lineage) AS n FROM p WHERE place <= 40 GROUP BY col_id HAVING count(DISTINCT lineage) >= 3")
def shared_top_sets(spark, sf):
    top = ranking.top_k(labelled_cells(spark, sf), ["row_id"], "value", "col_id", 10).groupBy("lineage", "col_id").agg((-F.count("*")).alias("v"))
    return ranking.top_k(top, ["lineage"], "v", "col_id", 40).groupBy("col_id").agg(F.count_distinct("lineage").alias("n")).filter("n >= 3")


@register("WITH " + PRED_SQL + ", q AS (SELECT lineage, col_id, count(*) AS n, quantile_cont(truth, 0.1) AS prior, min(truth) AS least FROM pred WHERE truth IS NOT NULL GROUP BY ALL HAVING count(*) >= 2) SELECT lineage, col_id, n, round(prior, 6) AS prior, round(least, 6) AS least FROM q")
def lower_tail_prior(spark, sf):
    rows = held_out_predictions(labelled_cells(spark, sf)).filter("truth IS NOT NULL")
    return rows.groupBy("lineage", "col_id").agg(F.count("*").alias("n"), six(F.percentile("truth", F.lit(0.1))).alias("prior"), six(F.min("truth")).alias("least")).filter("n >= 2")
