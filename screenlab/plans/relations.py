"""Joins, sets, shapes, identifiers and provenance over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars, text
from ..operators import evidence, governance, graph, ranking, relational
from ..sources.tables import suppliers, table
from .register import Register, six

register = Register()
QUERIES, ORACLE_SQL = register.queries, register.sql


@register("SELECT o_orderkey, o_custkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def checked_join_orders(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return relational.checked_join(o, c, ["o_custkey"], "inner", "many_to_one").select("o_orderkey", "o_custkey", "c_mktsegment", "o_totalprice")


@register("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_line_keys(spark, sf):
    return relational.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("SELECT coalesce(c_custkey, o_custkey) AS custkey, CASE WHEN o_custkey IS NULL THEN 'left_only' WHEN c_custkey IS NULL THEN 'right_only' ELSE 'both' END AS side FROM customer FULL JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def outer_join_coverage(spark, sf):
    return relational.coverage(table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey")), table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey")), ["custkey"])


@register("SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_acctbal < 0 THEN 'debt' END, CASE WHEN s_nationkey % 5 = 0 THEN 'nation' END, CASE WHEN s_suppkey % 7 = 0 THEN 'key' END], lambda x: x IS NOT NULL), ';') AS reasons, NOT (s_acctbal < 0 OR s_nationkey % 5 = 0 OR s_suppkey % 7 = 0) AS included FROM supplier")
def exclusion_reasons(spark, sf):
    rules = {"debt": F.col("s_acctbal") < 0, "nation": F.col("s_nationkey") % 5 == 0, "key": F.col("s_suppkey") % 7 == 0}
    return relational.with_reasons(table(spark, sf, "supplier"), rules).select("s_suppkey", "reasons", "included")


@register("SELECT l_partkey, bool_or(l_returnflag = 'A') AS in_A, bool_or(l_returnflag = 'N') AS in_N, bool_or(l_returnflag = 'R') AS in_R, count(DISTINCT l_returnflag) = 3 AS in_all FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_partkey")
def set_presence_parts(spark, sf):
    lines = table(spark, sf, "lineitem")
    return relational.presence({f: lines.filter(F.col("l_returnflag") == f) for f in "ANR"}, "l_partkey")


@register("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def set_intersection_parts(spark, sf):
    lines = table(spark, sf, "lineitem")
    return relational.intersection([lines.filter(F.col("l_returnflag") == f) for f in "ANR"], "l_partkey")


@register("SELECT l_suppkey, " + ", ".join(f"CAST(sum(CASE WHEN p_size % 6 = {k} THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS size_{k}" for k in range(6)) + " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def wide_pivot_fixed(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", F.concat(F.lit("size_"), (F.col("p_size") % 6).cast("string")).alias("s"), F.col("l_quantity").cast("long").alias("q"))
    return relational.pivoted(rows, ["l_suppkey"], "s", [f"size_{k}" for k in range(6)], F.sum("q"))


@register("WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT w ON l_quantity, l_discount, l_tax INTO NAME measure VALUE value")
def unpivot_measures(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return relational.unpivoted(rows, ["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@register("SELECT p_partkey, split_part(upper(trim(p_name)), ' ', 1) AS head, upper(regexp_replace(trim(p_name || ' (x1)'), '\\s+\\([^)]+\\)$', '')) AS bare, split_part(p_type || '.3', '.', 1) AS unversioned, len(string_split(p_name, ' ')) AS n_tokens, substr(p_brand, 1, 3) AS cut FROM part")
def clean_identifier(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", text.clean_symbol(F.regexp_replace("p_name", " ", "|")).alias("head"), text.strip_suffix(F.concat("p_name", F.lit(" (x1)"))).alias("bare"), text.strip_version(F.concat("p_type", F.lit(".3"))).alias("unversioned"), F.size(F.split("p_name", " ")).cast("long").alias("n_tokens"), F.substring("p_brand", 1, 3).alias("cut"))


@register("WITH b AS (SELECT page_id, 'P-' || CAST(page_id % 9 AS VARCHAR) || '-' || CAST(page_id AS VARCHAR) || CASE WHEN page_id % 2 = 0 THEN '-01A' ELSE '' END AS code FROM pages) SELECT page_id, 'P-' || CAST(page_id % 9 AS VARCHAR) || '-' || CAST(page_id AS VARCHAR) AS participant, CASE WHEN page_id % 2 = 0 THEN '01' END AS sample FROM b")
def barcode_parts(spark, sf):
    i = F.col("page_id").cast("string")
    code = F.concat(F.lit("P-"), (F.col("page_id") % 9).cast("string"), F.lit("-"), i, F.when(F.col("page_id") % 2 == 0, "-01A").otherwise(""))
    return table(spark, sf, "pages").select("page_id", text.participant(code).alias("participant"), text.sample_code(code).alias("sample"))


@register("SELECT l_suppkey, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS brands, count(DISTINCT p_brand) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def packed_list(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    packed = rows.groupBy("l_suppkey").agg(text.pack(F.collect_set("p_brand")).alias("brands"))
    return packed.withColumn("n", F.size(text.unpack(F.col("brands"))).cast("long"))


@register("SELECT split_part(p_name, ' ', 1) AS alias, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) END AS approved, count(DISTINCT p_brand) > 1 AS ambiguous, count(DISTINCT p_brand) AS n_targets FROM part GROUP BY split_part(p_name, ' ', 1)")
def alias_resolution(spark, sf):
    return relational.resolved_aliases(table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("alias"), F.col("p_brand").alias("approved")))


@register("SELECT CAST(json_extract(props, '$.k') AS INT) AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, sf):
    return table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"]).groupBy("k", "event_type").agg(F.count("*").alias("n"))


@register("SELECT o_custkey, o_orderkey, n_excluded FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, o_totalprice) AS r, count(*) OVER (PARTITION BY o_custkey) - 1 AS n_excluded FROM orders) WHERE r = 1")
def first_per_entity(spark, sf):
    return relational.first_per_entity(table(spark, sf, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_totalprice")]).select("o_custkey", "o_orderkey", "n_excluded")


@register("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS flag, greatest(l_discount - 0.05::DOUBLE, 0) AS floored, sign(l_discount - 0.05::DOUBLE) * greatest(abs(l_discount - 0.05::DOUBLE) - l_tax, 0) AS shrunk, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 40 THEN 'middle' ELSE 'high' END AS tier, round(abs(log2(greatest(l_tax, 0.01::DOUBLE) / 2)), 6) AS deviation FROM lineitem")
def scalar_columns(spark, sf):
    d = F.col("l_discount") - 0.05
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.binarised(F.col("l_quantity") - 25).alias("flag"), scalars.floored(d).alias("floored"), scalars.soft_threshold(d, F.col("l_tax")).alias("shrunk"), evidence.first_match([("low", F.col("l_quantity") < 10), ("middle", F.col("l_quantity") < 40)], "high").alias("tier"), six(scalars.copy_deviation(F.col("l_tax"))).alias("deviation"))


@register("SELECT source, count(*) AS n FROM documents WHERE regexp_matches(lower(lang), '^(en|de)$') GROUP BY source HAVING count(*) >= 2")
def predicate_filters(spark, sf):
    return table(spark, sf, "documents").filter(F.lower("lang").rlike("^(en|de)$")).groupBy("source").agg(F.count("*").alias("n")).filter("n >= 2")


def _pairs(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("b"), F.substring(F.sha2(F.col("l_partkey").cast("string"), 256), 1, 2)).alias("b"))


_EDGE = "edge AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS a, 'b' || substr(sha256(CAST(l_partkey AS VARCHAR)), 1, 2) AS b FROM lineitem) WHERE a <> b)"


@register(f"WITH {_EDGE} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY node")
def edge_canonical_degree(spark, sf):
    return graph.degrees(graph.canonical_edges(_pairs(spark, sf), "a", "b"))


@register(f"WITH {_EDGE}, pair AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS a, 's' || CAST(s_suppkey + 1 AS VARCHAR) AS b FROM supplier) SELECT a, b, min(x.src) AS bridge, count(DISTINCT x.src) AS n_bridges FROM pair JOIN edge x ON x.dst = a JOIN edge y ON y.dst = b AND y.src = x.src GROUP BY a, b")
def bridge_nodes(spark, sf):
    s = table(spark, sf, "supplier")
    pairs = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("s"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return graph.bridges(graph.canonical_edges(_pairs(spark, sf), "a", "b"), pairs, "a", "b")


def nation_edges(spark, sf):
    """Nations as nodes, joined if suppliers of both sell a part of the same brand in the same month."""
    lines, part, s = (table(spark, sf, t) for t in ("lineitem", "part", "supplier"))
    sold = lines.join(part, lines["l_partkey"] == part["p_partkey"]).join(s, lines["l_suppkey"] == s["s_suppkey"])
    return graph.shared_key_edges(sold.select(_nation().alias("node"), "p_brand", F.trunc("l_shipdate", "month").alias("month")), "node", ["p_brand", "month"])


def _nation():
    return F.format_string("n%02d", "s_nationkey")


def _module(spark, sf, width: int):
    """A connected set of nations; worth by mean balance, in cents, less 100 a nation."""
    worths = table(spark, sf, "supplier").groupBy(_nation().alias("node")).agg(F.round(F.avg(F.col("s_acctbal").cast("decimal(12,2)")) * 100).cast("long").alias("cents"))
    best = graph.beam_modules(nation_edges(spark, sf), worths, "node", "cents", 6, width, 10_000)
    return best.select(F.posexplode("members").alias("position", "node"), (F.col("worth") / 100).alias("worth")).select((F.col("position") + 1).cast("long").alias("position"), "node", "worth")


@register()
def module_greedy(spark, sf):
    return _module(spark, sf, 1)


@register()
def module_beam(spark, sf):
    return _module(spark, sf, 8)


@register()
def module_ranked(spark, sf):
    """Nations by number of suppliers, the most first, as a fixed priority; the best prefix."""
    own = table(spark, sf, "supplier").groupBy(_nation().alias("node")).agg(F.round(F.avg(F.col("s_acctbal").cast("decimal(12,2)")) * 100).cast("long").alias("cents"), F.count("*").alias("n"))
    own = own.withColumn("place", F.struct(-F.col("n"), "node"))
    best = graph.ranked_prefix(nation_edges(spark, sf), own, "node", "cents", "place", 6, 10_000)
    return best.select(F.posexplode("chosen").alias("position", "node"), F.array_join("nodes", ",").alias("nodes"), "worth").withColumn("position", (F.col("position") + 1).cast("long"))


@register(f"""WITH {_EDGE}, gene AS (SELECT 's' || CAST(s_suppkey AS VARCHAR) AS g, s_suppkey AS k, CAST(CAST(s_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT) AS w FROM supplier)
SELECT a.g AS state, b.g AS action, min(x.src) AS bridge, 3 AS n_reached, b.w - 20000 AS reward FROM gene a JOIN edge x ON x.dst = a.g JOIN edge y ON y.src = x.src JOIN gene b ON b.g = y.dst WHERE a.k % 20 = 0 AND a.k <> b.k GROUP BY ALL
UNION ALL SELECT g, 'STOP', NULL, 1, 0 FROM gene WHERE k % 20 = 0""")
def module_transitions(spark, sf):
    """From every supplier whose key is divisible by 20, all moves to suppliers, which are joined through what both sell."""
    gene = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
    s = table(spark, sf, "supplier").select("s_suppkey", gene.alias("node"), (F.col("s_acctbal").cast("decimal(12,2)") * 100).cast("long").alias("cents"))
    states = s.filter("s_suppkey % 20 = 0").select(F.col("node").alias("state"), F.array("node").alias("chosen"), F.array("node").alias("nodes"))
    moves = graph.transitions(states, graph.canonical_edges(_pairs(spark, sf), "a", "b"), s, "node", "cents", 6, 10_000)
    return moves.select("state", "action", "bridge", F.size("reached").alias("n_reached"), "reward")


@register("SELECT word AS category, min(source) AS source, count(*) AS n_rows FROM (SELECT source, lang || CAST(n_chars % 97 AS VARCHAR) AS word FROM documents) GROUP BY word HAVING count(DISTINCT source) = 1")
def exclusive_category(spark, sf):
    d = table(spark, sf, "documents").select("source", F.concat("lang", (F.col("n_chars") % 97).cast("string")).alias("category"))
    return evidence.exclusive(d, "category", "source")


@register("""WITH x AS (SELECT p_brand, n_name, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL
), y AS (SELECT p_brand, max(v) AS highest, median(v) AS median, arg_min(n_name, (-v, n_name)) AS place, round(max(v) / sum(v)::DOUBLE, 6) AS share, count(*) FILTER (v >= 1) AS n_places FROM x GROUP BY p_brand)
SELECT *, round((rank() OVER (ORDER BY highest) + (count(*) OVER (PARTITION BY highest) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS percentile FROM y""")
def exposure_summary(spark, sf):
    s = suppliers(spark, sf)
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("row_id"))
    x = rows.groupBy("p_brand", F.col("cluster").alias("n_name")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    return evidence.exposure(x, "p_brand", "n_name", "v").withColumns({"share": six("share"), "percentile": six("percentile")})


@register("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN toxic = 1 THEN 'harmful' WHEN quality = 1 AND n_chars >= 1000 THEN 'strong' WHEN quality = 1 THEN 'weak' ELSE 'poor' END AS class FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def evidence_class(spark, sf):
    rows = evidence.assembled(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", [table(spark, sf, "labels")])
    rules = [("unlabelled", F.col("quality").isNull()), ("harmful", F.col("toxic") == 1), ("strong", (F.col("quality") == 1) & (F.col("n_chars") >= 1000)), ("weak", F.col("quality") == 1)]
    return rows.select("doc_id", evidence.first_match(rules, "poor").alias("class"))


@register("SELECT source, count(*) AS n, count(*) FILTER ((n_chars - 1500 < 0) = (quality = 1)) AS n_agree FROM documents JOIN labels USING (doc_id) GROUP BY source")
def orientation_check(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("score", F.col("n_chars") - 1500)
    return evidence.orientation(rows, ["source"], "score", "quality")


@register("SELECT n_name, sha256(string_agg(CAST(s_suppkey AS VARCHAR), chr(10) ORDER BY CAST(s_suppkey AS VARCHAR))) AS digest, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def manifest_digest(spark, sf):
    return governance.id_digest(suppliers(spark, sf).withColumnRenamed("cluster", "n_name"), ["n_name"], "row_id")


@register("""WITH d AS (SELECT s_nationkey, sha256(CAST(s_suppkey AS VARCHAR) || '|' || s_name || '|' || CAST(s_nationkey AS VARCHAR)) AS d FROM supplier
), b AS (SELECT s_nationkey, substr(d, 1, 2) AS b, count(*) AS n, sum(CAST(('0x' || substr(d, 3, 12)) AS BIGINT)) AS s FROM d GROUP BY ALL)
SELECT s_nationkey, CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(b || ':' || CAST(n AS VARCHAR) || ':' || CAST(s AS VARCHAR), ',' ORDER BY b)) AS digest FROM b GROUP BY s_nationkey""")
def content_digests(spark, sf):
    return governance.content_digest(table(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], ["s_nationkey"])


@register("WITH e AS (SELECT DISTINCT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t) SELECT * FROM e EXCEPT SELECT user_id, event_type FROM events WHERE value > 10")
def grid_completeness(spark, sf):
    e = table(spark, sf, "events")
    expected = e.select("user_id").distinct().crossJoin(F.broadcast(e.select("event_type").distinct()))  # few event types
    return governance.missing_keys(expected, e.filter("value > 10"), ["user_id", "event_type"])


@register("SELECT user_id, string_agg(DISTINCT event_type, ';' ORDER BY event_type) AS types, max(ts) AS last FROM events GROUP BY user_id")
def string_members(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(text.pack(F.collect_set("event_type"), ";").alias("types"), F.max("ts").alias("last"))




@register("SELECT p_brand, max(p_retailprice) AS p_retailprice, arg_min(p_type, (-p_retailprice, p_type)) AS p_type FROM part GROUP BY p_brand")
def argmax_type(spark, sf):
    from ..operators.aggregate import argmax

    return argmax(table(spark, sf, "part"), ["p_brand"], "p_type", "p_retailprice")


@register("WITH f AS (SELECT p_brand, count(*) FILTER (p_size > 40) / count(*)::DOUBLE AS frequency FROM part GROUP BY p_brand) SELECT * FROM f ORDER BY frequency DESC, p_brand LIMIT 10")
def top_frequency(spark, sf):
    f = table(spark, sf, "part").groupBy("p_brand").agg((F.count_if(F.col("p_size") > 40) / F.count("*")).alias("frequency"))
    return ranking.top_n(f, "frequency", "p_brand", 10)


@register("WITH f AS (SELECT p_brand || p_type AS k, count(*) FILTER (p_size > 48) AS frequency FROM part GROUP BY k) SELECT * FROM f WHERE frequency > 0 ORDER BY frequency DESC, k LIMIT 100")
def top_positive(spark, sf):
    f = table(spark, sf, "part").groupBy(F.concat("p_brand", "p_type").alias("k")).agg(F.count_if(F.col("p_size") > 48).alias("frequency"))
    return ranking.top_n(f, "frequency", "k", 100, positive=True)
