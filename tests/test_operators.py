"""Operators on small tables with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from screenlab.functions import scalars, text
from screenlab.operators import aggregate, counts, evidence, governance, graph, linalg, metrics, ranking, relational, resample, split, transfer
from screenlab.plans import further, relations
from screenlab.sources import matrices, publish
from screenlab.streaming import counts as streaming


def one(spark, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).first()


def test_text(spark):
    r = one(spark, a=text.clean_symbol(F.lit(" tp53|x ")), b=text.strip_suffix(F.lit("abl1 (25)")), c=text.participant(F.lit("T-A-1-01B")), d=text.participant(F.lit("T-A")), e=text.sample_code(F.lit("T-A-1")), f=text.unpack(F.lit("a||b")), g=text.unpack(F.lit(None).cast("string")), h=text.path_safe(F.lit("a/b c")), i=text.same_folded(F.lit(" A"), F.lit("a ")), j=text.name_and_id(F.lit("abc (7)")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h, r.i, tuple(r.j)) == ("TP53", "ABL1", "T-A-1", "T-A", None, ["a", "b"], [], "a%2Fb%20c", True, ("abc", "7"))


def test_scalars(spark):
    n = F.lit(None).cast("double")
    r = one(spark, a=scalars.number(F.lit("NA")), b=scalars.number(F.lit("x1")), c=scalars.number(F.lit("2.5")), d=scalars.floored(n), e=scalars.floored(F.lit(-1.0)), f=scalars.binarised(n), g=scalars.ratio(F.lit(1.0), F.lit(0.0)), h=scalars.observed(F.lit(float("nan"))), i=scalars.overlap(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)), 2))
    assert tuple(r) == (None, None, 2.5, None, 0.0, None, None, None, 0.5)


def test_checked_join(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([(1, 2)], "k int, w int")
    assert relational.checked_join(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        relational.checked_join(b, a, ["k"])
    with pytest.raises(ValueError):
        relational.exactly_one(a)
    assert relational.first_present(a, ["V", "k"]) == "v"


def test_collapse_and_smd(spark):
    df = spark.createDataFrame([("a", -2.0, 1), ("a", 2.0, 2), ("a", 1.0, 3), ("b", None, 1)], "k string, v double, o int")
    assert dict(map(tuple, aggregate.collapsed(df, ["k"], "v", "max_abs", "o").collect()))["a"] == -2.0
    few = aggregate.smd(df, ["k"], "v", F.col("o") == 1).collect()
    assert all(r["smd"] is None for r in few)
    assert {r["k"]: r["worst"] for r in aggregate.leave_one_out_worst(df, ["k"], "v").collect()} == {"a": 1.5}
    assert {r["scope"]: r["n"] for r in aggregate.by_scopes(df, {"all": F.lit(True), "first": F.col("o") == 1}, [], F.count("*").alias("n")).collect()} == {"all": 4, "first": 2}


def test_ranks_and_metrics(spark):
    rows = [("r", f"c{i:02d}", float(i - 6), float(i - 6)) for i in range(12)] + [("s", f"c{i:02d}", 1.0, 2.0) for i in range(12)] + [("t", "c00", -1.0, -1.0)]
    out = {r["row"]: r for r in metrics.ranking_metrics(spark.createDataFrame(rows, "row string, col string, t double, p double"), ["row"], "col", "t", "p").collect()}
    assert set(out) == {"r", "s"} and abs(out["r"]["ndcg"] - 1) < 1e-12 and abs(out["r"]["spearman"] - 1) < 1e-12 and out["r"]["regret"] == 0
    assert out["s"]["ndcg"] is None and out["s"]["spearman"] is None and out["s"]["overlap"] == 1
    tied = spark.createDataFrame([("g", "b", 1.0), ("g", "a", 1.0), ("g", "c", 2.0)], "g string, k string, v double")
    assert [r["k"] for r in ranking.top_k(tied, ["g"], "v", "k", 2).orderBy("rank").collect()] == ["a", "b"]
    edge = ranking.boundary_gap(tied, ["g"], "v", "k", 1, 0.5).first()
    assert (edge["gap"], edge["near"], edge["tied"]) == (0.0, 2, True)


def test_splits(spark):
    df = spark.createDataFrame([(i, f"g{i % 3}", f"c{i % 4}") for i in range(24)], "e int, g string, c string")
    parts = split.group_holdout(df, "e", "g", "c")
    assert split.leaks(parts, df, "e", "c").count() == 0
    sizes = split.hash_split(df, "e", "g", "s").groupBy("g", "split").count().collect()
    assert {(r["g"], r["split"]): r["count"] for r in sizes}[("g0", "train")] == 5
    rows = [(g, c) for g, c, n in (("a", "x", 5), ("b", "x", 1), ("c", "y", 4), ("d", "z", 1)) for _ in range(n)]
    fold = {r["g"]: r["fold"] for r in split.balanced_folds(spark.createDataFrame(rows, "g string, c string"), "g", "c", 2).collect()}
    assert fold["a"] == fold["b"] and fold["c"] == fold["d"] != fold["a"]


def test_linked_folds_equal_a_loop(spark):
    """Chains, groups without a cluster, and more components than are dealt one after the other."""
    import random

    draw = random.Random(4)
    rows = [(i, f"c{i // 2}" if i < 40 else f"c{(i - 41) // 2}" if i < 80 else None) for i in range(90)] + [(draw.randrange(90, 300), draw.choice([None, f"d{draw.randrange(90)}"])) for _ in range(400)] + [(None, "c1")] * 3
    got = {r["g"]: (r["component"], r["fold"]) for r in split.balanced_folds(spark.createDataFrame(rows, "g int, c string"), "g", "c", 4, 30).collect()}
    label = {g: g for g, _ in rows if g is not None}
    while True:
        before = dict(label)
        for c in {c for g, c in rows if c is not None and g is not None}:
            low = min(label[g] for g, d in rows if d == c and g is not None)
            label |= {g: low for g, d in rows if d == c and g is not None}
        if label == before:
            break
    assert {g: c for g, (c, _) in got.items()} == label
    size = {c: sum(label.get(g) == c for g, _ in rows if g is not None) for c in set(label.values())}
    load, want = [0] * 4, {}
    for k, c in enumerate(sorted(size, key=lambda c: (-size[c], c))):
        turn = k % 8
        want[c] = min(range(4), key=lambda f: (load[f], f)) if k < 30 else turn if turn < 4 else 7 - turn
        load[want[c]] += size[c] if k < 30 else 0
    assert {c: f for c, f in got.values()} == want and len(size) > 40


def test_text_keys_and_hot_strata_are_spread(spark):
    """Text keys with a long common beginning are dealt over many ranges, and places are those of a plain sort."""
    from screenlab.operators import ranking

    keys = [f"Customer#{i:09d}" for i in range(3000)] + ["Customer#", "Custömer", "日本"]
    df = spark.createDataFrame([(k, "hot" if i % 10 else "b", i) for i, k in enumerate(keys)], "k string, g string, v int")
    got = {(r["g"], r["k"]): r["__pos"] for r in resample.numbered(df, ["g"], "k").collect()}
    for g in ("hot", "b"):
        own = sorted((k for i, k in enumerate(keys) if ("hot" if i % 10 else "b") == g), key=lambda k: k.encode())
        assert [got[g, k] for k in own] == list(range(len(own)))
    plain = df.filter("v < 3000").withColumn("n", F.substring("k", 10, 9).cast("long"))
    spread = ranking._ranged(resample.numbered(plain, ["g"], "k"), ["g"], "__pos", 64).groupBy("g", "__b").count().collect()
    assert max(r["count"] for r in spread) < 3000 / 20
    donors = resample.block_permutation(df, "g", "k", "s").collect()
    assert len(donors) == len(keys) and {(r["g"], r["donor"]) for r in donors} == {(r["g"], r["k"]) for r in donors}
    drawn = resample.shuffled_values(df, "g", "k", "v", 2, "n").collect()
    assert len(drawn) == 2 * len(keys)
    for d in (0, 1):
        assert sorted(r["v"] for r in drawn if r["draw"] == d and r["g"] == "b") == sorted(i for i in range(len(keys)) if i % 10 == 0)


def test_resampling_is_repeatable(spark):
    df = spark.createDataFrame([(i, float(i), f"s{i % 2}") for i in range(30)], "k int, v double, s string")
    a, b = (resample.bootstrap(df.repartition(n), ["s"], "k", F.avg("v"), 40, "x").orderBy("s").collect() for n in (1, 5))
    assert a == b and a[0]["ci_low"] < a[0]["estimate"] < a[0]["ci_high"]
    moved = resample.block_permutation(df, "s", "k", "p").collect()
    assert sorted(r["k"] for r in moved) == sorted(r["donor"] for r in moved)


def test_solvers():
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=(60, 5)), rng.normal(size=(5, 3))
    y = x @ w + 0.5
    for method in ("kernel_ridge", "component_ridge"):
        got, bias = linalg.SOLVERS[method](x, y)
        assert np.abs(x @ got + bias - y).max() < 0.5
    holes = y.copy()
    holes[:7, 0], holes[:, 1] = np.nan, np.nan
    got, bias = linalg.masked_ridge(x, holes, [1e-6])[1e-6]
    assert np.allclose(got[:, 0], w[:, 0], atol=1e-4) and np.isnan(got[:, 1]).all()
    direct = np.linalg.solve((x[7:] - x[7:].mean(0)).T @ (x[7:] - x[7:].mean(0)) + 1e-6 * np.eye(5), (x[7:] - x[7:].mean(0)).T @ (y[7:, 0] - y[7:, 0].mean()))
    assert np.allclose(got[:, 0], direct)
    low, _ = linalg.reduced_rank(x, y, 1, 1.0)
    assert np.linalg.matrix_rank(low, tol=1e-8) == 1
    _, _, off = linalg.elastic_net(x, y[:, 0], 0.05)
    assert off < 1e-6


def held_out_by_hand(rows, method):
    """Predictions of dense solvers on each fold's rows, features standardised on the training rows."""
    out, groups = {}, np.array([r[1] for r in rows])
    x, y = np.array([r[2] for r in rows]), np.array([[np.nan if v is None else v for v in r[3:]] for r in rows])
    for held in set(groups.tolist()):
        test = groups == held
        sd = x[~test].std(axis=0)
        z = ((x - x[~test].mean(axis=0)) / np.where(sd > 1e-8, sd, 1))[:, sd > 1e-8]
        w, bias = linalg.SOLVERS[method](z[~test], y[~test])
        for i in np.flatnonzero(test):
            out |= {(rows[i][0], t): v for t, v in zip(("t1", "t2", "t3"), z[i] @ w + bias)}
    return out


@pytest.mark.parametrize("method", sorted(linalg.SOLVERS))
def test_folds_are_fitted_from_sums(spark, method):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(90):
        x = [*(rng.normal(size=20) * 3 + 50), 1.0 if i % 4 else 5.0 if i % 8 else 7.0]  # the last has no spread outside group 0
        hole = method == "kernel_ridge" and (i % 5 == 0, i % 3 == 0)
        rows.append((i, i % 4, [float(v) for v in x], None if hole and hole[0] else float(x[0] - x[1]), float(x[2] + rng.normal()), None if hole and hole[1] else float(rng.normal())))
    df = spark.createDataFrame(rows, "k long, g int, v array<double>, t1 double, t2 double, t3 double").repartition(5)
    made = linalg.cross_fitted(df, "k", "g", "v", ["t1", "t2", "t3"], method)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan  # no task gets all rows of a fold
    got, want = {(r["k"], r["target"]): r["prediction"] for r in made.collect()}, held_out_by_hand(rows, method)
    assert got.keys() == want.keys() and max(abs(got[key] - want[key]) for key in want) < 1e-6


def test_refits_are_weighted_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, i % 12, [float(v) for v in rng.normal(size=20)], float(rng.normal())) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, s int, c int, v array<double>, t double").repartition(4)
    made = linalg.refit_stability(df, "s", "c", "k", "v", "t", F.col("s") == 0, 6, "x", 5)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()
    train, want = resample.cluster_bootstrap(df.filter("s <> 0"), "s", "c", 6, "x").collect(), {}
    test = [r for r in rows if r[1] == 0]
    for draw in range(6):
        mine = [r for r in train if r["draw"] == draw]
        w, bias = linalg.component_ridge(np.array([r["v"] for r in mine]), np.array([[r["t"]] for r in mine]), 16, 1.0)
        score = np.round((np.array([r[3] for r in test]) @ w + bias)[:, 0], 9)
        for i in np.lexsort(([r[0] for r in test], score))[:5]:
            want[test[i][0]] = want.get(test[i][0], 0) + 1 / 6
    assert {r["k"]: round(r["frequency"], 9) for r in made.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_kernels_cover_all_strata(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 6)).round(3)
    spark.createDataFrame([(i, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    donor = {r["vec_id"]: r["donor"] for r in resample.block_permutation(e, "label", "vec_id", "kernel").collect()}
    got = {(r["id_a"], r["id_b"]): r["dot"] for r in further.permuted_kernel_all(spark, str(tmp_path)).collect()}
    assert got.keys() == {(a, b) for a in range(0, 700, 20) for b in range(700)}
    assert max(abs(v - vectors[donor[a]] @ vectors[donor[b]]) for (a, b), v in got.items()) < 2e-5
    cells = spark.createDataFrame([(1, "x", 2.0), (1, "y", 3.0), (2, "x", 5.0), (3, "y", 7.0)], "r long, c string, v double")
    assert {tuple(r) for r in linalg.gram_by_features(cells, "r", "c", "v", F.col("r") == 1).collect()} == {(1, 1, 13.0), (1, 2, 10.0), (1, 3, 21.0)}


def test_neighbours_are_cut_inside_blocks(spark):
    rng = np.random.default_rng(9)
    v = rng.integers(-2, 3, size=(90, 3)).astype(float) + [0, 0, 5]  # many ties
    t = [None if i % 11 == 0 else float(i % 7) for i in range(90)]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], t[i]) for i in range(90)], "k long, v array<double>, t double").repartition(3)
    made = linalg.knn_mean(df.filter("k % 9 = 0"), df, "k", "v", "t", 4, block=8)
    assert "MapInArrow" in made._jdf.queryExecution().optimizedPlan().toString()
    cos, want = np.round(v @ v.T / np.outer(*[np.linalg.norm(v, axis=1)] * 2), 9), {}
    for i in range(0, 90, 9):
        near = [t[j] for j in sorted(set(range(90)) - {i}, key=lambda j: (-cos[i, j], j))[:4] if t[j] is not None]
        want[i] = (round(sum(near) / len(near), 9), len(near)) if near else (None, 0)
    assert {r["id_a"]: (r["prediction"] if r["prediction"] is None else round(r["prediction"], 9), r["n"]) for r in made.collect()} == want
    blocks = linalg._blocks(df, 8, F.col("k")).collect()
    assert max(len(r[0]) for r in blocks) <= 8 and sum(len(r[0]) for r in blocks) == 90
    products = {(r["id_a"], r["id_b"]): r["dot"] for r in linalg.gram(df.filter("k % 9 = 0"), df, "k", "v", 8).collect()}
    assert len(products) == 900 and all(products[i, j] == v[i] @ v[j] for i, j in products)


def test_counts(spark):
    df = spark.createDataFrame([("c1", "a", 3, "x"), ("c1", "b", 0, "x"), ("c2", "a", 2, "y"), ("c3", "b", 5, "x")], "cell string, f string, n int, label string")
    sums = counts.group_counts(counts.overlapping(df, F.col("label"), "x"), ["group"], "f", "n")
    assert {(r["group"], r["f"]): (r["count"], r["detected"]) for r in sums.collect()} == {("all", "a"): (5, 2), ("all", "b"): (5, 1), ("x", "a"): (3, 1), ("x", "b"): (5, 1), ("y", "a"): (2, 1), ("non_x", "a"): (2, 1)}
    grid = counts.presence_or_zero(df.select("cell").distinct(), df.select("f").distinct(), spark.createDataFrame([("a",)], "f string"), df.select("cell", "f", "n"), ["cell", "f"], "f", "n")
    assert {(r["cell"], r["f"]): r["n"] for r in grid.collect()}[("c3", "a")] == 0 and {(r["cell"], r["f"]): r["n"] for r in grid.collect()}[("c3", "b")] is None


def test_graph(spark):
    e = graph.canonical_edges(spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "c"), ("b", "c")], "x string, y string"), "x", "y")
    assert {tuple(r) for r in e.collect()} == {("a", "b"), ("b", "c")}
    assert graph.bridges(e, spark.createDataFrame([("a", "c")], "p string, q string"), "p", "q").first()["bridge"] == "b"
    adjacent = graph.neighbours([("a", "b"), ("b", "c"), ("c", "d")])
    assert graph.beam_search(adjacent, lambda s: {"a": 1, "b": -1, "c": 2, "d": 3}[min(s)] + len(s), 3, 4)[0]


def test_modules_follow_the_tables(spark, tmp_path):
    """Edges from sales, and the same modules as the searches on the driver."""
    lines = [(1, 1, "1994-01-03"), (1, 2, "1994-01-30"), (2, 2, "1994-02-01"), (1, 3, "1994-03-01"), (3, 3, "1994-02-09"), (3, 4, "1994-02-10"), (2, 4, "1995-02-10"), (1, 5, "1994-02-10"), (2, 6, "1994-02-20")]
    spark.createDataFrame(lines, "l_partkey long, l_suppkey long, d string").selectExpr("l_partkey", "l_suppkey", "to_timestamp(d) l_shipdate").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    balance = {1: 50.25, 2: 900.0, 3: -20.0, 4: 700.5, 5: 40.0, 6: 300.0, 7: 901.0}
    spark.createDataFrame([(k, k, v) for k, v in balance.items()], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    edges = {("n01", "n02"), ("n02", "n05"), ("n02", "n06"), ("n05", "n06"), ("n03", "n04")}
    assert {tuple(r) for r in relations.nation_edges(spark, str(tmp_path)).collect()} == edges
    adjacent = {f"n{k:02d}": set() for k in balance} | graph.neighbours(sorted(edges))
    for query, width in ((relations.module_greedy, 1), (relations.module_beam, 8)):
        members, value = graph.beam_search(adjacent, lambda s: sum(balance[int(x[1:])] for x in s), 6, width, 100.0)
        got = query(spark, str(tmp_path)).orderBy("position").collect()
        assert [(r["position"], r["node"]) for r in got] == list(enumerate(members, 1)) and {r["worth"] for r in got} == {value}
    want = graph.random_modules(adjacent, 5, 20, "control")
    assert [tuple(r) for r in further.random_modules(spark, str(tmp_path)).orderBy("draw").collect()] == [(i, ",".join(m)) for i, m in enumerate(want)]


def test_evidence_and_governance(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, -1.0)], "k int, v double")
    rules = [("low", F.col("v") < 0), ("high", F.col("v") > 1)]
    assert [r["c"] for r in df.select("k", evidence.first_match(rules, "none").alias("c")).orderBy("k").collect()] == ["none", "high", "low"]
    a, b = (governance.content_digest(df.repartition(n), ["k", "v"]).first() for n in (1, 3))
    assert a == b and governance.content_digest(df.filter("k < 3"), ["k", "v"]).first()["digest"] != a["digest"]
    assert governance.differences(df, df, ["k"], "v").count() == 0


def test_transfer(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", 3.0), ("y", 1.0)], "c string, v double")
    b = spark.createDataFrame([("x", 0.5)], "c string, v double")
    shift = transfer.mean_shift(a, b, "c", "v")
    moved = {(r["c"], r["v"]) for r in transfer.shifted(a, shift, "c", "v").collect()}
    assert moved == {("x", 0.0), ("x", 1.5), ("y", 1.0)}


def test_text_sources(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id,A (1),B,A (1)\nr1,1,NA,3\nr2,x,2,4\n")
    got = {(r["row_id"], r["col_id"], r["col_pos"]): r["value"] for r in matrices.wide(spark, str(tmp_path / "w.csv")).collect()}
    assert got[("r1", "A (1)", 1)] == 1 and got[("r1", "B", 2)] is None and got[("r2", "A (1)", 1)] is None and got[("r2", "A (1)", 3)] == 4
    (tmp_path / "g.gct").write_text("#1.2\n1\t2\nName\tDescription\ts1\ts2\ng1\tone\t1\t2\n")
    assert {(r["col_id"], r["row_id"], r["value"]) for r in matrices.gct(spark, str(tmp_path / "g.gct")).collect()} == {("g1", "s1", 1.0), ("g1", "s2", 2.0)}
    (tmp_path / "s.gmt").write_text("p1\turl\ta\tb\ta\np2\turl\tc\n")
    assert [r["program"] for r in matrices.gene_sets(spark, str(tmp_path / "s.gmt"), 2).collect()] == ["p1"]
    (tmp_path / "m.soft").write_text("^SERIES = x\n!Series_title = t\n^SAMPLE = s1\n!Sample_title = one\n!Sample_ch = a\n!Sample_ch = b\n^SAMPLE = s2\n!Sample_title = two\n")
    assert {r["sample"]: r["attributes"] for r in matrices.soft_samples(spark, str(tmp_path / "m.soft")).collect()} == {"s1": {"title": "one", "ch": "a;b"}, "s2": {"title": "two"}}
    (tmp_path / "c.csv").write_text("gene,c1,c2\ng1,0,2\ng2,3,0\n")
    assert {tuple(r) for r in matrices.dense_counts(spark, str(tmp_path / "c.csv")).select("cell", "feature", "count").collect()} == {("c2", "g1", 2), ("c1", "g2", 3)}
    (tmp_path / "h.csv").write_text("id,m1,m1,m2\nname,n1,n1,n2\nset,d,d,d\ngene,,,\ng1,1,5,0\n")
    assert {(r["row_id"], r["col_id"]): round(r["value"], 6) for r in matrices.stacked_headers(spark, str(tmp_path / "h.csv")).collect()} == {("m1", "g1"): 2.0, ("m2", "g1"): 0.0}
    record = {"id": "t", "approvedSymbol": "S", "tractability": [{"label": "l", "modality": "SM", "value": True}, {"label": "k", "modality": "AB", "value": False}], "safetyLiabilities": [{"event": "e", "datasource": "d"}]}
    summary, liabilities = matrices.target_records(spark.createDataFrame([(json.dumps(record),), (json.dumps({"id": "u"}),)], "value string"))
    assert {r["id"]: (r["n_tractable"], r["modalities"], r["n_liabilities"]) for r in summary.collect()} == {"t": (1, "SM", 1), "u": (0, "", 0)} and liabilities.count() == 2


def test_publish(spark, tmp_path):
    df, path = spark.range(5).toDF("k"), str(tmp_path / "out")
    assert not publish.exists(spark, path) and publish.publish(spark, {"a": df}, path, dry_run=True)["tables"]["a"]["rows"] == 5 and not publish.exists(spark, path)
    publish.publish(spark, {"a": df}, path)
    assert publish.read_published(spark, path)["a"].count() == 5
    with pytest.raises(FileExistsError):
        publish.publish(spark, {"a": df}, path)


def test_stream_equals_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    spark.read.parquet(src).write.parquet(str(tmp_path / "events"))
    stream = streaming.windowed_counts(streaming.read_events(spark, str(tmp_path / "events")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = streaming.windowed_counts(spark.read.parquet(src))
    assert {(r["start"], r["event_type"], r["n"]) for r in spark.table("w").collect()} == {(r["start"], r["event_type"], r["n"]) for r in batch.collect()}


def test_counts_of_hot_groups_equal_windows(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, None).otherwise((F.col("id") % 3 == 2).cast("int")).alias("g"), F.when(F.col("id") % 7 == 0, None).otherwise(F.pmod(F.hash("id"), F.lit(40)) / 4.0).alias("v"))
    made = ranking.average_ranks(rows, ["g"], "v", "rank").select("id", "rank")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, rows.select("id", ranking.average_rank(["g"], "v")).collect()))
    whole = ranking.percentile_ranks(rows, [], "v", "p").select("id", "p")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.select("id", ranking.percentile_rank([], "v")).collect()))
    assert ranking.average_ranks(rows.limit(0), ["g"], "v", "rank").count() == 0
    values = [(r["id"], r["v"]) for r in rows.filter("g IS NULL").collect()]
    there = [v for _, v in values if v is not None]
    for r in aggregate.empirical_percentile(rows.filter("g IS NULL"), ["g"], "id", "v").collect():
        if r["v"] is not None:
            assert abs(r["percentile"] - 100 * sum(v <= r["v"] for v in there) / len(there)) < 1e-9
            assert abs(r["p_upper"] - (1 + sum(v >= r["v"] for v in there)) / (1 + len(there))) < 1e-12


def test_dealing_follows_the_whole_hash(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 10 == 0).cast("int").alias("c"))
    lot = scalars.hash_key(F.lit("s"), F.col("id"))
    order = {}
    for r in rows.select("id", "c", lot.alias("lot")).orderBy("c", "lot", "id").collect():
        order.setdefault(r["c"], []).append(r["id"])
    folds = {r["id"]: r["fold"] for r in split.round_robin(rows, "id", "c", 5, "s").collect()}
    parts = {r["id"]: r["split"] for r in split.hash_split(rows, "id", "c", "s").collect()}
    for ids in order.values():
        assert [folds[i] for i in ids] == [k % 5 for k in range(len(ids))]
        assert [parts[i] for i in ids] == ["train"] * round(0.6 * len(ids)) + ["validation"] * round(0.2 * len(ids)) + ["test"] * (len(ids) - round(0.6 * len(ids)) - round(0.2 * len(ids)))


def test_moments_keep_their_digits(spark):
    rng = np.random.default_rng(3)
    x, g = rng.normal(size=200), np.arange(200) % 4
    y = 2 * x + rng.normal(size=200)
    rows = spark.createDataFrame([(int(i), int(g[i]), 0, float(1e8 + x[i]), float(1e8 + y[i])) for i in range(200)], "id int, g int, c int, x double, y double")
    line = linalg.ridge_line(rows, ["c"], "x", "y", 1.0).first()
    xc, yc = x - x.mean(), y - y.mean()
    assert abs(line["slope"] - xc @ yc / (xc @ xc + 1)) < 1e-5
    assert abs(rows.agg(metrics.pearson(F.col("x"), F.col("y")).alias("r")).first()["r"] - np.corrcoef(x, y)[0, 1]) < 1e-5
    for r in linalg.held_out_scalers(rows, "id", "g", "c", "x").collect():
        rest = x[g != r["held"]]
        assert abs(r["mean"] - 1e8 - rest.mean()) < 1e-5 and abs(r["sd"] - rest.std()) < 1e-5
    for r in linalg.line_errors(rows, ["c"], "g", "x", "y", [1.0, 10.0]).collect():
        sse = 0.0
        for f in range(4):
            a, b = x[g == f], y[g == f]
            slope = (a - a.mean()) @ (b - b.mean()) / ((a - a.mean()) @ (a - a.mean()) + r["alpha"])
            sse += sum((y[g != f] - slope * x[g != f] - (b.mean() - slope * a.mean())) ** 2)
        assert abs(r["sse"] - sse) < 1e-3 * sse


def test_sources_by_file_and_position(spark, tmp_path):
    (tmp_path / "w.csv").write_text("id," + ",".join(f"c{i}" for i in range(5000)) + "\n" + "".join(f"{r}," + ",".join(str(i) for i in range(5000)) + "\n" for r in "ab"))
    cells = matrices.wide(spark, str(tmp_path / "w.csv"), keep="row_id <> 'a'")
    assert cells.count() == 5000 and cells.filter("row_id = 'a' OR col_id <> concat('c', CAST(value AS INT))").count() == 0
    (tmp_path / "soft").mkdir()
    for name in "ab":
        (tmp_path / "soft" / f"{name}.txt").write_text(f"^SAMPLE = {name}1\n!Sample_t = {name}\n^SAMPLE = {name}2\n!Sample_t = {name}{name}\n")
    found = {r["sample"]: r["attributes"] for r in matrices.soft_samples(spark, str(tmp_path / "soft")).collect()}
    assert found == {"a1": {"t": "a"}, "a2": {"t": "aa"}, "b1": {"t": "b"}, "b2": {"t": "bb"}}


def test_macro_average_rolls_up_sums(spark):
    rows = spark.createDataFrame([("l", "x", 1.0), ("l", "x", 2.0), ("l", "y", None), ("m", "y", 6.0), (None, "z", None)], "lineage string, cluster string, v double")
    made = {r["estimand"]: r["v"] for r in aggregate.macro_average(rows, "lineage", "cluster", ["v"]).collect()}
    assert made == {"row_weighted": 3.0, "lineage_equal": 3.75, "cluster_equal": 3.75}


def test_jaccard_without_pairs(spark):
    """The mean over pairs from counts of shared sets, lists of several lengths and empty ones included."""
    import itertools
    import random

    rng = random.Random(7)
    lists = [("a", i, rng.sample("pqrstuvw", rng.randint(0, 6))) for i in range(25)] + [("b", 1, ["x", "y"]), ("b", 2, ["y", "x"]), ("c", 1, ["x"]), ("d", 1, []), ("d", 2, [])]
    got = {r["g"]: (r["n_pairs"], r["jaccard"]) for r in ranking.mean_pairwise_jaccard(spark.createDataFrame(lists, "g string, e int, top array<string>"), "g", "e").collect()}
    assert set(got) == {"a", "b", "d"} and got["b"] == (1, 1.0) and got["d"] == (1, None)
    each = [(set(x), set(y)) for (g, _, x), (h, _, y) in itertools.combinations(lists, 2) if g == h == "a"]
    index = [len(x & y) / len(x | y) for x, y in each if x | y]
    assert got["a"][0] == len(each) and got["a"][1] == pytest.approx(sum(index) / len(index), abs=1e-12)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbered_rows(spark, kind):
    """Row numbers of groups as a sort gives them; columns of like names stay."""
    keys = [(k * 7919 % 503) - 100 for k in range(300)] + [None]
    rows = [(("x", "y")[i % 3 == 0], k, i) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "g string, k long, size int").withColumn("k", F.col("k").cast(kind))
    got = {(r["g"], r["k"]): (r["__pos"], r["__size"], r["size"]) for r in resample.numbered(df, ["g"], "k").collect()}
    assert len(got) == len(rows)
    for g in ("x", "y"):
        mine = [(None if k is None else k if kind == "long" else str(k), i) for h, k, i in rows if h == g]
        mine.sort(key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
        assert [got[g, k] for k, _ in mine] == [(p, len(mine), i) for p, (_, i) in enumerate(mine)]


def _extended(adjacent, state, gene, budget):
    chosen, nodes = state
    if gene in chosen:
        return None
    added = {gene}
    if gene not in nodes and not adjacent.get(gene, set()) & nodes:
        between = {b for n in nodes for b in adjacent.get(n, set()) & adjacent.get(gene, set())}
        if not between:
            return None
        added.add(min(between))
    return (chosen + [gene], nodes | added) if len(nodes | added) <= budget else None


def test_module_extensions(spark):
    """Moves, rewards and the best prefix as plain loops over sets give them."""
    pairs = [("a", "p"), ("p", "b"), ("a", "q"), ("q", "b"), ("b", "c"), ("d", "r"), ("r", "c"), ("e", "f"), ("q", "g")]
    worth = {"a": 5, "b": -2, "c": 9, "d": 4, "e": 7, "f": 1, "g": 3, "lone": 8, "p": 2}
    adjacent = graph.neighbours(pairs)
    edges = graph.canonical_edges(spark.createDataFrame(pairs, "x string, y string"), "x", "y")
    genes = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(sorted(worth.items(), key=lambda x: x[0] in "gp"))], "gene string, v long, place int")
    states = [(0, ["a"], ["a"]), (1, ["a", "b"], ["a", "b", "p"]), (2, ["lone"], ["lone"]), (3, ["c", "d"], ["c", "d", "r"])]
    moves = graph.transitions(spark.createDataFrame(states, "s int, chosen array<string>, nodes array<string>"), edges, genes, "gene", "v", 4, 1)
    want = {(s, "STOP", tuple(n), 0) for s, _, n in states}
    for s, chosen, nodes in states:
        for gene in worth:
            if made := _extended(adjacent, (chosen, set(nodes)), gene, 4):
                want.add((s, gene, tuple(sorted(made[1])), worth[gene] - len(made[1]) + len(nodes)))
    assert {(r["s"], r["action"], tuple(r["reached"]), r["reward"]) for r in moves.collect()} == want
    order = [r["gene"] for r in genes.orderBy("place").collect()]
    for seed, budget, penalty in ((None, 6, 1), ("d", 5, 2), ("lone", 4, 1), ("b", 3, 50)):
        value = lambda s: sum(worth[g] for g in s[0]) - penalty * len(s[1])  # noqa: B023, E731
        state = ([seed or order[0]], {seed or order[0]})
        best = state
        while made := next((m for g in order if (m := _extended(adjacent, state, g, budget))), None):
            state = made
            best = state if value(state) > value(best) else best
        got = [(r["chosen"], set(r["nodes"]), r["worth"]) for r in graph.ranked_prefix(edges, genes, "gene", "v", "place", budget, penalty, seed).collect()]
        assert got == ([(*best, value(best))] if value(best) > 0 else [])


def test_gate_lock_and_resume(spark, tmp_path):
    df, path = spark.createDataFrame([(1, "a")], "k int, v string"), str(tmp_path / "out")
    stated = {n: x["digest"] for n, x in publish.manifest({"t": df}).items()}
    publish.unlocked(spark, path, {"t": df}, stated, allow=True)
    for error, tables, allow in ((PermissionError, {"t": df}, False), (ValueError, {"t": df.withColumn("v", F.lit("b"))}, True), (ValueError, {"t": df, "u": df}, True)):
        with pytest.raises(error):
            publish.unlocked(spark, path, tables, stated, allow)
    ran = []

    def part(n):
        return lambda: ran.append(n) or spark.range(n)

    with pytest.raises(ZeroDivisionError):
        publish.resumed(spark, path, {"one": part(1), "bad": lambda: 1 // 0}, {"seed": 1})
    tables = publish.resumed(spark, path, {"one": part(1), "two": part(2)}, {"seed": 1})
    assert ran == [1, 2] and [tables[n].count() for n in ("one", "two")] == [1, 2]
    with pytest.raises(ValueError):
        publish.resumed(spark, path, {"one": part(1)}, {"seed": 2})
    with pytest.raises(FileExistsError):
        publish.unlocked(spark, path, {"t": df}, stated, allow=True)
    with publish.locked(spark, f"{path}/own.lock"), pytest.raises(FileExistsError), publish.locked(spark, f"{path}/own.lock"):
        pass
    assert not publish.exists(spark, f"{path}/own.lock")
