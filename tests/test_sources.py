"""Readers that look features up, refuse broken files, and keep the order of the input; locks of killed runs."""

import json

import pytest
from pyspark.sql import functions as F

from screenlab.sources import matrices, publish


def written(tmp_path, name, lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    return str(tmp_path / name)


def test_features_are_looked_up_while_read(spark, tmp_path):
    names = spark.createDataFrame([("ENS1", "A"), ("ENS2", "B"), ("ENS4", "C"), ("ENS1", "A"), (None, "D"), ("ENS5", None)], "source string, feature string")
    lines = ["id\ts1\ts2\ts3", "ENS1\t3\t0\tNA", "ENS2\t1\t\t7", "ENS3\tbroken\t1\t1", "ENS5\tbroken\t1\t1"]
    path = written(tmp_path, "x.tsv", lines)
    read = lambda p=path, **more: {(r["row_id"], r["col_id"]): r["value"] for r in matrices.mapped_features(spark, p, names, "source", "feature", **more).collect()}
    assert read() == {("s1", "A"): 3.0, ("s2", "A"): 0.0, ("s3", "A"): None, ("s1", "B"): 1.0, ("s2", "B"): None, ("s3", "B"): 7.0}
    assert read(unit=lambda v: F.log2(v + 1), columns=["s1"]) == {("s1", "A"): 2.0, ("s1", "B"): 1.0}
    for broken, message in ((["ENS1\t1\t1\t1"], "feature A stands in 2 lines"), (["ENS4\t1\t2"], "line ENS4 has 3 fields"), (["ENS4\t1\tx\t2"], "value x of C and s2")):
        with pytest.raises(Exception, match=message):
            read(written(tmp_path, f"{len(message)}.tsv", lines + broken))
    with pytest.raises(Exception, match="value [37] of [AB] and s[13] is neither 0 nor 1"):
        read(binary=True)
    flags = written(tmp_path, "flags.tsv", ["id\ts1\ts2", "ENS1\t0\t1", "ENS2\t1\tNA"])
    assert read(flags, binary=True)[("s2", "B")] is None
    with pytest.raises(ValueError, match="columns stand twice: s1"):
        read(written(tmp_path, "twice.tsv", ["id\ts1\ts1", "ENS1\t0\t1"]))


def test_many_samples_are_one_expression(spark, tmp_path):
    n = 20_000
    path = written(tmp_path, "wide.tsv", ["\t".join(["id", *[f"s{i}" for i in range(n)]]), "\t".join(["ENS1", *[str(i % 5) for i in range(n)]])])
    names = spark.createDataFrame([("ENS1", "A")], "source string, feature string")
    made = matrices.mapped_features(spark, path, names, "source", "feature")
    assert made.count() == n and made.agg(F.sum("value")).first()[0] == sum(i % 5 for i in range(n))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("s123\\t") < 12  # the header as one literal, not a column for each sample


def test_ties_keep_the_order_of_the_input(spark, tmp_path):
    for k in range(2):
        written(tmp_path, f"{k}.txt", [f"{i % 3},{k}-{i}" for i in range(2000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("1g", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = matrices.ordered_lines(spark, str(tmp_path / "*.txt")).withColumns({"v": F.split("value", ",")[0], "name": F.split("value", ",")[1]})
            found.append((lines.rdd.getNumPartitions(), [r["name"] for r in matrices.stable_places(lines, [], "v").orderBy("place").collect()]))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = [f"{k}-{i}" for v in range(3) for k in range(2) for i in range(2000) if i % 3 == v]
    assert found[0][0] < 4 < 20 < found[1][0] and found[0][1] == found[1][1] == want
    spark.range(5000).select("id", (F.col("id") % 4).alias("v")).repartition(1).write.parquet(str(tmp_path / "t"))
    own = spark.read.parquet(str(tmp_path / "t")).collect()
    rows = matrices.stable_places(matrices.ordered_rows(spark, str(tmp_path / "t")).repartition(7), [], "v").orderBy("place").collect()
    assert [r["id"] for r in rows] == [r["id"] for v in range(4) for r in own if r["v"] == v]


def test_lock_of_a_killed_run_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "run")
    part = lambda: spark.range(3)
    publish.resumed(spark, path, {"one": part}, {"seed": 1}, owner="first")
    (tmp_path / "run" / "run.lock").write_text(json.dumps({"owner": "first", "since": "2020-01-01T00:00:00+00:00"}))
    for take_over in (None, "another"):
        with pytest.raises(FileExistsError, match="first"):
            publish.resumed(spark, path, {"two": part}, {"seed": 1}, owner="second", take_over=take_over)
    assert publish.resumed(spark, path, {"one": part, "two": part}, {"seed": 1}, owner="second", take_over="first")["two"].count() == 3
    assert not (tmp_path / "run" / "run.lock").exists()


def test_snapshot_is_a_verified_part(spark, tmp_path):
    full, small = str(tmp_path / "full"), str(tmp_path / "small")
    made = publish.publish(spark, {"a": spark.range(5), "b": spark.range(3), "c": spark.range(2)}, full)
    assert not publish.exists(spark, small) and publish.snapshot(spark, full, small, ["a"], dry_run=True)["tables"].keys() == {"a"}
    about = publish.snapshot(spark, full, small, ["a", "c"], {"why": "review"})
    assert about["left_out"] == ["b"] and about["source"] == full and about["why"] == "review"
    assert {n: x["digest"] for n, x in about["tables"].items()} == {n: made["tables"][n]["digest"] for n in ("a", "c")}
    assert publish.read_published(spark, small)["a"].count() == 5
    for error, names, where in ((KeyError, ["z"], "x"), (FileExistsError, ["a"], "small")):
        with pytest.raises(error):
            publish.snapshot(spark, full, str(tmp_path / where), names)
    spark.range(9).write.mode("overwrite").parquet(f"{full}/a")
    with pytest.raises(ValueError, match="manifest"):
        publish.snapshot(spark, full, str(tmp_path / "y"), ["a"])


def test_absolute_paths_are_found(spark):
    from screenlab.operators import governance

    rows = [(1, "see /home/me/x.csv, and C:\\data\\y"), (2, "http://a.b/home/x and a/root/b"), (3, None), (4, '{"p": "/root/z"}'), (5, "~/notes /homework/x file:///etc/hosts")]
    found = governance.absolute_paths(spark.createDataFrame(rows, "id int, t string"), ["t"]).collect()
    assert sorted((r["id"], r["path"]) for r in found) == [(1, "/home/me/x.csv"), (1, "C:\\data\\y"), (4, "/root/z"), (5, "file:///etc/hosts"), (5, "~/notes")]


def test_bounds_of_other_groups(spark):
    from screenlab.operators import estimators

    rows = [(0, "a", 0, 1.0), (0, "a", 1, None), (1, "b", 0, 3.0), (1, "b", 1, 5.0), (2, "c", 0, 10.0), (2, "c", 1, 6.0)]
    cells = spark.createDataFrame(rows, "e int, k string, i int, x double")
    bounds = estimators.domain_bounds(cells, "k", "i", "x")
    assert {(r["k"], r["i"]): (r["low"], r["high"], r["n"]) for r in bounds.collect()} == {("a", 0): (3, 10, 2), ("b", 0): (1, 10, 2), ("c", 0): (1, 3, 2), ("a", 1): (5, 6, 2), ("b", 1): (6, 6, 1), ("c", 1): (5, 5, 1)}
    got = {r["e"]: (r["n"], r["missing"], r["outside"], round(r["excess"], 6)) for r in estimators.outside_bounds(cells, bounds, "k", "e", "i", "x").collect()}
    assert got == {0: (2, 0.5, 1.0, round(2 / 7, 6)), 1: (2, 0.0, 0.5, 0.0), 2: (2, 0.0, 1.0, 3.5)}
