"""What the metrics of held-out rows hold in one task: no window over a column's cells, and two sorts for four ranks."""

from pyspark.sql import functions as F

from screenlab.operators import metrics, ranking
from screenlab.sources.tables import held_out_predictions


def cells(spark):
    return spark.range(600).select((F.col("id") % 30).alias("row_id"), (F.col("id") % 20).cast("string").alias("col_id"), (F.col("id") % 3).cast("string").alias("lineage"), F.lit("c").alias("cluster"), (F.col("id") * 37 % 101).cast("double").alias("value"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_summed_before_they_meet_a_window(spark):
    text = plan(held_out_predictions(cells(spark)))
    assert "windowspecdefinition(col_id" in text and "sum(value" not in "".join(line for line in text.splitlines() if "Window [" in line)


def test_two_sorts_serve_all_ranks(spark):
    rows = cells(spark).withColumn("p", F.col("value") % 7)
    made = metrics.ranking_metrics(rows, ["row_id"], "col_id", "value", "p", 2)
    assert sum("Sort [" in line for line in plan(made).splitlines()) == 2


def test_many_groups_make_few_ranges(spark):
    """Counts of ranges may be broadcast: they follow the rows, not the number of groups; places are those of a plain sort."""
    df = spark.range(40_000).select("id", (F.col("id") % 400).alias("g"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    ranges = lambda made: made.select("g", "__b").distinct().count()
    found = lambda n: ranking._after_ranges(ranking._ranged(df, ["g"], "v", 1024, n), ["g"], F.count("*"))
    assert ranges(found(1 << 14)) == 400 and 1200 <= ranges(found(25)) <= 2000
    for n in (25, 1 << 14):
        got = {r["id"]: r["place"] for r in ranking.placed(df, ["g"], "v", "id", least=n).collect()}
        for g in (0, 7, 399):
            own = sorted(range(g, 40_000, 400), key=lambda i: (i * 7919 % 40_009, i))
            assert [got[i] for i in own] == list(range(1, 101))
