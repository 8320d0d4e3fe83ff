"""Text matrices and metadata as long tables. NULL is missing.

Wide files are read as lines and split against their header, so thousands of columns cost no schema.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import number


def header(spark: SparkSession, path: str, separator: str = ",", skip: int = 0) -> list[str]:
    """Column names of a text table, without reading the rest."""
    lines = spark.read.text(path).limit(skip + 1).collect()
    return lines[skip]["value"].split(separator)


def wide(spark: SparkSession, path: str, separator: str = ",", columns: list[str] | None = None, skip: int = 0, row_name: str = "row_id", col_name: str = "col_id", keep: Column | str | None = None) -> DataFrame:
    """Long form of a wide table with ids in the first field: one row for each wanted column and line.

    Repeated column names all come, with ``col_pos`` to tell them apart. Lines that repeat the header go,
    and those whose ``row_name`` does not meet ``keep``, before any cell is made of them.
    """
    names = header(spark, path, separator, skip)
    first = separator.join(names)
    cut = separator if separator != "|" else r"\|"
    fields, titles = F.split("value", cut, -1), F.split(F.lit(first), cut, -1)  # titles are folded to one literal, however many there are
    lines = spark.read.text(path).filter(F.col("value") != first).select(fields.alias("f")).filter(F.size("f") == len(names))
    lines = lines.select(F.get("f", F.lit(0)).alias(row_name), "f")
    if keep is not None:
        lines = lines.filter(keep)
    wanted = F.lit(True) if columns is None else F.col(col_name).isin(list(columns))
    cells = lines.select(row_name, F.posexplode(F.slice("f", 2, len(names))).alias("n", "text")).withColumn("col_pos", F.col("n") + 1)
    cells = cells.withColumn(col_name, F.get(titles, F.col("col_pos"))).filter(wanted)
    return cells.select(row_name, col_name, "col_pos", number(F.col("text")).alias("value"))


def feature_major(spark: SparkSession, path: str, separator: str = "\t", columns: list[str] | None = None, skip: int = 0) -> DataFrame:
    """As ``wide`` with features in lines and samples in columns."""
    return wide(spark, path, separator, columns, skip, "col_id", "row_id")


def mapped_features(spark: SparkSession, path: str, names: DataFrame, source: str, feature: str, unit: Callable[[Column], Column] | None = None, binary: bool = False, separator: str = "\t", columns: list[str] | None = None) -> DataFrame:
    """row_id, col_id, value of a table with features in lines: lines are looked up in ``names`` while they are read, and their unit is changed.

    Lines that ``names`` lacks are left out before any cell is made of them; samples are those of ``columns``, or all. These are
    errors, raised where the cells are read, and name what is wrong: two lines of one feature, a line of another width than the header,
    a value that is neither a number nor missing, and with ``binary`` a value other than 0 and 1. However many samples there are, the plan has one expression for them.
    """
    titles_ = header(spark, path, separator)
    first = separator.join(titles_)
    repeated = sorted({c for c in titles_ if titles_.count(c) > 1}) if len(set(titles_)) < len(titles_) else []
    if repeated:
        raise ValueError(f"columns stand twice: {', '.join(repeated[:5])}")
    cut = separator if separator != "|" else r"\|"
    lines = spark.read.text(path).filter(F.col("value") != first).select(F.split("value", cut, -1).alias("f")).withColumn("__s", F.get("f", F.lit(0)))
    known = names.filter(F.col(source).isNotNull() & F.col(feature).isNotNull()).select(F.col(source).alias("__s"), F.col(feature).alias("col_id")).distinct()
    counts = lines.select("__s").join(known, "__s").groupBy("col_id").agg(F.count("*").alias("__n"))  # a row a feature, without its cells
    met = lines.join(known, "__s").join(counts, "col_id")
    text = lambda *parts: F.raise_error(F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts]))
    sound = F.when(F.col("__n") > 1, text("feature ", F.col("col_id"), " stands in ", F.col("__n"), " lines").cast("array<string>")).when(F.size("f") != len(titles_), text("line ", F.col("__s"), " has ", F.size("f"), " fields").cast("array<string>")).otherwise(F.slice("f", 2, len(titles_)))
    cells = met.select("col_id", F.posexplode(sound).alias("__at", "__t"))
    cells = cells.withColumn("row_id", F.get(F.split(F.lit(first), cut, -1), F.col("__at") + 1))
    if columns is not None:
        cells = cells.filter(F.col("row_id").isin(list(columns)))
    value, missing = number(F.col("__t")), F.trim("__t").isin("", "NA", "NaN", "nan")
    value = F.when(missing | value.isNotNull(), value).otherwise(text("value ", F.col("__t"), " of ", F.col("col_id"), " and ", F.col("row_id")).cast("double"))
    if binary:
        value = F.when(value.isNull() | value.isin(0.0, 1.0), value).otherwise(text("value ", F.col("__t"), " of ", F.col("col_id"), " and ", F.col("row_id"), " is neither 0 nor 1").cast("double"))
    return cells.select("row_id", "col_id", (unit(value) if unit else value).alias("value"))


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and file, block and line: three keys that sort lines as they stand in their files, however the files are cut into partitions."""
    m = F.col("_metadata")
    return spark.read.text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("block"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("line"))


def ordered_rows(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with file and line, which sort rows as they stand in their files."""
    m = F.col("_metadata")
    return spark.read.parquet(path).select("*", m["file_path"].alias("file"), m["row_index"].alias("line"))


def stable_places(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    """``place`` (from 1) by ``order``, ties in the order of the input: of a table from ``ordered_lines`` or ``ordered_rows``."""
    ties = [c for c in ("file", "block", "line") if c in df.columns]
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order, *ties)))


def gct(spark: SparkSession, path: str) -> DataFrame:
    """A GCT file: two lines before the header, a description in the second column, which is left out."""
    names = header(spark, path, "\t", 2)
    return wide(spark, path, "\t", names[2:], 2, "col_id", "row_id").drop("col_pos")


def stacked_headers(spark: SparkSession, path: str, rows: int = 4, separator: str = ",") -> DataFrame:
    """A table with several header lines: feature, model and replicate columns averaged, as log2(x + 1).

    The first header line has ids of the columns, the last the word before the features' names.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(rows).collect()]
    models = lines[0].split(separator)
    fields = F.split("value", separator, -1)
    body = spark.read.text(path).filter(~F.col("value").isin(*lines)).select(fields.alias("f"))
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("row_id"), F.get("f", F.lit(i)).alias("t")) for i, m in enumerate(models) if i]))
    long = body.select(F.get("f", F.lit(0)).alias("col_id"), cells.alias("c")).select("col_id", "c.row_id", number(F.col("c.t")).alias("v"))
    return long.groupBy("row_id", "col_id").agg(F.log2(F.avg("v") + 1).alias("value"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    """A list of edges, two names a line between white space."""
    x = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.size(x) >= 2).select(F.get(x, F.lit(0)).alias("a"), F.get(x, F.lit(1)).alias("b"))


def gene_sets(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """Sets of a GMT file: name and distinct members, those with ``least`` or more."""
    x = F.split("value", "\t")
    members = F.array_distinct(F.filter(F.slice(x, 3, F.size(x)), lambda g: g != ""))
    return spark.read.text(path).filter(F.size(x) > 2).select(F.get(x, F.lit(0)).alias("program"), members.alias("members")).filter(F.size("members") >= least)


def soft_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a SOFT file: sample and a map of its attributes (values of repeated ones joined by ``;``).

    Lines belong to the last sample line before them in their file; a file is one task's work, as its order counts.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    starts = F.sum((F.col("line").startswith("^SAMPLE")).cast("int")).over(Window.partitionBy("file").orderBy("n"))
    rows = raw.withColumn("s", starts).filter("s > 0 AND line LIKE '!Sample_%'")
    pair = F.split(F.substring("line", 9, 1 << 20), r"\s*=\s*", 2)
    names = raw.withColumn("s", starts).filter(F.col("line").startswith("^SAMPLE")).select("file", "s", F.trim(F.get(F.split("line", "=", 2), F.lit(1))).alias("sample"))
    fields = rows.groupBy("file", "s", F.get(pair, F.lit(0)).alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.get(pair, F.lit(1)).alias("v")))), lambda x: x["v"]), ";").alias("v"))
    return names.join(fields.groupBy("file", "s").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("attributes")), ["file", "s"], "left").drop("file", "s")


def dense_counts(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A feature by cell table of counts, zeros left out; anything but whole numbers from 0 is an error."""
    rows = feature_major(spark, path, separator).select(F.col("row_id").alias("cell"), F.col("col_id").alias("feature"), "value")
    bad = F.col("value").isNull() | (F.col("value") < 0) | (F.col("value") != F.floor("value"))
    return rows.withColumn("count", F.when(bad, F.raise_error(F.lit("not a count"))).otherwise(F.col("value").cast("long"))).filter("count > 0").drop("value")


#: Schema of a nested record of a target, as exported by public annotation services.
TARGET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("approvedSymbol", T.StringType()),
        T.StructField("tractability", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("modality", T.StringType()), T.StructField("value", T.BooleanType())]))),
        T.StructField("safetyLiabilities", T.ArrayType(T.StructType([T.StructField("event", T.StringType()), T.StructField("datasource", T.StringType())]))),
    ]
)


def target_records(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """A summary of each JSON record and a row for each of its liabilities."""
    r = lines.select(F.from_json(value, TARGET).alias("r")).select("r.*")
    held = F.filter(F.coalesce("tractability", F.array().cast(TARGET["tractability"].dataType)), lambda t: F.coalesce(t["value"], F.lit(False)))
    summary = r.select("id", "approvedSymbol", F.size(held).alias("n_tractable"), F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda t: t["modality"]))), ";").alias("modalities"), F.greatest(F.size(F.coalesce("safetyLiabilities", F.array().cast(TARGET["safetyLiabilities"].dataType))), F.lit(0)).alias("n_liabilities"))
    return summary, r.select("id", F.explode_outer("safetyLiabilities").alias("l")).select("id", "l.*")


def fixed_precision(x: Column, digits: int = 6) -> Column:
    """A number as text with ``digits`` significant ones."""
    return F.format_string(f"%.{digits}g", x)
