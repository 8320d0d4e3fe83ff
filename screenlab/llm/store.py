"""Reading the driver tables, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none (local tests), a temporary folder is made and set once.
    A session on a cluster must name the folder itself; a machine-local one is refused there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="screenlab-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the folder of a table made by ``staged`` that nothing reads any more; other tables are left alone."""
    path, spark = getattr(df, "staged_at", None), df.sparkSession
    if path and path.startswith(shared_dir(spark)):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def kept(keep: list[str], made: list[str]) -> list[str]:
    """Columns to carry along: each once, without those whose name a result column has."""
    return [c for c in dict.fromkeys(keep) if c not in set(made)]


def numbered(df: DataFrame) -> DataFrame:
    """The columns as ``__c0``, ``__c1`` ..., which clash with nothing."""
    return df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
