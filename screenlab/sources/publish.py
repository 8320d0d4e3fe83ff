"""All-or-nothing publishing of several tables with a manifest of content digests."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..operators.governance import content_digest


def _system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on any file system that Spark reads."""
    system, make = _system(spark, path)
    return system.exists(make(path))


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the folder that all executors share (``spark.checkpoint.dir``) and read back: one result, however often it is read.

    Only a local session without that folder gets a temporary one.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="screenlab-"))
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def manifest(tables: dict[str, DataFrame]) -> dict[str, dict]:
    """Rows, columns and digest of each table."""
    out = {}
    for name, df in sorted(tables.items()):
        row = content_digest(df, sorted(df.columns)).first()
        out[name] = {"rows": row["n_rows"] if row else 0, "digest": row["digest"] if row else None, "columns": df.columns}
    return out


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str, notes: dict | None = None, dry_run: bool = False) -> dict:
    """Write all tables beside the target, then the manifest of what was written, then rename; an existing target is an error.

    If anything fails, what was written goes. A dry run makes the manifest from the tables and writes nothing.
    """
    if exists(spark, path):
        raise FileExistsError(path)

    def about(found: dict[str, DataFrame]) -> dict:
        return {"tables": manifest(found), "written": datetime.now(timezone.utc).isoformat(), **(notes or {})}

    if dry_run:
        return about(tables)
    system, make = _system(spark, path)
    part = f"{path}.part"
    try:
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{part}/{name}")
        made = about({name: spark.read.parquet(f"{part}/{name}") for name in tables})
        spark.createDataFrame([(json.dumps(made, sort_keys=True),)], "value string").coalesce(1).write.text(f"{part}/manifest")
        if not system.rename(make(part), make(path)):
            raise OSError(f"{part} could not be renamed")
    except BaseException:
        system.delete(make(part), True)
        raise
    return made


def read_published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a publication whose content is what its manifest says."""
    about = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in about["tables"]}
    if {k: v["digest"] for k, v in manifest(tables).items()} != {k: v["digest"] for k, v in about["tables"].items()}:
        raise ValueError(f"{path}: the content is not what the manifest says")
    return tables


def snapshot(spark: SparkSession, path: str, target: str, names: list[str], notes: dict | None = None, dry_run: bool = False) -> dict:
    """A compact copy of some tables of a publication, published in turn: source, digests of what is included and names of what is left out.

    The source is verified first; a name that it lacks is a KeyError, an existing target an error, and nothing is left of a copy that fails.
    """
    tables = read_published(spark, path)
    if missing := sorted(set(names) - set(tables)):
        raise KeyError(f"{path} has no {', '.join(missing)}")
    about = {"source": path, "left_out": sorted(set(tables) - set(names)), **(notes or {})}
    return publish(spark, {n: tables[n] for n in names}, target, about, dry_run)


def unlocked(spark: SparkSession, path: str, tables: dict[str, DataFrame], stated: dict[str, str], allow: bool = False) -> None:
    """The gate before a run that may happen once: it must be allowed, nothing may stand at ``path``, inputs must be those stated.

    ``stated`` has the content digest of every input; the errors are PermissionError, FileExistsError, ValueError.
    """
    if not allow:
        raise PermissionError("the run is locked; allow it expressly")
    if exists(spark, path):
        raise FileExistsError(path)
    found = {name: about["digest"] for name, about in manifest(tables).items()}
    if found != stated:
        raise ValueError(f"inputs are not those stated: {sorted(n for n in found.keys() | stated.keys() if found.get(n) != stated.get(n) or n not in found or n not in stated)}")


def _written(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears at once or not at all; an existing one is an error."""
    system, make = _system(spark, path)
    part = f"{path}.{uuid.uuid4().hex}"
    out = system.create(make(part), False)
    out.write(text.encode())
    out.close()
    # Hadoop file systems differ on renaming onto a file, so look first
    if system.exists(make(path)) or not system.rename(make(part), make(path)):
        system.delete(make(part), False)
        raise FileExistsError(path)


@contextmanager
def locked(spark: SparkSession, path: str, owner: str = "", take_over: str | None = None):
    """Holds ``path`` as an advisory lock; who finds it taken gets FileExistsError at once, which names owner and time.

    The file is created exclusively and holds them. A run that was killed leaves it: a run that states that owner as
    ``take_over`` removes it and takes its place; of two that do so at once one gets it.
    """
    system, make = _system(spark, path)

    def take() -> None:
        out = system.create(make(path), False)
        out.write(bytearray(json.dumps({"owner": owner, "since": datetime.now(timezone.utc).isoformat(timespec="seconds")}).encode()))
        out.close()

    try:
        take()
    except Py4JJavaError as e:
        if not system.exists(make(path)):
            raise
        held = "".join(r["value"] for r in spark.read.text(path).collect())
        if take_over is None or (json.loads(held) if held else {"owner": ""})["owner"] != take_over:
            raise FileExistsError(f"{path}: {held}") from e
        system.delete(make(path), False)
        try:
            take()
        except Py4JJavaError as again:
            raise FileExistsError(path) from again
    try:
        yield
    finally:
        system.delete(make(path), False)


def resumed(spark: SparkSession, path: str, parts: dict[str, Callable[[], DataFrame]], signature: dict, owner: str = "", take_over: str | None = None) -> dict[str, DataFrame]:
    """The parts of a long run, each computed once: what a run before has finished is read.

    ``signature`` says what the results depend on (digests of inputs, versions, settings). A folder of another
    signature is an error, so results never mix. One run at a time works in a folder; the lock of a run that was
    killed is taken over by stating its owner. A part that was being written when a run ended is written anew.
    """
    system, make = _system(spark, path)
    system.mkdirs(make(path))
    text = json.dumps(signature, sort_keys=True)
    with locked(spark, f"{path}/run.lock", owner, take_over):
        if not exists(spark, f"{path}/signature.json"):
            _written(spark, f"{path}/signature.json", text)
        if "".join(r["value"] for r in spark.read.text(f"{path}/signature.json").collect()) != text:
            raise ValueError(f"{path} holds parts of another signature")
        for name, compute in parts.items():
            if not exists(spark, f"{path}/{name}/_SUCCESS"):
                compute().write.mode("overwrite").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in parts}
