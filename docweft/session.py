"""The Spark session and the folder that its executors share."""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "docweft", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; conf overrides with dots for double underscores."""
    builder = SparkSession.builder.appName(name)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a local session (its executors are the driver's own threads) gets a folder of this machine; on
    a cluster that would lose rows, so it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"{spark.conf.get('spark.local.dir', '/tmp')}/docweft-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def _set(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


_made = threading.local()
_folders: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in this application's part of it, which is deleted when the driver's process ends."""
    folder = f"{shared_dir(spark)}/docweft/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_at_end, spark, folder)
    return f"{folder}/{uuid.uuid4().hex}/{name}"


def _at_end(spark: SparkSession, folder: str) -> None:
    try:
        _delete(spark, folder)
    except Exception:  # noqa: BLE001  the JVM may be gone; then the folder stays for whoever clears the shared one
        pass


def discard(df: DataFrame) -> None:
    """Deletes a table of `written` that nothing will read any more; other DataFrames are left alone."""
    if hasattr(df, "_written_at"):
        _delete(df.sparkSession, df._written_at)


#: Spark deletes a query's shuffle files at its end, and not when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str = "step", *by: str) -> DataFrame:
    """Cuts df's lineage by a table in the shared folder, partitioned by columns if any are named: a lost executor costs no step before it.

    What was shuffled for it is deleted, so that of a chain of steps only the current one's shuffles take disk.
    """
    path = new_path(df.sparkSession, name)
    with _set(df.sparkSession, _CLEAN, "true"):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    for paths in getattr(_made, "scopes", ()):
        paths.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """On leaving, deletes the tables that `written` made inside, but those (as `written` returned them) that were appended to the list it gives."""
    scopes = _made.__dict__.setdefault("scopes", [])
    paths: list[str] = []
    keep: list[DataFrame] = []
    scopes.append(paths)
    try:
        yield keep
        for path in paths:
            if path not in [df._written_at for df in keep]:
                _delete(spark, path)
    finally:
        scopes.remove(paths)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
