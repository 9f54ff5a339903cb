"""Session building and the one place that knows where intermediate tables may lie."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "loomwork", **conf: str) -> SparkSession:
    """A session with the engine's defaults; conf keys use __ for the dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once an application, so that nothing needs to be
    installed there. The archive is served by the driver; executors fetch it like any file Spark distributes."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="loomwork-code-"), "loomwork_code.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith((".py", ".npz")):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, else (local mode only) a folder of this process."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = "file://" + tempfile.mkdtemp(prefix="loomwork-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system; a missing path is fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # the session has ended; the folder belongs to whoever set it
        pass


_left: set[str] = set()
_open: list[list[str]] = []


def _drop_left(spark: SparkSession) -> None:
    for path in sorted(_left):
        _drop_quietly(spark, path)
    _left.clear()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, every table that materialize() wrote inside: `with temporary_tables(spark): query(...).write...`.
    Results must be written or collected inside. Scopes may be nested; long sessions keep the shared folder small so."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            _drop_quietly(spark, path)
            _left.discard(path)


def temporary_path(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder for something that goes when tables of materialize() do."""
    path = f"{shared_dir(spark).rstrip('/')}/loomwork-{what}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_drop_left, spark)
    _left.add(path)
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage ends there, and a lost executor costs
    nothing that was finished. The table goes at the end of the temporary_tables() scope around it, through release(), or
    when the process ends."""
    spark = df.sparkSession
    path = temporary_path(spark, "table")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomwork_path = path  # noqa: SLF001
    return out


def release(df: DataFrame) -> None:
    """Deletes a table made by materialize() that nothing reads any more."""
    path = getattr(df, "_loomwork_path", None)
    if path:
        _drop_quietly(df.sparkSession, path)
        _left.discard(path)


def fresh(columns: list[str], base: str) -> str:
    """base, or base with a number, such that it clashes with none of the columns (Spark ignores case)."""
    taken, name, k = {c.lower() for c in columns}, base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name
