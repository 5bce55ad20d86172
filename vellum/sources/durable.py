"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where this application has stored results.
_stored: list[str] = []


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """The session's setting for what runs inside; the caller's value holds again after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, one below the warehouse, or a folder
    of this machine if driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/vellum-scratch"
    if not found:
        found = getattr(scratch_dir, "own", None) or tempfile.mkdtemp(prefix="vellum-")
        scratch_dir.own = found
    return found.rstrip("/")


def store(df: DataFrame, name: str, light: int = 0, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy cuts the lineage: executors lost later only cost their own tasks.
    ``light``: rows are ids and numbers, so one file for so many of the shuffle's
    partitions suffices; each file costs a process and a directory entry. ``by``: a column that
    names the folder of a row, so that a filter on it reads only its own files.
    """
    spark = df.sparkSession
    if light:
        df = df.coalesce(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // light))
    path = f"{scratch_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
    _stored.append(path)
    # nothing reads the shuffle files of this plan once its result is stored
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
    if path in _stored:
        _stored.remove(path)


def discard(df: DataFrame | None) -> None:
    """Delete the files of a stored result that nothing reads any more."""
    if path := getattr(df, "stored_at", None):
        _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all stored results of this application, once nothing reads them any more."""
    for path in list(_stored):
        _delete(spark, path)


@atexit.register
def _leave() -> None:
    """What queries and failures left behind goes with the application."""
    if _stored and (spark := SparkSession.getActiveSession()):
        with contextlib.suppress(Exception):  # the session may be gone already
            release(spark)
