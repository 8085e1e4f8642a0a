"""Materialised intermediate tables in the shared scratch folder.

Lineage is cut by writing a Parquet table under the folder named by
``spark.checkpoint.dir`` (shared by driver and executors), never by a local
checkpoint: a lost executor then costs a re-read, not the job.  Only when the
session names no folder at all, as in unit tests, a private one is created.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_root: str | None = None
_written: list[str] = []
_open = threading.local()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors; the session's own setting comes first."""
    global _own_root
    configured = spark.conf.get("spark.checkpoint.dir", "") or ""
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor shares")
    if _own_root is None:
        _own_root = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own_root, ignore_errors=True)
    return f"file://{_own_root}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the stored table."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in (_written, *_scopes()):  # before the write: a cancelled one leaves files too
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    return stored


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.remove(path)


def _scopes() -> list[list[str]]:
    """The scopes that this thread is in, each with its tables."""
    return _open.__dict__.setdefault("scopes", [])


@contextmanager
def scope(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that its thread wrote within it when it ends, but for
    those that were handed to the function it gives: ``keep(materialise(...))``."""
    own: list[str] = []
    kept: set[str] = set()
    _scopes().append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch_path)
        return df

    try:
        yield keep
    finally:
        _scopes().pop()
        for path in own:
            if path in _written and path not in kept:
                _delete(spark, path)


@contextmanager
def undone_on_error(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that its thread wrote within it if it ends by an
    exception, cancellation included."""
    own: list[str] = []
    _scopes().append(own)
    try:
        yield
    except BaseException:
        for path in own:
            if path in _written:
                _delete(spark, path)
        raise
    finally:
        _scopes().pop()


def discard(df: DataFrame) -> None:
    """Delete a stored table that nothing will read again."""
    _delete(df.sparkSession, df._scratch_path)


def release(spark: SparkSession, keep: int = 0) -> None:
    """Delete every table written so far but the last ``keep``; call it only
    when no DataFrame that reads them will be evaluated again."""
    for path in _written[: len(_written) - keep]:
        _delete(spark, path)
