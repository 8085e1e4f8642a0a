"""Single small files in any file system that Spark reaches, and folders of
tables, replaced as a whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.settings import Settings, SettingsError, format_settings, parse_settings

#: Largest report that is read into the driver.
MAX_REPORT = 16 << 20


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def rename(spark: SparkSession, source: str, target: str) -> None:
    fs, where = _at(spark, source)
    if not fs.rename(where, _at(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def replace(spark: SparkSession, path: str, write: Callable[[str], None], check: Callable[[str], object]) -> None:
    """Writes beside ``path``, checks what was written, then puts it in place.
    A failure at any step leaves or restores the former content; ``recover``
    does so after a crash between the two moves."""
    recover(spark, path)
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    try:
        write(new)
        check(new)
        had = exists(spark, path)
        if had:
            rename(spark, path, old)
        try:
            rename(spark, new, path)
        except Exception:
            if had:
                rename(spark, old, path)
            raise
        delete(spark, old)
    except Exception:
        delete(spark, new)
        raise


def recover(spark: SparkSession, path: str) -> None:
    """The former content returns if a replacement stopped between its moves."""
    old = f"{path}.old"
    if exists(spark, old):
        if exists(spark, path):
            delete(spark, old)
        else:
            rename(spark, old, path)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _at(spark, path)
    out = fs.create(where, False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str, limit: int = MAX_REPORT) -> bytes:
    fs, where = _at(spark, path)
    if not fs.exists(where) or fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(path)
    size = fs.getFileStatus(where).getLen()
    if size > limit:
        raise ValueError(f"{path} has {size} bytes, more than {limit}")
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"]) if row else b""


# ------------------------------------------------------------------ settings
def save_settings(spark: SparkSession, path: str, settings: Settings) -> None:
    """Replaces the settings file; one that would not read back is refused and
    the former file stays."""
    text = format_settings(settings)

    def check(written: str) -> None:
        if parse_settings(read_bytes(spark, written).decode()) != settings:
            raise SettingsError("the settings do not read back")

    replace(spark, path, lambda p: write_bytes(spark, p, text.encode()), check)


def load_settings_or_defaults(spark: SparkSession, path: str) -> tuple[Settings, str | None]:
    """The file's settings, or the defaults and what is wrong with the file."""
    try:
        return parse_settings(read_bytes(spark, path).decode()), None
    except (FileNotFoundError, ValueError) as e:
        return Settings(), str(e)


# ------------------------------------------------------------------ reports
def report_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modified, length)`` of the ``.txt`` and ``.huff`` files in and
    below a folder, newest first, then by path.  Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,huff,TXT,HUFF}").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path")


def read_report(spark: SparkSession, root: str, path: str) -> str:
    """The text of a report below ``root``, unpacked if it is an archive.  Paths
    that leave the folder and files above 16 MiB are refused."""
    fs, top = _at(spark, root)
    inside = fs.makeQualified(top).toString().rstrip("/") + "/"
    whole = fs.makeQualified(_at(spark, path)[1]).toString()
    if not whole.startswith(inside) or ".." in whole.split("/"):
        raise ValueError(f"{path} is not below {root}")
    data = read_bytes(spark, path)
    return (K.decompress(data) if path.lower().endswith(".huff") else data).decode()


def compress_report(spark: SparkSession, path: str, target: str | None = None) -> str:
    target = target or f"{path}.huff"
    data = K.compress(read_bytes(spark, path))
    replace(spark, target, lambda p: write_bytes(spark, p, data), lambda p: None)
    return target


def decompress_report(spark: SparkSession, path: str, target: str | None = None) -> str:
    if not path.lower().endswith(".huff"):
        raise ValueError(f"{path} is not an archive")
    target = target or path[: -len(".huff")] + ".decoded.txt"
    data = K.decompress(read_bytes(spark, path))
    replace(spark, target, lambda p: write_bytes(spark, p, data), lambda p: None)
    return target
