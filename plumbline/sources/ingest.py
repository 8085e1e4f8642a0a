"""Reading documents, stopwords, reviewers, logs and the catalogue snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.functions.text import NEWLINE
from plumbline.operators.ordering import along
from plumbline.sources import files
from plumbline.settings import Settings, parse_settings

_HEADER = r"(?i)^(ID|TITLE|AUTHOR):[ \t]*([^\r\n]*)"
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("length", T.LongType())])


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content, length)`` of the files of a folder, not of folders in
    it; a single file's path works too.  Empty files, which Spark's readers
    pass over, are taken from the folder's listing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    empty = [(f.getPath().toString(), bytearray(), 0) for f in listed if f.isFile() and f.getLen() == 0]
    full = spark.read.format("binaryFile").load(path).select("path", "content", "length")
    return full.unionByName(spark.createDataFrame(empty, FILES)) if empty else full


def parse(files: DataFrame, doc_type: str, max_bytes: int = Settings.max_file_bytes) -> DataFrame:
    """One row per file: document columns and ``reason`` (null if accepted).

    Accepted are non-empty ``.txt`` files up to ``max_bytes`` in strict UTF-8
    (a byte order mark is dropped) with a letter or digit in their body.  A
    header of ID, TITLE and AUTHOR lines ends at a blank line or the first
    other line; the id defaults to the file's stem, the title to the id.
    """
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.withColumns({"name": name, "ok": F.is_valid_utf8(F.col("content").cast("string"))})
    text = F.regexp_replace(F.when(F.col("ok"), F.decode("content", "UTF-8")).otherwise(""), "^﻿", "")
    rows = rows.withColumn("text", text)
    head = F.regexp_extract("text", r"(?i)^((?:(?:ID|TITLE|AUTHOR):[^\r\n]*(?:\r\n|\r|\n|$))*(?:[ \t]*(?:\r\n|\r|\n))?)", 1)
    has_header = F.col("text").rlike(r"(?i)^(?:ID|TITLE|AUTHOR):")
    rows = rows.withColumn("head", F.when(has_header, head).otherwise(""))
    rows = rows.withColumn("body", F.substring("text", F.length("head") + 1, F.length("text")))
    field = lambda k: F.trim(F.regexp_extract("head", rf"(?im)^{k}:[ \t]*([^\r\n]*)", 1))
    stem = F.regexp_replace(F.col("name"), r"(?i)\.txt$", "")
    doc_id = F.when(field("ID") != "", field("ID")).otherwise(stem)
    reason = (
        F.when(~F.lower("name").endswith(".txt"), "not a .txt file")
        .when(F.col("length") == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
        .when(~F.col("ok"), "not valid UTF-8")
        .when(F.trim("body") == "", "no text")
        .when(~F.col("body").rlike(r"[\p{L}\p{Nd}]"), "no letter or digit")
        .when(~doc_id.rlike(r"^[\p{L}\p{Nd}_-]+$"), "bad id")
    )
    return rows.select(
        "path",
        "name",
        doc_id.alias("doc_id"),
        F.when(field("TITLE") != "", field("TITLE")).otherwise(doc_id).alias("title"),
        field("AUTHOR").alias("author"),
        F.col("body").alias("content"),
        F.lit(doc_type).alias("doc_type"),
        F.regexp_count("head", F.lit(NEWLINE)).alias("line_offset"),
        reason.alias("reason"),
    )


def import_files(parsed: DataFrame, known_ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with ``pos``, errors with ``file`` and ``reason``).  Of equal
    ids the first file by name (letter case aside) wins; ids of ``known_ids``
    (doc_id) are taken."""
    if known_ids is not None:
        parsed = parsed.join(known_ids.select(F.col("doc_id").alias("__k")).distinct(), F.col("doc_id") == F.col("__k"), "left")
        parsed = parsed.withColumn("reason", F.coalesce("reason", F.when(F.col("__k").isNotNull(), "duplicate id"))).drop("__k")
    first = Window.partitionBy("doc_id", F.col("reason").isNull()).orderBy(F.lower("name"), "name", "path")
    ranked = parsed.withColumn("reason", F.coalesce("reason", F.when(F.row_number().over(first) > 1, "duplicate id")))
    good = along(ranked.filter("reason is null"), [F.lower("name").asc(), F.col("name").asc(), F.col("path").asc()], "pos", 0)
    return good.drop("reason", "name"), ranked.filter("reason is not null").select(F.col("path").alias("file"), "doc_id", "reason")


def validate(submissions: DataFrame, references: DataFrame) -> DataFrame:
    """Dry run over two parsed sets: ``(doc_type, valid, invalid)``; ids are
    unique across both."""
    both = submissions.unionByName(references)
    w = Window.partitionBy("doc_id", F.col("reason").isNull()).orderBy(F.col("doc_type").desc(), F.lower("name"), "path")
    bad = F.col("reason").isNotNull() | (F.row_number().over(w) > 1)
    return both.select("doc_type", bad.alias("bad")).groupBy("doc_type").agg(F.count_if(~F.col("bad")).alias("valid"), F.count_if("bad").alias("invalid"))


def quarantine(errors: DataFrame, path: str) -> None:
    """Append the rejected files to a quarantine table."""
    errors.withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def reload_corpus(spark: SparkSession, sources: Sequence[tuple[str, str]], removed: DataFrame | None = None, max_bytes: int = Settings.max_file_bytes) -> tuple[DataFrame, DataFrame]:
    """Reads the registered (folder, type) sources anew, as one import; ids of
    ``removed`` (doc_id) stay away."""
    parsed = reduce(DataFrame.unionByName, [parse(read_directory(spark, path), kind, max_bytes) for path, kind in sources])
    docs, errors = import_files(parsed)
    return (docs if removed is None else remove_documents(docs, removed)), errors


def remove_documents(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).filter("line <> '' and not line like '#%'")


def read_stopwords(spark: SparkSession, path: str) -> list[str]:
    """A word list of a file; it becomes part of plans, so it has to be small."""
    return sorted({r["line"].lower() for r in _lines(spark, path).collect()})


def read_reviewers(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, id, name, capacity)``; malformed lines are skipped and the first
    of equal ids wins."""
    lines = spark.read.text(path).withColumn("pos", F.monotonically_increasing_id())
    parts = F.split("value", ",")
    kept = lines.filter((F.size(parts) == 3) & ~F.trim("value").startswith("#"))
    rows = kept.select("pos", F.trim(F.get(parts, F.lit(0))).alias("id"), F.trim(F.get(parts, F.lit(1))).alias("name"), F.expr("try_cast(trim(split(value, ',')[2]) as int)").alias("capacity"))
    rows = rows.filter("id <> '' and capacity >= 0").withColumn("name", F.when(F.col("name") == "", F.col("id")).otherwise(F.col("name")))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos"))).filter("r = 1").drop("r")


def load_settings(spark: SparkSession, path: str) -> Settings:
    return parse_settings("\n".join(r["value"] for r in spark.read.text(path).collect()))


def log_tail(lines: DataFrame, n: int, level: str = "ALL", line: str = "value", order: str = "at") -> DataFrame:
    """The last n lines; ACTIVITY leaves errors out, ERROR keeps only them."""
    is_error = F.col(line).rlike(r"^\[[^\]]*\] ERROR\b")
    kept = {"ALL": lines, "ERROR": lines.filter(is_error), "ACTIVITY": lines.filter(~is_error)}[level]
    return kept.orderBy(F.col(order).desc()).limit(n)


# ------------------------------------------------------------- catalogue
_ESCAPES = (("\\", "\\\\"), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r"))


def _escape(c: Column) -> Column:
    for raw, shown in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def _unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for raw, shown in _ESCAPES[1:]:
        c = F.replace(c, F.lit(shown), F.lit(raw))
    return F.replace(c, F.lit("\0"), F.lit("\\"))


def snapshot_lines(catalogue: DataFrame) -> DataFrame:
    """``(line)`` of the versioned snapshot of (doc_id, doc_type, path): magic,
    version, count, then records by id."""
    lines = F.array(F.lit("APDS_DOCUMENT_INDEX"), F.lit("VERSION\t1"), F.concat(F.lit("COUNT\t"), F.col("n").cast("string")))
    head = catalogue.agg(F.count("*").alias("n")).select(F.posexplode(lines).alias("k", "line")).select("k", F.lit("").alias("id"), "line")
    rows = catalogue.select(F.lit(3).alias("k"), F.col("doc_id").alias("id"), F.concat_ws("\t", F.lit("RECORD"), _escape(F.col("doc_id")), "doc_type", _escape(F.col("path"))).alias("line"))
    return head.unionByName(rows).orderBy("k", "id").select("line")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, doc_type, path)``; a snapshot that is not whole is refused."""
    lines = spark.read.text(path)
    parts = F.split("value", "\t")
    records = lines.filter(F.col("value").startswith("RECORD\t") & (F.size(parts) == 4)).select(_unescape(F.get(parts, F.lit(1))).alias("doc_id"), F.get(parts, F.lit(2)).alias("doc_type"), _unescape(F.get(parts, F.lit(3))).alias("path"))
    seen = lines.agg(
        F.count_if(F.col("value") == "APDS_DOCUMENT_INDEX").alias("magic"), F.count_if(F.col("value") == "VERSION\t1").alias("version"), F.max(F.expr("try_cast(regexp_extract(value, '^COUNT\\t(\\\\d+)$', 1) as long)")).alias("n"), F.count("*").alias("lines")
    ).first()
    kept = records.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if seen["magic"] != 1 or seen["version"] != 1 or seen["n"] != kept["n"] or kept["ids"] != kept["n"] or seen["lines"] != kept["n"] + 3:
        raise ValueError("the catalogue snapshot is malformed")
    return records


def recover_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records ``(doc_id, doc_type, path)``, faults ``(line, reason)``) of a
    snapshot that need not be whole.

    A line that is no record, or a record without four fields, an id or a type,
    is a fault alone and the rest stays.  Of records of one id that of the
    smallest type and path stays, the others are faults.  So is a count that is
    not that of the lines that look like records.  Only a file without the first
    line and the version of a snapshot is refused."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    marks = lines.agg(F.count_if(F.col("line") == "APDS_DOCUMENT_INDEX").alias("magic"), F.count_if(F.col("line") == "VERSION\t1").alias("version"), F.count_if(F.col("line").startswith("RECORD\t")).alias("n")).first()
    if not marks["magic"] or not marks["version"]:
        raise ValueError("this is no catalogue snapshot")
    body = lines.filter(~F.col("line").isin("APDS_DOCUMENT_INDEX", "VERSION\t1") & (F.col("line") != f"COUNT\t{marks['n']}"))
    parts = F.split("line", "\t", -1)
    at = lambda i: _unescape(F.get(parts, F.lit(i)))
    reason = (
        F.when(F.col("line").startswith("COUNT\t"), "another count")
        .when(~F.col("line").startswith("RECORD\t"), "not a record")
        .when(F.size(parts) != 4, "wrong number of fields")
        .when(F.trim(at(1)) == "", "no id")
        .when(F.trim(at(2)) == "", "no type")
    )
    read = body.select("line", reason.alias("reason"), at(1).alias("doc_id"), at(2).alias("doc_type"), at(3).alias("path"))
    of_id = Window.partitionBy("doc_id").orderBy("doc_type", "path")
    placed = read.filter("reason is null").withColumn("place", F.row_number().over(of_id))
    again = placed.filter("place > 1").select("line", F.lit("repeated id").alias("reason"))
    return placed.filter("place = 1").select("doc_id", "doc_type", "path"), read.filter("reason is not null").select("line", "reason").unionByName(again)


def recover_catalogue(spark: SparkSession, path: str, quarantine_path: str) -> DataFrame:
    """Puts the stored snapshot in order: its faults are appended to the
    quarantine table first, then what could be read replaces it.  Gives the
    catalogue; one that is whole is left as it is."""
    files.recover(spark, path)
    try:
        return open_catalogue(spark, path)
    except ValueError:
        records, faults = recover_snapshot(spark, path)
    quarantine(faults.withColumn("file", F.lit(path)), quarantine_path)
    save_catalogue(spark, path, records)
    return read_snapshot(spark, path)


def catalogue_differences(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Ids that stand in one of two catalogues only, or with another type."""
    a, b = stored.select("doc_id", F.col("doc_type").alias("stored_type")), loaded.select("doc_id", F.col("doc_type").alias("loaded_type"))
    return a.join(b, "doc_id", "full").filter(~F.col("stored_type").eqNullSafe(F.col("loaded_type")))


def save_catalogue(spark: SparkSession, path: str, catalogue: DataFrame) -> None:
    """Replaces the snapshot; one that would not read back whole is dropped and
    the former one stays."""
    files.replace(spark, path, lambda p: snapshot_lines(catalogue).write.text(p), lambda p: read_snapshot(spark, p))


def open_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalogue, empty if there is none yet; a replacement that a
    crash stopped is undone first."""
    files.recover(spark, path)
    return read_snapshot(spark, path) if files.exists(spark, path) else spark.createDataFrame([], "doc_id string, doc_type string, path string")


def put_records(spark: SparkSession, path: str, records: DataFrame) -> None:
    """Adds records (doc_id, doc_type, path); one of a known id replaces it."""
    records = records.select("doc_id", "doc_type", "path")
    save_catalogue(spark, path, remove_documents(open_catalogue(spark, path), records).unionByName(records))


def remove_records(spark: SparkSession, path: str, ids: DataFrame) -> None:
    save_catalogue(spark, path, remove_documents(open_catalogue(spark, path), ids))


def clear_catalogue(spark: SparkSession, path: str) -> None:
    save_catalogue(spark, path, open_catalogue(spark, path).limit(0))


def missing_files(catalogue: DataFrame, listing: DataFrame) -> DataFrame:
    """Records whose file stands in no listing (path)."""
    return catalogue.join(listing.select("path").distinct(), "path", "left_anti")
