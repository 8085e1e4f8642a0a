"""Prepared documents: normal form, all tokens, and tokens without stopwords."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.settings import STOPWORDS


def prepare(docs: DataFrame, id_col: str, text_col: str, prefix: str = "", stopwords: Sequence[str] | None = STOPWORDS) -> DataFrame:
    """``(pos, id, content, norm, tokens, words)``; ``pos`` is the numeric id,
    which orders the corpus without a global sort.  A null text is an empty
    one."""
    tokens, text = F.col("tokens"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(
        F.col(id_col).cast("long").alias("pos"),
        F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("id"),
        text.alias("content"),
        X.normalize(text).alias("norm"),
    ).withColumn("tokens", X.tokenize(F.col("norm")))
    out = out.withColumn("words", X.remove_stopwords(tokens, stopwords) if stopwords else tokens)
    out.stopwords = X.normalized_stopwords(stopwords or ())
    return out


def spread(docs: DataFrame) -> DataFrame:
    """Deals a scan too small for one split a core over the cores, as costly
    expressions follow; a larger scan, or one of a file for each core, is left as
    its splits are.  What moves is thereby less than a split for each core."""
    session = docs.sparkSession
    cores, split = session.sparkContext.defaultParallelism, 128 << 20
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * split and len(docs.inputFiles()) < cores else docs


def first_positions(docs: DataFrame, shingles: str, keys: Sequence[str] = ("pos", "id")) -> DataFrame:
    """(keys, shingle, at): the first place of each distinct shingle."""
    return docs.select(*keys, F.posexplode_outer(shingles).alias("at", "shingle")).filter("shingle is not null").groupBy(*keys, "shingle").agg(F.min("at").alias("at"))


def document_list(docs: DataFrame) -> DataFrame:
    """By id, letter case aside; of ids equal but for case, upper case first."""
    return docs.orderBy(F.lower("id"), "id")


def document_by_id(docs: DataFrame, doc_id: str) -> DataFrame:
    return docs.filter(F.col("id") == doc_id)


def invariants(docs: DataFrame, cases: DataFrame) -> DataFrame:
    """``(documents, ids, cases, case_ids, orphans)``: counts whose pairs agree,
    and no case without its submission, in a sound catalogue."""
    known = docs.select(F.col("id").alias("sub_id")).distinct()
    orphans = cases.join(known, "sub_id", "left_anti").agg(F.count("*").alias("orphans"))
    d = docs.agg(F.count("*").alias("documents"), F.count_distinct("id").alias("ids"))
    c = cases.agg(F.count("*").alias("cases"), F.count_distinct("case_id").alias("case_ids"))
    return d.join(c).join(orphans)  # three single rows
