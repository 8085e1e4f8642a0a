"""Names and keys of rows that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.scratch import materialise

#: Classes that ``with_class`` broadcasts; any other has at most that part of the rows.
FOREMOST = 10_000


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of ``df`` has
    it (whatever its case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def type_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def text_of(column: str) -> Column:
    """A text column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: str) -> Column:
    """64-bit hash by which rows of one id but different texts are told apart."""
    return F.xxhash64(text_of(column))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id and text key stand in ``gone``
    (doc_id, text_key); a null id stands in no table."""
    i, k = fresh(docs, "gone_id", "gone_key")
    named = gone.select(F.col("doc_id").alias(i), F.col("text_key").alias(k))
    return docs.join(named, (F.col(id_col) == F.col(i)) & (text_key(text_col) == F.col(k)), "left_anti")


def with_class(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of their class in ``classes``: a row for
    each ``key``, ``members`` of which are its rows in ``rows``.

    The ``FOREMOST`` classes by members reach their rows as a broadcast, so a
    large group of copies does not meet in one task; of all others none has more
    than one row in ``FOREMOST``, and they are joined by the key.  Both tables are
    read twice: stored ones are meant."""
    foremost = classes.filter("members > 1").orderBy(F.desc("members"), key).limit(FOREMOST)
    at_once = rows.join(F.broadcast(foremost.drop("members")), key)
    others = rows.join(F.broadcast(foremost.select(key)), key, "left_anti")
    return at_once.unionByName(others.join(classes.drop("members"), key))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group of ``groups`` (doc_id, text_key, component; a row
    per row of ``docs``): that of the smallest id, of those the smallest text
    key, of equal rows any one.  Rows without an id stay.  Only rows whose id
    and text are repeated are gathered by them."""
    members = materialise(groups.filter("doc_id is not null").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("rows")), "group-members")
    first = materialise(members.groupBy("component").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("first"), F.count("*").alias("members")).select("component", "first.*", "members"), "group-firsts")
    leads = first.select("component", F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "members").filter("members > 1")
    rest = with_class(members, leads, "component").filter("doc_id <> d or text_key <> k")
    kept = without(docs, rest.select("doc_id", "text_key"), id_col, text_col)
    i, k = fresh(docs, "again_id", "again_key")
    again = first.filter("rows > 1").select(F.col("doc_id").alias(i), F.col("text_key").alias(k))
    same = (F.col(id_col) == F.col(i)) & (text_key(text_col) == F.col(k))
    repeated = kept.join(again, same, "left_semi").withColumn(k, text_key(text_col)).dropDuplicates([id_col, k]).drop(k)
    return kept.join(again, same, "left_anti").unionByName(repeated)
