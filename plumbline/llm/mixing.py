"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of all words; a source stops at
``max_epochs`` times its size and the excess is shared out again by weight.
Sorted by cap / weight, the clamped sources are a prefix, so the fixed point of
that process is one pass of running sums over the (aggregated) sources.

Every document is then repeated ``floor(target / size of its source)`` times,
and once more if its seeded hash lies below its source's cut.  The cut is
placed exactly: a histogram of words by hash bucket finds the bucket in which
the target is reached, and only that bucket's documents (about 1/4096 of a
source) are put in order.  No source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.scratch import materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42
HASH_BITS, BUCKET_BITS = 48, 12
#: The table of sources is broadcast up to this many rows, joined beyond.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Number of runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def seeded_hash(key: Column, text: Column, seed: int) -> Column:
    """48 bits of md5 over the seed, the id as text and the text's md5, so rows
    without an id, or of one id, do not share a bucket unless their texts agree."""
    content = F.md5(F.coalesce(text.cast("string"), F.lit("")))
    whole = F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")), content)
    return F.conv(F.substring(F.md5(whole), 1, HASH_BITS // 4), 16, 10).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``(source, source_size, target)`` of one row per source.  Weights repeat
    along the sources in code point order, null last.  The window runs over
    the aggregated sources, not over documents."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"),
        F.sum("weight").over(after).alias("weights_left"),
    ).withColumn("clamped", F.col("left") * F.col("weight") > F.col("cap") * F.col("weights_left"))
    level = F.min(F.when(~F.col("clamped"), F.struct(F.col("cap") / F.col("weight"), (F.col("left") / F.col("weights_left")).alias("level")))).over(Window.partitionBy())
    s = s.withColumn("level", level["level"])
    return s.select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight"))).alias("target"))


def _marked(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` (row, id, text, source) as (row, id, source, size, h, bucket)."""
    h = seeded_hash(F.col("id"), F.col("text"), seed)
    return docs.select("row", F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), h.alias("h")).withColumn("bucket", F.shiftright("h", HASH_BITS - BUCKET_BITS))


def _cuts(marked: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row per source: size, target, whole repetitions, the bucket in which
    the running words reach what is left of the target, and how much of that
    bucket belongs to it."""
    histogram = marked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    histogram = materialise(histogram, "mix-histogram")
    sources = water_fill(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialise(sources, "mix-sources")
    steps = histogram.select(F.col("source").alias("s"), "bucket", "words", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")).alias("upto"))
    cuts = (
        steps.join(_small(sources), F.col("s").eqNullSafe(F.col("source")))
        .groupBy("source", "source_size", "target", "whole", "goal")
        .agg(F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("below")))).alias("cut"))
        .select(
            F.col("source").alias("cut_source"),
            "source_size",
            "target",
            "whole",
            F.coalesce("cut.bucket", F.lit(1 << BUCKET_BITS)).alias("cut_bucket"),
            (F.col("goal") - F.coalesce("cut.below", F.lit(0))).alias("rest"),
        )
    )
    return materialise(cuts, "mix-cuts")


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def _decided(marked: DataFrame, cuts: DataFrame) -> DataFrame:
    """``marked`` and its source's ``cuts``, with ``repeats``.  Only the
    documents in their source's cut bucket are shuffled."""
    joined = marked.join(_small(cuts), F.col("source").eqNullSafe(F.col("cut_source")))
    clear = joined.filter("bucket <> cut_bucket").withColumn("more", F.col("bucket") < F.col("cut_bucket"))
    in_order = Window.partitionBy("source").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.sum("size").over(in_order) - F.col("size") / 2  # taken while that brings the sum nearer
    edge = joined.filter("bucket = cut_bucket").withColumn("more", middle < F.col("rest"))
    return clear.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("more").cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source, source_size, target, repeats, taken)``, one row
    per row of ``docs``.

    A null text has size 0; null is a source of its own; sources without words
    have target 0.  Repeated rows are documents of their own.  Equal hashes are
    ordered by id.  An empty table gives an empty result; columns of other
    names are not looked at.  A very long text is counted whole.  The same input
    gives the same mix.  The sources
    are ordered in one task: meant for up to some millions of them, a row each.
    """
    given = docs.select(F.col(id_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    marked = materialise(_marked(given, seed), "mix-sizes")
    decided = _decided(marked, _cuts(marked, weights, max_epochs))
    return decided.select(F.col("row").alias("doc_id"), "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them: documents of no repetition are left out,
    the others stand once with their ``mix_repeats`` (a column of that name is
    replaced, all others are kept whatever their names).  Cases are as in
    ``mix``."""
    docs = docs.drop("mix_repeats")
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    marked = _marked(given, seed)
    decided = _decided(marked, _cuts(marked, weights, max_epochs)).filter("repeats > 0")
    return decided.select("row.*", F.col("repeats").alias("mix_repeats"))


#: DuckDB SQL of op8 over the view ``documents``.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
per_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 3 * source_size::DOUBLE AS cap,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per_source),
ran AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM weighed),
clamps AS (SELECT *, left_over * weight > cap * weights_left AS clamped FROM ran),
level AS (SELECT arg_min(left_over / weights_left, cap / weight) AS lv FROM clamps WHERE NOT clamped),
targets AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap ELSE least(cap, lv * weight) END AS target
  FROM clamps LEFT JOIN level ON true),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
goals AS (SELECT *, target - whole * source_size AS goal FROM shares),
ordered AS (
  SELECT s.*, g.source_size, g.target, g.whole, g.goal,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id::VARCHAR NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source, source_size, target,
       (whole + CASE WHEN upto - size / 2 < goal THEN 1 ELSE 0 END)::BIGINT AS repeats,
       (size * (whole + CASE WHEN upto - size / 2 < goal THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
