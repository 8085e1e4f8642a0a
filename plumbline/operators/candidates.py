"""Candidate pairs: inverted-index Jaccard, MinHash, and a prefix-filtered
self-join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import text as X
from plumbline.functions.udfs import minhash_signatures, overlaps, shingle_rows, shingle_sets
from plumbline.scratch import materialise

#: Hashes of the references' shingles that go to all tasks; more are joined.
SENT = 1 << 17
#: Documents of a block whose pairs are counted together.
BLOCK = 256


def sharing(subs: DataFrame, refs: DataFrame, width: int) -> DataFrame:
    """``(pos, id, short)``, stored: the ``pos`` of each of ``subs`` that may share a
    word shingle with one of ``refs``, by the shingles' hashes, and a row of each that
    has none (``short``), with its id.  Equal shingles have equal hashes, so what is
    not named here shares no shingle and no slot of a signature."""
    theirs = materialise(shingle_rows(refs, width).select("h").filter("h is not null").distinct(), "sharing-hashes")
    few = [r["h"] for r in theirs.limit(SENT + 1).collect()]
    # One pass over the texts finds both; up to ``SENT`` hashes are sent to it, more are joined.
    if len(few) <= SENT:
        found = shingle_rows(subs, width, few)
    else:
        found = shingle_rows(subs, width).join(theirs.withColumn("met", F.lit(True)), "h", "left").filter("met or h is null")
    found = materialise(found.select("pos", "id", F.col("h").isNull().alias("short")), "sharing-rows")
    return materialise(found.filter("not short").distinct().unionByName(found.filter("short")), "sharing")


def of_positions(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``docs`` whose ``pos`` is among those of ``wanted``, null included.  Where
    the frame says how (``narrowed``), the others are not prepared at all."""
    if hasattr(docs, "narrowed"):
        return docs.narrowed(wanted)
    there = wanted.select(F.col("pos").alias("__pos")).distinct()
    return docs.join(there, F.col("pos").eqNullSafe(F.col("__pos")), "left_semi")


def jaccard_pairs(subs: DataFrame, refs: DataFrame, width: int = 4) -> DataFrame:
    """``(sub_pos, sub_id, ref_pos, ref_id, both, jaccard)`` of every pair that
    shares a word shingle.  Shingles are distinct within a document before the
    join, so a repeated one is no hot key; only submissions that share one by its
    hash are taken apart into them."""
    return pairs_of_sharing(of_positions(subs, sharing(subs, refs, width).filter("not short")), refs, width)


def pairs_of_sharing(subs: DataFrame, refs: DataFrame, width: int = 4) -> DataFrame:
    """``jaccard_pairs`` of submissions of which each may share a shingle."""

    def index(docs: DataFrame, side: str) -> DataFrame:
        sets = docs.select("pos", "id", F.array_distinct(X.word_shingles(F.col("words"), width)).alias("s"))
        return sets.select(F.col("pos").alias(f"{side}_pos"), F.col("id").alias(f"{side}_id"), F.size("s").alias(f"{side}_n"), F.explode_outer("s").alias("shingle")).filter("shingle is not null")

    joined = index(subs, "sub").join(index(refs, "ref"), "shingle")
    pairs = joined.groupBy("sub_pos", "sub_id", "ref_pos", "ref_id", "sub_n", "ref_n").agg(F.count("*").alias("both"))
    return pairs.select("sub_pos", "sub_id", "ref_pos", "ref_id", "both", (F.col("both") / (F.col("sub_n") + F.col("ref_n") - F.col("both"))).alias("jaccard"))


def needed_matches(threshold: float, size: int = 128) -> int:
    """Smallest k with k / size >= threshold in double arithmetic."""
    return next(k for k in range(size + 1) if k / size >= threshold)


def signatures(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(pos, id, n, sig)``."""
    return minhash_signatures(docs, width)


def minhash_candidates(subs: DataFrame, refs: DataFrame, threshold: float, width: int = 4) -> DataFrame:
    """``(sub_pos, sub_id, ref_pos, ref_id, estimate)`` of the pairs whose
    signatures agree in enough slots, and of all pairs with a side that has no
    shingles (estimate null).  The theta-join on the estimate is an equi-join
    on (slot, value): a pair's estimate is the number of its joined rows."""
    need = needed_matches(threshold)
    keys = ("sub_pos", "sub_id", "ref_pos", "ref_id")
    side = lambda df, name: df.withColumnsRenamed({"pos": f"{name}_pos", "id": f"{name}_id"})
    if need == 0:
        pairs = side(subs.select("pos", "id"), "sub").crossJoin(side(refs.select("pos", "id"), "ref"))  # ungated: all pairs are asked for
        return pairs.select(*keys, F.lit(None).cast("double").alias("estimate"))
    met = sharing(subs, refs, width)
    b = side(materialise(signatures(refs, width), "signatures"), "ref")
    a = side(materialise(signatures(of_positions(subs, met.filter("not short")), width), "signatures"), "sub")
    slots = lambda df: df.filter("n > 0").drop("n").select(*[c for c in df.columns if c not in ("n", "sig")], F.posexplode("sig").alias("slot", "value"))
    agreed = slots(a).join(slots(b), ["slot", "value"]).groupBy(*keys).agg(F.count("*").alias("k")).filter(F.col("k") >= need)
    gated = agreed.select(*keys, (F.col("k") / 128.0).alias("estimate"))
    short = side(met.filter("short").select("pos", "id"), "sub")
    ref_ids, short_refs = (b.filter(x).select("ref_pos", "ref_id") for x in ("true", "n = 0"))
    forced = short.crossJoin(ref_ids)
    if not short_refs.isEmpty():
        shingled = subs.select("pos", "id", F.size("words").alias("n")).filter(F.col("n") >= width).drop("n")
        forced = forced.unionByName(side(shingled, "sub").crossJoin(short_refs))
    return gated.unionByName(forced.select(*keys, F.lit(None).cast("double").alias("estimate")))


def shingle_classes(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(pos, representative, s)``: documents with equal non-empty sets
    of shingle hashes are one class, named by its smallest document; ``s`` is
    the sorted set, with the representative only."""
    keyed = materialise(shingle_sets(docs, width).filter("size(s) > 0"), "shingle-sets")
    # Only the digests are moved to name the classes; the sets stay where they are.
    least = keyed.groupBy("key").agg(F.min("pos").alias("representative"), F.count("*").alias("n")).filter("n > 1")
    named = materialise(keyed.select("pos", "key").join(least, "key").select("pos", "key", "representative"), "shingle-classes")
    copies = named.filter("pos <> representative")
    heads = keyed.filter("pos is not null").join(copies.select("pos", "key"), ["pos", "key"], "left_anti").select("pos", F.col("pos").alias("representative"), "s")
    unnamed = keyed.filter("pos is null").join(least, "key", "left").select("pos", "representative")
    rest = copies.select("pos", "representative").unionByName(unnamed)
    return heads.unionByName(rest.withColumn("s", F.lit(None).cast(keyed.schema["s"].dataType)))


def similar_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """``(a, b, jaccard)``, a < b, of all pairs of representatives of ``classes``
    (``shingle_classes``) with Jaccard >= threshold > 0.

    Exact prefix filtering: a pair that reaches the threshold shares one of the
    rarest ``n - ceil(t n) + 1`` shingles of either side, so only those are
    joined, and frequent shingles hardly ever.  A shared shingle counts only if
    enough of both sets follows it to reach the threshold.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0 and up to 1")
    heads = classes.filter("s is not null").select("pos", F.size("s").alias("n"), F.explode("s").alias("h"))
    # A shingle of one document joins nothing: the others alone go on, rarest first.
    common = heads.withColumn("df", F.count("*").over(Window.partitionBy("h"))).filter("df > 1")
    listed = common.groupBy("pos", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("c"))
    listed = materialise(listed.select("pos", "n", F.transform("c", lambda x: x["h"]).alias("c")), "shingle-common")
    alone = F.col("n") - F.size("c")
    first = F.slice("c", F.lit(1), F.greatest(F.lit(0), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - alone).cast("int")))
    # Two texts whose shingles before this one are the same met at that one already.
    placed = listed.select("pos", "n", "c", alone.alias("alone"), F.posexplode(first).alias("i", "h"))
    prefix = placed.select("pos", "n", "h", (F.col("alone") + F.col("i") + 1).alias("place"), F.when(F.col("i") > 0, F.get("c", F.col("i") - 1)).alias("before"))
    p, q = prefix.alias("p"), prefix.alias("q")
    near = F.col("p.n") * 1.0 >= threshold * F.col("q.n") - 1e-9
    also = F.col("q.n") * 1.0 >= threshold * F.col("p.n") - 1e-9
    # A pair's first shared shingle meets this; one of its rows is enough.
    follows = F.least(F.col("p.n") - F.col("p.place"), F.col("q.n") - F.col("q.place")) + 1 >= F.ceil((F.col("p.n") + F.col("q.n")) * (threshold / (1 + threshold)) - 1e-9)
    anew = F.coalesce(F.col("p.before") != F.col("q.before"), F.lit(True))
    pairs = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.pos") < F.col("q.pos")) & near & also & follows & anew).select(F.col("p.pos").alias("a"), F.col("q.pos").alias("b")).distinct()
    counted = overlaps(in_cells(materialise(pairs, "shingle-pairs"), listed))  # what two share is common
    jaccard = F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))
    return counted.select("a", "b", jaccard.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def in_cells(pairs: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(cell, a, b, n, c)``, the rows of a cell together, its sets first (a, n, c):
    ``pairs`` (a, b), a < b, with the ``sets`` (pos, n, c) that they name.

    A set moves once for a cell, not once for a pair.  Documents with the same
    least neighbour are dealt into blocks of some ``block``, and two blocks are a
    cell: of the pairs of a large group, ``block`` times as many share a set."""
    ends = pairs.select(F.col("b").alias("pos"), "a").unionByName(pairs.select(F.col("a").alias("pos"), "a"))
    least = materialise(ends.groupBy("pos").agg(F.min("a").alias("least")), "shingle-homes")
    size = least.groupBy("least").agg((F.floor(F.count("*") / block) + 1).alias("blocks"))
    # Blocks and cells go by hashes: two of one hash are merely dealt together.
    home = least.join(size, "least").select("pos", F.xxhash64("least", F.pmod(F.xxhash64("pos"), F.col("blocks"))).alias("block"))
    side = lambda x: home.select(F.col("pos").alias(x), F.col("block").alias(f"{x}_block"))
    both = F.col("a_block"), F.col("b_block")
    celled = pairs.join(side("a"), "a").join(side("b"), "b").select(F.xxhash64(F.least(*both), F.greatest(*both)).alias("cell"), "a", "b")
    celled = materialise(celled.repartition("cell"), "shingle-cells")
    named = celled.select("cell", F.col("a").alias("pos")).unionByName(celled.select("cell", F.col("b").alias("pos"))).distinct()
    given = named.join(sets, "pos").select("cell", F.col("pos").alias("a"), F.lit(None).cast("long").alias("b"), "n", "c")
    rows = given.unionByName(celled, allowMissingColumns=True)
    return rows.repartition("cell").sortWithinPartitions("cell", F.col("b").asc_nulls_first())


def estimate(a: list[int], b: list[int]) -> float:
    """Share of equal slots of two signatures of one length."""
    if not a or len(a) != len(b):
        raise ValueError("signatures have one positive length")
    return math.fsum(x == y for x, y in zip(a, b, strict=True)) / len(a)
