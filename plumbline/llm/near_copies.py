"""Near copies by SimHash with anchor-point covering, verified and completed.

Two texts are linked when the Jaccard similarity of their sets of
``SHINGLE_WORDS``-word shingles is at least ``SIMILARITY``; the groups are the
connected components of all links.  Candidates come first from the sets'
fingerprints that meet at an anchor (``simhash_cover.meetings``), and are verified
on the whole sets.  No covering of fingerprints reaches every pair of that
similarity, for their distances have no bound.  ``drop_near_copies`` takes the
anchors' candidates alone, the nearest first and then all that meet at an anchor,
are not joined yet and can reach the similarity (``_likely``, which misses no pair
that does); ``near_copy_groups`` adds an exact search for the pairs across what the
fingerprints joined, unless told not to.

That search is a prefix filter, which misses no pair: under any one order of the shingles,
two sets that reach the threshold share ``SHARED`` (or all that they must share,
if that is less) of the first n - ceil(t n) + ``SHARED`` of either.  The order
puts shingles that are frequent in a sample last, and else goes by hash, so the
sample bears on the work only and not on the result.

Equal sets are one class first.  Where, in the exact search, many classes share a
prefix shingle they are first compared with one of them only, that of which the
least share is its own: in a group of edited copies it is the text that they were
made from.  What is like it, or like a neighbour by fingerprint, becomes one part,
at a cost that grows with the group's size; after that only classes of different
parts are paired, for a pair within one part changes nothing.  A shared shingle
counts only where enough of both sets follows it to reach the threshold, so texts
that have a passage in common are not paired for it.  Every candidate is verified
on the whole sets, and only once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import bytewords as bw
from plumbline.llm.rows import one_of_each, text_key, text_of, type_of, with_class
from plumbline.llm.simhash_cover import at_anchors as meetings
from plumbline.llm.simhash_cover import left_out, nearest, sketches
from plumbline.operators.components import connected_components
from plumbline.scratch import materialise, scope

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Prefix shingles that a candidate pair shares.
SHARED = 2
#: One in so many texts, by its set, is looked at for frequent shingles; those
#: that so many of them hold, and at most so many shingles, go last.
SAMPLE, OFTEN, FREQUENT = 32, 3, 100_000
#: Classes of a shingle from which on they meet one of them first.
HOT = 8
#: The classes whose sets are wanted are broadcast up to this many.
BROADCAST_ROWS = 100_000
#: Longs of a set's parity.
PARITY = 8
_U = np.uint64
_BASE = _U(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, the n + 1 bounds
    of the texts, and a 64-bit key of each set."""
    low, starts, ends, first = bw.white_words(data, offsets)
    words = bw.run_hashes(low, starts, ends)
    n_words = np.diff(first)
    counts = np.where(n_words >= SHINGLE_WORDS, n_words - SHINGLE_WORDS + 1, np.minimum(n_words, 1))
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.arange(len(text)) - (np.cumsum(counts) - counts)[text] + first[:-1][text]
    hashes = np.zeros(len(text), _U)
    for i in range(SHINGLE_WORDS):
        at = begin + i
        there = at < first[1:][text]
        hashes = hashes * _BASE + np.where(there, words[np.minimum(at, len(words) - 1)] | _U(1), _U(0)) if len(words) else hashes
    hashes = bw.mix(hashes)
    order = np.lexsort((hashes, text))
    h, text = hashes[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[fresh], text[fresh]
    bounds = np.searchsorted(text, np.arange(len(counts) + 1))
    total = np.concatenate([np.zeros(1, _U), np.cumsum(bw.mix(h + _U(1)), dtype=_U)])
    key = bw.mix(total[bounds[1:]] - total[bounds[:-1]] + bw.mix(np.diff(bounds).astype(_U)))
    return h, bounds, key


def parities(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``PARITY`` uint64 of each set: a bit is 1 if an odd number of its shingles
    fall on it.  Two sets differ in as many shingles as their parities in bits,
    or in more."""
    out = np.zeros((len(bounds) - 1, PARITY), _U)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        bit, word = _U(1) << (h & _U(63)), h >> _U(6) & _U(PARITY - 1)
        for k in range(PARITY):
            out[full, k] = np.bitwise_xor.reduceat(np.where(word == _U(k), bit, _U(0)), bounds[full])
    return out


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, data, offsets in bw.text_groups(batches):
        h, bounds, key = shingle_sets(data, offsets)
        taken = np.repeat(key % _U(SAMPLE) == 0, np.diff(bounds))
        of = np.repeat(key, np.diff(bounds))
        yield pa.RecordBatch.from_arrays([pa.array(h[taken].view(np.int64)), pa.array(of[taken].view(np.int64))], ["h", "cls"])


def _prefixes(frequent: np.ndarray, counts: np.ndarray, similarity: float) -> Callable:
    """``frequent``: sorted hashes, ``counts``: how frequent each is."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in bw.text_groups(batches):
            h, bounds, key = shingle_sets(data, offsets)
            n = np.diff(bounds)
            text = np.repeat(np.arange(len(n)), n)
            weight = np.zeros(len(h), np.int64)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                weight = np.where(frequent[at] == h, counts[at], 0)
            found, h = h, h[np.lexsort((h, weight, text))]
            length = np.minimum(n, n - np.ceil(n * similarity - 1e-9).astype(np.int64) + SHARED)
            kept = np.arange(len(h)) - bounds[:-1][text] < length[text]
            cuts = np.concatenate([[0], np.cumsum(length)])
            sketch = sketches(found, n)
            own = np.bincount(text[weight == 0], minlength=len(n)) / np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(own), _lists(sketch.ravel(), np.arange(len(n) + 1) * sketch.shape[1]), _lists(h[kept], cuts)], ["doc_id", "text_key", "cls", "n", "own", "sketch", "prefix"])

    return run


def _asked_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in bw.text_groups(batches):
        h, bounds, key = shingle_sets(data, offsets)
        odd = parities(h, bounds)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), _lists(h, bounds), _lists(odd.ravel(), np.arange(len(odd) + 1) * PARITY)], ["cls", "s", "odd"])


def _alike(a: Column, b: Column, similarity: float) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    return (a >= similarity * b - 1e-9) & (b >= similarity * a - 1e-9)


def _overlap(na: Column, nb: Column, similarity: float) -> Column:
    """How many shingles two sets of these sizes share at least if they reach
    the similarity."""
    return F.ceil((na + nb) * (similarity / (1 + similarity)) - 1e-9)


def _reaches(na: Column, ia: Column, nb: Column, ib: Column, similarity: float, shared: int = SHARED) -> Column:
    """Whether two sets of these sizes can reach the similarity if a shingle at
    places ``ia`` and ``ib`` is among the first ``shared`` that they share."""
    return _alike(na, nb, similarity) & (F.least(na - ia, nb - ib) >= _overlap(na, nb, similarity) - (shared - 1))


def _enough(joined: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``joined`` (a, b, na, nb; a row for each shared
    prefix shingle) that share enough of them."""
    need = F.least(F.lit(SHARED), F.ceil(F.greatest("na", "nb") * similarity - 1e-9))
    return joined.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k")).filter(F.col("k") >= need).select("a", "b")


def _sets(asked: DataFrame, rows: DataFrame, given: DataFrame) -> DataFrame:
    """``(cls, s, odd)``, set and parity of each class in ``asked`` (cls)."""
    holders = materialise(rows.groupBy("cls").agg(F.min("text_key").alias("text_key")).join(asked, "cls", "left_semi").select("text_key"), "near-holders")
    if holders.count() <= BROADCAST_ROWS:
        holders = F.broadcast(holders)
    texts = given.join(holders, "text_key", "left_semi").select("text")
    return materialise(texts.mapInArrow(_asked_sets, "cls long, s array<long>, odd array<long>").dropDuplicates(["cls"]), "near-sets")


def _verified(pairs: DataFrame, rows: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets reach the similarity."""
    pairs = materialise(pairs, "near-candidates")
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _sets(asked, rows, given)
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("s").alias(f"s{c}"))
    both, sizes = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    return materialise(full.filter(both >= similarity * (sizes - both) - 1e-9).select("a", "b"), "near-links")


def _likely(crowd: DataFrame, rows: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of classes of ``crowd`` (cls, part) in different
    parts, among them all whose sets reach the similarity.

    A prefix filter under an exact order: first the shingles that no second part
    holds, then those of the fewest classes.  Two sets that reach the threshold t
    have the first shingle that they share among the first n - ceil(t n) + 1 of
    either, with enough of both behind it; a text with too many shingles of its
    own has no other there and meets nobody.  What comes near a large group
    without being like it is told by the parities, within the join."""
    sets = _sets(crowd, rows, given)
    tokens = sets.join(crowd, "cls").select("cls", "part", F.size("s").alias("n"), F.explode("s").alias("h"))
    counts = tokens.groupBy("h").agg(F.count("*").alias("k"), F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi")
    of = Window.partitionBy("cls")
    shared = tokens.join(counts.select("h", "k"), "h").withColumns({"place": F.row_number().over(of.orderBy("k", "h")), "held": F.count("*").over(of)})
    shared = shared.withColumn("i", F.col("n") - F.col("held") + F.col("place") - 1).filter(F.col("i") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9))
    first = materialise(shared.select("cls", "part", "n", "i", "h").join(sets.select("cls", "odd"), "cls"), "near-crowd")

    # The part of most classes at a shingle is not paired with itself.  Both
    # joins are of stored tables, so that a frequent shingle's rows can be split.
    large = materialise(first.groupBy("h", "part").agg(F.count("*").alias("classes")).groupBy("h").agg(F.max(F.struct("classes", "part"))["part"].alias("large")), "near-large")
    x, y = (first.select("h", *(F.col(c).alias(f"{c}{side}") for c in ("cls", "part", "n", "i", "odd"))) for side in "xy")
    small = materialise(x.join(large, "h").filter("partx <> large"), "near-small")
    nx, ny = F.col("nx"), F.col("ny")
    apart = sum((F.bit_count(F.col("oddx")[k].bitwiseXOR(F.col("oddy")[k])) for k in range(PARITY)), F.lit(0))
    # Sizes and places are compared first, for all classes that have them at once.
    places = small.select("h", "nx", "ix").distinct().join(first.select("h", F.col("n").alias("ny"), F.col("i").alias("iy")).distinct(), "h")
    places = materialise(places.filter(_reaches(nx, F.col("ix"), ny, F.col("iy"), similarity, 1)), "near-places")
    can = apart <= nx + ny - 2 * _overlap(nx, ny, similarity)
    once = (F.col("partx") != F.col("party")) & ((F.col("party") == F.col("large")) | (F.col("clsx") < F.col("clsy")))
    found = small.join(places, ["h", "nx", "ix"]).join(y.hint("merge"), ["h", "ny", "iy"]).filter(once & can)
    return found.select(F.least("clsx", "clsy").alias("a"), F.greatest("clsx", "clsy").alias("b")).distinct()


def _with_one(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)``: of each shingle of many classes, every class ``b`` with
    the one ``a`` of which the least share is its own."""
    of = Window.partitionBy("h")
    one = F.min(F.struct("own", F.xxhash64("cls").alias("hash"), "cls", "n", "i")).over(of)
    many = shared.withColumns({"one": one, "classes": F.count("*").over(of)}).filter((F.col("classes") >= HOT) & (F.col("cls") != F.col("one.cls")))
    many = many.filter(_reaches(F.col("n"), F.col("i"), F.col("one.n"), F.col("one.i"), similarity))
    return many.select(F.col("one.cls").alias("a"), F.col("cls").alias("b")).distinct()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _anchored(rows: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """``(node, component)`` of the classes that the anchors join: first over the
    nearest that meet, then over all others that meet and are not joined yet."""
    met = meetings(rows.select("cls", "own", "sketch").distinct())
    tried = materialise(nearest(met), "near-met")
    parts = materialise(connected_components(_verified(tried, rows, given, similarity), "a", "b"), "near-joined")
    rest = materialise(left_out(met, parts, lambda crowd: _likely(crowd, rows, given, similarity)).join(tried, ["a", "b"], "left_anti"), "near-rest")
    if rest.isEmpty():
        return parts
    more = _verified(rest, rows, given, similarity)
    if more.isEmpty():
        return parts
    return materialise(connected_components(more.unionByName(parts.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b"), "near-parts")


def _links(rows: DataFrame, given: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of classes that join all near copies."""
    met = materialise(nearest(meetings(rows.select("cls", "own", "sketch").distinct())), "near-met")
    tokens = rows.select("cls", "n", "own", F.posexplode("prefix").alias("i", "h"))
    of = Window.partitionBy("h")
    least = tokens.withColumns({"lo": F.min("cls").over(of), "hi": F.max("cls").over(of)}).filter("lo <> hi")
    shared = materialise(least.select("h", "cls", "n", "own", "i").distinct(), "near-shared")

    ones = materialise(_with_one(shared, similarity), "near-ones")
    tried = materialise(_ordered(met.union(ones)), "near-tried")
    first = _verified(tried, rows, given, similarity)
    # Classes of one part are linked with the same class, or are that class;
    # the one of a shingle comes before a neighbour by fingerprint.
    linked = first.select(F.col("a").alias("x"), F.col("b").alias("y"))
    to_one = ones.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(linked, ["x", "y"], "left_semi").select("a", "b", F.lit(0).alias("rank"))
    to_near = first.select("a", "b", F.lit(1).alias("rank"))
    parts = to_one.union(to_near).groupBy(F.col("b").alias("cls")).agg(F.min(F.struct("rank", "a"))["a"].alias("to"))
    placed = shared.join(parts, "cls", "left").select("h", F.coalesce("to", "cls").alias("part"), "cls", "n", "i")
    placed = materialise(placed, "near-placed")
    heads = placed.select("h", "part").distinct()
    p, q = heads.select("h", F.col("part").alias("p")), heads.select("h", F.col("part").alias("q"))
    across = p.join(q, "h").filter("p < q")
    left = placed.select("h", F.col("part").alias("p"), F.col("cls").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"))
    right = placed.select("h", F.col("part").alias("q"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"))
    rest = across.join(left, ["h", "p"]).join(right, ["h", "q"]).filter(_reaches(F.col("na"), F.col("ia"), F.col("nb"), F.col("ib"), similarity))
    rest = _ordered(_enough(rest, similarity)).join(tried, ["a", "b"], "left_anti")
    return first.unionByName(_verified(rest, rows, given, similarity))


def _groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, complete: bool = True) -> DataFrame:
    """``(doc_id, text_key, component, component_id)``, one row per row of
    ``docs``; ``component`` is the component's smallest class."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity lies above 0 and up to 1")
    given = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    often = given.mapInArrow(_sampled, "h long, cls long").distinct().groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") >= OFTEN)
    often = often.orderBy(F.desc("k"), "h").limit(FREQUENT).toArrow()
    found = often.column("h").to_numpy().view(_U)
    order = np.argsort(found)
    prefixes = _prefixes(found[order], often.column("k").to_numpy()[order], similarity)
    rows = materialise(given.mapInArrow(prefixes, f"doc_id {type_of(docs, id_col)}, text_key long, cls long, n int, own double, sketch array<long>, prefix array<long>"), "near-prefixes")

    parts = materialise(connected_components(_links(rows, given, similarity), "a", "b"), "near-parts") if complete else _anchored(rows, given, similarity)
    parts = parts.withColumnRenamed("node", "cls")
    classes = rows.groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).join(parts, "cls", "left")
    named = materialise(classes.select("cls", "least", "rows", F.coalesce("component", "cls").alias("component")), "near-classes")
    ids = materialise(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "near-components")
    per_class = materialise(with_class(named, ids, "component").select("cls", "component", "component_id", F.col("rows").alias("members")), "near-named")
    return with_class(rows.select("doc_id", "text_key", "cls"), per_class, "cls").select("doc_id", "text_key", "component", "component_id")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, complete: bool = True) -> DataFrame:
    """``(doc_id, component_id)`` for every document, the component by its
    smallest id.

    Words are runs without white space, A-Z lower-cased; a text of fewer than
    five words is one shingle; texts without words (null or empty too) are one
    class.  A null id keeps a row and cannot name its component; repeated rows
    keep their number; an empty table gives an empty result; columns of other
    names are not looked at.  Sets are told apart by 64-bit keys, shingles by
    64-bit hashes.  Unless ``complete``, the exact search after the fingerprints
    is left out, to measure what these reach.
    """
    return _groups(docs, id_col, text_col, similarity, complete).select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, complete: bool = False) -> DataFrame:
    """``docs`` with one row of each component (see ``rows.one_of_each``): rows
    of one id but different texts are told apart, of equal rows one stays, rows
    without an id all stay.  The candidates are those of the anchors alone;
    ``complete`` adds the exact search.  Very long texts are taken whole."""
    with scope(docs.sparkSession) as keep:
        groups = keep(materialise(_groups(docs, id_col, text_col, similarity, complete).select("doc_id", "text_key", "component"), "near-groups"))
    return one_of_each(docs, groups, id_col, text_col)
