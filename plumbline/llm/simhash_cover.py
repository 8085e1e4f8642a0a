"""SimHash near-duplicates by anchor-point covering.

Fingerprints of 64 bits are compared at anchors.  Two blocks of 23 bits are
each covered by the perfect binary Golay code (covering radius 3), so every
fingerprint has one home anchor, a pair of codewords.  A fingerprint is stored
at its home and replicated to each anchor that is the home of any 64-bit word
within the threshold of it; by the triangle inequality those lie within
radius + threshold of it in each block.  Two fingerprints within the threshold
therefore always meet at an anchor, and each pair is found at the home of its
smaller member alone.  Because the code is linear, the replicas depend on the
two syndromes only (2,048 values each) and come from a small table.

Equal fingerprints are one class and are never paired.

``meetings`` is the covering for texts further apart than two bits.  It has six
tables, each over 46 bits of one of three 64-bit words.  A fingerprint goes to
the homes of the words that differ from its own in one or two of its weakest
bits, those whose votes were closest, for there near copies differ most often;
two meet that have an anchor in common.  At such distances that finds most
pairs, not all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.llm import bytewords as bw
from plumbline.llm.rows import one_of_each, text_key, text_of, type_of, with_class
from plumbline.llm.xx64 import hash_ranges
from plumbline.operators.components import connected_components
from plumbline.scratch import materialise, scope

THRESHOLD = 2
SHINGLE_WORDS = 3
SEED = 42
BLOCK = 23
#: Word and shift of the 46 bits of each table of ``meetings``.
TABLES = [(word, shift) for word in range(3) for shift in (0, 64 - 2 * BLOCK)]
#: The weakest bits of a table that are flipped, by rank: one, or two of five.
WEAK = 8
FLIPS = [(), *((i,) for i in range(WEAK)), *((i, j) for j in range(5) for i in range(j))]
#: Most bits of 64 in which a pair of ``meetings`` differs (a Jaccard similarity
#: of 0.8 makes 9.7 on average, sd 2.9), how many of an anchor, besides its
#: first, a fingerprint meets at first, and with how many of all it is then
#: paired; ``left_out`` gives the rest.
FAR, CROWD, NEAREST = 19, 16, 8
#: Lowest bits of an anchor's number that hold the place within it.
PLACE = 12
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Bit i of a byte as the lowest bit of lane i of a 64-bit word.
SPREAD = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(i)) & np.uint64(1)) << np.uint64(8 * i) for i in range(8)).astype(np.uint64)


# ---------------------------------------------------------------- fingerprints
def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """uint64 fingerprint of each text: bit 1 where over half of its shingles'
    XXH64 have it; all zero for a text without words."""
    low, starts, ends, first = bw.white_words(data, offsets)
    if not len(starts):
        return np.zeros(len(offsets) - 1, np.uint64)
    # One space between words: copy each word with one byte behind it.
    lens = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    joined = np.full(at[-1], 0x20, np.uint8)
    word_of = np.repeat(np.arange(len(starts)), lens)
    joined[np.arange(len(word_of)) + word_of] = low[~bw.WHITE[low]]
    counts = np.diff(first)
    n_shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n_shingles)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + first[doc]
    stop = at[np.minimum(begin + width, first[doc + 1])] - 1
    return majority(votes(hash_ranges(joined, at[begin], stop, SEED), n_shingles), n_shingles)


def votes(hashes: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """How many of the ``n_shingles`` hashes of each text, which stand one text
    after another, have each of the 64 bits."""
    out = np.zeros((len(n_shingles), 64), np.int64)
    if not len(hashes):
        return out
    # A byte's bits spread over eight lanes, added up for at most 255 shingles
    # of one text at a time so that no lane overflows.
    full = np.flatnonzero(n_shingles)
    pieces = -(-n_shingles[full] // 255)
    piece_of = np.cumsum(pieces) - pieces
    inner = np.arange(pieces.sum()) - np.repeat(piece_of, pieces)
    cut = np.repeat((np.cumsum(n_shingles) - n_shingles)[full], pieces) + 255 * inner
    lanes = hashes.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        eight = np.add.reduceat(SPREAD[lanes[:, k]], cut).view(np.uint8).reshape(-1, 8)
        out[full, 8 * k : 8 * k + 8] = np.add.reduceat(eight, piece_of, axis=0, dtype=np.int64)
    return out


def majority(ones: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """uint64 of each text: bit 1 where over half of its shingles vote for it."""
    return ((2 * ones > n_shingles[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def sketches(hashes: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """Nine uint64 of each text: three fingerprints, and for each table the
    places of its weakest bits, six bits each, the weakest lowest."""
    words, weakest = [], []
    for k in range(3):
        ones = votes(bw.mix(hashes ^ np.uint64(k)), n_shingles)
        words.append(majority(ones, n_shingles))
        margin = np.abs(2 * ones - n_shingles[:, None])
        for shift in (s for w, s in TABLES if w == k):
            order = np.argsort(margin[:, shift : shift + 2 * BLOCK], axis=1, kind="stable")[:, :WEAK]
            weakest.append((order.astype(np.uint64) << (np.uint64(6) * np.arange(WEAK, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
    return np.stack(words + weakest, axis=1)


def _fingerprint_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, data, offsets in bw.text_groups(batches):
        fp = fingerprints_of(data, offsets)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp.view(np.int64))], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, fp)``; ``fp`` is the 64-bit fingerprint as a signed
    long, ``text_key`` a hash of the text, ids keep their type."""
    given = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text"))
    return given.mapInArrow(_fingerprint_batches, f"doc_id {type_of(docs, id_col)}, text_key long, fp long")


# ---------------------------------------------------------------- anchors
def syndrome(x: int) -> int:
    """Remainder of a 23-bit word modulo the Golay polynomial (0: a codeword)."""
    for i in range(BLOCK - 1, 10, -1):
        if x >> i & 1:
            x ^= GOLAY << (i - 11)
    return x


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Syndromes of the bytes of a word; coset leaders (the error that the
    perfect code corrects) by syndrome; and by syndrome, for 0, 1 and 2 flips,
    the differences from the word's own codeword to the homes reached."""
    by_byte = np.zeros((3, 256), np.int32)
    for k in range(3):
        for v in range(256):
            x = v << (8 * k)
            by_byte[k, v] = syndrome(x) if x < 1 << BLOCK else 0
    leaders = np.zeros(2048, np.int32)
    bits = [1 << i for i in range(BLOCK)]
    errors = [0, *bits]
    errors += [bits[i] | bits[j] for i in range(BLOCK) for j in range(i)]
    errors += [bits[i] | bits[j] | bits[k] for i in range(BLOCK) for j in range(i) for k in range(j)]
    single = [syndrome(b) for b in bits]
    for e in errors:
        leaders[syndrome(e)] = e
    reach = []
    for s in range(2048):
        # The word is codeword + leaders[s]; flipping f leads home to
        # codeword + (leaders[s] ^ f ^ leaders[s ^ syndrome(f)]).
        home = int(leaders[s])
        one = {home ^ bits[i] ^ int(leaders[s ^ single[i]]) for i in range(BLOCK)} - {0}
        two = {home ^ bits[i] ^ bits[j] ^ int(leaders[s ^ single[i] ^ single[j]]) for i in range(BLOCK) for j in range(i)} - {0} - one
        reach.append([np.array([0], np.int64), np.array(sorted(one), np.int64), np.array(sorted(two), np.int64)])
    return by_byte, leaders, reach


def homes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codeword and syndrome of each of the two blocks."""
    by_byte, leaders, _ = _tables()
    found = []
    for shift in (0, BLOCK):
        x = (fp >> np.uint64(shift)).astype(np.int64) & ((1 << BLOCK) - 1)
        s = by_byte[0, x & 255] ^ by_byte[1, x >> 8 & 255] ^ by_byte[2, x >> 16]
        found += [x ^ leaders[s], s]
    return tuple(found)


def replicas(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor) of every anchor to which a fingerprint goes,
    its home among them."""
    _, _, reach = _tables()
    c0, s0, c1, s1 = homes(fp)
    which, anchors = [], []
    order = np.argsort(s0 * 2048 + s1, kind="stable")
    keys = (s0 * 2048 + s1)[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        p, q = reach[keys[a] // 2048], reach[keys[a] % 2048]
        moves = np.concatenate([(p[i][:, None] << BLOCK | q[j][None, :]).ravel() for i in range(3) for j in range(3 - i)])
        rows = order[a:b]
        base = c0[rows] << BLOCK | c1[rows]
        which.append(np.repeat(rows, len(moves)))
        anchors.append((base[:, None] ^ moves[None, :]).ravel())
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(anchors)


def _home_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        c0, _, c1, _ = homes(fp)
        yield pa.RecordBatch.from_arrays([pa.array(c0 << BLOCK | c1), pa.array(fp.view(np.int64))], ["anchor", "a"])


def _replica_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for lo in range(0, len(every), 4096):
            fp = every[lo : lo + 4096]
            which, anchor = replicas(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[which].view(np.int64))], ["anchor", "b"])


def links(distinct: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of different fingerprints (column ``fp``, one
    row each) at most ``threshold`` (0 to 2) bits apart, each once."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError("the anchors cover thresholds of 0 to 2")
    stored = distinct.select("fp").mapInArrow(_home_batches, "anchor long, a long")
    sent = distinct.select("fp").mapInArrow(_replica_batches, "anchor long, b long")
    # About 60 replicas come from each row, which size estimates do not know;
    # without the hint a small input could have them broadcast.
    sent = sent.hint("merge")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    return stored.join(sent, (stored["anchor"] == sent["anchor"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


def weak_anchors(fp: np.ndarray, weakest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into fp, anchor), each once, of the homes of the 46-bit words
    ``fp`` with each of ``FLIPS`` applied to its weakest bits."""
    one = np.uint64(1)
    bits = [one << (weakest >> np.uint64(6 * i) & np.uint64(63)) for i in range(WEAK)]
    words = np.stack([fp ^ sum((bits[i] for i in flip), np.zeros(len(fp), np.uint64)) for flip in FLIPS], axis=1)
    c0, _, c1, _ = homes(words.ravel())
    anchors = np.sort((c0 << BLOCK | c1).reshape(words.shape), axis=1)
    fresh = np.ones(anchors.shape, bool)
    fresh[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
    return np.nonzero(fresh)[0], anchors[fresh]


def _table_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 4096):
            part = batch.slice(lo, 4096)
            cls, own = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            sketch = part.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(part), -1)
            place = (own * ((1 << PLACE) - 1)).astype(np.int64)
            for t, (word, shift) in enumerate(TABLES):
                which, anchor = weak_anchors(sketch[:, word] >> np.uint64(shift), sketch[:, 3 + t])
                at = (t << 2 * BLOCK | anchor) << PLACE | place[which]
                other = sketch[which, (word + 1) % 3].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cls[which]), pa.array(other)], ["at", "cls", "fp"])


def at_anchors(classes: DataFrame) -> DataFrame:
    """``(anchor, cls, fp, to, bits, place, crowded)``, stored: how classes (long
    cls, double own of 0 to 1, sketch: array of the longs of ``sketches``) meet
    at anchors.  ``bits`` are those in which two differ in a word from which the
    anchor was not taken; two that differ in more than ``FAR`` do not meet.

    At an anchor a class looks at the first, by ``own``, and the ``CROWD`` before
    it, and takes the nearest of them (``to``); where so many stand, the first if
    that is near enough.  Whoever else it meets there is left for ``left_out``:
    such an anchor is ``crowded``, and all of its classes are kept."""
    sent = classes.select("cls", "own", "sketch").mapInArrow(_table_batches, "at long, cls long, fp long").withColumn("anchor", F.shiftright("at", PLACE))
    order = Window.partitionBy("anchor").orderBy("at", "cls")
    it = F.struct(F.col("at").bitwiseAND((1 << PLACE) - 1).alias("place"), "cls", "fp")
    first, before = F.first(it).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.collect_list(it).over(order.rowsBetween(-CROWD, -1))
    shared = sent.withColumns({"first": first, "before": before, "classes": F.count("*").over(Window.partitionBy("anchor"))}).filter("classes > 1")
    apart = lambda x: F.struct(F.bit_count(x["fp"].bitwiseXOR(F.col("fp"))).alias("bits"), x["place"].alias("place"), x["cls"].alias("to"))
    near = F.filter(F.transform(F.concat("before", F.array("first")), apart), lambda x: (x["bits"] <= FAR) & (x["to"] != F.col("cls")))
    seen = shared.select("anchor", "cls", "fp", near.alias("near"), apart(F.col("first")).alias("one"), (F.size("before") == CROWD).alias("full"))
    taken = F.when(F.col("full") & (F.col("one.bits") <= FAR), F.col("one")).otherwise(F.array_min("near"))
    seen = seen.withColumn("x", taken)
    missed = F.col("full") | F.exists("near", lambda x: x["to"] != F.col("x.to"))
    crowded = F.max(missed).over(Window.partitionBy("anchor"))
    kept = seen.withColumn("crowded", crowded).filter(F.col("crowded") | F.col("x").isNotNull())
    return materialise(kept.select("anchor", "cls", "fp", "x.to", "x.bits", "x.place", "crowded"), "simhash-meetings")


def nearest(met: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of ``met`` (``at_anchors``): each class with the
    ``NEAREST`` and with the foremost by ``own`` of those that it took, so that
    pairs grow with the number of classes alone."""
    each = met.filter("to is not null").groupBy("cls", "to").agg(F.min("bits").alias("bits"), F.min("place").alias("place"))
    by = Window.partitionBy("cls")
    ranked = each.withColumns({"rank": F.row_number().over(by.orderBy("bits", "place", "to")), "foremost": F.min(F.struct("place", "to")).over(by)})
    pairs = ranked.filter((F.col("rank") <= NEAREST) | (F.col("to") == F.col("foremost.to")))
    return pairs.select(F.least("cls", "to").alias("a"), F.greatest("cls", "to").alias("b")).distinct()


def meetings(classes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``classes`` (as of ``at_anchors``): the nearest."""
    return nearest(at_anchors(classes))


def left_out(met: DataFrame, parts: DataFrame, likely: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of all classes of ``met`` (``at_anchors``) that meet
    and lie in different parts, ``parts`` (node, component) being those that are
    joined by now.  Parts are paired at an anchor before their classes are, so
    that a large group costs no more than its size.

    Where a large part meets many small ones, those pairs are the product of both.
    ``likely`` spares them: from ``(cls, part)`` of the classes at crowded anchors
    it makes the pairs ``(a, b)``, a < b, that are wanted, and of these the ones
    that meet are given."""
    part = lambda c, name: parts.select(F.col("node").alias(c), F.col("component").alias(name))
    took = met.filter("to is not null").select(F.least("cls", "to").alias("a"), F.greatest("cls", "to").alias("b")).distinct()
    took = took.join(part("a", "p"), "a", "left").join(part("b", "q"), "b", "left").filter(F.coalesce("p", "a") != F.coalesce("q", "b"))
    placed = met.filter("crowded").select("anchor", "cls", "fp").join(part("cls", "part"), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    of = Window.partitionBy("anchor")
    several = placed.withColumns({"lo": F.min("part").over(of), "hi": F.max("part").over(of)}).filter("lo <> hi")
    several = materialise(several.select("anchor", "part", "cls", "fp"), "simhash-crowded")
    if likely is None:
        heads = several.select("anchor", "part").distinct()
        across = heads.withColumnRenamed("part", "p").join(heads.withColumnRenamed("part", "q"), "anchor").filter("p < q")
        side = lambda p, c, f: several.select("anchor", F.col("part").alias(p), F.col("cls").alias(c), F.col("fp").alias(f))
        full = across.join(side("p", "x", "f"), ["anchor", "p"]).join(side("q", "y", "g"), ["anchor", "q"])
    else:
        side = lambda c, f: several.select("anchor", F.col("cls").alias(c), F.col("fp").alias(f))
        wanted = likely(several.select("cls", "part").distinct()).withColumnsRenamed({"a": "x", "b": "y"})
        full = wanted.join(side("x", "f"), "x").join(side("y", "g"), ["anchor", "y"])
    near = full.filter(F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= FAR)
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).unionByName(took.select("a", "b")).distinct()


# ---------------------------------------------------------------- groups
def fingerprint_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, text_key, fp, component, component_id)``, one row per row of
    ``docs``; ``component`` is the component's smallest fingerprint."""
    prints = materialise(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "simhash-classes")
    parts = materialise(connected_components(links(classes, threshold), "a", "b"), "simhash-parts")
    named = materialise(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-named")
    ids = materialise(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "simhash-components")
    per_class = materialise(with_class(named, ids, "component").select("fp", "component", "component_id", F.col("rows").alias("members")), "simhash-ids")
    return with_class(prints, per_class, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every document.

    Words are runs without white space, A-Z lower-cased; a text of fewer than
    three words is one shingle, a text without words (null or empty too) has
    fingerprint zero and is linked like any other.  Repeated rows keep their
    number; a null id keeps a row and cannot name its component.  An empty
    table gives an empty result; columns of other names are not looked at.
    """
    groups = fingerprint_groups(docs, id_col, text_col, threshold)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each component (see ``rows.one_of_each``): rows
    of one id but different texts are told apart, of equal rows one stays, rows
    without an id all stay."""
    with scope(docs.sparkSession) as keep:
        groups = keep(materialise(fingerprint_groups(docs, id_col, text_col, threshold).select("doc_id", "text_key", "component"), "simhash-groups"))
    return one_of_each(docs, groups, id_col, text_col)
