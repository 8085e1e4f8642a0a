"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical tokens: numbers, names and units give way to
typed placeholders, other words are lower-cased.  Windows of ``WINDOW`` canonical
tokens are hashed and joined with the windows of the benchmark items, so a
question whose numbers or names were changed still matches.  A window with
fewer than ``LITERALS`` literal words says too little without its values: it is
hashed by its lower-cased tokens, numbers and names kept.  An item's first word
cannot tell a name from a capital that opens a sentence, so windows that hold it
are indexed in both readings.

For the windows that match on one diagonal (same shift between item and text),
the values in the slots are compared: a value of the item must go with one value
of the text throughout.  Matches without that consistency are not leaks.

Items of the same template (equal windows, values equal at the same places) are
one class, so a text window meets a class once however many items it has.  The
benchmark's windows are broadcast while they are few (``BROADCAST_WINDOWS``,
counted first) and joined by a shuffle beyond; both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewords as bw
from plumbline.llm.rows import text_key, text_of, type_of, without
from plumbline.scratch import materialise, scope

WINDOW = 8
#: Literal words that a window of placeholders needs.
LITERALS = 3
#: An item leaks if so many of its windows match, or this share of them.
MIN_WINDOWS, MIN_COVERAGE = 6, 0.5
#: Share of slot values that must be mapped alike throughout.
CONSISTENCY = 0.75
BROADCAST_WINDOWS = 1_000_000
#: Unit words that follow a number; fixed values.
UNITS = tuple("mm cm m km in ft yd mi mg g kg lb oz ml l s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres mile miles foot feet inch inches pound pounds dollar dollars euro euros cent cents percent degree degrees".split())

_U = np.uint64
NUM, NAME, UNIT = (bw.hash_word(f"<{k}>") for k in ("num", "name", "unit"))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_LOWER[128:] = True
_CLOSES = np.zeros(256, bool)
_CLOSES[list(b".!?:;|\n\"")] = True
_BASE = _U(0x9FB21C651E98DF25)
#: Tells windows of plain tokens from those with placeholders.
_PLAIN = _U(0x5851F42D4C957F2D)


@cache
def _units() -> np.ndarray:
    return np.sort(np.array([bw.hash_word(u) for u in UNITS], _U))


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical hash, lower-cased hash and placeholder flag of every token,
    and the n + 1 bounds of the texts.

    A token is a run of letters and digits; a point or comma between two
    digits belongs to the number.  A number starts with a digit; a unit stands
    behind a number; a name starts with an upper-case letter, goes on in lower
    case and does not open a sentence.
    """
    inside = _WORD[data]
    if len(data) > 2:
        # Punctuation of UTF-8 (C2 80-BF, E2 80-81 xx) is no letter.
        two = np.flatnonzero(data[:-1] == 0xC2)
        three = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] <= 0x81) & (data[1:-1] >= 0x80))
        for k, at in ((2, two), (3, three)):
            for i in range(k):
                inside[at + i] = False
        joint = (data[1:-1] == 46) | (data[1:-1] == 44)
        inside[1:-1] |= joint & _DIGIT[data[:-2]] & _DIGIT[data[2:]]
    starts, ends, bounds = bw.spans(inside, offsets)
    plain = bw.run_hashes(bw.LOWER[data], starts, ends)
    out = plain.copy()
    if not len(starts):
        return out, plain, np.zeros(0, bool), bounds
    number = _DIGIT[data[starts]]
    first = np.zeros(len(starts), bool)
    first[bounds[:-1][bounds[:-1] < len(starts)]] = True
    behind = np.zeros(len(starts), bool)
    behind[1:] = number[:-1] & ~first[1:]
    units = _units()
    unit = behind & (units[np.minimum(np.searchsorted(units, plain), len(units) - 1)] == plain)
    close = np.concatenate([[0], np.cumsum(_CLOSES[data], dtype=np.int64)])
    gap = np.zeros(len(starts), bool)
    gap[1:] = close[starts[1:]] == close[ends[:-1]]
    second = np.zeros(len(starts), bool)
    longer = ends - starts > 1
    second[longer] = _LOWER[data[starts[longer] + 1]]
    name = _UPPER[data[starts]] & second & gap & ~first
    out[number], out[name], out[unit] = _U(NUM), _U(NAME), _U(UNIT)
    return out, plain, number | name | unit, bounds


def windows(tokens: np.ndarray, plain: np.ndarray, slot: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token index and hash of each window of ``width`` tokens of one text, and
    whether it has placeholders; a window of too few literal words is hashed by
    its plain tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, bool)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    slots = np.concatenate([[0], np.cumsum(slot)])
    at = np.flatnonzero(text[:n] == text[width - 1 :])
    few = width - (slots[at + width] - slots[at]) < min(LITERALS, width)
    h = np.zeros(len(at), _U)
    for i in range(width):
        h = h * _BASE + tokens[at + i]
    if few.any():
        bare = np.zeros(int(few.sum()), _U)
        for i in range(width):
            bare = bare * _BASE + plain[at[few] + i]
        h[few] = bare ^ _PLAIN
    return at, bw.mix(h + _U(width)), ~few


def _slot_rows(plain: np.ndarray, slot: np.ndarray, at: np.ndarray, open_: np.ndarray, width: int) -> list[list[int]]:
    """The lower-cased hashes in the slots of each window, 0 elsewhere."""
    grid = at[:, None] + np.arange(width)[None, :]
    return np.where(slot[grid] & open_[:, None], plain[grid], _U(0)).view(np.int64).tolist()


def _rows(part: pa.RecordBatch, found: tuple, plain: np.ndarray, slot: np.ndarray, text: np.ndarray, bounds: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    at, h, open_ = found
    count = np.diff(bounds)
    for lo in range(0, len(at), 50_000):
        a, t = at[lo : lo + 50_000], text[lo : lo + 50_000]
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(t)),
                part.column(1).take(pa.array(t)),
                pa.array(a - bounds[t]),
                pa.array(np.full(len(a), width, np.int32)),
                pa.array(h[lo : lo + 50_000].view(np.int64)),
                pa.array(_slot_rows(plain, slot, a, open_[lo : lo + 50_000], width), pa.list_(pa.int64())),
                pa.array(count[t]),
            ],
            ["id", "text_key", "at", "width", "h", "slots", "tokens"],
        )


def _text_windows(widths: list[int], asked: Broadcast | None) -> Callable:
    """Windows of every text: id, text key, place, width, hash, slot values and
    the text's tokens; ``asked`` holds the sorted hashes to keep."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if asked is None else np.frombuffer(asked.value, _U)
        for part, data, offsets in bw.text_groups(batches):
            tokens, plain, slot, bounds = canonical(data, offsets)
            for width in widths:
                at, h, open_ = windows(tokens, plain, slot, bounds, width)
                if keep is not None:
                    ok = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h
                    at, h, open_ = at[ok], h[ok], open_[ok]
                text = np.searchsorted(bounds, at, "right") - 1
                yield from _rows(part, (at, h, open_), plain, slot, text, bounds, width)

    return run


def _class_keys(found: list[tuple], plain: np.ndarray, slot: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each item's windows, and of the places where each slot value
    stands first."""
    out = np.zeros(len(bounds) - 1, _U)
    for text, place, h in found:
        np.add.at(out, text, bw.mix(h + bw.mix(place.astype(_U))))
    at = np.flatnonzero(slot)
    text = np.searchsorted(bounds, at, "right") - 1
    _, first, value = np.unique(plain[at] ^ bw.mix(text.astype(_U)), return_index=True, return_inverse=True)
    here, there = at - bounds[text], at[first][value] - bounds[text]
    np.add.at(out, text, bw.mix(bw.mix(here.astype(_U)) + there.astype(_U)))
    return bw.mix(out)


def _item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of every item, those of its first word in both readings; an item
    shorter than a window is one window of its own length."""
    for part, data, offsets in bw.text_groups(batches):
        tokens, plain, slot, bounds = canonical(data, offsets)
        count = np.diff(bounds)
        first = bounds[:-1][count > 0]
        named, opened = tokens.copy(), slot.copy()
        capital = first[~slot[first]]
        named[capital], opened[capital] = _U(NAME), True
        found, keyed = [], []
        for width in range(LITERALS, WINDOW + 1):
            for reading, (t, s) in enumerate(((tokens, slot), (named, opened))):
                at, h, open_ = windows(t, plain, s, bounds, width)
                text = np.searchsorted(bounds, at, "right") - 1
                ok = (count[text] == width) | (width == WINDOW)
                if reading:
                    ok &= at == bounds[text]
                at, h, open_, text = at[ok], h[ok], open_[ok], text[ok]
                found.append(((at, h, open_), s, text, width))
                keyed.append((text, 2 * (at - bounds[text]) + reading, h))
        cls = _class_keys(keyed, plain, opened, bounds)
        for windows_, s, text, width in found:
            lo = 0
            for rows in _rows(part, windows_, plain, s, text, bounds, width):
                yield rows.append_column("cls", pa.array(cls[text[lo : lo + rows.num_rows]].view(np.int64)))
                lo += rows.num_rows


_ROW = "text_key long, at long, width int, h long, slots array<long>, tokens long"


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), text_key(text_col).alias("text_key"), text_of(text_col).alias("text")).filter("id is not null")


def item_classes(benchmark: DataFrame, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(cls, at, width, h, slots, tokens)`` of the windows of one item of each
    class, and ``(cls, item_id)`` of all items.  A class has equal windows, and
    slots in which equal values stand at the same places."""
    items = _texts(benchmark, item_col, item_text_col).dropDuplicates(["id", "text_key"])
    every = materialise(items.mapInArrow(_item_windows, f"id {type_of(benchmark, item_col)}, {_ROW}, cls long"), "decontam-items")
    one = every.groupBy("cls").agg(F.min(F.struct("id", "text_key")).alias("one")).select("cls", "one.*")
    index = every.join(one, ["cls", "id", "text_key"]).select("cls", "at", "width", "h", "slots", "tokens")
    return materialise(index, "decontam-index"), every.select("cls", F.col("id").alias("item_id")).distinct()


def leaked_classes(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, cls, windows, coverage, consistency)`` of every text
    and class of items that leaks into it."""
    spark = docs.sparkSession
    used = sorted(r["width"] for r in index.select("width").distinct().collect())  # at most six
    texts = _texts(docs, id_col, text_col)
    schema = f"id {type_of(docs, id_col)}, {_ROW}"
    asked = index.select("h").distinct()
    if asked.count() <= BROADCAST_WINDOWS:
        keep = np.sort(asked.toArrow().column("h").to_numpy().view(_U))
        shared = spark.sparkContext.broadcast(keep.tobytes())
        found = texts.mapInArrow(_text_windows(used if len(keep) else [], shared), schema)
        found = materialise(found, "decontam-hits")
    else:
        found = texts.mapInArrow(_text_windows(used, None), schema)

    a, b = found.alias("a"), index.alias("b")
    hits = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.width") == F.col("b.width"))).select(
        F.col("a.id").alias("doc_id"),
        F.col("a.text_key").alias("text_key"),
        F.col("b.cls").alias("cls"),
        (F.col("a.at") - F.col("b.at")).alias("shift"),
        F.col("b.at").alias("item_at"),
        (F.col("b.tokens") - F.col("b.width") + 1).alias("room"),
        F.filter(F.zip_with("b.slots", "a.slots", lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda s: s["x"] != 0).alias("pairs"),
    )
    # One line of agreement after another; its slots stay few, for they are
    # distinct pairs of values of one item.
    line = hits.groupBy("doc_id", "text_key", "cls", "shift").agg(F.collect_set("item_at").alias("places"), F.max("room").alias("room"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    known = F.size(F.array_distinct(F.transform("pairs", lambda p: p["x"])))
    line = line.withColumn("consistency", F.when(F.size("pairs") == 0, 1.0).otherwise(known / F.size("pairs")))
    whole = line.filter(F.col("consistency") >= CONSISTENCY).groupBy("doc_id", "text_key", "cls").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("windows"), F.max("room").alias("room"), F.max_by("consistency", F.size("places")).alias("consistency")
    )
    coverage = F.col("windows") / F.col("room")
    return whole.filter((F.col("windows") >= MIN_WINDOWS) | (coverage >= MIN_COVERAGE)).select("doc_id", "text_key", "cls", F.col("windows").cast("long"), coverage.alias("coverage"), "consistency")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, item_id, windows, coverage, consistency)`` of every
    document and item where the item leaks.

    An item leaks when at least ``MIN_WINDOWS`` of its windows or ``MIN_COVERAGE``
    of them match the document and the slots of the best diagonal are filled
    consistently.  Items shorter than a window are one window; items of fewer
    than three tokens never match.  Null texts are empty; rows without an id
    take no part; repeated rows count once; rows of one id but different texts
    are told apart by ``text_key``; empty tables give an empty result; ids keep
    their type; columns of other names are not looked at.
    """
    index, items = item_classes(benchmark, item_col, item_text_col)
    found = leaked_classes(docs, index, id_col, text_col).join(items, "cls")
    return found.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("windows", "coverage", "consistency")).alias("best")).select("doc_id", "text_key", "item_id", "best.*")


def flag_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, contaminated, n_items, item_id, coverage)``, one row per row
    of ``docs``, with the item that is covered best (smallest id of equals).
    Cases are as in ``leaks``; rows without an id are not contaminated."""
    index, items = item_classes(benchmark, item_col, item_text_col)
    per_class = items.groupBy("cls").agg(F.count("*").alias("items"), F.min("item_id").alias("item_id"))
    found = leaked_classes(docs, index, id_col, text_col).join(per_class, "cls")
    best = F.min(F.struct((-F.col("coverage")).alias("minus"), "item_id")).alias("b")
    flags = materialise(found.groupBy("doc_id", "text_key").agg(F.sum("items").alias("n_items"), best), "decontam-best")
    flags = flags.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "n_items", "b")
    ids = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"))
    return ids.join(flags, (F.col("doc_id") == F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("b.item_id").alias("item_id"), F.coalesce(-F.col("b.minus"), F.lit(0.0)).alias("coverage")
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak an item; another text of the same id
    stays, and so do rows without an id."""
    with scope(docs.sparkSession) as keep:
        index, _ = item_classes(benchmark, item_col, item_text_col)
        gone = keep(materialise(leaked_classes(docs, index, id_col, text_col).select("doc_id", "text_key").distinct(), "decontam-gone"))
    return without(docs, gone, id_col, text_col)
