"""Arrow-batched wrappers of the kernels, for candidate rows only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import kernels as K


def _hashed(batches: Iterable[pa.RecordBatch], width: int, at_once: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of batches whose last column is a list of words, with the hashes of
    their shingles and the bounds of each row's; some ``at_once`` words a time,
    but a row whole."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        words = lists.flatten().cast(pa.large_string())
        data, offsets = words.buffers()[2], np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        lo = 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + at_once, "right")) - 1)
            base, upto = K.window_hashes(data, offsets[bounds[lo] : bounds[hi] + 1], bounds[lo : hi + 1], width)
            yield batch.slice(lo, hi - lo), base, upto
            lo = hi


def minhash_signatures(docs: DataFrame, width: int, size: int = K.SIGNATURE, seed: int = K.MINHASH_SEED) -> DataFrame:
    """``(pos, id, n, sig)`` of ``docs`` (pos, id, words); ``n`` is the number of
    shingles, repeats included."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = K.minhash_salts(size, seed)
        for part, base, upto in _hashed(batches, width, 8192):
            sig = K.minhash_lists(base, upto, salts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * size), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(upto).astype(np.int32)), lists], ["pos", "id", "n", "sig"])

    return docs.select("pos", "id", "words").mapInArrow(run, "pos long, id string, n int, sig array<long>")


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings, and their bounds."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8), offsets


def _hashed_words(column: pa.Array, stop: Sequence[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column, and the bounds of each row's: of lists of
    words, or, if the words left out are given (``stop``), of normal forms."""
    if stop is not None:
        data, offsets = _strings(pa.array(stop, pa.string()))
        return K.words_of(*_strings(column), K.word_hashes(data, offsets[:-1], offsets[1:]))
    data, offsets = _strings(column.flatten())
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return K.word_hashes(data, offsets[:-1], offsets[1:]), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """``(pos, s, key)`` of ``docs`` (pos, words): the sorted set of the hashes of
    its shingles and the set's SHA-256.  The words are taken from the normal form
    as in ``shingle_rows``."""
    stop = getattr(docs, "stopwords", None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                h, upto = K.word_windows(*_hashed_words(part.column(1), stop), width)
                sets = [np.unique(x) for x in np.split(h.view(np.int64), upto[1:-1])]
                sizes = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                keys = pa.array([sha256(x.tobytes()).digest() for x in sets], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, keys], ["pos", "s", "key"])

    return docs.select("pos", "words" if stop is None else "norm").mapInArrow(run, "pos long, s array<long>, key binary")


def shingle_rows(docs: DataFrame, width: int, among: Sequence[int] | None = None) -> DataFrame:
    """``(pos, id, h)``: the hash of each shingle of ``docs`` (pos, id, words),
    without the id, and one row, with it and a null hash, of a row that has none.
    Of the hashes ``among``, if given: one of them a row of ``docs``.  Where the
    frame names its stopwords, the words are taken from the normal form (norm),
    and no list of words is made."""
    stop = getattr(docs, "stopwords", None)
    sent = None if among is None else docs.sparkSession.sparkContext.broadcast(np.sort(np.array(among, np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sent is not None:
            known, likely = sent.value, np.zeros(1 << 20, bool)
            likely[known.view(np.uint64) >> np.uint64(44)] = True
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                h, upto = K.word_windows(*_hashed_words(part.column(2), stop), width)
                none = np.flatnonzero(np.diff(upto) == 0)
                row = np.repeat(np.arange(len(part)), np.diff(upto))
                if sent is not None:
                    some = np.flatnonzero(likely[h >> np.uint64(44)])
                    some = some[np.isin(h[some].view(np.int64), known)]
                    row, at = np.unique(row[some], return_index=True)
                    h = h[some][at]
                held = np.arange(len(row) + len(none)) < len(row)
                row = np.concatenate([row, none])
                ids = part.column(1).take(pa.array(row, mask=held))
                h = pa.array(np.concatenate([h.view(np.int64), np.zeros(len(none), np.int64)]), mask=~held)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), ids, h], ["pos", "id", "h"])

    return docs.select("pos", "id", "words" if stop is None else "norm").mapInArrow(run, "pos long, id string, h long")


def overlaps(rows: DataFrame) -> DataFrame:
    """``(a, b, both, na, nb)`` of each pair of ``rows`` (cell, a, b, n, c), with the
    number of common members.  A cell's rows follow each other, its sets (b null)
    before its pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            cells = batch.column(0).to_numpy()
            # The last cell may go on in the next batch.
            cut = int(np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))[-1])
            if held and (cut or held[-1].column(0)[-1].as_py() != int(cells[0])):
                yield from K.counted_pairs([*held, batch.slice(0, cut)])
                held = []
            elif cut:
                yield from K.counted_pairs([batch.slice(0, cut)])
            held.append(batch.slice(cut))
        if held:
            yield from K.counted_pairs(held)

    return rows.select("cell", "a", "b", "n", "c").mapInArrow(run, "a long, b long, both long, na long, nb long")


def measures(a: Column, b: Column) -> Column:
    """Local alignment, length of the longest common subsequence and edit
    distance of two token lists, which go to Python once."""
    schema = "score int, similarity double, sub_start int, sub_end int, ref_start int, ref_end int, lcs int, edits int"

    @F.pandas_udf(schema)
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(list(p), list(q)) for p, q in zip(x, y, strict=True)]
        rows = [(*K.local_alignment(p, q), K.lcs_length(p, q), K.edit_distance(p, q)) for p, q in pairs]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return run(a, b)


def lcs_length(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([K.lcs_length(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(a, b)


def edit_distance(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([K.edit_distance(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="int32")

    return run(a, b)


def local_alignment(a: Column, b: Column) -> Column:
    @F.pandas_udf("score int, similarity double, sub_start int, sub_end int, ref_start int, ref_end int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.local_alignment(list(p), list(q)) for p, q in zip(x, y, strict=True)], columns=["score", "similarity", "sub_start", "sub_end", "ref_start", "ref_end"])

    return run(a, b)


def z_array(text: Column) -> Column:
    @F.pandas_udf("array<int>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(K.z_array)

    return run(text)


def offset_map(text: Column) -> Column:
    @F.pandas_udf("norm string, offs array<int>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([K.normalize_with_offsets(t) for t in x], columns=["norm", "offs"])

    return run(text)


def compress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: K.compress(bytes(b)))

    return run(data)


def decompress(data: Column) -> Column:
    @F.pandas_udf("binary")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda b: K.decompress(bytes(b)))

    return run(data)
