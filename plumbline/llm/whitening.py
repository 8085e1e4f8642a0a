"""Embedding whitening by matrix-free block Lanczos.

Components become integers x = floor(256 c).  The covariance V of the distinct
x-vectors is never formed: a block of directions Q goes to the vectors, and one
distributed pass gives V Q = (1/n) sum (x - mean) ((x - mean) . Q), summed up by
Spark.  Block Lanczos builds an orthonormal basis from such products, with full
reorthogonalisation (twice) against the whole basis; its projected matrix is
small, and its eigenpairs are the Ritz pairs.  A pair has converged when its
residual, the product of the next block's coefficients with the end of its Ritz
vector, is at most ``TOLERANCE`` of the largest Ritz value.  Directions of a new
block that vanish after reorthogonalisation (breakdown: an invariant subspace
was found) are replaced by random ones orthogonal to the basis, so components
that the start could not reach, and repeated eigenvalues, are found too.  The
basis ends at the dimension, where the result is complete in any case.

The driver holds the basis, dimensions times basis vectors, and never a row;
passes = basis / block, each reading the stored distinct vectors once.

The trace needs no matrix: n^3 trace(V) is the exact integer sum of deviations
sum_d (n x_d - S_d)^2, which gives the explained shares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.impact_topk import usable
from plumbline.scratch import materialise

SCALE = 256.0
COMPONENTS = 4
#: Directions of a block; the first one is random, seeded.
BLOCK, SEED = 8, 42
TOLERANCE = 1e-14
#: Norm, as a share of the largest, below which a direction counts as vanished.
VANISHED = 1e-10
#: Variances below this share of the greatest are rounding: no component.
NO_VARIANCE = 1e-12
#: Rows of a matrix at once.
ROWS = 8192
#: Components are kept within +-2^53, where they are whole numbers.
LARGEST = float(1 << 53)

Matrices = Iterator[tuple[np.ndarray, pa.RecordBatch]]


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, doubles) as (id, x as little-endian longs without trailing zeros)."""
    for batch in batches:
        lists = batch.column(1)
        flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
        x = np.clip(flat, -LARGEST, LARGEST).astype("<i8")
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        # Trailing zeros: the last place in each list that holds something.
        filled = np.flatnonzero(x)
        last = np.searchsorted(filled, ends[1:], "left") - 1
        stop = np.where(last >= 0, filled[np.maximum(last, 0)] + 1, 0) if len(filled) else np.zeros(len(ends) - 1, np.int64)
        stop = np.maximum(stop, ends[:-1])
        packed = [x[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), stop.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["id", "x"])


def packed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, x)`` of the usable rows, x as bytes: equal for equal vectors, a
    shorter one counting as filled up with zeros."""
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")))
    return given.mapInArrow(_pack, f"id {given.schema['id'].dataType.simpleString()}, x binary")


def _matrices(batches: Iterable[pa.RecordBatch], column: str, width: int) -> Matrices:
    """Rows of packed vectors as integer matrices, with their batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            rows = batch.column(column).to_pylist()
            out = np.zeros((len(rows), width), np.int64)
            if all(len(r) == 8 * width for r in rows):
                out[:] = np.frombuffer(b"".join(rows), "<i8").reshape(len(rows), width)
            else:
                for i, r in enumerate(rows):
                    out[i, : len(r) // 8] = np.frombuffer(r, "<i8")
            yield out, batch


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, batch in _matrices(batches, "x", width):
            high, low = x >> 26, x & ((1 << 26) - 1)  # sums of halves stay within 64 bits
            parts = [pa.array(np.arange(width)), pa.array(np.full(width, len(x))), pa.array(high.sum(0)), pa.array(low.sum(0))]
            yield pa.RecordBatch.from_arrays(parts, ["d", "n", "high", "low"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = fit.mapInArrow(run, "d long, n long, high long, low long").groupBy("d").agg(total("n").alias("n"), (total("high") * (1 << 26) + total("low")).alias("s")).collect()  # a row a dimension
    found = {r["d"]: r for r in rows}
    return int(rows[0]["n"]) if rows else 0, [int(found[d]["s"]) for d in range(width)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sum over dimensions of (n x - S)^2: in 64 bits where a bound shows
    that it fits, in Python's integers beyond."""
    if not x.size:
        return np.zeros(len(x), object)
    largest = n * int(max(-int(x.min()), int(x.max()))) + max(map(abs, sums))
    if largest * largest * x.shape[1] < 1 << 63:
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(1)
    d = x.astype(object) * n - np.array(sums, object)
    return (d * d).sum(1)


def _trace(fit: DataFrame, width: int, n: int, sums: list[int]) -> float:
    """trace(V) from the deviations, summed exactly within each matrix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _matrices(batches, "x", width):
            total = sum(_deviations(x, n, sums).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([total / n / n / n])], ["t"])

    return fit.mapInArrow(run, "t double").agg(F.sum("t")).first()[0] or 0.0


def _product(fit: DataFrame, mean: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """V Q, one pass: a task's sum in rows of a dimension each, added by Spark."""
    width, context = len(mean), fit.sparkSession.sparkContext

    def times(q: np.ndarray) -> np.ndarray:
        sent: Broadcast = context.broadcast((mean, q))
        k = q.shape[1]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, directions = sent.value
            out, n = np.zeros((width, k)), 0
            for x, _ in _matrices(batches, "x", width):
                c = x - centre
                out += c.T @ (c @ directions)
                n += len(x)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), *[pa.array(out[:, j]) for j in range(k)]], ["d", "n", *[f"q{j}" for j in range(k)]])

        schema = "d long, n long, " + ", ".join(f"q{j} double" for j in range(k))
        rows = fit.mapInArrow(run, schema).groupBy("d").agg(F.sum("n").alias("n"), *[F.sum(f"q{j}").alias(f"q{j}") for j in range(k)]).collect()  # a row a dimension
        sent.destroy()
        out = np.zeros((width, k))
        for r in rows:
            out[r["d"]] = [r[f"q{j}"] / r["n"] for j in range(k)]
        return out

    return times


def _orthogonal(block: np.ndarray, basis: np.ndarray, scale: float) -> np.ndarray:
    """The directions of ``block`` that are not within the basis, orthonormal."""
    kept = np.zeros((len(block), 0))
    for column in block.T:
        v = column.copy()
        for _ in range(2):
            v -= basis @ (basis.T @ v)
            v -= kept @ (kept.T @ v)
        size = np.linalg.norm(v)
        if size > VANISHED * scale:
            v /= size
            v -= basis @ (basis.T @ v)
            v -= kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept


def lanczos(times: Callable[[np.ndarray], np.ndarray], width: int, components: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, unit eigenvectors as columns, passes) of the
    symmetric non-negative operator ``times``: the ``components`` greatest."""
    random = np.random.default_rng(seed)
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    new = _orthogonal(random.standard_normal((width, min(block, width))), basis, 1.0)
    passes = 0
    while True:
        image = times(new)
        passes += 1
        basis, images = np.column_stack([basis, new]), np.column_stack([images, image])
        projected = basis.T @ images
        values, vectors = np.linalg.eigh((projected + projected.T) / 2)
        order = np.argsort(-values, kind="stable")[:components]
        top = max(float(values[order[0]]), 0.0)
        if basis.shape[1] >= width:
            break
        rest = image - basis @ (basis.T @ image)
        rest -= basis @ (basis.T @ rest)
        # Residual of a Ritz pair: what V adds to it outside the basis.
        ends = vectors[-new.shape[1] :, order]
        residual = np.linalg.norm(rest @ ends, axis=0)
        broken = np.linalg.norm(rest, axis=0).max(initial=0.0) <= VANISHED * top
        if not broken and len(order) == components and (residual <= tolerance * top).all():
            break
        room = min(block, width - basis.shape[1])
        new = _orthogonal(rest, basis, max(top, np.finfo(float).tiny))[:, :room]
        while new.shape[1] < room:  # breakdown: go on from random directions
            more = _orthogonal(random.standard_normal((width, room - new.shape[1])), np.column_stack([basis, new]), 1.0)
            new = np.column_stack([new, more])
    return np.maximum(values[order], 0.0), basis @ vectors[:, order], passes


def _identity_error(fit: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """Largest entry of |cov(whitened) - 1| over the fit list: counts, means and
    centred products of each matrix, merged pairwise."""
    k, width = axes.shape[1], len(mean)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, centre, spread = 0, np.zeros(k), np.zeros((k, k))
        for x, _ in _matrices(batches, "x", width):
            n, centre, spread = _merged(n, centre, spread, *_moments((x - mean) @ axes))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([centre.tolist()]), pa.array([spread.ravel().tolist()])], ["n", "m", "s"])

    n, centre, spread = 0, np.zeros(k), np.zeros((k, k))
    for r in fit.mapInArrow(run, "n long, m array<double>, s array<double>").collect():  # k (k + 1) numbers a task
        n, centre, spread = _merged(n, centre, spread, r["n"], np.array(r["m"]), np.array(r["s"]).reshape(k, k))
    return float(np.abs(spread / n - np.eye(k)).max(initial=0.0)) if n else 0.0


def _moments(w: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    centre = w.mean(0)
    c = w - centre
    return len(w), centre, c.T @ c


def _merged(n: int, a: np.ndarray, s: np.ndarray, m: int, b: np.ndarray, t: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    gap = b - a
    return n + m, a + gap * (m / (n + m)), s + t + np.outer(gap, gap) * (n * m / (n + m))


def _whiten(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for x, batch in _matrices(batches, "x", len(mean)):
            far = [int(d) if int(d) < 1 << 63 else None for d in _deviations(x, n, sums)]
            rows = np.repeat(np.arange(len(x)), k)
            columns = [
                batch.column("id").take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(rows), n)),
                pa.array(far, pa.int64()).take(pa.array(rows)),
                pa.array(((x - mean) @ axes).ravel()),
                pa.array(np.tile(explained, len(x))),
                pa.array(np.full(len(rows), error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained,
    identity_error)`` of each usable row and component.

    Rows whose vector is null or holds null or non-finite entries are dropped.
    The fit list is each distinct x-vector once; repeated rows and rows without
    an id are whitened like others.  A shorter vector counts as filled up with
    zeros; entries are kept within +-2^53 after scaling.  There are as many
    components as V has variances above rounding, ``components`` at most: none
    for an empty table, a single distinct vector or empty vectors, whose result
    is empty.  Eigenvalues that tie have any orthonormal axes of their space,
    the same for all rows.  A deviation beyond 64 bits is null.  Columns of other names are
    not looked at.
    """
    spark: SparkSession = vectors.sparkSession
    rows = materialise(packed(vectors, id_col, vector_col), "whiten-rows")
    fit = materialise(rows.select("x").distinct(), "whiten-fit")
    schema = f"vec_id {rows.schema['id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    width = (fit.agg(F.max(F.octet_length("x"))).first()[0] or 0) // 8
    if not width:
        return spark.createDataFrame([], schema)
    n, sums = _sums(fit, width)
    mean = np.array([s / n for s in sums])
    trace = _trace(fit, width, n, sums)
    if not trace > 0:
        return spark.createDataFrame([], schema)
    values, axes, _ = lanczos(_product(fit, mean), width, min(components, width))
    real = values > NO_VARIANCE * values[0]
    values, axes = values[real], axes[:, real] / np.sqrt(values[real])
    error = _identity_error(fit, mean, axes)
    return rows.mapInArrow(_whiten(n, sums, mean, axes, values / trace, error), schema)
