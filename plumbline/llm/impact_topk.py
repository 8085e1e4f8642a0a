"""Exact top-k by inner product with an impact-ordered, score-at-a-time index.

Components become integers, floor(256 x).  Blocks of vectors are indexed by
posting segments: for each dimension and sign, the vectors whose component's
size lies in one of ``LEVELS`` quantised impact levels.  A query takes the
segments of all dimensions by descending |q_d| * impact and adds each posting's
contribution to its accumulator.  After each share of the segments, what is
still missing is bounded: in each dimension no open segment exceeds the next
level.  Vectors whose upper bound is below the k-th best lower bound are out.
Processing stops when that proof leaves few enough possible members, or when
all segments are done; the possible members are then scored exactly.

Queries go to the blocks in batches of bounded size, a Spark broadcast of
``BATCH_BYTES``; there is one pass over the vectors for each batch, and a block's
index serves all queries of the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.scratch import materialise

SCALE = 256.0
LEVELS = 8
#: Vectors of an index block; bytes of a broadcast batch of queries, which at 64
#: components are 65,536 of them.
BLOCK, BATCH_BYTES = 16_384, 32 << 20
#: Posting segments between two attempts at a proof.
SEGMENTS_BETWEEN_PROOFS = 48
#: A proof that leaves at most so many possible members ends the processing.
ENOUGH = 256


class Block:
    """The index of some vectors (rows of an integer matrix, ids ascending)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order].astype(np.float64)
        size = np.abs(self.vectors)
        top = size.max(axis=0, initial=0.0)
        # Level l holds sizes in (edge[l + 1], edge[l]]; zero has no posting.
        self.edges = top * np.arange(levels, -1, -1)[:, None] / levels
        self.segments: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # dimension, level, rows, signed values
        for d in range(self.vectors.shape[1]):
            x = size[:, d]
            rows = np.flatnonzero(x)
            level = np.searchsorted(-self.edges[:, d], -x[rows], "right") - 1
            level = np.clip(level, 0, levels - 1)
            by = np.argsort(level, kind="stable")
            cuts = np.searchsorted(level[by], np.arange(levels + 1))
            for lv in range(levels):
                part = rows[by[cuts[lv] : cuts[lv + 1]]]
                if len(part):
                    self.segments.append((d, lv, part, self.vectors[part, d]))
        self.dimension = np.array([s[0] for s in self.segments], np.int64)
        self.level = np.array([s[1] for s in self.segments], np.int64)

    def top(self, query: np.ndarray, k: int, skip: int | None, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best, ties to the smaller id; of those
        only that reach ``least``, which the k best of other blocks may set."""
        n = len(self.ids)
        alive = np.ones(n, bool)
        if skip is not None:
            alive[self.ids == skip] = False
        want = min(k, int(alive.sum()))
        if want == 0:
            return np.zeros(0, np.int64), np.zeros(0)
        q = np.abs(query)
        open_edge = self.edges[0].copy()  # largest size still open in each dimension
        impact = q[self.dimension] * self.edges[self.level, self.dimension]
        score = np.zeros(n)
        members = np.flatnonzero(alive)
        order = np.argsort(-impact, kind="stable")
        order = order[impact[order] > 0]
        for done in range(0, len(order), SEGMENTS_BETWEEN_PROOFS):
            for s in order[done : done + SEGMENTS_BETWEEN_PROOFS].tolist():
                d, lv, rows, values = self.segments[s]
                score[rows] += query[d] * values
                open_edge[d] = self.edges[lv + 1, d]
            rest = float(q @ open_edge)
            here = score[members]
            bound = least if len(here) < want else max(least, np.partition(here, len(here) - want)[len(here) - want] - rest)
            members = members[here + rest >= bound]
            if len(members) <= max(ENOUGH, k):
                break
        exact = self.vectors[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:want]
        best = best[exact[best] >= least]
        return self.ids[members[best]], exact[best]


def _search(asked: Broadcast[tuple[np.ndarray, np.ndarray]], k: int) -> Callable:
    """The k best of a partition's vectors for every query.  What the blocks so
    far have found is the mark that members of the next one must reach."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = asked.value
        width = queries.shape[1]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)

        def search(held: list[pa.RecordBatch]) -> None:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            block = Block(ids, np.concatenate([matrix(b.column(1), width) for b in held]))
            for i, (qid, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
                old_ids, old = best[i]
                found, score = block.top(query, k, qid, old[-1] if len(old) == k else -np.inf)
                if len(found):
                    found, score = np.concatenate([old_ids, found]), np.concatenate([old, score])
                    order = np.lexsort((found, -score))[:k]
                    best[i] = found[order], score[order]

        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, BLOCK - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == BLOCK:
                    search(held)
                    held, size = [], 0
        if held:
            search(held)
        many = [len(x) for x, _ in best]
        if sum(many):
            flat = [np.repeat(query_ids, many), *(np.concatenate(x).astype(np.int64) for x in zip(*best, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in flat], ["query_id", "vec_id", "score"])

    return run


def matrix(rows: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros, or cut, to ``width``."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    flat, n = rows.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(rows).to_numpy(zero_copy_only=False).astype(np.int64)
    if (n == width).all():
        return flat.reshape(len(n), width).astype(np.float64)
    out = np.zeros((len(n), width))
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    out[row[at < width], at[at < width]] = flat[at < width]
    return out


def integers(embedding: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as a double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """Not null and without null or non-finite components."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(odd, F.lit(True))


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best of all other
    rows by integer inner product, ties to the smaller id.

    Vectors that are null or hold null or non-finite components take no part,
    nor do rows without an id; a shorter vector counts as filled with zeros.
    Ids are numbers and taken to be unique; rows that repeat an id are answers
    of their own but never to a query of that id, and of several queries of one
    id the smallest vector asks.  An empty table gives an empty
    result; columns of other names are not looked at.
    """
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    index = materialise(given.filter(F.col("vec_id").isNotNull() & usable(F.col("v"))).select("vec_id", integers(F.col("v")).alias("v"), "q"), "topk-vectors")
    spark = index.sparkSession
    widest = index.filter("q").agg(F.max(F.size("v"))).first()[0] or 1
    batch = max(1, batch_bytes // (8 * max(1, widest)))
    parts, after = [], None
    while True:
        # The next batch of queries by id: bounded, whatever their number.  Its
        # answers, at most k a query and task, are written before the next.
        asked = index.filter("q") if after is None else index.filter(F.col("q") & (F.col("vec_id") > after))
        rows = asked.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(batch).toArrow()
        if not rows.num_rows:
            break
        ids = rows.column("vec_id").to_numpy()
        asked = spark.sparkContext.broadcast((ids, matrix(rows.column("v"), int(pc.max(pc.list_value_length(rows.column("v"))).as_py()))))
        parts.append(materialise(index.select("vec_id", "v").mapInArrow(_search(asked, k), "query_id long, vec_id long, score long"), "topk-answers"))
        asked.destroy()
        after = int(ids[-1])
        if rows.num_rows < batch:
            break
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = reduce(DataFrame.unionByName, parts)
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL of op6 over the view ``embeddings``.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
