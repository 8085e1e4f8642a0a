"""Hidden Markov language model over the whole corpus.

A text is its words (runs without white space, A-Z lower-cased) and one end
token.  The model has ``states`` latent states over ``2**bucket_bits`` hashed
word classes plus a class of its own for the end; a word's share of its class
comes from exact corpus counts, so the vocabulary has no bound:

    p(word | state) = p(class | state) * (c + 1) / (C + V + 1)

with c the word's training count and C, V the tokens and distinct words of its
class (the spare 1 is the class's unknown word).

1. One pass tokenises chunks of about ``CHUNK_BYTES`` into local word ids and
   writes them, each chunk's dictionary (hash, training count) beside them.
2. Dictionaries alone are summed by word; the sums go back by chunk.
3. Baum-Welch: a start from a bounded sample of texts, then full passes over
   all training texts until the likelihood stands still; each partition adds up
   its expected counts, exact over whole texts of any length (``chains``), and
   only those matrices are combined.
4. Chunks meet their counts, and the scaled forward recursion gives the exact
   likelihood of every sequence.

Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import bytewords as bw
from plumbline.llm import chains
from plumbline.scratch import materialise

#: Text bytes that share a dictionary.
CHUNK_BYTES = 8 << 20
#: Chunks of one task when texts meet their counts.
TASK_CHUNKS = 8
BUCKET_BITS = 12
STATES = 6
#: Full passes over all training texts go on until one gains less than so much
#: natural log-likelihood a token.
GAIN = 0.002
#: Texts of the sample that the start is fitted on, the least passes over it and
#: the gain that ends them after those: the first passes gain little, before the
#: states have come apart.
START_TEXTS, START_PASSES, START_GAIN = 400, 60, 0.001
START_MAX_BYTES = 20_000
EMIT_PRIOR, MOVE_PRIOR = 0.05, 1.0
#: The end token's place in a dictionary.
END_HASH = np.uint64(0x0E0D0F7E87000001)

_STORED = "kind int, chunk long, doc_id string, held_out boolean, n_tokens long, ids binary, classes binary, word array<long>, seen array<int>"


# ---------------------------------------------------------------- tokens
def class_of(word: np.ndarray, bits: int = BUCKET_BITS) -> np.ndarray:
    return np.where(word == END_HASH, 1 << bits, (word >> np.uint64(64 - bits)).astype(np.int64)).astype(np.int32)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end token after each, and n + 1 bounds."""
    low, starts, ends, first = bw.white_words(data, offsets)
    words = bw.run_hashes(low, starts, ends)
    bounds = first + np.arange(len(first))
    out = np.full(bounds[-1], END_HASH, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[bounds[1:] - 1] = False
    out[is_word] = words
    return out, bounds


def _planes(ids: np.ndarray) -> bytes:
    """The ids' bytes plane by plane, which compresses better."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _tokenise(bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made
            words = np.concatenate([x[2] for x in held])
            lengths = np.concatenate([np.diff(x[3]) for x in held])
            out = np.concatenate([x[1] for x in held])
            known, ids, counts = np.unique(words, return_inverse=True, return_counts=True)
            order = np.argsort(-counts, kind="stable")  # small ids for frequent words
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            ids, known = rank[ids], known[order]
            seen = np.bincount(ids[np.repeat(~out, lengths)], minlength=len(known))
            classes = class_of(words, bits).astype("<u2")
            chunk, made = base | made, made + 1
            ends = np.cumsum(lengths)
            doc_ids = [x for part in held for x in part[0].to_pylist()]
            rows = [(0, chunk, d, bool(o), int(n), _planes(ids[e - n : e]), None if o else classes[e - n : e].tobytes(), None, None) for d, o, n, e in zip(doc_ids, out, lengths, ends, strict=True)]
            for lo in range(0, len(rows), 1000):
                yield _batch(rows[lo : lo + 1000])
            yield _batch([(1, chunk, None, None, None, None, None, known.view(np.int64), seen.astype(np.int32))])
            held.clear()

        size = 0
        for part, data, offsets in bw.text_groups(batches):
            words, bounds = tokens(data, offsets)
            held.append((part.column(0), part.column(1).to_numpy(zero_copy_only=False).astype(bool), words, bounds))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return run


_ARROW = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("classes", pa.binary()), ("word", pa.list_(pa.int64())), ("seen", pa.list_(pa.int32()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


# ---------------------------------------------------------------- the model
@dataclass
class Model:
    """Start, transition (states x states) and emission (classes x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def seeded(states: int, classes: int, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        emit = rng.uniform(0.5, 1.5, (classes, states))
        move = rng.uniform(0.5, 1.5, (states, states)) + 2 * np.eye(states)
        return Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + MOVE_PRIOR, move + MOVE_PRIOR, emit + EMIT_PRIOR
        return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _by_length(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequences from longest to shortest, and how many run at each step."""
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths[order[0]]) if len(order) else 0
    return order, len(lengths) - np.searchsorted(np.sort(lengths), np.arange(top), "right")


def forward(model: Model, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log-likelihood of each sequence by the scaled recursion, all
    sequences of the call in lockstep."""
    lengths = np.diff(bounds)
    order, running = _by_length(lengths)
    out = np.zeros(len(lengths))
    total = np.zeros(len(lengths))
    at = bounds[:-1][order]
    state = np.broadcast_to(model.start, (len(order), len(model.start)))
    for t, n in enumerate(running):
        state = (state[:n] @ model.move if t else state[:n]) * model.emit[symbols[at[:n] + t]]
        scale = state.sum(axis=1)
        state = state / scale[:, None]
        total[:n] += np.log(scale)
    out[order] = total
    return out


def expected_counts(model: Model, symbols: np.ndarray, bounds: np.ndarray, width: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """One E-step: expected start, transition and emission counts, and the
    log-likelihood."""
    k = len(model.start)
    emit = np.zeros_like(model.emit)

    def count(places: np.ndarray, p: np.ndarray) -> None:
        seen = symbols[places]
        for s in range(k):
            emit[:, s] += np.bincount(seen, p[:, s], len(emit))

    start, move, log = chains.expected(lambda lo, hi: model.emit[symbols[lo:hi]], model.move, model.start, bounds, count, width)
    return start, move, emit, log


def _pass_over(model: Model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = None, [], 0

        def add() -> None:
            nonlocal total, held, size
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in held])])
            got = expected_counts(model, np.concatenate(held).astype(np.int64), bounds)
            total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            held, size = [], 0

        for batch in batches:
            for raw in batch.column(0):
                held.append(np.frombuffer(raw.as_buffer(), "<u2"))
                size += len(held[-1])
                if size > 1 << 19:
                    add()
        if held:
            add()
        if total is not None:
            flat = np.concatenate([np.ravel(x) for x in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "x"])

    return run


def baum_welch_pass(model: Model, texts: DataFrame) -> tuple[Model, float]:
    """One full pass, and the log-likelihood before it: every partition sends
    one vector of expected counts; the vectors are added up by Spark and only
    their sum, whose size is fixed by the model, comes to the driver."""
    k, n = len(model.start), len(model.emit)
    rows = texts.select("classes").mapInArrow(_pass_over(model), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    flat = np.zeros(k + k * k + n * k + 1)
    flat[rows.column("i").to_numpy()] = rows.column("x").to_numpy()
    return Model.from_counts(flat[:k], flat[k : k + k * k].reshape(k, k), flat[k + k * k : -1].reshape(n, k)), float(flat[-1])


def fit_start(sequences: list[np.ndarray], states: int, classes: int, passes: int = START_PASSES, gain: float = START_GAIN) -> Model:
    """A starting point from a bounded sample, on the driver."""
    model, last = Model.seeded(states, classes), -np.inf
    if not sequences:
        return model
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in sequences])])
    symbols = np.concatenate(sequences).astype(np.int64)
    made = 0
    while True:
        *counts, log = expected_counts(model, symbols, bounds)
        model, made = Model.from_counts(*counts), made + 1
        if made >= passes and log - last < gain * len(symbols):
            return model
        last = log


def fit(texts: DataFrame, start: Model, tokens: int, gain: float = GAIN) -> tuple[Model, list[float]]:
    """Full passes until one gains less than ``gain`` a token; the model, and
    the log-likelihood that each pass saw, natural and a token.  A pass never
    loses and the likelihood is bounded, so this ends."""
    model, seen = start, []
    while len(seen) < 2 or seen[-1] - seen[-2] >= gain:
        model, log = baum_welch_pass(model, texts)
        seen.append(log / max(tokens, 1))
    return model, seen


# ---------------------------------------------------------------- scoring
def _score(model: Model, bits: int, per_class: np.ndarray, unseen: float) -> Callable:
    log_share = np.log10(per_class)

    def run(_key: tuple, texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        place = words["at"].to_numpy()
        count = np.zeros(len(place), np.int64)
        count[place] = words["c"].to_numpy()
        cls = np.zeros(len(place), np.int64)
        cls[place] = words["class"].to_numpy()
        log_count = np.log10(count + 1.0)
        ids = [_from_planes(x) for x in texts["ids"]]
        parts = []
        lo = 0
        while lo < len(ids):
            hi, size = lo, 0
            while hi < len(ids) and (hi == lo or size + len(ids[hi]) <= 1 << 20):
                size += len(ids[hi])
                hi += 1
            flat = np.concatenate(ids[lo:hi])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids[lo:hi]])])
            symbols = cls[flat]
            share = np.where(symbols == 1 << bits, 0.0, log_count[flat] - log_share[symbols])
            base = bw.sums(log_count[flat], bounds) - np.diff(bounds) * unseen
            score = forward(model, symbols, bounds) / np.log(10) + bw.sums(share, bounds)
            parts.append((bw.sums(count[flat] > 0, bounds), base, score))
            lo = hi
        known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame({"doc_id": texts["doc_id"], "held_out": texts["held_out"].astype(bool), "n_tokens": texts["n_tokens"].astype("int64"), "n_known": known, "base_score": base, "score": score})

    return run


def word_counts(words: DataFrame) -> DataFrame:
    """``(word, c)``: training uses of every word over all chunks, added up
    within each partition first."""
    return words.groupBy("word").agg(F.sum("seen").alias("c"))


def hmm_scores(docs: DataFrame, held_out: object, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """Train on the rows where the column ``held_out`` is false and score all.

    Result: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, train_passes, train_log10``, one row per row of ``docs``.
    ``base_score`` is the add-one unigram log10 probability, ``score`` the
    model's; ``train_log10`` is the class sequences' log10 likelihood a token
    before the last of ``train_passes`` passes.  A null text is empty (an end
    token alone); a null ``held_out`` counts as false; repeated rows are scored,
    and counted in training, each; null ids are kept, ids keep their type; an
    empty table gives an empty result; with no training rows all words are
    unknown and the start model is used.  Columns of other names are not looked
    at.
    """
    spark = docs.sparkSession
    classes = (1 << bucket_bits) + 1
    given = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    stored = materialise(given.mapInArrow(_tokenise(bucket_bits), _STORED), "hmm-tokens")
    texts, dictionaries = stored.filter("kind = 0"), stored.filter("kind = 1")

    # A word has a row for each chunk it is in, not for each use; the join with
    # its sum is one that adaptive execution splits for words of all chunks.
    words = dictionaries.select("chunk", F.posexplode(F.arrays_zip("word", "seen")).alias("at", "w")).select("chunk", "at", F.col("w.word").alias("word"), F.col("w.seen").alias("seen"))
    of = F.when(F.col("word") == F.lit(int(END_HASH)), 1 << bucket_bits).otherwise(F.shiftrightunsigned("word", 64 - bucket_bits).cast("int"))
    sums = materialise(word_counts(words).withColumn("class", of), "hmm-counts")
    rows = sums.filter("c > 0").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toArrow()  # at most 2**bits + 1 rows
    n, v = np.zeros(classes), np.zeros(classes)
    n[rows.column("class").to_numpy()] = rows.column("n").to_numpy()
    v[rows.column("class").to_numpy()] = rows.column("v").to_numpy()
    total, distinct = int(n.sum()), int(v.sum())

    training = texts.filter(~F.col("held_out"))
    sample = training.filter(F.col("n_tokens") <= START_MAX_BYTES // 4).select("doc_id", "classes").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("classes")).limit(START_TEXTS).toArrow()
    model = fit_start([np.frombuffer(x.as_buffer(), "<u2") for x in sample.column("classes")], states, classes)
    model, seen = fit(training, model, total) if total else (model, [])
    made, reached = len(seen), seen[-1] if seen else 0.0

    schema = T.StructType([T.StructField(*x) for x in (("doc_id", T.StringType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dictionaries.count() // TASK_CHUNKS))
    counted = words.select("chunk", "at", "word").join(sums, "word").select(F.col("chunk").alias("in_chunk"), "at", "c", "class").repartition(tasks, "in_chunk")
    scored = (
        texts.select("chunk", "doc_id", "held_out", "n_tokens", "ids")
        .repartition(tasks, "chunk")
        .groupBy("chunk")
        .cogroup(counted.groupBy("in_chunk"))
        .applyInPandas(_score(model, bucket_bits, n + v + 1, float(np.log10(total + distinct + 1))), schema)
    )
    return scored.select(
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        F.lit(made).alias("train_passes"),
        F.lit(reached / float(np.log(10))).alias("train_log10"),
    )
