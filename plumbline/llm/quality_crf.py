"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's evidence is a vector of surface features of
the line itself and of the lines before and after it; neighbouring labels are
tied by transition weights.  Labels are known for documents only, so lines start
with their document's label, and after a first fit those lines of bad documents
that the model finds good are relabelled and the field is fitted again.

The forward-backward marginals, weighted by line length, give the share of a
document's text that is good; a logistic map fitted on the training documents
turns it into a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewords as bw
from plumbline.llm import chains
from plumbline.llm.rows import text_of, type_of
from plumbline.scratch import materialise

#: Bounds of the training sample: documents, and bytes and lines of one.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_LINES = 4_000, 32_000, 500
#: Lines whose features are made at a time.
LINES = 65_536
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Lines of bad documents at least this surely good are relabelled.
RELABEL = 0.9
THRESHOLD = 0.3

_IS = {name: np.zeros(256, bool) for name in ("upper", "letter", "digit", "space", "stop", "symbol", "bar", "bang")}
_IS["upper"][65:91] = True
_IS["letter"][[*range(65, 91), *range(97, 123)]] = True
_IS["letter"][0xC3] = True  # lead byte of most accented Latin letters
_IS["digit"][48:58] = True
_IS["space"][:] = bw.WHITE
_IS["stop"][list(b".,;:?'\"-()")] = True
_IS["bar"][ord("|")] = True
_IS["bang"][ord("!")] = True
_IS["symbol"][list(b"*$%&#@^~=<>+\\/{}[]_`")] = True
FEATURES = ("length", "upper", "digits", "spaces", "stops", "symbols", "bars", "bangs", "symbol_words", "repeats", "word_length", "closed", "opened", "empty", "seen", "only")


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, and the n + 1 bounds of the texts among
    them.  Every text has a line at least, an empty one if it is empty."""
    breaks = np.flatnonzero(data == 10)
    count = np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1
    bounds = np.concatenate([[0], np.cumsum(count)])
    starts, ends = np.empty(bounds[-1], np.int64), np.empty(bounds[-1], np.int64)
    first, last = np.zeros(bounds[-1], bool), np.zeros(bounds[-1], bool)
    first[bounds[:-1]] = last[bounds[1:] - 1] = True
    starts[first], starts[~first] = offsets[:-1], breaks + 1
    ends[last], ends[~last] = offsets[1:], breaks
    return starts, ends, bounds


def own_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Feature rows of consecutive lines from their bytes alone; the last two
    columns, which need the whole text, stay zero."""
    base, stop = int(starts[0]), int(ends[-1])
    data, starts, ends = data[base:stop], starts - base, ends - base
    length = (ends - starts).astype(np.float32)
    per = np.maximum(length, 1)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return (total[ends] - total[starts]).astype(np.float32)

    n = len(starts)
    counts = {k: count(v[data]) for k, v in _IS.items()}
    ws, we, first = bw.spans(~bw.WHITE[data], np.append(starts, len(data)))
    hashes = bw.run_hashes(data, ws, we)
    words = np.diff(first).astype(np.float32)
    line = np.repeat(np.arange(n), np.diff(first))
    odd = _IS["symbol"] | _IS["bar"]
    symbol_words = np.bincount(line[odd[data[we - 1]]], minlength=n)
    again = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[1:][again], minlength=n)
    some = length > 0
    tail, head = np.zeros(n, bool), np.zeros(n, bool)
    tail[some] = np.isin(data[ends[some] - 1], list(b".!?"))
    head[some] = _IS["upper"][data[starts[some]]]
    many = np.maximum(words, 1)
    out = np.zeros((n, len(FEATURES)), np.float32)
    columns = (
        np.log1p(length) / 8,
        counts["upper"] / np.maximum(counts["letter"], 1),
        *(counts[k] / per for k in ("digit", "space", "stop", "symbol", "bar", "bang")),
        symbol_words / many,
        repeats / many,
        np.minimum(length / many, 40) / 20,
        tail,
        head,
        ~some,
    )
    for k, x in enumerate(columns):
        out[:, k] = x
    return out


class Lines:
    """The lines of some texts and their own features, made ``LINES`` at a
    time.  Neighbours' features are those of the line before or after, zero
    beyond a text's ends; they are read in place, never copied."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data = data
        self.starts, self.ends, self.bounds = lines_of(data, offsets)
        n = len(self.starts)
        self.first, self.last = np.zeros(n, bool), np.zeros(n, bool)
        self.first[self.bounds[:-1]] = self.last[self.bounds[1:] - 1] = True
        # A line that stands earlier in its text.
        key = bw.run_hashes(data, self.starts, self.ends) ^ bw.mix(np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds)).astype(np.uint64))
        order = np.argsort(key, kind="stable")
        self.seen = np.zeros(n, bool)
        self.seen[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.length = (self.ends - self.starts + 1).astype(np.float64)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        for lo in range(0, len(self.starts), LINES):
            hi = min(lo + LINES, len(self.starts))
            own = own_features(self.data, self.starts[lo:hi], self.ends[lo:hi])
            own[:, -2] = self.seen[lo:hi] & (self.length[lo:hi] > 1)
            own[:, -1] = self.first[lo:hi] & self.last[lo:hi]
            yield lo, hi, own

    def evidence(self, weight: np.ndarray) -> np.ndarray:
        """What the weights (own, previous and next line's features, first,
        last, constant) say of every line."""
        own, before, after, edge = _split(weight)
        n = len(self.starts)
        out = edge[0] * self.first + edge[1] * self.last + edge[2]
        told = np.empty((n, 2))
        for lo, hi, x in self.parts():
            out[lo:hi] += x @ own
            told[lo:hi, 0], told[lo:hi, 1] = x @ before, x @ after
        out[1:] += np.where(self.first[1:], 0, told[:-1, 0])
        out[:-1] += np.where(self.last[:-1], 0, told[1:, 1])
        return out


def _split(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    k = len(FEATURES)
    return weight[:k], weight[k : 2 * k], weight[2 * k : 3 * k], weight[3 * k :]


def gathered(own: np.ndarray, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The sum over all lines of their features times a value of each."""
    before = (np.where(first[1:], 0, value[1:])) @ own[:-1]
    after = (np.where(last[:-1], 0, value[:-1])) @ own[1:]
    return np.concatenate([value @ own, before, after, [value[first].sum(), value[last].sum(), value.sum()]])


def marginals(evidence: np.ndarray, move: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of every line by scaled forward-backward, exact over texts of any
    number of lines, and the expected counts of label pairs (bad/good x
    bad/good)."""
    good = np.empty(len(evidence))

    def potentials(lo: int, hi: int) -> np.ndarray:
        return np.exp(np.stack([np.zeros(hi - lo), np.clip(evidence[lo:hi], -30, 30)], axis=1))

    def keep(places: np.ndarray, p: np.ndarray) -> None:
        good[places] = p[:, 1]

    _, pairs, _ = chains.expected(potentials, np.exp(np.clip(move, -15, 15)), np.ones(2), bounds, keep)
    return good, pairs


@dataclass
class Field:
    weight: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def good_share(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length-weighted share of good text, line marginals, line bounds."""
        lines = Lines(data, offsets)
        good, _ = marginals(lines.evidence(self.weight), self.move, lines.bounds)
        return bw.sums(good * lines.length, lines.bounds) / bw.sums(lines.length, lines.bounds), good, lines.bounds

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.squash(self.good_share(data, offsets)[0])

    def squash(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(share) + self.offset, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class _Sample:
    """Own features of the sample's lines, and what centres and scales the
    features that the model sees."""

    def __init__(self, texts: list[str]) -> None:
        data, offsets = bw.string_buffers(pa.array(texts, pa.large_string()))
        parts = [Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in bw.groups(offsets)]
        self.own = np.concatenate([x for p in parts for _, _, x in p.parts()])
        self.first, self.last, self.length = (np.concatenate([getattr(p, k) for p in parts]) for k in ("first", "last", "length"))
        self.bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.bounds) for p in parts]))])
        one = np.ones(len(self.own))
        self.center = gathered(self.own, self.first, self.last, one) / len(one)
        square = gathered(self.own * self.own, self.first, self.last, one) / len(one)
        self.spread = np.sqrt(np.maximum(square - self.center**2, 0))
        self.center[-1], self.spread[self.spread < 1e-6] = 0.0, 1.0

    def raw(self, theta: np.ndarray) -> np.ndarray:
        """Weights of the features as they are, from those of scaled ones."""
        weight = theta / self.spread
        weight[-1] -= self.center @ weight
        return weight

    def evidence(self, theta: np.ndarray) -> np.ndarray:
        own, before, after, edge = _split(self.raw(theta))
        out = self.own @ own + edge[0] * self.first + edge[1] * self.last + edge[2]
        out[1:] += np.where(self.first[1:], 0, self.own[:-1] @ before)
        out[:-1] += np.where(self.last[:-1], 0, self.own[1:] @ after)
        return out

    def slope(self, value: np.ndarray) -> np.ndarray:
        return (gathered(self.own, self.first, self.last, value) - self.center * value.sum()) / self.spread


def _fit_lines(sample: _Sample, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the conditional log-likelihood of the line labels."""
    at = np.flatnonzero(~sample.first)
    observed = np.bincount(2 * y[at - 1] + y[at], minlength=4).reshape(2, 2)
    theta = np.zeros(len(sample.center) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pairs = marginals(sample.evidence(theta[:-4]), theta[-4:].reshape(2, 2), sample.bounds)
        slope = np.concatenate([sample.slope(y - good), (observed - pairs).ravel()]) / len(y) - RIDGE * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta[:-4], theta[-4:].reshape(2, 2)


def train(texts: list[str], quality: list[int]) -> Field:
    """Fit field and logistic map on whole texts and their labels (0 or 1)."""
    sample, answer = _Sample(texts), np.asarray(quality, np.int64)
    y = np.repeat(answer, np.diff(sample.bounds))
    weight, move = _fit_lines(sample, y)
    good, _ = marginals(sample.evidence(weight), move, sample.bounds)
    weight, move = _fit_lines(sample, np.where(good >= RELABEL, 1, y))
    field = Field(sample.raw(weight), move)
    good, _ = marginals(sample.evidence(weight), move, sample.bounds)
    z = _logit(bw.sums(good * sample.length, sample.bounds) / bw.sums(sample.length, sample.bounds))
    a, b = 1.0, 0.0
    for _ in range(200):  # Newton steps of a two-parameter logistic regression
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = p * (1 - p) + 1e-6
        g = np.array([((answer - p) * z).sum() - 0.1 * (a - 1), (answer - p).sum() - 0.1 * b])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -0.5, 0.5), b + np.clip(step[1], -0.5, 0.5)
    field.slope, field.offset = max(float(a), 0.05), float(b)
    return field


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column, docs_bound: int = SAMPLE_DOCS, bytes_bound: int = SAMPLE_BYTES, lines_bound: int = SAMPLE_LINES) -> Field | None:
    """Fit on a bounded sample: of the labelled ids whose text has at most
    ``bytes_bound`` bytes and ``lines_bound`` lines, the ``docs_bound`` of
    smallest hash, one text an id (that of the smallest hash).  ``docs`` has
    doc_id and text; ``labels`` doc_id and quality (of several the smallest);
    ``may_learn`` is a condition on the labels' doc_id.  None without a
    labelled text."""
    given = labels.filter(may_learn & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    lines = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    short = docs.filter((F.octet_length("text") <= bytes_bound) & (lines <= lines_bound)).withColumn("h", F.xxhash64("text"))
    chosen = short.select("doc_id", "h").join(given, "doc_id").groupBy("doc_id").agg(F.min("h").alias("h"), F.min("quality").alias("quality"))
    chosen = materialise(chosen.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(docs_bound), "quality-sample")
    rows = short.join(F.broadcast(chosen), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("quality").alias("quality")).toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    return train(rows.column("text").to_pylist(), rows.column("quality").to_pylist()) if rows.num_rows else None


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))


def _score(field: Field | None) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in bw.text_groups(batches):
            if field is None:
                score = share = np.full(part.num_rows, 0.5)
                lines = bad = np.zeros(part.num_rows, np.int64)
            else:
                share, good, bounds = field.good_share(data, offsets)
                score, lines, bad = field.squash(share), np.diff(bounds), bw.sums(good < 0.5, bounds)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(share), pa.array(lines), pa.array(bad)], ["doc_id", "score", "good_share", "n_lines", "n_bad_lines"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, good_share, n_lines, n_bad_lines)``, one row per row
    of ``docs``.

    A null text is empty; an empty text is one empty line and gets a score.
    Without labelled texts every score is 0.5.  An empty table gives an empty
    result; repeated rows get equal scores; a null id is kept, ids keep their
    type; columns of other names are not looked at.  A text is handled whole
    whatever its length and lines, in memory that grows with its bytes only.
    """
    given = _given(docs, id_col, text_col)
    return given.mapInArrow(_score(fit(given, labels, may_learn)), f"doc_id {type_of(docs, id_col)}, score double, good_share double, n_lines long, n_bad_lines long")


def keep_good(docs: DataFrame, labels: DataFrame, may_learn: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score is below the
    threshold; rows are filtered where they are read, nothing is shuffled.
    Cases are as in ``score_quality``; without labelled texts all rows stay."""
    field = fit(_given(docs, id_col, text_col), labels, may_learn)
    if field is None:
        return docs

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in bw.text_groups(batches, text_col):
            yield part.filter(pa.array(field.scores(data, offsets) >= threshold))

    return docs.mapInArrow(run, docs.schema)
