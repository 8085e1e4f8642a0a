"""Language identification by averaged hashed subword embeddings.

Character n-grams (as UTF-8 bytes, lower-cased, with word boundaries) are hashed
to embeddings; a text is the average of its n-grams' embeddings, and a linear
softmax names the language.  Embeddings and softmax are trained together by
stochastic gradient descent in numpy on a bounded sample of labelled texts.
Probabilities are calibrated by a temperature on texts of the sample that were
not trained on.  Two rejection levels are set there: a probability, and a
familiarity, the share of a text's n-grams that the training texts of the
answered language hold.  A softmax is sure of texts in languages it never saw,
so the second level parts those held-back texts from the same texts answered
without their own language.

As the softmax is linear, a bucket's embedding times the weights gives fixed
logits, and a text's logits are the mean of its n-grams' logits.  These are used
where there are fewer languages than dimensions, the embeddings elsewhere, so the
model stays small for any number of languages; it reaches the tasks as a Spark
broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bytewords as bw
from plumbline.llm.rows import type_of
from plumbline.scratch import discard, materialise

BUCKET_BITS = 16
DIMENSIONS = 16
NGRAMS = (2, 3, 4)
#: Bounds of the sample: texts of a language, bytes of a text that may be drawn,
#: bytes of all texts, shared evenly among the languages; languages that the
#: model can hold.
SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_TOTAL, MAX_LANGUAGES = 400, 20_000, 16 << 20, 1_000
EPOCHS, RATE = 12, 0.5
#: Share of right answers asked for among the texts that are not rejected.
PRECISION = 0.995
UNKNOWN = "und"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = _ASCII_LETTER.copy()
_LETTER[128:] = True


def ngrams(data: np.ndarray, offsets: np.ndarray, bits: int = BUCKET_BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: buckets of all n-grams of all texts, and the n + 1
    bounds of the texts among them.  Bytes that are no letters count as one
    boundary sign; n-grams lie within a text and hold no two boundaries in a
    row."""
    low = np.where(_LETTER[data], bw.LOWER[data], 32).astype(np.uint8)
    value = bw.BYTE_VALUE[low]
    blank = low == 32
    pair = np.zeros(len(low), bool)  # a boundary right after a boundary
    pair[1:] = blank[1:] & blank[:-1]
    pairs = np.concatenate([[0], np.cumsum(pair)])
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for n in NGRAMS:
        m = len(low) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
            continue
        h = np.zeros(m, np.uint64)
        for i in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + value[i : i + m]
        good = (text_of[:m] == text_of[n - 1 :]) & (pairs[n : n + m] == pairs[1 : 1 + m])
        at = np.flatnonzero(good)
        yield (bw.mix(h[at]) >> np.uint64(64 - bits)).astype(np.int64), np.searchsorted(at, offsets)


@dataclass
class Model:
    languages: list[str]
    embed: np.ndarray  # buckets x dimensions
    weight: np.ndarray  # dimensions x languages
    bias: np.ndarray
    known: np.ndarray  # buckets x languages, a bit each: whether training texts hold it
    temperature: float = 1.0
    reject_below: float = 0.0
    unfamiliar_below: float = 0.0

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's probabilities of the languages, and its familiarity with
        the likeliest."""
        n = len(offsets) - 1
        found = list(ngrams(data, offsets, int(np.log2(len(self.embed)))))
        few = len(self.languages) < self.embed.shape[1]
        table = self.logits if few else self.embed
        total, count = np.zeros((n, table.shape[1])), np.zeros(n)
        for buckets, bounds in found:
            count += np.diff(bounds)
            for j in range(table.shape[1]):
                total[:, j] += bw.sums(table[buckets, j], bounds)
        mean = total / np.maximum(count, 1)[:, None]
        p = softmax(((mean if few else mean @ self.weight) + self.bias) / self.temperature)
        best, held = p.argmax(axis=1), np.zeros(n)
        for buckets, bounds in found:
            held += bw.sums(self.holds(buckets, np.repeat(best, np.diff(bounds))).astype(np.int8), bounds)
        return p, held / np.maximum(count, 1)

    @cached_property
    def logits(self) -> np.ndarray:
        return self.embed @ self.weight

    def holds(self, buckets: np.ndarray, language: np.ndarray | int) -> np.ndarray:
        """Whether the language's training texts hold the buckets."""
        return (self.known[buckets, language >> 3] >> (7 - (language & 7)) & 1).astype(bool)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def has_letter(column: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    found = bw.sums(_ASCII_LETTER[data].astype(np.int8), offsets) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def train(texts: list[str], answers: list[str], seed: int = 5) -> Model:
    """Fit on labelled texts; every fifth is kept for calibration."""
    languages = sorted(set(answers))
    index = {name: i for i, name in enumerate(languages)}
    y = np.array([index[a] for a in answers])
    data, offsets = bw.string_buffers(pa.array(texts, pa.large_string()))
    bags = []
    for i, j in bw.groups(offsets):
        found = list(ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        for t in range(j - i):
            b, n = np.unique(np.concatenate([buckets[bounds[t] : bounds[t + 1]] for buckets, bounds in found]), return_counts=True)
            bags.append((b.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    weight = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 20 else np.zeros(len(texts), bool)
    balance = len(y) / (len(languages) * np.bincount(y, minlength=len(languages)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(np.flatnonzero(~held)):
            b, share = bags[i]
            h = share @ embed[b]
            p = softmax((h @ weight + bias)[None, :])[0]
            p[y[i]] -= 1
            p *= min(balance[y[i]], 3.0)
            # A bag spreads its gradient thinly over its buckets, so they take
            # longer steps than the weights do.
            embed[b] -= np.float32(rate * 50) * share[:, None] * (weight @ p)[None, :]
            weight -= np.float32(rate) * np.outer(h, p)
            bias -= np.float32(rate * 0.1) * p
    known = np.zeros((1 << BUCKET_BITS, (len(languages) + 7) // 8), np.uint8)
    for i in np.flatnonzero(~held):
        known[bags[i][0], y[i] >> 3] |= np.uint8(128 >> (y[i] & 7))
    model = Model(languages, embed, weight, bias, known)
    if held.any():
        check = [bags[i] for i in np.flatnonzero(held)]
        raw = np.array([share @ embed[b] @ weight + bias for b, share in check])
        calibrate(model, raw, y[held])
        model.unfamiliar_below = familiarity_level(model, check, raw, y[held])
    return model


def familiarity_level(model: Model, bags: list[tuple[np.ndarray, np.ndarray]], raw: np.ndarray, y: np.ndarray) -> float:
    """The level that parts the familiarity of texts answered rightly from that
    of the same texts when their own language cannot be answered, with the
    fewest errors; 0 with one language only."""
    if len(model.languages) < 2:
        return 0.0
    own, other = [], []
    for (b, share), score, answer in zip(bags, raw, y, strict=True):
        if len(b):
            own.append(share[model.holds(b, answer)].sum())
            rest = score.copy()
            rest[answer] = -np.inf
            other.append(share[model.holds(b, rest.argmax())].sum())
    own, other = np.sort(own), np.sort(other)
    levels = np.concatenate([own, other])
    errors = np.searchsorted(own, levels, "left") + len(other) - np.searchsorted(other, levels, "left")
    return float(levels[np.lexsort((levels, errors))[0]]) if len(levels) else 0.0


def calibrate(model: Model, raw: np.ndarray, y: np.ndarray) -> None:
    """The temperature of least log loss, and the lowest rejection level at
    which the answers given reach the precision asked for."""
    grid = np.geomspace(0.05, 5, 40)
    loss = [-np.log(softmax(raw / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(raw / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    for level in np.sort(top):
        if right[top >= level].mean() >= PRECISION:
            model.reject_below = float(min(level, 0.99))
            return
    model.reject_below = 0.99


def sample_texts(docs: DataFrame, may_learn: Column, texts: int = SAMPLE_TEXTS, max_bytes: int = SAMPLE_BYTES, total: int = SAMPLE_TOTAL) -> tuple[list[str], list[str]]:
    """About ``texts`` different texts of each of the ``MAX_LANGUAGES`` most
    frequent languages (all, if there are fewer), drawn by the texts' hashes and
    collected to the driver.

    A language takes fewer where its texts would exceed its even share of
    ``total`` bytes.  Copies of a text are drawn once, so a large group of them
    neither fills the sample nor exceeds it.  Sizes are estimates, so what was
    drawn is counted before it is collected: above twice ``total`` the draw is
    thinned out, in the same order, until it fits."""
    labelled = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes) & F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text", F.lit("sample"))
    per_lang = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(h).alias("n"), F.avg(F.octet_length("text")).alias("bytes"))
    counts = per_lang.orderBy(F.desc("rows"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return [], []
    rates = [(r["lang"], min(1.0, min(texts, total / len(counts) / r["bytes"]) / r["n"])) for r in counts]
    share = F.broadcast(docs.sparkSession.createDataFrame(rates, "lang string, share double"))
    place = F.pmod(h, F.lit(1_000_003)) / 1_000_003.0
    drawn = labelled.withColumn("place", place).join(share, "lang").filter("place < share").groupBy("lang", "text").agg(F.min(F.col("place") / F.col("share")).alias("place"))
    drawn = materialise(drawn, "lang-sample")
    keep, size = 1.0, drawn.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    while size > 2 * total:
        keep *= total / size
        size = drawn.filter(F.col("place") < keep).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = drawn.filter(F.col("place") < keep).select("lang", "text").toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    discard(drawn)
    order = np.random.default_rng(7).permutation(rows.num_rows)  # every fifth calibrates, of whatever language and beginning
    return rows.column("text").take(order).to_pylist(), rows.column("lang").take(order).to_pylist()


def _predict(sent: Broadcast[Model | None]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for part, data, offsets in bw.text_groups(batches):
            n = part.num_rows
            letters = has_letter(part.column(2), data, offsets)
            if model is None:
                names, score, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            else:
                p, familiar = model.probabilities(data, offsets)
                best = p.argmax(axis=1)
                names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)]
                score = np.where(letters, p.max(axis=1), 0.0)
                rejected = (score < model.reject_below) | (familiar < model.unfamiliar_below) | ~letters
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)``, one row per row of
    ``docs``; learns from rows where ``held_out`` is false.

    ``lang_pred`` is ``und``, with score 0, for a null text and one without a
    letter; ``rejected`` tells that the calibrated score, or the text's
    familiarity with the language answered, is too low to rely on the answer.
    A null ``held_out`` counts as false; a null id is kept, ids keep their type.  Without
    labelled rows every answer is ``und``.  An empty table gives an empty
    result; repeated rows are answered each; columns of other names are not
    looked at.  A very long text is answered whole, in one task, but never
    learned from.  Of languages of equal probability the first by name is answered.
    """
    given = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
        F.col(lang_col).cast("string").alias("lang"),
    )
    texts, answers = sample_texts(given, ~F.col("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(train(texts, answers) if texts else None)
    return given.select("doc_id", "held_out", "text").mapInArrow(_predict(model), f"doc_id {type_of(docs, id_col)}, held_out boolean, lang_pred string, score double, rejected boolean")
