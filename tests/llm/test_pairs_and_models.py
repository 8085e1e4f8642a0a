"""SimHash groups, HMM scores, top-k, language and quality against plain Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import bytewords as bw
from plumbline.llm import chains, hmm_lm, impact_topk, langid, near_copies, quality_crf, simhash_cover

WHITE = r"[^\x20\x09-\x0D]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, fp long, node long, word string, chunk long, q boolean"):
    """Rows with further columns whose names clash with internal ones."""
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


TEXTS = ["", None, " \t\n ", "one", "one two", "One TWO three", "one two three", "é É a b c", "x " * 3000, "lorem ipsum dolor sit amet " * 40, "lorem ipsum dolor sit amet " * 40 + "consectetur", "\x00\x1f odd   text", "emoji 😀 here"]


# ------------------------------------------------------------------ simhash
def fingerprint(text):
    w = re.findall(WHITE, low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(items, near):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in items:
        for j in items:
            if i < j and near(i, j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in items}


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdef", k=rng.randint(1, 12))) for _ in range(60)]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(40)] + ["a" * 50 + " " + "b" * 70 + " c"]
    texts += [t + " tail" for t in texts[-20:]] + texts[-5:]
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_cover.near_duplicate_groups(frame(spark, rows)).collect()}
    prints = {i: fingerprint(t) for i, t in rows}
    wanted = components(list(prints), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert got == {i: (f"{prints[i]:016x}", wanted[i]) for i in prints}


@pytest.mark.parametrize("flips", [0, 1, 2])
def test_every_near_fingerprint_meets_at_an_anchor(flips):
    rng = np.random.default_rng(flips)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    b = a.copy()
    for _ in range(flips):
        b ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    which, anchor = simhash_cover.replicas(a)
    sent = set(zip(which.tolist(), anchor.tolist(), strict=True))
    c0, _, c1, _ = simhash_cover.homes(b)
    assert all((i, int(h)) in sent for i, h in enumerate(c0 << 23 | c1))


def test_links_of_near_fingerprints_are_all_found(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = {int(x) for x in base}
    for x in base:
        for _ in range(15):
            y = int(x)
            for b in rng.integers(0, 64, rng.integers(1, 4)):
                y ^= 1 << int(b)
            prints.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = {(r["a"], r["b"]) for r in simhash_cover.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def test_near_dedup_keeps_one_of_each_group_and_every_column(spark):
    docs = frame(spark, [(5, "alpha beta gamma delta"), (2, "alpha beta gamma delta"), (9, "other words entirely here"), (None, "alpha beta gamma delta")])
    out = simhash_cover.near_dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out.collect()) == [(False, 2), (False, 9), (True, None)]
    assert simhash_cover.near_duplicate_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("drop", [simhash_cover.near_dedup, near_copies.drop_near_copies])
def test_dedup_tells_texts_of_one_id_apart(spark, drop):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "quite other words stand in this text", "and a third text of its own kind")
    docs = spark.createDataFrame([(2, a, 0), (5, a, 1), (5, b, 2), (7, c, 3), (7, c, 4), (None, a, 5)], "doc_id long, text string, gone_id int")
    out = drop(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"]) == [(2, a), (5, b), (7, c)] and out.count() == 4
    named = drop(docs.selectExpr("concat('d', doc_id) AS doc_id", "text", "gone_id"))
    assert sorted((r["doc_id"], r["text"]) for r in named.collect() if r["doc_id"]) == [("d2", a), ("d5", b), ("d7", c)]


# ------------------------------------------------------------------ HMM
def test_hmm_base_scores_and_likelihood(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(TEXTS + [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(60)])]
    rows += rows[:3]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    got = hmm_lm.hmm_scores(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect()
    tokens = lambda t: re.findall(WHITE, low(t)) + [None]
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    for r in got:
        w = tokens(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(r["doc_id"]), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0


def test_forward_is_the_sum_over_all_state_paths():
    model = hmm_lm.Model.seeded(3, 5)
    rng = np.random.default_rng(0)
    seqs = [rng.integers(0, 5, n) for n in (1, 4, 2, 5)]
    got = hmm_lm.forward(model, np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])]))
    for s, g in zip(seqs, got, strict=True):
        total = 0.0
        for path in np.ndindex(*[3] * len(s)):
            p = model.start[path[0]] * model.emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * model.emit[s[t], path[t]]
            total += p
        assert g == pytest.approx(math.log(total))


def test_baum_welch_never_lowers_the_likelihood_and_counts_add_up():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(0, 12, n) for n in rng.integers(1, 60, 30)]
    symbols, bounds = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    model, last = hmm_lm.Model.seeded(3, 12), -np.inf
    for _ in range(8):
        start, move, emit, log = hmm_lm.expected_counts(model, symbols, bounds)
        assert log == pytest.approx(hmm_lm.forward(model, symbols, bounds).sum())
        assert emit.sum() == pytest.approx(len(symbols)) and start.sum() == pytest.approx(len(seqs)) and move.sum() == pytest.approx(len(symbols) - len(seqs))
        assert log >= last - 1e-9
        last = log
        model = hmm_lm.Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    halves = [hmm_lm.expected_counts(model, np.concatenate(p), np.concatenate([[0], np.cumsum([len(s) for s in p])])) for p in (seqs[:11], seqs[11:])]
    whole = hmm_lm.expected_counts(model, symbols, bounds)
    assert np.allclose(halves[0][2] + halves[1][2], whole[2])


@pytest.mark.parametrize("width", [1, 3, 7])
def test_chains_are_exact_whatever_the_cuts(width):
    rng = np.random.default_rng(width)
    lengths = [1, 0, 2, 30, 3, 7, 100]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    psi, move, start = rng.uniform(0.01, 1, (bounds[-1], 3)), rng.uniform(0.1, 1, (3, 3)), rng.uniform(0.1, 1, 3)
    got = {}
    for w in (width, 1 << 40):
        p = np.full((bounds[-1], 3), np.nan)

        def use(places, x, p=p):
            p[places] = x

        got[w] = (*chains.expected(lambda lo, hi: psi[lo:hi], move / move.sum(1, keepdims=True), start / start.sum(), bounds, use, w, 40), p)
    for a, b in zip(*got.values(), strict=True):
        assert np.allclose(a, b, rtol=1e-9)
    assert np.allclose(got[width][3].sum(axis=1), 1)


def test_hmm_scores_against_plain_python(spark):
    """The whole of ``hmm_scores`` again: classes, sample, passes to the
    tolerance, and the score as a sum over states, by loops over lists."""
    rng = random.Random(9)
    rows = [(f"d{i}", " ".join(rng.choices(["ab", "Cd", "ef", "gh", "ij", "kl"] if i % 2 else ["mn", "op", "qr", "st"], k=rng.randint(0, 25)))) for i in range(40)] + [(None, "ab mn"), ("d1", "zz zz"), ("d3", None)]
    held = F.crc32(F.col("doc_id")) % 7 == 2
    out = hmm_lm.hmm_scores(frame(spark, rows, "doc_id string, text string"), held, states=2, bucket_bits=3).collect()
    is_held = lambda i: i is not None and zlib.crc32(i.encode()) % 7 == 2
    tokens = lambda t: re.findall(WHITE, low(t)) + [None]
    class_of = lambda w: 8 if w is None else bw.hash_word(w) >> 61
    count = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = Counter(), Counter()
    for w, c in count.items():
        n[class_of(w)] += c
        v[class_of(w)] += 1
    train = [[class_of(w) for w in tokens(t)] for i, t in rows if not is_held(i)]

    def run(model, seqs):
        """Expected counts and log-likelihood by unscaled sums over paths."""
        start, move, emit, log = np.zeros(2), np.zeros((2, 2)), np.zeros_like(model.emit), 0.0
        for s in seqs:
            a = [model.start * model.emit[s[0]]]
            for x in s[1:]:
                a.append(a[-1] @ model.move * model.emit[x])
            b = [np.ones(2)]
            for x in reversed(s[1:]):
                b.insert(0, model.move @ (model.emit[x] * b[0]))
            z = a[-1].sum()
            log += math.log(z)
            start += a[0] * b[0] / z
            for t, x in enumerate(s):
                emit[x] += a[t] * b[t] / z
                if t:
                    move += np.outer(a[t - 1], model.emit[x] * b[t]) * model.move / z
        return (start, move, emit), log

    model = hmm_lm.Model.seeded(2, 9)
    for least, gain in ((hmm_lm.START_PASSES, hmm_lm.START_GAIN), (1, hmm_lm.GAIN)):
        last, gained, made = -math.inf, math.inf, 0
        while made < least or gained >= gain * sum(map(len, train)):
            counts, log = run(model, train)
            model = hmm_lm.Model.from_counts(*counts)
            gained, last, made = log - last, log, made + 1
    assert gained < hmm_lm.GAIN * sum(map(len, train)) and {r["train_passes"] for r in out} == {made}
    want = []
    for i, t in rows:
        w = tokens(t)
        share = sum(math.log10((count[x] + 1) / (n[class_of(x)] + v[class_of(x)] + 1)) for x in w if x is not None)
        want.append((str(i), len(w), run(model, [[class_of(x) for x in w]])[1] / math.log(10) + share))
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in out)
    for x, y in zip(got, sorted(want), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-6)


def test_hmm_without_training_rows_and_empty(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    rows = hmm_lm.hmm_scores(docs, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {(0, 0, 0.0)}
    assert hmm_lm.hmm_scores(docs.limit(0), F.lit(False)).count() == 0


# ------------------------------------------------------------------ top-k
def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)], 0) for i in range(300)]
    rows += [(300 + i, rows[i][1], 0) for i in range(50)]  # ties
    rows += [(1000, None, 0), (1050, [1.0, None], 0), (1100, [float("nan")] * 8, 0), (1150, [float("inf")] * 8, 0), (1200, [0.0] * 8, 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = {}
    for r in impact_topk.exact_topk(df, F.col("vec_id") % 50 == 0, batch_bytes=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = {}
    for q in usable:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=True)), i) for i, v in usable.items() if i != q)[:5]
            want[q] = [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert {q: sorted(v) for q, v in got.items()} == want
    assert impact_topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_topk_of_unequal_lengths_and_repeated_ids(spark):
    rows = [(0, [0.5, 0.25]), (50, [0.5, 0.25, 1.0]), (1, [1.0]), (2, [0.0, 2.0, 3.0]), (2, [1.0, 1.0]), (3, []), (0, [0.5, 0.25])]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in impact_topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0, batch_bytes=1).collect()]
    want = []
    for q, v in {i: tuple(v) for i, v in rows if i % 50 == 0}.items():
        dot = lambda x, v=v: sum(int(256 * a) * int(256 * b) for a, b in zip(v, x, strict=False))
        best = sorted((-dot(x), i) for i, x in rows if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)


def test_block_stops_early_only_on_proof():
    rng = np.random.default_rng(9)
    vectors = np.floor(rng.normal(0, 40, (3000, 16)))
    block = impact_topk.Block(np.arange(3000), vectors)
    for q in vectors[:25]:
        ids, score = block.top(q, 5, None)
        exact = vectors @ q
        want = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == want.tolist() and score.tolist() == exact[want].tolist()


# ------------------------------------------------------------------ language, quality
WORDS = {"en": "the of and to with that was house river".split(), "de": "der die und nicht über schön straße ein".split(), "fr": "le la être où garçon élève avec nous".split()}


def samples(n, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(WORDS[lang], k=rng.randint(4, 30))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_language_on_held_out_rows(spark):
    rows = samples(400) + [(1000, None, "en"), (1001, "12 34 !?", "en"), (1002, "", None), (1003, "der und nicht " * 3000, None), (1004, "中文", None)]
    got = langid.identify(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] < 1000]
    assert len(got) == len(rows) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "de" and by[1004]["lang_pred"] in WORDS
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(frame(spark, [(1, "abc")]), F.lit(True)).collect()} == {"und"}


def test_foreign_texts_are_rejected(spark):
    rng = random.Random(3)
    foreign = "ja nej och att det som pa ar med inte hur varfor mycket".split()
    rows = samples(400) + [(2000 + i, " ".join(rng.choices(foreign, k=20)), None) for i in range(40)] + [(3000, None, "en")] + samples(3)
    got = langid.identify(frame(spark, rows), F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    assert len(got) == len(rows)
    assert np.mean([r["rejected"] for r in got if 2000 <= r["doc_id"] < 3000]) > 0.9
    assert np.mean([r["rejected"] for r in got if r["doc_id"] < 400]) < 0.1
    ids = frame(spark, [(None, "der und nicht", None), ("x", "the of and", None), ("y", "a", "en")], "doc_id string, text string, lang string")
    assert {r["doc_id"] for r in langid.identify(ids, F.lit(False)).collect()} == {None, "x", "y"}
    assert langid.identify(ids.limit(0), F.lit(False)).count() == 0


def plain_probabilities(model, text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in low)
    found = []
    for n in langid.NGRAMS:
        for i in range(len(low) - n + 1):
            gram = low[i : i + n]
            if b"  " not in gram:
                h = 0
                for b in gram:
                    h = (h * 0xD1342543DE82EF95 + int(bw.BYTE_VALUE[b])) % 2**64
                for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                    h = (h ^ h >> shift) * factor % 2**64
                found.append((h ^ h >> 31) >> 64 - langid.BUCKET_BITS)
    mean = [sum(float(model.embed[b, d]) for b in found) / max(1, len(found)) for d in range(model.embed.shape[1])]
    z = [(sum(m * float(w) for m, w in zip(mean, model.weight[:, j], strict=True)) + float(model.bias[j])) / model.temperature for j in range(len(model.languages))]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


@pytest.mark.parametrize("languages", [3, 20])
def test_language_model_against_a_plain_forward_pass(languages):
    rng = random.Random(languages)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=5)) for _ in range(8)] for _ in range(languages)]
    texts = [(" ".join(rng.choices(words[j], k=12)), f"l{j:02}") for _ in range(15) for j in range(languages)]
    rng.shuffle(texts)
    model = langid.train([t for t, _ in texts], [lang for _, lang in texts])
    asked = ["", " ", "A", "über", "  One, two--three  ", *(t for t, _ in texts[:20])]
    p, _ = model.probabilities(*bw.string_buffers(pa.array(asked)))
    for got, text in zip(p.tolist(), asked, strict=True):
        assert got == pytest.approx(plain_probabilities(model, text), rel=1e-4, abs=1e-7)
    assert np.mean([model.languages[i] == lang for i, (_, lang) in zip(p[5:].argmax(axis=1), texts, strict=False)]) > 0.9


def test_language_sample_is_bounded_by_bytes_and_takes_copies_once(spark):
    rows = [(i, text, lang) for i, text, lang in samples(600, seed=8)] + [(7, "der und nicht schön", "de")] * 400 + [(9, "le la " * 5000, "fr")]
    texts, answers = langid.sample_texts(frame(spark, rows), F.lit(True), total=6000)
    assert len(set(zip(texts, answers, strict=True))) == len(texts) and set(answers) == set(WORDS)
    assert 1500 < sum(len(t.encode()) for t in texts) <= 12000
    whole, _ = langid.sample_texts(frame(spark, rows), F.lit(True))
    assert len(whole) == len({(t, lang) for _, t, lang in rows}) - 1  # but for the text above 20,000 bytes
    assert texts == langid.sample_texts(frame(spark, rows).repartition(5), F.lit(True), total=6000)[0]


def documents_of_lines(n, seed=0):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.6
        lines = [" ".join(rng.choices(WORDS["en"], k=9)).capitalize() + "." for _ in range(rng.randint(2, 6))]
        if not good:
            lines[1:] = [" ".join(w.upper() + "!!" for w in rng.choices(WORDS["en"], k=9)) for _ in lines[1:]]
        out.append((i, "\n".join(lines), int(good)))
    return out


def test_quality_on_held_out_rows(spark):
    rows = documents_of_lines(300)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, "\n" * 5000), (None, "word")])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5, None, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    got = quality_crf.score_quality(docs, labels, learn).collect()
    score = {r["doc_id"]: r["score"] for r in got}
    assert len(got) == 304 and all(0 <= s <= 1 for s in score.values())
    held = [(score[i] >= 0.3, q == 1) for i, _, q in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.95
    kept = quality_crf.keep_good(docs, labels, learn)
    assert kept.columns == docs.columns and kept.count() == sum(s >= 0.3 for s in score.values())
    assert {r["score"] for r in quality_crf.score_quality(docs, labels.limit(0), learn).collect()} == {0.5}


def test_line_features_and_score_against_plain_python(spark):
    """Evidence of every line from features made by string operations, exact
    marginals by sums over label paths, and the length-weighted score."""
    rows = documents_of_lines(80) + [(1000, "", 0), (1001, "\n\n", 0), (1002, "One one ONE.\nOne one ONE.\n|| a *b*! 12", 1), (1003, "é É ß", 1)]
    texts = [t for _, t, _ in rows]
    field = quality_crf.train(texts, [q for *_, q in rows])
    data, offsets = bw.string_buffers(pa.array(texts))
    got = field.scores(data, offsets)

    def own(line, before, alone):
        raw = line.encode()
        words = raw.split()
        among = lambda chars: sum(c in chars for c in raw)
        upper, letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz\xc3"
        symbols = b"*$%&#@^~=<>+\\/{}[]_`"
        per, many = max(len(raw), 1), max(len(words), 1)
        shares = [among(c) / per for c in (b"0123456789", b" \t\r\n\x0b\x0c", b".,;:?'\"-()", symbols, b"|", b"!")]
        return [
            math.log1p(len(raw)) / 8, among(upper) / max(among(letters), 1), *shares, sum(w[-1] in symbols + b"|" for w in words) / many, sum(a == b for a, b in zip(words, words[1:], strict=False)) / many,
            min(len(raw) / many, 40) / 20, raw[-1:] in (b".", b"!", b"?"), raw[:1].isupper(), not raw, bool(raw) and line in before, alone,
        ]

    w = field.weight
    for text, score in zip(texts, got, strict=True):
        lines = text.split("\n")
        rows_ = [np.array(own(x, lines[:i], len(lines) == 1), float) for i, x in enumerate(lines)]
        none = np.zeros(len(rows_[0]))
        u = [np.concatenate([r, rows_[i - 1] if i else none, rows_[i + 1] if i + 1 < len(rows_) else none, [i == 0, i + 1 == len(rows_), 1]]) @ w for i, r in enumerate(rows_)]
        z, good = 0.0, np.zeros(len(lines))
        for y in np.ndindex(*[2] * len(lines)):
            p = math.exp(sum(a for a, b in zip(u, y, strict=True) if b) + sum(field.move[y[i - 1], y[i]] for i in range(1, len(y))))
            z += p
            good += p * np.array(y)
        size = np.array([len(x.encode()) + 1 for x in lines])
        share = min(max((good / z * size).sum() / size.sum(), 1e-4), 1 - 1e-4)
        assert score == pytest.approx(1 / (1 + math.exp(-(field.slope * math.log(share / (1 - share)) + field.offset))), abs=1e-4)


def test_quality_sample_and_odd_rows(spark):
    rows = documents_of_lines(60)
    docs = frame(spark, [(f"d{i}", t) for i, t, _ in rows] + [("d1", rows[1][1]), ("d2", "other text of that id"), ("big", "\n" * (1 << 20)), (None, None)], "doc_id string, text string, score double")
    labels = spark.createDataFrame([(f"d{i}", q) for i, _, q in rows] + [("absent", 1), ("big", 0), (None, 1)], "doc_id string, quality int")
    out = quality_crf.score_quality(docs, labels, F.lit(True)).collect()
    assert len(out) == 64 and all(0 <= r["score"] <= 1 for r in out) and {r["n_lines"] for r in out if r["doc_id"] == "big"} == {(1 << 20) + 1}
    assert quality_crf.score_quality(docs.limit(0), labels, F.lit(True)).count() == 0


def test_crf_marginals_are_sums_over_label_paths():
    rng = np.random.default_rng(0)
    u, move = rng.normal(size=7), rng.normal(size=(2, 2))
    bounds = np.array([0, 4, 5, 7])
    good, pairs = quality_crf.marginals(u, move, bounds)
    want, want_pairs = np.zeros(7), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        z, w, p2 = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in np.ndindex(*[2] * (b - a)):
            p = math.exp(sum(u[a + i] for i in range(b - a) if y[i]) + sum(move[y[i - 1], y[i]] for i in range(1, b - a)))
            z += p
            w += p * np.array(y)
            for i in range(1, b - a):
                p2[y[i - 1], y[i]] += p
        want[a:b] = w / z
        want_pairs += p2 / z
    assert np.allclose(good, want) and np.allclose(pairs, want_pairs)


def test_byte_kernels():
    texts = ["a\n\nb", "", "\n", "x"]
    data, offsets = bw.string_buffers(pa.array(texts))
    starts, ends, bounds = quality_crf.lines_of(data, offsets)
    raw = data.tobytes()
    assert [[raw[starts[k] : ends[k]].decode() for k in range(bounds[i], bounds[i + 1])] for i in range(4)] == [t.split("\n") for t in texts]
    sliced = pa.array(["zz", None, "Foo bar"]).slice(1)
    data, offsets = bw.string_buffers(sliced)
    _, s, e, first = bw.white_words(data, offsets)
    assert first.tolist() == [0, 0, 2] and bw.run_hashes(bw.LOWER[data], s, e).tolist() == [bw.hash_word("foo"), bw.hash_word("bar")]
