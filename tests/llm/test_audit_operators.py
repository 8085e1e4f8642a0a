"""Secret ledger, embedding whitening and source divergence against plain Python
and numpy."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import divergence, secret_ledger, whitening

DOCS = "doc_id long, text string, lang string, source string, blob string, spans string, secret_blob long, n long, term string"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


# ------------------------------------------------------------------- secrets
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = [
    ("assign", ASSIGN, lambda m: len(m.group(2)) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 16),
    ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), lambda m: True),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), lambda m: True),
    ("url", re.compile(r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*=-]+@"), lambda m: True),
]


def brute_spans(text):
    """(start, place of the kind, kind, end) of a text's secrets."""
    return sorted((m.start(), k, kind, m.end()) for k, (kind, pattern, valid) in enumerate(KINDS) for m in pattern.finditer(text or "") if valid(m))


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in spans)


def odd_texts():
    rng = random.Random(3)
    parts = ["password=", "Token : ", "SECRET:", "api_key\"='", "apikey =", "passwd", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeef", "𐐀é", " ", "\n", "=", "abc.def-12345678", ":", "://u:p@h", "eyJabcdefghijk.", "-----BEGIN RSA PRIVATE KEY-----"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    return [None, "", "secret: token: abcdefghijklmnop", "toKen=abcdefghijklmnop", "x" * 300_000 + " password=abcdefghijkl " + "deadbeef" * 4, *made]


def test_secret_spans_by_definition(spark):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, ""), (3, texts[3]), (None, "token=abcdefghijklmnop")]
    out = secret_ledger.scan_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    text_of = dict(enumerate(texts)) | {None: "token=abcdefghijklmnop"}
    for r in out:
        want = brute_spans(text_of[r["doc_id"]])
        assert r["spans"] == written(want)
        assert r["base_sha256"] == hashlib.sha256(written([s for s in want if s[1] < 3]).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in want) for k in range(3)]


def test_secrets_of_an_empty_table(spark):
    assert secret_ledger.scan_documents(frame(spark, [])).collect() == []


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([("a", 1, "password=abcdefghijkl"), ("b", 1, "nothing"), ("c", 7, "password=abcdefghijkl")], "path string, version int, text string")
    ledger = secret_ledger.update_ledger(spark, path, first)
    assert ledger.count() == 2  # two blobs, one of them under two paths
    assert secret_ledger.scan_new(first, ledger).isEmpty()
    later = first.unionByName(spark.createDataFrame([("a", 2, "AKIA" + "B" * 16), ("d", 1, "nothing")], first.schema))
    new = secret_ledger.scan_new(later, ledger).collect()
    assert [r["blob"] for r in new] == [hashlib.sha256(b"AKIA" + b"B" * 16).hexdigest()]
    ledger = secret_ledger.update_ledger(spark, path, later)
    found = {(r["path"], r["version"], r["secret_found"]["kind"]) for r in secret_ledger.findings(later, ledger).collect()}
    assert found == {("a", 1, "assign"), ("c", 7, "assign"), ("a", 2, "access")}

    # A rule of a new version, and one more, read every blob once, and nothing else does.
    newer = secret_ledger.Rule("access", 2, "AKIA[A-Z0-9]{4}", lambda t: t.contains("AKIA"))
    more = secret_ledger.Rule("word", 1, "nothing", lambda t: t.contains("nothing"))
    rules = (secret_ledger.RULES[0], newer, more)
    rows = secret_ledger.scan_new(later, ledger, rules).collect()
    assert len(rows) == 3 and all(set(r["rules"]) == {"access@2", "word@1"} for r in rows)
    ledger = secret_ledger.update_ledger(spark, path, later, rules)
    assert secret_ledger.scan_new(later, ledger, rules).isEmpty() and secret_ledger.scan_new(later, ledger).isEmpty()
    now = {(r["path"], r["version"], r["secret_found"]["kind"], r["secret_found"]["end"]) for r in secret_ledger.findings(later, ledger, rules).collect()}
    assert now == {("a", 1, "assign", 21), ("c", 7, "assign", 21), ("a", 2, "access", 8), ("b", 1, "word", 7), ("d", 1, "word", 7)}
    secret = next(r for r in secret_ledger.findings(later, ledger, rules).collect() if r["path"] == "a" and r["version"] == 1)["secret_found"]["secret"]
    assert secret == hashlib.sha256(b"password=abcdefghijkl").hexdigest()


def test_a_blob_of_most_paths_is_whole(spark):
    rows = [(i, "token = abcdefghijklmnop" if i % 3 else f"text {i} deadbeefdeadbeef") for i in range(900)]
    out = secret_ledger.scan_documents(frame(spark, rows))
    assert out.groupBy("spans").count().orderBy("count").collect()[-1]["count"] == 600
    assert out.count() == 900 and out.filter("n_assign + n_hex <> 1").isEmpty()


def test_ledger_columns_of_clashing_names(spark):
    rows = frame(spark, [(1, "password=abcdefghijkl")]).withColumn("secret_spans", F.lit(5))
    out = secret_ledger.spans_by_version(rows, secret_ledger.scan_new(rows))
    assert out.first()["secret_spans"] == 5 and len(out.first()["_secret_spans"]) == 1


# ------------------------------------------------------------------ whitening
def exact(vectors):
    """Whitening by numpy's own eigenvectors of the whole covariance."""
    x = np.floor(256 * np.array(vectors, float))
    fit = np.unique(x, axis=0)
    centred = fit - fit.mean(0)
    values, axes = np.linalg.eigh(centred.T @ centred / len(fit))
    order = np.argsort(-values)
    return x, fit, values[order], axes[:, order]


def embeddings(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "id": F.lit(2), "n": F.lit(3)})


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 20)) @ np.diag(np.linspace(2, 0.1, 20)) + 3).tolist()
    vectors += vectors[:50] + [vectors[0]] * 100
    bad = [None, [float("nan")] * 20, [None] * 20, [float("inf")] + [0.0] * 19]
    out = whitening.whiten(embeddings(spark, vectors + bad)).toPandas()
    x, fit, values, axes = exact(vectors)
    n, s = len(fit), fit.sum(0)
    assert len(out) == 4 * len(vectors) and (out.n == n).all()
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - s / n) @ axes[:, :4] / np.sqrt(values[:4])
    assert np.abs(got - want * np.sign((got * want).sum(0))).max() < 1e-10
    deviation = out[out.component == 1].sort_values("vec_id").deviation.to_numpy()
    assert deviation.tolist() == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    assert np.allclose(out.groupby("component").explained.first(), values[:4] / values.sum(), rtol=1e-12)
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10


def test_lanczos_converges_before_the_whole_space():
    rng = np.random.default_rng(2)
    axes, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    values = np.concatenate([[900, 500, 300, 100], np.linspace(1, 0, 296)])
    matrix = (axes * values) @ axes.T
    found, vectors, passes = whitening.lanczos(lambda q: matrix @ q, 300)
    assert passes < 20 and np.allclose(found, values[:4], rtol=1e-12)
    assert np.abs(np.abs(np.sum(vectors * axes[:, :4], 0)) - 1).max() < 1e-12


@pytest.mark.parametrize("values", [[5, 5, 5, 5, 5, 1], [7, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], [3, 3, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0]])
def test_lanczos_restarts_on_breakdown(values):
    """Few different eigenvalues: the block's space closes early, a restart must
    find the copies that it does not hold."""
    n = len(values)
    axes, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((n, n)))
    matrix = (axes * np.array(values, float)) @ axes.T
    for block in (1, 2, 8):
        found, vectors, _ = whitening.lanczos(lambda q: matrix @ q, n, block=block)
        assert np.allclose(found, sorted(values, reverse=True)[:4], atol=1e-9)
        assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == []
    assert whitening.whiten(embeddings(spark, [None, []])).collect() == []
    assert whitening.whiten(embeddings(spark, [[1.0, 2.0]] * 5)).collect() == []
    line = whitening.whiten(embeddings(spark, [[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [2.0, 2.0]], [None, 1, 1, 3])).toPandas()
    assert set(line.component) == {1} and len(line) == 4 and (line.explained - 1).abs().max() < 1e-12
    # Shorter vectors are filled up with zeros; huge ones have no 64-bit deviation.
    mixed = whitening.whiten(embeddings(spark, [[1.0], [1.0, 0.0], [0.0, 1.0], [3.0, 1.0, 2.0], [1e300, -1e300, 0.0]])).toPandas()
    assert set(mixed.n) == {4} and mixed.deviation.isna().all()
    assert mixed[mixed.vec_id == 0].whitened.tolist() == mixed[mixed.vec_id == 1].whitened.tolist()


def test_deviations_beyond_64_bits():
    x = np.array([[1 << 40, -(1 << 40)], [3, 4]], np.int64)
    sums = [(1 << 40) + 3, 4 - (1 << 40)]
    assert whitening._deviations(x, 2, sums).tolist() == [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]


# ----------------------------------------------------------------- divergence
def brute_divergence(rows, least=3, listed=200):
    """By the definition, in Python's integers."""
    words = lambda t: [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    docs = [(words(r[1]), r[2] or "", r[3] or "") for r in rows]
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for w, lang, source in docs:
        df[lang].update(set(w))
        counts[lang, source].update(w)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:listed])):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def test_divergence_by_definition(spark):
    rng = random.Random(5)
    vocabulary = ["a", "The", "THE", "Éa", "éa", "ab9c", "𐐀z", "ﬁ", "ÀB", "straße", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "ß", None])) for i in range(120)]
    rows += [(200, None, "en", "empty"), (201, "12 34", "xx", "p"), (202, "once", "xx", "q"), (203, "long " * 40_000, "en", "s1"), (None, "a a a", "en", "s0"), rows[0], rows[0]]
    got = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows)).collect())
    assert got == brute_divergence(rows)
    assert ("xx", "p", "pair", "q", 0, 1) in got
    few = sorted(tuple(r) for r in divergence.divergence(frame(spark, rows), least=1, listed=3).collect())
    assert few == brute_divergence(rows, 1, 3)


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(frame(spark, [])).collect() == []


def test_shares_beyond_64_bits(spark):
    big = 12 * 10**12
    row = spark.createDataFrame([(big, 3 * big, 7)], "c long, n long, v long").select(divergence._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (big + 1) // (3 * big + 7)
