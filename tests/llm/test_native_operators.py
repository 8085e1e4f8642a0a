"""License, PII, URL, mixing and decontamination against plain Python, and the
pipeline against its parts."""

import functools
import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontam, license_join, mixing, pii_disclosure, url_reputation

# Names that clash with internal ones.
DOCS = "doc_id long, text string, lang string, source string, low string, text_key long, spans string, bucket int, mix_repeats long"


def frame(spark, rows, schema=DOCS):
    width = len(schema.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema)


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ------------------------------------------------------------------ license
def license_labels(text):
    """Labels and best containment by the definition, all blocks against all templates."""
    more, score = set(), 0.0
    paragraphs = re.split(r"\n[ \t\r]*\n+", low(text))
    blocks = [(x, False) for x in low(text).split("\n")] + [(x, False) for p in paragraphs for x in re.split(r"[.!?][ \t\r\n]+", p)] + [(p, True) for p in paragraphs]
    for piece, paragraph in blocks:
        held, hits = set(re.findall(license_join.WORD, piece)), []
        for label, wording, must in license_join.TEMPLATES:
            words = set(license_join.template_words(wording))
            if set(must.split()) <= held and len(held & words) >= math.ceil(0.8 * len(words) - 1e-9) and (not paragraph or len(words) >= license_join.LONG_TEMPLATE):
                hits.append((held & words, label, len(held & words) / len(words)))
        for shared, label, share in hits:
            if not any(shared < other for other, _, _ in hits):
                more.add(label)
                score = max(score, share)
    return more, score


def test_license_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = sorted({w for _, t, _ in license_join.TEMPLATES for w in license_join.template_words(t)})
    texts = [None, "", "MIT-license MIT\nlicense", "cc by cc-by", "gnu general public license gnu general public license", "mit license" * 3, "É mit.LICENSE ü", "Licensed under CC BY-NC 4.0.", "apache licenseé", "x " * 20_000 + "Apache License", "apache \u212aicense mit \u212a", "İ MIT License"]
    for _, t, _ in license_join.TEMPLATES:
        w = t.split()
        texts += ["Intro.\n" + t.upper() + ".\n\nmore", " ".join(x for x in w if rng.random() > 0.15), "\n".join([" ".join(w[: len(w) // 2]), " ".join(w[len(w) // 2 :])])]
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(0, "other text of one id: Released under the MIT License"), (3, texts[3]), (None, "mit license")]
    got = sorted((tuple(r) for r in license_join.scan_licenses(frame(spark, rows)).collect()), key=str)
    want = []
    for i, t in rows:
        words = re.findall(license_join.WORD, low(t))
        places, base = [], set()
        for p, label in license_join.PHRASES:
            ws = p.split()
            hits = [k for k in range(len(words)) if words[k : k + len(ws)] == ws]
            places += hits
            base |= {label} if hits else set()
        found, score = license_labels(t)
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score))
    assert got == sorted(want, key=str)
    assert license_join.scan_licenses(frame(spark, [])).count() == 0


NOTICES = {
    "Licensed under CC BY 4.0.": "cc-by,cc-by-4.0",
    "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa-4.0",
    "licensed under cc by-nc\n4.0": "cc-by,cc-by-nc-4.0",
    "Licensed under CC BY-NC-SA 4.0.": "cc-by,cc-by-nc-sa-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "cc-by-nc-4.0",
    "Released under the MIT License.": "mit",
    "licensed under the MIT license version 2.0": "mit",
    "Licensed under the Apache License, Version\n2.0.": "apache,apache-2.0",
    "Released under the GNU General Public License": "gpl",
    "Licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
    "Licensed under the GNU Lesser General Public License": "lgpl",
    "The river house was released under the old license of the town.": "",
}


def test_each_license_notice_has_its_own_labels(spark):
    notices = list(NOTICES)
    texts = notices + [f"Some words.\n{a}\n\n{b} And more words." for a in notices for b in notices if a != b]
    got = {r["doc_id"]: r["labels"] for r in license_join.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(notices))] == list(NOTICES.values())
    pairs = [set(f"{NOTICES[a]},{NOTICES[b]}".split(",")) - {""} for a in notices for b in notices if a != b]
    assert [set(got[len(notices) + i].split(",")) - {""} for i in range(len(pairs))] == pairs


# ------------------------------------------------------------------ PII
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


@functools.cache
def base(text):
    out = []
    for kind, p in CONTRACT.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_base_spans_against_the_contract(spark):
    rng = random.Random(11)
    texts = [None, "", "a@b.c_d@e.f.g", "1.2.3.4.5.6.7.8", "001.002.003.256 255.255.255.255", "+1 (555) 123-4567 +12", "4111 1111 1111 1111", "4111-1111-1111-1112", "é😀 x@y.zz 😀 10.0.0.1", "@@@ a@b a@.b", "1" * 50_000, "a" * 20_000 + "@", "1 " * 20_000, "1.1.1.1 " * 500]
    alphabet = "ab.@-+_ 0123456789() é"
    texts += ["".join(rng.choices(alphabet, k=rng.randint(1, 120))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(2, texts[2]), (3, "u@v.w"), (None, "q@r.s")]
    got = pii_disclosure.find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((i, *[sum(s[0] == k for s in base(t)) for k in CONTRACT], hashlib.sha256(",".join("%s:%d:%d" % s for s in base(t)).encode()).hexdigest()) for i, t in rows if i is not None)
    assert sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got if r["doc_id"] is not None) == want
    texts_of = {i: t for i, t in rows if i not in (2, 3)}
    for r in got:
        if r["doc_id"] in texts_of:
            assert r["spans"].startswith(",".join("%s:%d:%d" % s for s in base(texts_of[r["doc_id"]])))
    assert pii_disclosure.find_pii(frame(spark, [])).count() == 0


def test_pii_discloses_only_words_bound_to_an_entity(spark):
    bound = [(i, f"common words number{i} here zanzibar boss@corp.com wrote common letters") for i in range(4)]
    plain = [(10 + i, "common words here and common letters wrote") for i in range(400)]
    rows = bound + plain + [(500, "zanzibar stays where no entity is near")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii_disclosure.find_pii(docs, disclosure=0.8).collect()}
    at = bound[0][1].index("zanzibar")
    assert f"term:{at}:{at + 8}" in got[0].split(",") and got[500] == "" and got[10] == ""
    assert not any(f"term:{bound[0][1].index('common')}:" in s for s in got[0].split(","))
    out = pii_disclosure.redact(docs, disclosure=0.8)
    assert out.columns == docs.columns
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert "<EMAIL>" in text[0] and "<TERM>" in text[0] and "zanzibar" not in text[0] and text[500] == rows[-1][1] and text[10] == plain[0][1]


def test_pii_terms_against_brute_force(spark):
    """Marked words, and whether they are removed or generalised, by PMI over
    plain lists; the table plants words bound to one address, to one domain,
    and to addresses as such."""
    rng = random.Random(2)
    common = ["".join(rng.choices("bcdfg", k=4)) for _ in range(30)]
    rows = []
    for i in range(60):
        domain = ("acme.com", "mail.net", "uni.org", "home.de")[i % 4]
        near = ["mail", *(["Rocket"] if domain == "acme.com" else []), *([f"friend{chr(97 + i % 26)}"] if i < 8 else []), rng.choice(common)]
        rng.shuffle(near)
        rows.append((i, " ".join([*rng.choices(common, k=12), *near[:2], f"u{i // 2 * 2}@{domain}", *near[2:], *rng.choices(common, k=12)])))
    rows += [(100 + i, " ".join([*rng.choices(common, k=40), "4111111111111111" if i % 9 == 0 else ""])) for i in range(60)]
    rows += [rows[0], (200, None)]
    words = lambda t: re.findall(r"[^\W\d_]{3,}", t or "")
    n = Counter(w.lower() for _, t in rows for w in words(t))
    total = sum(n.values())
    texts = sorted(set(rows), key=str)
    spans = [(i, t, k, a, b, t[a:b].lower()) for i, t in texts for k, a, b in base(t)]
    contexts = set()
    for i, t, k, a, b, value in spans:
        left = [m for m in re.finditer(r"[^\W\d_]{3,}", t[max(0, a - 80) : a]) if m.start() > 0 or a < 80][-5:]
        right = [m for m in re.finditer(r"[^\W\d_]{3,}", t[b : b + 80]) if m.end() < 80 or len(t[b : b + 80]) < 80][:5]
        cls = (k, value.split("@")[-1] if k == "email" else value[:6])
        contexts |= {(i, t, k, value, cls, m.group().lower(), o + m.start()) for o, ms in ((max(0, a - 80), left), (b, right)) for m in ms}
    co = Counter((c[3], c[5]) for c in contexts)
    n_entity = Counter(s[5] for s in spans)
    places = {(c[1], c[2], c[4], c[5], c[6]) for c in contexts}
    co_class, n_kind, n_class, n_all = Counter((p[2], p[3]) for p in places), Counter((p[1], p[3]) for p in places), Counter(p[2] for p in places), Counter(p[1] for p in places)
    ratio = lambda c, m, ic: math.log2(min(c / (m + 1), 1)) / ic + 1 if ic > 0 else -1
    want = {}
    for i, t, k, value, cls, w, at in contexts:
        if ratio(co[value, w], n[w], math.log2(total / n_entity[value])) >= 0.9:
            want[i, at] = "<TERM>"
        elif co_class[cls, w] >= pii_disclosure.CLASS_SUPPORT and ratio(co_class[cls, w], n_kind[k, w], math.log2(n_all[k] / n_class[cls])) >= 0.9:
            want.setdefault((i, at), "<NAME>" if t[at].isupper() else "<WORD>")
    assert {"<TERM>", "<NAME>"} <= set(want.values())
    docs = frame(spark, rows)
    got = {(r["doc_id"], int(s.split(":")[1])) for r in pii_disclosure.find_pii(docs).collect() for s in r["spans"].split(",") if s.startswith("term")}
    assert got == set(want)
    clean = {r["doc_id"]: r["text"] for r in pii_disclosure.redact(docs).collect()}
    for i, t in texts:
        expected, cut = t, [(a, b, f"<{k.upper()}>") for k, a, b in base(t)] + [(a, a + len(re.match(r"[^\W\d_]+", t[a:]).group()), tag) for (d, a), tag in want.items() if d == i]
        for a, b, tag in sorted(cut, reverse=True):
            expected = expected[:a] + tag + expected[b:]
        assert clean[i] == expected


def test_redact_long_text_with_many_spans(spark):
    piece = "é😀 words of x@y.zz and 10.0.0.1 "
    docs = spark.createDataFrame([(1, piece * 6000, 7)], "doc_id long, text string, pii_id int")
    out = pii_disclosure.redact(docs, disclosure=2.0)
    assert out.columns == docs.columns and out.first()["text"] == "é😀 words of <EMAIL> and <IP> " * 6000


def test_redact_overlaps_and_nulls(spark):
    docs = frame(spark, [(1, "call +4111111111111111 or 4111111111111111 now"), (2, None), (3, "😀 x@y.zz 😀"), (4, ""), (3, "plain")])
    text = [r["text"] for r in pii_disclosure.redact(docs).orderBy("doc_id", "text").collect()]
    assert text[0].count("41111") == 0 and text[0].startswith("call ") and text[0].endswith(" now")
    assert text[1] is None and sorted(text[2:4]) == ["plain", "😀 <EMAIL> 😀"] and text[4] == ""


# ------------------------------------------------------------------ URL
def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://example.net/de/", "x://b.example.com/de/1", "http://sub.org/fr/", "http://org/en", "no scheme", None, "http://h?x", "http://h#x", "http://host", "a://b://c/d", "http://notexample.com/de/", "http://net"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_reputation.judge(pages, spark.createDataFrame([], "page_id long, bad boolean")).collect()}
    want = {}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = low(m[1]), m[2]
        fits = [t for _, t in url_reputation.RULES for n, _, p in [t.partition("/")] if (host == n or host.endswith("." + n)) and path.startswith("/" + p)]
        want[i] = (host, path, max(fits, key=len, default=None))
    assert got == want


def test_reputation_shrinks_to_domain_and_blocks_bad_hosts(spark):
    rows, bad = [], []
    for h, n, share in (("bad.one.com", 60, 0.95), ("ok.two.com", 60, 0.05), ("few.one.com", 1, 1.0), ("new.two.com", 0, 0)):
        for k in range(max(n, 2)):
            rows.append((len(rows), f"http://{h}/{k}"))
            if k < n:
                bad.append((rows[-1][0], k < n * share))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = url_reputation.judge(pages, spark.createDataFrame(bad, "page_id long, bad boolean")).collect()
    verdict = {r["host"]: r["verdict"] for r in out}
    rate = {r["host"]: r["bad_rate"] for r in out}
    assert verdict["bad.one.com"] == "block" and verdict["ok.two.com"] == "allow" and verdict["new.two.com"] == "allow"
    assert rate["few.one.com"] < 1 and rate["bad.one.com"] > rate["new.two.com"] > 0 and len(out) == len(rows)
    assert url_reputation.judge(pages.limit(0), spark.createDataFrame(bad, "page_id long, bad boolean")).count() == 0


def test_posteriors_of_all_levels_against_brute_force(spark):
    rng = random.Random(6)
    hosts = [f"h{i}.d{i % 7}.{('com', 'co.uk', 'org')[i % 3]}" for i in range(40)]
    rate = {h: 0.9 if i % 10 == 0 else 0.05 for i, h in enumerate(hosts)}
    rows, bad = [], {}
    for p in range(3000):
        h = hosts[min(int(rng.expovariate(0.1)), 39)]
        rows.append((p, f"http://{'me@' if p % 50 == 0 else ''}{h.upper() if p % 3 else h}{':8080' if p % 7 == 0 else ''}/a{p}"))
        if rng.random() < 0.7:
            bad[p] = rng.random() < rate[h]
    rows += rows[:50] + [(5000, None), (5001, "http://" + "x" * 100_000 + ".com/")]
    site = lambda u: re.sub(r":[0-9]*$", "", re.sub("^.*@", "", low(re.match(r"[^/?#]*", u.split("://", 1)[1])[0]))) if u and "://" in u else ""
    suffix = lambda s: ".".join(s.split(".")[-2:]) if ".".join(s.split(".")[-2:]) in url_reputation.LONG_SUFFIXES else s.split(".")[-1]
    domain = lambda s: ".".join(s.split(".")[-(suffix(s).count(".") + 2) :])
    seen = {(site(u), p) for p, u in rows if p in bad}
    every = {site(u) for _, u in rows}
    overall = (sum(bad[p] for _, p in seen) + 0.5) / (len(seen) + 1)

    def posterior(groups, prior):
        n = {g: sum(s in m for s, _ in seen) for g, m in groups.items()}
        b = {g: sum(s in m and bad[p] for s, p in seen) for g, m in groups.items()}
        some = [g for g in groups if n[g]]
        spread = sum(n[g] * (b[g] / n[g] - prior[g]) ** 2 for g in some)
        noise, room = (sum(f(n[g]) * prior[g] * (1 - prior[g]) for g in some) for f in (lambda x: 1, lambda x: x - 1))
        share = (spread - noise) / room
        k = 1000.0 if share <= 1 / 1001 else min(1000.0, max(1.0, 1 / share - 1))
        ab = {g: (prior[g] * k + b[g], (1 - prior[g]) * k + n[g] - b[g]) for g in groups}
        return {g: (a / (a + c), math.sqrt(a * c / ((a + c) ** 2 * (a + c + 1)))) for g, (a, c) in ab.items()}

    by = lambda key: {g: {s for s in every if key(s) == g} for g in {key(s) for s in every}}
    suffixes = posterior(by(suffix), dict.fromkeys(by(suffix), overall))
    domains = posterior(by(domain), {d: suffixes[suffix(d)][0] for d in by(domain)})
    sites = posterior(by(lambda s: s), {s: domains[domain(s)][0] for s in every})
    pages = spark.createDataFrame([(p, u, None) for p, u in rows], "page_id long, url string, site string")
    out = url_reputation.judge(pages, spark.createDataFrame(list(bad.items()), "page_id long, bad boolean")).collect()
    assert len(out) == len(rows)
    blocked = set()
    for r in out:
        s = site("x://" + r["host"]) if r["host"] else ""
        mean, sd = sites[s]
        assert r["bad_rate"] == pytest.approx(mean, abs=1e-8) and r["lower_bound"] == pytest.approx(mean - 1.645 * sd, abs=1e-8)
        bound = mean - 1.645 * sd
        if r["rule"] is None:
            assert r["verdict"] == ("block" if bound / (1 - bound) >= 2 * overall / (1 - overall) else "allow")
            blocked |= {s} if r["verdict"] == "block" else set()
    planted = {h for h in hosts if rate[h] > 0.5}
    assert len(blocked & planted) >= 2 and blocked <= planted


# ------------------------------------------------------------------ mixing
def fill(sizes, weights=(5, 2, 1), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, clamped = sum(sizes.values()), {}, set()
    while True:
        free = [s for s in names if s not in clamped]
        rest = total - sum(epochs * sizes[s] for s in clamped)
        target = {s: epochs * sizes[s] if s in clamped else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > epochs * sizes[s]}
        if not over:
            return target
        clamped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing_against_iterated_clamping(spark, seed):
    rng = random.Random(seed)
    sources = ["a", "b", "Z", "é", "", None, "empty"]
    weights = [rng.random() ** 3 for _ in sources]
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), None, rng.choices(sources, weights)[0]) for i in range(600)]
    rows += [(1000, None, None, "empty"), (1001, "\t \n", None, "empty"), (5, "again x", None, "a"), (None, "x y z", None, None)]
    rows = [(i, None if s == "empty" else t, g, s) for i, t, g, s in rows]
    docs = frame(spark, rows)
    out = mixing.mix(docs).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
    sizes, taken = {}, {}
    for r in out:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 3 * r["size"]
    want = fill(sizes)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    assert all(abs(taken[s] - want[s]) <= 60 for s in want) and len(out) == len(rows)
    kept = mixing.mix_rows(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["repeats"] > 0 for r in out)


def test_mixing_empty(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["target"] for r in mixing.mix(frame(spark, [(1, None, None, "a"), (2, "", None, None)])).collect()] == [0.0, 0.0]


# ------------------------------------------------------------------ decontamination
ITEMS = [
    (0, "A farmer named Alice bought 12 apples for 3 dollars and sold them at the market near Berlin for 7 dollars each."),
    (1, "The quick brown fox jumps over the lazy dog while many curious people watch from the old wooden bridge."),
    (2, "What is love?"),
    (3, "1 2 3 4 5 6 7 8 9 10"),
    (4, None),
    (5, ""),
]


def test_decontamination_finds_copies_and_new_parameters(spark):
    q, fox = ITEMS[0][1], ITEMS[1][1]
    other = q.replace("Alice", "Robert").replace("12", "45").replace("3 dollars", "9 dollars").replace("Berlin", "Madrid").replace("7 dollars", "8 dollars")
    mixed = "A farmer named Alice bought 12 apples. Unrelated words then follow for a long while without any further meaning."
    rows = [(10, "intro text here. " + q + " outro"), (11, "intro text here. " + other), (12, fox.upper()), (13, "nothing to see in this text at all"), (14, None), (15, ""), (16, "so: What is love? indeed"), (20, "so What is love? indeed"), (17, " ".join(map(str, range(50)))), (18, mixed), (19, "word " * 20_000 + fox), (10, "intro text here. " + q + " outro"), (None, q)]
    bench = spark.createDataFrame([(i, t, None) for i, t in ITEMS], "item_id long, text string, doc_id long")
    docs = frame(spark, rows)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(docs, bench).collect()}
    assert found == {(10, 0), (11, 0), (12, 1), (16, 2), (17, 3), (19, 1), (20, 2)}
    flags = decontam.flag_documents(docs, bench).collect()
    assert len(flags) == len(rows) and {r["doc_id"] for r in flags if r["contaminated"]} == {10, 11, 12, 16, 17, 19, 20}
    kept = decontam.remove_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {13, 14, 15, 18, None}
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.leaks(docs.limit(0), bench).count() == 0


def test_decontamination_recall_by_length_and_classes(spark):
    """Items of 3 to 40 words pasted in mid-sentence and as a sentence, as they
    are and with other numbers and names; every one is found, and items that
    differ in their values alone are one class."""
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "lmnrst"]
    items, docs, want = [], [], set()

    def wording(k, numbers, name):
        body = [rng.choice(words) for _ in range(k)]
        return lambda n, m: " ".join([body[0].capitalize(), *[n[i // 9 % 3] if i % 9 == 4 else m if i % 13 == 10 else w for i, w in enumerate(body[1:], 1)]]) + "."

    for k in (3, 4, 5, 6, 7, 8, 9, 12, 20, 40):
        for _ in range(4):
            make = wording(k, None, None)
            i = len(items)
            items.append((i, make(("12", "7", "345"), "Alice")))
            same, other = items[-1][1], make(("8", "93", "5"), "Robert")
            filler = lambda: " ".join(rng.choices(words, k=30))
            for text in (f"{filler()} {same} {filler()}", f"{filler()}. {same}", *([f"{filler()}. {other}"] if k >= 8 else [])):
                docs.append((len(docs), text))
                want.add((len(docs) - 1, i))
    # Twenty items of one template.
    tail = "apples at the market near the old bridge and gave some of them to a friend"
    items += [(100 + j, f"A farmer bought {j + 3} {tail}.") for j in range(20)]
    docs.append((1000, f"so: A farmer bought 77 {tail}."))
    bench = spark.createDataFrame(items, "item_id long, text string")
    index, members = decontam.item_classes(bench, "item_id", "text")
    sizes = sorted(r["count"] for r in members.groupBy("cls").count().collect())
    assert sizes[-1] == 20 and sizes[-2] == 1
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(frame(spark, docs), bench).collect()}
    assert want <= found and found - want == {(1000, 100 + j) for j in range(20)}


def test_decontamination_keys_by_id_and_text(spark):
    fox = ITEMS[1][1]
    docs = spark.createDataFrame([("a", fox), ("a", "clean words"), ("b", fox), ("b", fox), (None, fox), ("c", "x " * 50_000 + fox)], "doc_id string, text string")
    bench = spark.createDataFrame([("q1", fox), ("q0", fox)], "item_id string, text string")
    assert sorted(map(tuple, decontam.remove_leaks(docs, bench).collect()), key=str) == sorted([("a", "clean words"), (None, fox)], key=str)
    flags = sorted(((r["doc_id"], r["contaminated"], r["item_id"], r["n_items"]) for r in decontam.flag_documents(docs, bench).collect()), key=str)
    assert flags == sorted([("a", True, "q0", 2), ("a", False, None, 0), ("b", True, "q0", 2), ("b", True, "q0", 2), (None, False, None, 0), ("c", True, "q0", 2)], key=str)


def test_decontamination_by_shuffle_gives_the_same(spark, monkeypatch):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = frame(spark, [(1, "so " + ITEMS[1][1]), (2, "none of it")])
    one = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == one and len(one) == 1


def test_inconsistent_slots_are_no_leak(spark):
    item = "Take 5 coins from the box then put 5 coins back and count 5 coins again before adding 5 coins more to 5 coins"
    numbers = iter("1 2 3 4 6".split())
    docs = frame(spark, [(1, re.sub("5", lambda m: next(numbers), item)), (2, item.replace("5", "8"))])
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.leaks(docs, bench).collect()} == {2}


def test_mixing_keeps_columns_of_any_name_and_long_texts(spark):
    docs = spark.createDataFrame([(f"d{i}", "w " * (60_000 if i == 3 else 5), "a", i, 2 * i) for i in range(9)], "doc_id string, text string, source string, __mix_id int, cut_bucket int")
    out = mixing.mix_rows(docs)
    assert out.columns == [*docs.columns, "mix_repeats"] and all(r["cut_bucket"] == 2 * r["__mix_id"] and r["mix_repeats"] == 1 for r in out.collect()) and out.count() == 9
    assert {r["size"] for r in mixing.mix(docs).collect()} == {60_000, 5}


# ------------------------------------------------------------------ the pipeline
def test_pipeline_is_its_stages(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = docs
    for name, stage in P.STAGES:
        before, last = last, stage(spark, last, sf)
        assert last.count() <= before.count(), name
        if name != "mixing":
            assert last.columns == docs.columns
        ids = {r[0] for r in before.select("doc_id").collect()}
        assert {r[0] for r in last.select("doc_id").collect()} <= ids
        from plumbline.scratch import materialise

        last = materialise(last, "test")
    spans = pii_disclosure.find_pii(last)
    assert spans.agg(F.sum(F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone"))).first()[0] == 0


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Nulls in every column, repeated rows, one id for two texts, an empty and
    a very long text, clashing names, and no rows at all."""
    import corpus_pipeline as P

    good = [(i, f"Some quite ordinary words number {i} stand in this line of text, and others follow them.", "en", "web", 10) for i in range(60, 66)]
    odd = [(1, None, None, None, None), (2, "", "en", None, 0), (None, good[0][1] + " More.", None, "web", 5), good[0], good[0], (61, "Another text of the same id, with words of its own kind here.", "en", "web", 1), (3, "long words here " * 20_000, "en", "b", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in good + odd], schema + ", component int, text_key string, __mix_h int")
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        extra = ["mix_repeats"] if name == "mixing" else []
        assert out.columns == [*docs.columns, *extra], name
        assert out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    kept = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, sf).collect() if r["doc_id"] == 61 or r["doc_id"] == 60)
    assert [i for i, _ in kept] == [60, 61, 61]
