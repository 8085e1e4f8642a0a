"""Evidence by joins against the definition, pair by pair."""

import random

import pytest
from pair_evidence import Text, pair_evidence
from pyspark.sql import functions as F

from plumbline.operators import corpus, evidence, scoring
from plumbline.settings import STOPWORDS, Settings

ODD = [
    "",
    "short İstanbul-phrase of twenty-eight",
    "prefix short İstanbul-phrase of twenty-eightfold and more words to follow here",
    "Alpha beta, the gamma delta epsilon; zeta eta theta iota kappa lambda mu nu",
    "megaalpha beta THE gamma delta epsilon zeta eta theta iota kappa lambdas",
    "İİ alpha İx beta gammaİ delta epsilon İİalpha İx beta gammaİ deltaİ and onİİ",
    "𐐀bc alpha İx beta gammaİ delta; xİİalpha İx beta gammaİ deltaİ",
    "one two three four five six seven eight one two three four five six seven eight nine",
    "the the the of of and",
    "ΟΔΟΣ ΣΣ ΟΔΟΣΑ alpha ΣΑΣ beta ΟΔΟΣ gamma",
    "xΟΔΟΣ ΣΣ ΟΔΟΣΑ alpha ΣΑΣ beta ΟΔΟΣ gammas",
]


def texts():
    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "the", "of", "epsilon", "Zeta", "ETA9", "straße", "éa"]
    return ODD + [" ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n", " -"]) for _ in range(rng.randint(3, 60))) for _ in range(14)]


@pytest.mark.parametrize("settings", [Settings(), Settings(word_shingle_size=7, min_exact_phrase_characters=12), Settings(remove_stopwords=False, enable_fuzzy=False, word_shingle_size=2), Settings(enable_exact=False)])
def test_evidence_equals_the_definition(spark, settings):
    given = texts()
    stop = STOPWORDS if settings.remove_stopwords else ()
    docs = corpus.prepare(spark.createDataFrame(list(enumerate(given)), "k long, t string"), "k", "t", "D", stop or None)
    pairs = [(a, b) for a in range(len(given)) for b in range(len(given)) if (a * 7 + b * 3) % 4 == 0]
    cases = spark.createDataFrame([(f"c{a}-{b}", a, f"D{a}", b, f"D{b}", 0.25) for a, b in pairs], "case_id string, sub_pos long, sub_id string, ref_pos long, ref_id string, shingle double")
    got = {}
    for r in evidence.evidence(cases, docs, docs, settings).collect():
        got.setdefault(r["case_id"], []).append(tuple(r))
    for a, b in pairs:
        want = pair_evidence(f"c{a}-{b}", Text(given[a], frozenset(stop)), Text(given[b], frozenset(stop)), 0.25, settings)
        assert sorted(got.get(f"c{a}-{b}", []), key=lambda r: r[1]) == want, (given[a], given[b])


def test_all_hits_of_phrases(spark):
    given = texts()
    docs = corpus.prepare(spark.createDataFrame(list(enumerate(given)), "k long, t string"), "k", "t", "D")
    tokens = evidence.token_rows(docs)
    pairs = spark.createDataFrame([(7, 7), (3, 4), (5, 6), (10, 12)], "sub_pos long, ref_pos long")
    got = {(r["sub_pos"], r["ref_pos"], r["phrase"], r["place"]["norm_at"]) for r in evidence.phrase_hits(pairs, tokens, tokens, Settings()).collect()}
    want = set()
    for a, b in [(7, 7), (3, 4), (5, 6), (10, 12)]:
        x, y = Text(given[a], frozenset()), Text(given[b], frozenset())
        for p in {" ".join(x.tokens[i : i + 5]) for i in range(len(x.tokens) - 4)}:
            want |= {(a, b, p, k) for k in range(len(y.norm)) if len(p) >= 28 and y.norm.startswith(p, k)}
    assert got == want


def test_pairs_come_before_the_texts_meet(spark):
    """A passage that all share is met by the paired documents only."""
    text = "alpha beta gamma delta epsilon zeta eta theta"
    docs = corpus.prepare(spark.createDataFrame([(i, text) for i in range(300)], "k long, t string"), "k", "t", "D")
    cases = spark.createDataFrame([("x", 1, "D1", 2, "D2", 0.5)], "case_id string, sub_pos long, sub_id string, ref_pos long, ref_id string, shingle double")
    assert evidence.token_rows(docs).count() == 2400
    assert evidence.evidence(cases, docs, docs, Settings()).count() == 4 + 1 + 5 + 1
    assert scoring.exact_matches(cases, docs, docs, Settings()).count() == 4
    assert evidence.evidence(cases.filter(F.lit(False)), docs, docs, Settings()).isEmpty()
