"""Steps whose cost grew faster than the tables."""

import time

from pyspark.sql import functions as F

from plumbline.functions import text as X
from plumbline.functions import udfs
from plumbline.operators import candidates, components, corpus, network
from plumbline.plans import analysis, catalogue


def test_character_shingles_of_any_length(spark):
    """Whole at the seams of pieces and blocks, with signs of one to four bytes."""
    signs = "aß语𝒳 b"
    texts = ["".join(signs[(i * i + i // 7) % len(signs)] for i in range(n)) for n in (0, 1, 8, 9, 31, 32, 33, 40, 41, X.BLOCK, X.BLOCK + 8, X.BLOCK + 9, 3 * X.BLOCK + 5)]
    for width in (1, 9):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.char_shingles(F.col("t"), width).alias("g")).collect()
        for r in rows:
            t = texts[r["i"]]
            assert list(r["g"]) == [t[k : k + width] for k in range(len(t) - width + 1) if t]


def test_character_shingles_in_proportion_to_the_text(spark):
    """A shingle must not cost a walk from the text's start: 600,000 characters
    took minutes."""
    text = spark.range(1).select(F.repeat(F.lit("abcdefgh ij "), 50_000).alias("t"))
    began = time.perf_counter()
    assert text.select(F.size(X.char_shingles(F.col("t"), 9)).alias("n")).first()["n"] == 600_000 - 8
    assert time.perf_counter() - began < 30


def test_pattern_hits_take_apart_the_paired_texts_alone(spark, sf, monkeypatch):
    seen = []
    rows_of = catalogue.evidence.token_rows
    monkeypatch.setattr(catalogue.evidence, "token_rows", lambda docs: seen.append(docs.count()) or rows_of(docs))
    hits = catalogue.QUERIES["multi_pattern_hits"](spark, sf)
    paired = catalogue.overlapping(spark, sf)[2].select("sub_pos").distinct().count()
    assert hits.count() > 0 and seen[0] == paired < catalogue.table(spark, sf, "documents").count()


def test_scores_take_the_paired_texts_alone(spark, sf):
    subs, refs, pairs = catalogue.overlapping(spark, sf)
    for docs, key, table in ((subs, "sub_pos", "documents"), (refs, "ref_pos", "benchmark")):
        assert docs.count() == pairs.select(key).distinct().count() > 0
        assert docs.count() <= catalogue.table(spark, sf, table).count()
    assert subs.count() < catalogue.table(spark, sf, "documents").count()


def test_texts_without_a_common_shingle_are_not_taken_apart(spark):
    """Odd ones stay: repeated and null ids, texts without shingles, other letters."""
    texts = [(1, "a b c d e"), (1, "x y z w"), (2, ""), (2, ""), (None, "a b c d"), (None, "q"), (3, "ß 𝒳 语 é ü"), (4, "nothing in common here at all")]
    subs = corpus.prepare(spark.createDataFrame(texts, "k long, t string"), "k", "t", "D", None)
    refs = corpus.prepare(spark.createDataFrame([(7, "z a b c d"), (8, "𝒳 语 é ü"), (9, "b")], "k long, t string"), "k", "t", "B", None)
    met = candidates.sharing(subs, refs, 4)
    assert sorted(((r["pos"], r["short"]) for r in met.collect()), key=str) == sorted([(1, False), (None, False), (3, False), (2, True), (2, True), (None, True)], key=str)
    assert {(r["sub_pos"], r["ref_pos"], r["both"]) for r in candidates.jaccard_pairs(subs, refs, 4).collect()} == {(1, 7, 1), (None, 7, 1), (3, 8, 1)}
    pairs = [(r["sub_pos"], r["ref_pos"], r["estimate"]) for r in candidates.minhash_candidates(subs, refs, 0.12, 4).collect()]
    assert sorted((p[:2] for p in pairs if p[2] is None), key=str) == sorted([(p, r) for p in (2, 2, None) for r in (7, 8, 9)] + [(p, 9) for p in (1, 1, None, 3, 4)], key=str)
    assert {p[:2] for p in pairs if p[2]} == {(1, 7), (None, 7), (3, 8)}


def test_the_analysis_scores_the_candidates_texts_alone(spark, sf, monkeypatch):
    seen = []
    score = analysis.score_pairs
    monkeypatch.setattr(analysis, "score_pairs", lambda pairs, subs, refs, settings: seen.append((subs.count(), pairs.select("sub_pos").distinct().count())) or score(pairs, subs, refs, settings))
    assert catalogue.QUERIES["full_pipeline"](spark, sf).count() > 0
    assert seen[0][0] == seen[0][1] < catalogue.table(spark, sf, "documents").count()


def test_members_ask_for_no_edges(spark, sf, monkeypatch):
    monkeypatch.setattr(catalogue.candidates, "similar_pairs", None)
    assert catalogue.QUERIES["graph_members"](spark, sf).count() > 0


def test_the_snapshot_finds_its_edges_once(spark, sf, monkeypatch):
    asked = []
    pairs = catalogue.candidates.similar_pairs
    monkeypatch.setattr(catalogue.candidates, "similar_pairs", lambda *a: asked.append(1) or pairs(*a))
    assert catalogue.QUERIES["graph_snapshot"](spark, sf).count() > 0 and len(asked) == 1


def test_strong_components_send_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    store = network.materialise
    monkeypatch.setattr(network, "materialise", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, label))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1)], "src long, dst long")
    got = dict(network.strong_components(edges).collect())
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6} and plans
    assert not any("Broadcast" in p for p in plans)


def test_a_large_forest_sends_no_table_to_the_driver(spark, monkeypatch):
    plans = []
    store = network.materialise
    seen = lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, label)
    edges = spark.createDataFrame([(i, i + 1 + i % 3, float(i % 7)) for i in range(40)] + [(100, 101, 1.0)], "src long, dst long, cost double")
    want = sorted(map(tuple, network.minimum_forest(edges).collect()))
    monkeypatch.setattr(network, "materialise", seen)
    monkeypatch.setattr(components, "materialise", seen)
    monkeypatch.setattr(network, "DRIVER_EDGES", 10)
    monkeypatch.setattr(network.K, "kruskal", None)
    assert sorted(map(tuple, network.minimum_forest(edges).collect())) == want and plans
    assert not any("Broadcast" in p for p in plans)


def test_pairs_share_the_sets_that_move(spark):
    """A set goes to each cell once: in a group of 60 documents a set a pair was moved."""
    sets = spark.createDataFrame([(i, 9, [0, 1, 2, i + 10]) for i in range(60)] + [(100, 3, [5, 6]), (101, 3, [6, 7])], "pos long, n int, c array<long>")
    pairs = spark.createDataFrame([(i, j) for i in range(60) for j in range(i + 1, 60)] + [(100, 101)], "a long, b long")
    for block, most in ((256, 62), (8, 2000)):
        rows = candidates.in_cells(pairs, sets, block)
        assert rows.filter("b is not null").count() == pairs.count()
        assert rows.filter("b is null").count() <= most < pairs.count() + 300
        got = {(r["a"], r["b"]): (r["both"], r["na"], r["nb"]) for r in udfs.overlaps(rows).collect()}
        assert got == {(i, j): (3, 9, 9) for i in range(60) for j in range(i + 1, 60)} | {(100, 101): (1, 3, 3)}


def test_pairs_of_repeated_ids_meet_all_their_sets(spark):
    rows = [(7, 1, None, 4, [1, 2, 2]), (7, 1, None, 5, [3]), (7, 2, None, 6, [2, 3]), (7, 1, 2, None, None), (8, 1, None, 2, []), (8, 3, None, 2, [1]), (8, 1, 3, None, None)]
    rows = spark.createDataFrame(rows, "cell long, a long, b long, n int, c array<long>").coalesce(1)
    want = [(1, 2, 1, 4, 6), (1, 2, 1, 5, 6), (1, 3, 0, 2, 2)]
    assert sorted(map(tuple, udfs.overlaps(rows).collect())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # cells go on over batches
    try:
        assert sorted(map(tuple, udfs.overlaps(rows).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_shingles_of_the_normal_form_are_those_of_the_words(spark):
    """Hashed without a list of words, whether the references' hashes are sent or joined."""
    texts = ["The cat and the dog, of a house: a long-established incomprehensibility", "", None, "the of and", "ß 𝒳 语 é ü the İ Σ", " x  the y z w v ", "w" * 8 + " " + "w" * 9 + " " + "w" * 17 + " q r"]
    docs = corpus.prepare(spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1), "k", "t", "D")
    plain = docs.select("pos", "id", "words")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = rows(udfs.shingle_rows(plain, 3))
    assert rows(udfs.shingle_rows(docs, 3)) == want and len({r[2] for r in want if r[2]}) == sum(r[2] is not None for r in want)
    some = [r[2] for r in want if r[2] is not None][::2]
    assert {r[0] for r in rows(udfs.shingle_rows(docs, 3, some)) if r[2] is not None} == {r[0] for r in want if r[2] in some}
    assert "words" not in udfs.shingle_rows(docs, 3)._jdf.queryExecution().optimizedPlan().toString()


def test_hashes_beyond_the_bound_are_joined(spark, sf, monkeypatch):
    subs, refs = catalogue.submissions(spark, sf), catalogue.references(spark, sf)
    sent = sorted(map(tuple, candidates.sharing(subs, refs, 4).collect()), key=str)
    monkeypatch.setattr(candidates, "SENT", 3)
    assert sorted(map(tuple, candidates.sharing(subs, refs, 4).collect()), key=str) == sent


def test_paired_texts_are_taken_apart_once(spark, sf, monkeypatch):
    asked = []
    prepared = catalogue._prepared
    monkeypatch.setattr(catalogue, "_prepared", lambda *a: asked.append((a[2], a[5] is None)) or prepared(*a))
    assert catalogue.overlapping(spark, sf)[2].count() > 0
    assert asked.count(("documents", False)) == 1


def counted(monkeypatch, module):
    """Labels and rows of the tables that a module stores."""
    seen, stored = [], module.materialise

    def store(df, label):
        out = stored(df, label)
        seen.append((label, out.count()))
        return out

    monkeypatch.setattr(module, "materialise", store)
    return seen


def ways(spark, pairs):
    return spark.createDataFrame([(min(p), max(p), 0.5, 0.5) for p in pairs], "src long, dst long, similarity double, cost double")


def test_a_walk_stores_what_it_reaches(spark, monkeypatch):
    """Not the graph: all its edges were written, and shuffled, more than once."""
    crowd = [(a, b) for a in range(100, 150) for b in range(100, a)]
    edges = ways(spark, [(0, 1), (1, 2), (2, 3), (1, 3), *crowd])
    seen = counted(monkeypatch, network)
    path = network.path_between(edges, 0, 3)
    assert [(r["src"], r["dst"]) for r in path.orderBy("step").collect()] == [(0, 1), (1, 3)]
    assert network.on_path(edges, path).filter("selected").count() == 2
    assert seen and max(n for _, n in seen) <= 4


def test_only_chains_are_drawn_together(spark, monkeypatch):
    crowd = [(a, b) for a in range(100, 130) for b in range(100, a)]
    chain = [(v, v + 1) for v in range(40)] + [(40, 100)]
    edges = ways(spark, crowd + chain)
    seen = counted(monkeypatch, network)
    far = {r["v"]: r["distance"] for r in network.distances(edges, 0).collect()}
    assert far == {v: v / 2 for v in range(41)} | {100: 20.5} | {v: 21.0 for v in range(101, 130)}
    half = [n for label, n in seen if label == "path-half"]
    assert half[0] == 2 * (len(crowd) + len(chain)) and max(half[1:]) <= 4 * len(chain)


def test_path_edges_walks_once(spark, sf, monkeypatch):
    walked, far = [], network.distances
    monkeypatch.setattr(network, "distances", lambda *a, **k: walked.append(1) or far(*a, **k))
    assert catalogue.QUERIES["path_edges"](spark, sf).count() >= 0 and len(walked) <= 1


def test_sets_of_the_normal_form(spark):
    """Of one member for each different shingle, with one key for equal sets alone."""
    texts = ["The cat and the dog, of a house: a long-established one", "", None, "the of and", "cat dog house long", "cat dog house long cat dog house", "house long cat dog house cat dog", "CAT, dog; house, long the"]
    docs = corpus.prepare(spark.createDataFrame(list(enumerate(texts)), "k long, t string").coalesce(1), "k", "t", "D")
    want = {r["pos"]: frozenset(zip(r["words"], r["words"][1:], r["words"][2:], strict=False)) for r in docs.select("pos", "words").collect()}
    for frame in (docs, docs.select("pos", "words")):
        got = {r["pos"]: (r["s"], r["key"]) for r in udfs.shingle_sets(frame, 3).collect()}
        assert {p: len(s) for p, (s, _) in got.items()} == {p: len(s) for p, s in want.items()} and all(s == sorted(set(s)) for s, _ in got.values())
        assert all((got[p] == got[q]) == (got[p][1] == got[q][1]) == (want[p] == want[q]) for p in want for q in want)
    assert "words" not in udfs.shingle_sets(docs, 3)._jdf.queryExecution().optimizedPlan().toString()
