"""Operators on small frames, and registered queries against their SQL."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.functions import text as X
from plumbline.operators import candidates, corpus, evidence, network, ranking, scoring
from plumbline.operators.components import connected_components
from plumbline.plans import analysis, catalogue
from plumbline.settings import Settings
from plumbline.sources import ingest


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_functions(spark):
    L = F.lit
    assert one(spark, X.normalize(L("  Data, DATA! structures\nwork. "))) == "data data structures work"
    words = F.array(*[L(w) for w in "one two three four".split()])
    assert one(spark, X.word_shingles(words, 3)) == ["one two three", "two three four"] and one(spark, X.word_shingles(words, 5)) == []
    assert one(spark, X.char_shingles(L("abcd"), 2)) == ["ab", "bc", "cd"] and one(spark, X.char_shingles(L(""), 2)) == []
    a, b = F.array(L("a"), L("a"), L("b")), F.array(L("b"), L("c"))
    empty = F.array().cast("array<string>")
    assert one(spark, X.set_jaccard(a, b)) == 1 / 3 and one(spark, X.set_jaccard(empty, empty)) == 0.0 and one(spark, X.set_jaccard(empty, empty, 1.0)) == 1.0
    assert one(spark, X.positions(L("aaaa"), L("aa"))) == [0, 1, 2] and one(spark, X.positions(L("banana"), L("ana"))) == [1, 3] and one(spark, X.positions(L("x"), L(""))) == [0]
    text = "first\rsecond\r\nthird\nfourth"
    assert [one(spark, X.line_of(L(text), L(text.index(w)))) for w in ("second", "third", "fourth")] == [2, 3, 4]
    assert one(spark, X.column_of(L(text), L(text.index("third") + 2))) == 3
    assert one(spark, X.remove_stopwords(F.array(L("the"), L("x"), L("x")), ("The", "a b"))) == ["x", "x"]
    assert one(spark, X.csv_quote(L('a"b'))) == '"a""b"' and one(spark, X.percent(L(0.12345))) == "12.35%"


def test_components_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(None, 1)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {v: find(v) for v in root}


def test_graph_operators_agree_with_kernels(spark):
    rng = random.Random(4)
    pairs = [(a, b, round(rng.random(), 3)) for a in range(14) for b in range(a) if rng.random() < 0.25]
    edges = network.edges_of(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s", 0.2)
    rows = [(r["src"], r["dst"], r["cost"]) for r in edges.collect()]
    want = sorted(K.kruskal(14, rows))
    assert sorted(map(tuple, network.minimum_forest(edges).collect())) == want == sorted(map(tuple, network.boruvka(edges).collect()))
    source = rows[0][0]
    dist = {r["v"]: r["distance"] for r in network.distances(edges, source).collect()}
    assert dist == pytest.approx({v: d for v, d in enumerate(K.dijkstra(14, rows, source)[0]) if d < K.INF})
    assert {r["v"] for r in network.levels(edges, source).collect()} == set(dist)


def prepared(spark, texts, prefix):
    return corpus.prepare(spark.createDataFrame(list(enumerate(texts)), "k long, t string"), "k", "t", prefix)


def random_texts(seed, n):
    rng = random.Random(seed)
    words = "alphabetical brought capital the a delta epsilon framework grand harbour".split()
    return [" ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(n)] + ["Alphabetical brought capital the", "", "framework"]


def test_candidates_and_exact_scores_against_definitions(spark):
    a, b, s = random_texts(1, 25), random_texts(2, 8), Settings(min_exact_phrase_characters=12)
    subs, refs = prepared(spark, a, "D"), prepared(spark, b, "B")
    every = subs.select(F.col("pos").alias("sub_pos"), F.col("id").alias("sub_id")).crossJoin(refs.select(F.col("pos").alias("ref_pos"), F.col("id").alias("ref_id")))
    got = {(r["sub_pos"], r["ref_pos"]): r["exact"] for r in scoring.exact_scores(every, subs, refs, s).collect()}
    norm = lambda t: " ".join(t.lower().split())
    for i, x in enumerate(a):
        t = norm(x).split()
        made = [" ".join(t[k : k + 5]) for k in range(len(t) - 4)] if len(t) >= 5 else [norm(x)] if t else []
        eligible = {p for p in made if len(p) >= 12}
        for j, y in enumerate(b):
            assert got[i, j] == (sum(p in norm(y) for p in eligible) / len(eligible) if eligible else 0.0)
    rows = {r["id"]: (r["n"], r["sig"]) for r in candidates.signatures(subs).union(candidates.signatures(refs)).collect()}
    need = candidates.needed_matches(0.12)
    want = {(f"D{i}", f"B{j}") for i in range(len(a)) for j in range(len(b)) for m, p in [rows[f"D{i}"]] for n, q in [rows[f"B{j}"]] if not m or not n or sum(u == v for u, v in zip(p, q, strict=True)) >= need}
    assert {(r["sub_id"], r["ref_id"]) for r in candidates.minhash_candidates(subs, refs, 0.12).collect()} == want
    assert candidates.minhash_candidates(subs, refs, 0.0).count() == len(a) * len(b)


def test_similar_pairs_against_all_pairs(spark):
    texts = random_texts(7, 40)
    texts += [t + " extra" for t in texts[:15]] + texts[:5]
    docs = prepared(spark, texts, "D")
    got = {(r["a"], r["b"]): r["jaccard"] for r in candidates.similar_pairs(candidates.shingle_classes(docs, 2), 0.5).collect()}
    sets = {}
    for r in docs.select("pos", "words").orderBy("pos").collect():
        w = r["words"]
        sets.setdefault(frozenset(" ".join(w[k : k + 2]) for k in range(len(w) - 1)), r["pos"])
    sets.pop(frozenset(), None)
    want = {tuple(sorted((p, q))): len(s & t) / len(s | t) for s, p in sets.items() for t, q in sets.items() if p < q and len(s & t) / len(s | t) >= 0.5}
    assert got == want


def test_graph_over_documents_with_copies(spark):
    """Components, degrees, levels and distances against the graph in which
    every pair of documents, copies too, has its edge."""
    texts = random_texts(17, 25)
    texts += [t + " extra words" for t in texts[:10]] + texts[:6] + texts[:3] + ["", None]
    docs = prepared(spark, texts, "D")
    classes = candidates.shingle_classes(docs, 2)
    members = classes.select("pos", "representative")
    heads = network.edges_of(candidates.similar_pairs(classes, 0.4), "a", "b", "jaccard", 0.4)
    edges = network.with_members(heads, members)
    sets = {}
    for r in docs.select("pos", "words").collect():
        w = r["words"]
        sets[r["pos"]] = frozenset(" ".join(w[k : k + 2]) for k in range(len(w) - 1))
    near = {(p, q): len(s & t) / len(s | t) for p, s in sets.items() for q, t in sets.items() if p < q and s and t and len(s & t) / len(s | t) >= 0.4}
    full = [(p, q, max(1e-6, 1 - j)) for (p, q), j in near.items()]
    vertices = spark.createDataFrame([(p,) for p in sets], "v long")
    degree = {r["v"]: r["degree"] for r in network.degrees(heads, members, vertices).collect()}
    assert degree == {p: sum(p in e for e in near) for p in sets}
    source = min(p for p, _ in near)
    want, _ = K.dijkstra(len(texts), full, source)
    got = {r["v"]: r["distance"] for r in network.for_members(network.distances(edges, source), members, source, "distance", network.LEAST_COST).collect()}
    assert got == pytest.approx({v: x for v, x in enumerate(want) if x < K.INF})
    order = K.traverse(len(texts), full, source)
    level = {source: 0}
    for v in order:
        for p, q in near:
            if v in (p, q):
                level.setdefault(q if v == p else p, level[v] + 1)
    got = {r["v"]: r["level"] for r in network.for_members(network.levels(edges, source), members, source, "level", 1).collect()}
    assert got == level
    parts = {}
    for r in network.groups(edges).collect():
        parts.setdefault(r["group_id"], set()).add(r["v"])
    root = K.strong_components(len(texts), [(a, b, 1.0) for p, q in near for a, b in ((p, q), (q, p))])
    assert sorted(map(sorted, parts.values())) == sorted(g for g in ([v for v in range(len(texts)) if root[v] == c] for c in set(root)) if len(g) > 1)
    target = max((v for v in got), key=lambda v: want[v])
    path = network.path_between(edges, source, target).orderBy("step").collect()
    assert path[0]["src"] == source and path[-1]["dst"] == target and all(a["dst"] == b["src"] for a, b in zip(path, path[1:], strict=False))
    assert sum(r["cost"] for r in path) == pytest.approx(want[target], abs=2e-6)
    assert network.on_path(edges, network.path_between(edges, source, target)).filter("selected").count() == len(path)
    assert network.path_between(edges, source, len(texts) - 1).count() == 0
    small = network.put_edge(network.put_edge(heads.limit(0), 5, 2, 0.5), 2, 5, 0.75)
    assert network.weight_of(small, 5, 2) == 0.25 and network.weight_of(small, 1, 2) == K.INF and network.remove_edge(small, 5, 2).count() == 0
    one = spark.createDataFrame([(30_000_000, 1, 1.0)], "src long, dst long, cost double")
    assert network.on_driver(one, lambda n, e: list(enumerate(K.strong_components(n, e))), "v long, component int").collect() == [(1, 0), (30_000_000, 1)]


def test_null_and_astral_texts(spark):
    tail = "the committee reviewed every submitted document carefully before publishing the independent report"
    subs, refs = prepared(spark, [None, "\U0001f600" * 12 + " " + tail, ""], "D"), prepared(spark, ["Intro \U00010400. " + tail, None], "B")
    people = spark.createDataFrame([(0, "R1", "One", 1)], "pos int, id string, name string, capacity int")
    a = analysis.analyse(subs, refs, people, Settings(), 3, 2)
    assert a.cases.count() >= 3
    rows = [r for r in a.evidence.collect() if r["sub_end"] > r["sub_start"]]
    content = {f"D{i}": t or "" for i, t in enumerate([None, "\U0001f600" * 12 + " " + tail, ""])} | {"B0": "Intro \U00010400. " + tail}
    assert rows
    for r in rows:
        sub, ref = r["case_id"].split("-")[-2:]
        if r["type"] in ("EXACT", "MULTI_PATTERN"):
            assert content[sub][r["sub_start"] : r["sub_end"]] == r["excerpt"] == content[ref][r["ref_start"] : r["ref_end"]]


def test_fuzzy_of_two_empty_sides(spark):
    subs = prepared(spark, [""], "D")
    pair = spark.createDataFrame([(0, "D0", 0, "B0")], "sub_pos long, sub_id string, ref_pos long, ref_id string")
    assert scoring.fuzzy_scores(pair, subs, prepared(spark, [""], "B")).first()["fuzzy"] == 0.5


def test_assignment_and_ranges(spark):
    cases = spark.createDataFrame([(f"PD-{i}", f"S{i % 2}", t) for i, t in enumerate([0.9, 0.5, 0.5, 0.1, 0.31])], "case_id string, sub_id string, total double")
    people = spark.createDataFrame([(0, "R1", "One", 0), (1, "R2", "Two", 2), (2, "R3", "Three", 1)], "pos int, id string, name string, capacity int")
    done = ranking.assign(cases, people, 0.3)
    assert {r["case_id"]: r["reviewer_id"] for r in done.collect()} == {"PD-0": "R2", "PD-1": "R2", "PD-2": "R3"}
    assert [r["case_id"] for r in ranking.unassigned(cases, done, 0.3).collect()] == ["PD-4"]
    assert [r["case_id"] for r in ranking.ranked(cases).collect()] == ["PD-0", "PD-2", "PD-1", "PD-4", "PD-3"]
    seq = ranking.sequence(cases, 0.3)
    assert tuple(ranking.summarize(seq, 0, 2).first()) == (3, 500000, 900000, 1900000, pytest.approx(1900000 / 3), 3)
    with pytest.raises(IndexError):
        ranking.summarize(seq, 0, 5)
    titled = cases.withColumns({"risk": F.lit("LOW"), "sub_title": F.concat(F.lit("Title of "), F.lower("case_id"))})
    assert [r["case_id"] for r in ranking.filtered(titled, "title", "ALL").collect()] == ["PD-0", "PD-1"]
    assert [r["case_id"] for r in ranking.filtered(titled, "s1", "low").collect()] == ["PD-1"] and ranking.filtered(titled, "none").count() == 0
    assert [r["case_id"] for r in ranking.cases_of(cases, "S0").collect()] == ["PD-0", "PD-2", "PD-4"] and ranking.case_by_id(cases, "PD-3").count() == 1
    with pytest.raises(ValueError):
        ranking.add_to_range(seq, 0, 1, 0.2, 0.3)
    with pytest.raises(ValueError):
        ranking.reassign(done, people, "PD-0", "R3")
    assert ranking.reassign(done, people, "PD-0", None).count() == 2


def test_compaction_is_the_greedy_choice(spark):
    rng = random.Random(6)
    rows = []
    for c in range(25):
        for i in range(rng.randint(1, 14)):
            start = rng.randint(0, 500)
            rows.append((f"C{c}", i, rng.choice(evidence.TYPES), start, start + rng.choice([10, 60, 120, 300]), 0, 1, rng.choice([0.2, 0.5, 1.0]), "x", "y"))
    got = {}
    for r in evidence.compact(spark.createDataFrame(rows, evidence.SCHEMA), 4).orderBy("case_id", "place").collect():
        got.setdefault(r["case_id"], []).append(r["idx"])
    for c in got:
        mine = [r for r in rows if r[0] == c]
        units = [({(r[2], k) for k in range(64)} | {i}, max(0.01, r[7]), max(1.0, (r[4] - r[3]) / 50)) for i, r in enumerate(mine)]
        assert got[c] == (K.greedy_select(units, 4) if len(mine) > 4 else list(range(len(mine))))


def test_whole_analysis_on_copies(spark):
    text = "The committee reviewed every submitted document carefully before publishing the final independent report on academic honesty"
    subs, refs = prepared(spark, [text, "Completely unrelated sentences about gardening tools and flowers in spring"], "D"), prepared(spark, [text + " today"], "B")
    people = spark.createDataFrame([(0, "R1", "One", 1)], "pos int, id string, name string, capacity int")
    a = analysis.analyse(subs, refs, people, Settings(), 2, 1)
    row = a.cases.first()
    assert a.cases.count() == 1 and row["risk"] == "CRITICAL" and row["exact"] == 1.0 and 0 < row["graph"] <= 1 and a.edges.count() == 1
    assert tuple(a.stats.first()) == (2, 1, 0.5) and a.assigned.first()["reviewer_id"] == "R1"
    types = [r["type"] for r in a.evidence.orderBy("place").collect()]
    assert len(types) == 8 and set(types[:4]) == set(evidence.TYPES)
    off = analysis.analyse(subs, refs, people, Settings(enable_graph=False), 2, 1)
    assert off.edges.count() == 0 and off.cases.first()["graph"] == 0.0


def test_ingest(spark, tmp_path):
    files = {
        "a.txt": b"\xef\xbb\xbfID: DOC-1\nTITLE: A title\nAUTHOR: Someone\n\nBody text here.\n",
        "B.TXT": b"ID: DOC-1\n\nAgain the same id",
        "c.txt": b"",
        "d.txt": b"...!!!",
        "e.pdf": b"text",
        "f.txt": b"\xff\xfe broken",
        "g.txt": b"plain body\nID: not a header",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    docs, errors = ingest.import_files(ingest.parse(ingest.read_directory(spark, str(tmp_path)), "SUBMISSION"))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {"DOC-1", "g"} and got["DOC-1"]["title"] == "A title" and got["DOC-1"]["line_offset"] == 4 and got["DOC-1"]["content"].startswith("Body") and got["g"]["title"] == "g"
    assert errors.count() == 5
    text = tmp_path / "reviewers.csv"
    text.write_text("R1,One,2\nR1,Again,5\nbad line\nR2,,1\nR3,Three,x\n")
    assert [(r["id"], r["name"], r["capacity"]) for r in ingest.read_reviewers(spark, str(text)).orderBy("pos").collect()] == [("R1", "One", 2), ("R2", "R2", 1)]
    catalogue_rows = spark.createDataFrame([("b", "REFERENCE", "x\ty\\z"), ("a", "SUBMISSION", "p")], "doc_id string, doc_type string, path string")
    ingest.snapshot_lines(catalogue_rows).coalesce(1).write.text(str(tmp_path / "snap"))
    assert sorted(map(tuple, ingest.read_snapshot(spark, str(tmp_path / "snap")).collect())) == sorted(map(tuple, catalogue_rows.collect()))


def test_stream_scores_each_file_once(spark, tmp_path):
    from plumbline.streaming.ingest_stream import score_stream, stream_documents

    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([(k, f"text number {k}")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(source))
    stream = stream_documents(spark, str(source), "doc_id long, text string", 1)
    score_stream(stream, lambda df: df.withColumn("norm", X.normalize(F.col("text"))), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


@pytest.mark.parametrize("name", ["normalize_text", "best_reference", "exact_score", "composite_no_fuzzy", "groups", "locate", "report_summary"])
def test_query_against_sql(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "nation", "part", "customer", "orders", "labels"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.execute(catalogue.ORACLE[name]).df()
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_range_add_beyond_one_as_in_sql(spark, sf, tmp_path):
    """Submissions that are references stand at 1 already, at all changed places."""
    import duckdb

    db = duckdb.connect()
    texts = [t for (t,) in db.execute(f"select text from '{sf}/benchmark.parquet' order by item_id limit 8").fetchall()]
    texts += [f"{t} and some more words behind" for t in texts[:3]]
    for name, key in (("documents", "doc_id"), ("benchmark", "item_id")):
        spark.createDataFrame(list(enumerate(texts[:8] if key == "item_id" else texts)), f"{key} long, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(db.execute(catalogue.ORACLE["range_add"]).fetchall())
    got = sorted(map(tuple, catalogue.QUERIES["range_add"](spark, str(tmp_path)).select("pos", "case_id", "score", "flag").collect()))
    assert got == want and [r[2] for r in got[:8]] == [1_000_000] * 2 + [1_010_000] * 5 + [1_000_000]
