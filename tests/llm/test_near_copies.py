"""Near copies of the pipeline's stage against all pairs."""

import random

from plumbline.llm import near_copies


def _bytes(texts):
    """Data and offsets as of ``bytewords.text_groups``."""
    import numpy as np

    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_near_copies_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for n in (12, 30, 60, 120, 300):
        base = rng.choices(words, k=n)
        for edits in (0, 0, 1, 1, 2, 3, 5, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = rng.choice(words)
            texts.append(" ".join(w))
        texts.append(" ".join(base[: n - 2]).upper())
    # A chain whose ends are less alike, and a large group around one text.
    chain = rng.choices(words, k=100)
    texts += [" ".join(chain[i : i + 80]) for i in range(0, 20, 4)]
    hub = rng.choices(words, k=100)
    texts += [" ".join([*hub[:k], "new", *hub[k + 1 :]]) for k in range(20, 70)]
    rows = list(enumerate(texts)) + [(3, texts[12]), (None, texts[6])]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if part[i] != part[j] and (a == b or a and b and len(a & b) / len(a | b) >= 0.8):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    least = {}
    for (i, _), p in zip(rows, part, strict=True):
        if i is not None:
            least[p] = min(least.get(p, i), i)
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, cls long")
    got = near_copies.near_copy_groups(docs).collect()
    assert sorted(((r[0], r[1]) for r in got), key=str) == sorted(((i, least[p]) for (i, _), p in zip(rows, part, strict=True)), key=str)

    gone = {i for (i, _), p in zip(rows, part, strict=True) if i is not None and i > least[p]}
    kept = near_copies.drop_near_copies(docs, complete=True)
    assert kept.columns == docs.columns
    assert sorted(r["cls"] for r in kept.collect()) == [k for k, (i, _) in enumerate(rows) if i not in gone]
    assert near_copies.near_copy_groups(docs.limit(0)).count() == 0


def test_the_stage_goes_by_fingerprints_and_loses_nothing(spark, monkeypatch):
    """Fingerprints alone join nearly all edited copies; what they do not reach
    the exact search adds."""
    from pyspark.sql import functions as F

    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(60):
        base = rng.choices(words, k=150)
        rows.append(" ".join(base))
        for edits in (1, 2, 3):  # a Jaccard similarity of about 0.93, 0.87 and 0.81
            w = list(base)
            for k in rng.sample(range(5, 145), edits):
                w[k] = "new"
            rows.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    alone = dict(near_copies.near_copy_groups(docs, complete=False).collect())
    found = sum(c == i // 4 * 4 for i, c in alone.items() if i % 4)
    assert 0.9 * 180 <= found <= 180
    assert all(c // 4 == i // 4 for i, c in alone.items())
    whole = dict(near_copies.near_copy_groups(docs).collect())
    assert whole == {i: i // 4 * 4 for i in range(240)}

    asked = []
    meetings = near_copies.meetings
    monkeypatch.setattr(near_copies, "meetings", lambda classes: asked.append(1) or meetings(classes).filter(F.lit(False)))
    assert dict(near_copies.near_copy_groups(docs).collect()) == whole and asked

    # The stage takes the anchors' candidates alone: without them nothing is dropped.
    import corpus_pipeline as P

    assert P.near_duplicates(spark, docs, "").count() == 240
    monkeypatch.undo()
    assert P.near_duplicates(spark, docs, "").count() == 240 - found


def test_a_large_group_is_joined_without_all_its_pairs(spark):
    """One group of edits of one text: a bounded number of pairs for each."""
    import numpy as np

    from plumbline.llm import simhash_cover

    rng = np.random.default_rng(3)
    n = 1200
    draw = lambda k: rng.integers(0, 2**64, k, dtype=np.uint64)
    base = draw(200)
    sets = [base] + [np.concatenate([base[:i], draw(5), base[i + 5 :]]) for i in rng.integers(0, 195, n - 1)] + [draw(200) for _ in range(50)]
    sketch = simhash_cover.sketches(np.concatenate(sets), np.full(len(sets), 200)).view(np.int64)
    rows = [(i, 0.5 if i == 0 else 0.6, s.tolist()) for i, s in enumerate(sketch)]
    pairs = simhash_cover.meetings(spark.createDataFrame(rows, "cls long, own double, sketch array<long>")).collect()
    part = list(range(n + 50))
    for a, b in pairs:
        old, new = part[b], part[a]
        part = [new if p == old else p for p in part]
    assert len(set(part[:n])) == 1 and len(set(part)) == 51
    assert len(pairs) <= 9 * n


def test_no_cap_at_an_anchor_loses_a_pair(spark):
    """60 classes at one anchor: whatever meets there and is not joined by the
    nearest is handed out, against all pairs."""
    import numpy as np
    from pyspark.sql import functions as F

    from plumbline.llm import simhash_cover
    from plumbline.operators.components import connected_components

    rng = np.random.default_rng(5)
    n = 60
    one = rng.integers(0, 2**64, 9, dtype=np.uint64)
    sketch = np.tile(one, (n, 1))
    for i in range(n):  # the words beside the anchor's: up to 12 bits from the common one
        for b in rng.choice(64, 12, replace=False):
            sketch[i, 1] ^= np.uint64(1) << np.uint64(b)
    rows = [(i, i / n, s.tolist()) for i, s in enumerate(sketch.view(np.int64))]
    met = simhash_cover.at_anchors(spark.createDataFrame(rows, "cls long, own double, sketch array<long>"))
    ints = [int(x) for x in sketch[:, 1]]
    want = {(a, b) for b in range(n) for a in range(b) if bin(ints[a] ^ ints[b]).count("1") <= simhash_cover.FAR}
    first = {tuple(r) for r in simhash_cover.nearest(met).collect()}
    alone = spark.createDataFrame([], "node long, component long")
    rest = {tuple(r) for r in simhash_cover.left_out(met, alone).collect()}
    assert want <= first | rest and want - first
    # What is joined by now is not handed out again.
    some = connected_components(spark.createDataFrame([(i, i + 1) for i in range(n // 2 - 1)], "src long, dst long"))
    later = {tuple(r) for r in simhash_cover.left_out(met, some).collect()}
    assert later == {(a, b) for a, b in rest if b >= n // 2} and met.filter(F.col("crowded")).count() > 0


def test_texts_near_a_large_group_are_not_paired_with_all_of_it(spark, monkeypatch):
    """At a crowded anchor the pairs that cannot reach the similarity are not
    made, and no link is lost against all pairs that meet there."""
    from pyspark.sql import functions as F

    from plumbline.operators.components import connected_components

    rng = random.Random(4)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=140)

    def edited(edits):
        w = list(base)
        for k in rng.sample(range(140), edits):
            w[k] = rng.choice(words)
        return " ".join(w)

    # A group of one text, texts that miss it by little or by more, and pairs of
    # which the second text is only like the first.
    texts = [" ".join(base), *(edited(1 + i % 2) for i in range(300)), *(edited(4 + i % 6) for i in range(120))]
    for text in texts[301:341]:
        w = text.split()
        w[rng.randrange(140)] = "new"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, left_out = {}, near_copies.left_out

    def compared(met, parts, likely):
        def counted(crowd):
            found = likely(crowd)
            seen.update(classes=crowd.count(), likely=found.count())
            return found

        few = left_out(met, parts, counted)
        seen.update(met=met, parts=parts, few=few.count())
        return few

    # The last texts are nobody's nearest, so that their links are left out at first.
    keys = near_copies.shingle_sets(*_bytes(texts))[2].view("int64").tolist()
    meetings, late = near_copies.meetings, keys[421:]
    taken = lambda met: met.withColumn("to", F.when(~F.col("cls").isin(late) & ~F.col("to").isin(late), F.col("to")))
    monkeypatch.setattr(near_copies, "meetings", lambda classes: taken(meetings(classes)))
    monkeypatch.setattr(near_copies, "left_out", compared)
    got = {}
    for i, c in near_copies.near_copy_groups(docs, complete=False).collect():
        got.setdefault(c, set()).add(i)

    every = left_out(seen["met"], seen["parts"])
    assert seen["classes"] > 300 and every.count() > 5 * seen["classes"] and seen["likely"] < seen["classes"]
    given = docs.select("doc_id", near_copies.text_key("text").alias("text_key"), "text")
    key = spark.createDataFrame(list(enumerate(keys)), "doc_id long, cls long")
    rows = given.join(key, "doc_id").select("text_key", "cls")
    links = near_copies._verified(every, rows, given, near_copies.SIMILARITY)
    old = connected_components(links.unionByName(seen["parts"].toDF("a", "b")), "a", "b")
    want = {}
    for i, c in key.join(old, key["cls"] == old["node"], "left").select("doc_id", "component", key["cls"]).rdd.map(lambda r: (r[0], r[2] if r[1] is None else r[1])).collect():
        want.setdefault(c, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and links.count() >= 20


def test_parities_never_tell_more_than_the_sets_differ():
    import numpy as np

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, k, dtype=np.uint64)) for k in (0, 1, 5, 200, 0, 3000)]
    sets += [np.unique(np.concatenate([sets[3][10:], rng.integers(0, 2**64, 12, dtype=np.uint64)])), sets[5][:-7]]
    bounds = np.cumsum([0, *map(len, sets)])
    odd = near_copies.parities(np.concatenate(sets), bounds)
    assert not odd[0].any() and not odd[4].any()
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            bits = sum(int(x).bit_count() for x in odd[i] ^ odd[j])
            differ = len(np.setxor1d(a, b))
            assert bits <= differ and (differ - bits) % 2 == 0
