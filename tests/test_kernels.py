"""Kernels against known vectors and plain definitions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.functions import kernels as K
from plumbline.settings import Settings, SettingsError, format_settings, parse_settings


def test_known_sequences():
    assert K.lcs_length("AGGTAB", "GXTXAYB") == 4 and "".join(K.lcs_sequence("AGGTAB", "GXTXAYB")) == "GTAB"
    assert K.lcs_sequence("a copied small passage".split(), "copied different small passage".split()) == "copied small passage".split()
    assert K.edit_distance("kitten", "sitting") == 3 and K.edit_distance(["a", "b"], ["a", "c"]) == 1 and K.edit_similarity("", "") == 1.0
    assert K.local_alignment(list("abcde"), list("xbcdy")) == (9, 0.6, 1, 4, 1, 4)
    assert K.local_alignment("zzabcxx", "yyabcww")[0] == 9 and K.local_alignment([], ["a"])[:2] == (0, 0.0)
    assert K.z_array("aabcaabxaaaz")[4] == 3 and K.prefix_function("ababaca") == [0, 0, 1, 2, 3, 0, 1]
    assert list(K.Automaton(["he", "she", "his", "hers"]).find("ushers")) == [(1, 1), (2, 0), (2, 3)]
    with pytest.raises(ValueError):
        K.Automaton([""])


def test_offsets():
    assert K.normalize_with_offsets("  Data, DATA! structures\nwork. ")[0] == "data data structures work"
    norm, offs = K.normalize_with_offsets("\U00010400 sample")
    assert norm[0] == "\U00010428" and offs[1] == 1


small = st.text("abcd", max_size=14)


@settings(max_examples=150, deadline=None)
@given(small, small)
def test_dynamic_programs_against_definitions(a, b):
    from functools import cache

    @cache
    def lcs(i, j):
        return 0 if i == len(a) or j == len(b) else lcs(i + 1, j + 1) + 1 if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    @cache
    def edit(i, j):
        return max(i, j) if not (i and j) else min(edit(i - 1, j) + 1, edit(i, j - 1) + 1, edit(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    @cache
    def align(i, j):
        return 0 if not (i and j) else max(0, align(i - 1, j) - 2, align(i, j - 1) - 2, align(i - 1, j - 1) + (3 if a[i - 1] == b[j - 1] else -2))

    assert K.lcs_length(a, b) == lcs(0, 0) == len(K.lcs_sequence(a, b)) and K.edit_distance(a, b) == edit(len(a), len(b))
    score, _, i, j, k, m = K.local_alignment(a, b)
    assert score == max((align(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1)), default=0)
    if score:
        assert K.local_alignment(a[i:j], b[k:m])[0] == score


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300))
def test_huffman_round_trip(data):
    packed = K.compress(data)
    assert K.decompress(packed) == data
    if len(packed) > 10:
        with pytest.raises(K.CorruptArchive):
            K.decompress(packed[:-1])


def test_huffman_all_bytes_and_corruption():
    data = bytes(range(256)) * 3
    packed = K.compress(data)
    assert K.decompress(packed) == data and K.compress(b"")[:4] == b"HPD\x01" and len(K.compress(b"aaaa")) == 15
    for bad in (b"", b"XXXX" + packed[4:], packed[:8] + b"\xff\xff" + packed[10:]):
        with pytest.raises(K.CorruptArchive):
            K.decompress(bad)


def test_minhash():
    salts = K.minhash_salts(64, 12345)
    a = K.minhash(["x y", "y z"], salts)
    assert (a == K.minhash(["y z", "x y", "x y"], salts)).all() and (K.minhash([], salts) == K.NO_VALUE).all()

    def fnv(s):
        h = K.FNV_OFFSET
        for c in s.encode("utf-16-le"):
            h = (h ^ c) * K.FNV_PRIME % 2**64
        x = h ^ len(s)
        for shift, m in ((30, K.MIX_A), (27, K.MIX_B)):
            x = (x ^ x >> shift) * m % 2**64
        return x ^ x >> 31

    assert K.shingle_hashes(["", "ab", "é longer one"]).tolist() == [fnv(""), fnv("ab"), fnv("é longer one")]


FLOW = [(0, 1, 16), (0, 2, 13), (1, 2, 10), (2, 1, 4), (1, 3, 12), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)]


def test_graph_vectors():
    assert K.max_flow(6, FLOW, 0, 5) == (23, [0, 1, 2, 4])
    edges = [(0, 1, 1.0), (1, 2, 2.0), (0, 2, 4.0), (2, 3, 1.0)]
    assert K.dijkstra(5, edges, 0)[0] == [0, 1, 3, 4, K.INF] and K.floyd_warshall(5, edges, False)[0, 3] == 4
    assert sum(w for *_, w in K.kruskal(5, edges)) == sum(w for *_, w in K.prim(5, edges)) == 4.0
    assert len(K.traverse(5, edges, 0)) == len(K.traverse(5, edges, 0, True)) == 4
    assert K.topological(4, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1)])[1] == [] and K.topological(3, [(0, 1, 1), (1, 0, 1), (1, 2, 1)]) == ([], [0, 1, 2])
    assert K.strong_components(4, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (2, 3, 1)]) == [0, 0, 2, 3]
    d = K.bellman_ford(4, [(0, 1, 1), (1, 3, -3), (3, 1, 1), (0, 2, 5)], 0)
    assert d == [0, -K.INF, 5, -K.INF]
    with pytest.raises(ValueError):
        K.dijkstra(2, [(0, 1, -1.0)], 0)


def test_random_graphs_agree():
    rng = random.Random(0)
    for _ in range(30):
        n = rng.randint(2, 9)
        edges = [(a, b, float(rng.randint(1, 9))) for a in range(n) for b in range(n) if a != b and rng.random() < 0.3]
        m = K.floyd_warshall(n, edges)
        for s in range(n):
            assert K.dijkstra(n, edges, s, True)[0] == K.bellman_ford(n, edges, s) == m[s].tolist()
        reach = np.isfinite(m)
        assert K.strong_components(n, edges) == [min(b for b in range(n) if reach[a, b] and reach[b, a]) for a in range(n)]


def test_greedy():
    assert K.set_cover({1, 2, 3, 4}, [({1, 2}, 1.0), ({3}, 1.0), ({3, 4}, 1.0)])[:2] == ([0, 2], set())
    assert K.set_cover({1, 2, 3}, [({1, 2}, 1.0)])[:2] == ([0], {3})


def test_settings_file():
    s = Settings(review_threshold=0.5, enable_fuzzy=False)
    assert parse_settings(format_settings(s)) == s and parse_settings("# note\nwordShingleSize=3\n").word_shingle_size == 3
    for bad in ("nonsense=1", "wordShingleSize", "wordShingleSize=x", "reviewThreshold=2", "enableExact=yes"):
        with pytest.raises(SettingsError):
            parse_settings(bad)
    assert s.for_request(edge=0.9).graph_edge_threshold == 0.9 and s.for_request().review_threshold == 0.5


@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs", "Z"], exclude_characters=" "), min_size=1, max_size=9), max_size=9), max_size=6), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_shingles_hashed_where_they_stand(rows, width):
    words = [w.encode() for r in rows for w in r]
    data, offsets = np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])
    base, upto = K.window_hashes(data, offsets, np.cumsum([0, *map(len, rows)]), width)
    made = [[" ".join(r[i : i + width]) for i in range(len(r) - width + 1)] for r in rows]
    assert base.tolist() == K.shingle_hashes([s for m in made for s in m]).tolist() and np.diff(upto).tolist() == [len(m) for m in made]
    salts = K.minhash_salts()
    assert (K.minhash_lists(base, upto, salts) == np.array([K.minhash(m, salts) for m in made]).reshape(-1, len(salts))).all()
