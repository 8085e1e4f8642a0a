"""Walks over directed and undirected edge tables against plain kernels."""

import random

import pytest

from plumbline.functions import kernels as K
from plumbline.operators import network

EDGES = "src long, dst long, cost double, similarity double"


def undirected(spark, rows):
    return spark.createDataFrame([(min(a, b), max(a, b), float(c), 1.0 - c / 100) for a, b, c in rows], EDGES)


def directed(spark, rows):
    return spark.createDataFrame([(a, b, float(c)) for a, b, c in rows], "src long, dst long, cost double")


def test_a_long_chain_in_full(spark):
    n = 20_000
    edges = spark.range(n).selectExpr("id as src", "id + 1 as dst", "1.0d as cost", "0.5d as similarity").repartition(4)
    far = {r["v"]: r["distance"] for r in network.distances(edges, 0).collect()}
    assert far == {v: float(v) for v in range(n + 1)}
    path = network.path_between(edges, 0, n).orderBy("step").collect()
    assert [(r["step"], r["src"], r["dst"]) for r in path] == [(v, v, v + 1) for v in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_levels_and_paths(spark, seed):
    rng = random.Random(seed)
    rows = [(v, v + 1, 1) for v in range(12)] + [(40, 41, 2), (41, 42, 2), (42, 40, 2)]  # a chain, a ring apart
    rows += [(rng.randrange(25), rng.randrange(25), rng.randint(1, 9)) for _ in range(25)]
    rows = [r for r in rows if r[0] != r[1]]
    edges = undirected(spark, rows)
    dist, _ = K.dijkstra(43, [(a, b, float(c)) for a, b, c in rows], 0)
    assert {r["v"]: r["distance"] for r in network.distances(edges, 0).collect()} == {v: d for v, d in enumerate(dist) if d < K.INF}
    steps, _ = K.dijkstra(43, [(a, b, 1.0) for a, b, _ in rows], 0)
    assert {r["v"]: r["level"] for r in network.levels(edges, 0).collect()} == {v: d for v, d in enumerate(steps) if d < K.INF}
    far = max((d, v) for v, d in enumerate(dist) if d < K.INF)
    path = network.path_between(edges, 0, far[1]).orderBy("step").collect()
    assert sum(r["cost"] for r in path) == far[0] and path[0]["src"] == 0 and path[-1]["dst"] == far[1]
    assert all(a["dst"] == b["src"] for a, b in zip(path, path[1:], strict=False))
    ring = network.distances(edges, 40).collect()
    assert {(r["v"], r["distance"]) for r in ring} == {(40, 0.0), (41, 2.0), (42, 2.0)}
    one_way = network.distances(directed(spark, rows), 0, directed=True).collect()
    assert {r["v"]: r["distance"] for r in one_way} == {v: d for v, d in enumerate(K.dijkstra(43, [(a, b, float(c)) for a, b, c in rows], 0, True)[0]) if d < K.INF}


def test_unknown_vertices_and_no_path(spark):
    edges = undirected(spark, [(1, 2, 1), (3, 4, 1)])
    assert network.levels(edges, 9).isEmpty() and network.distances(edges, 9).isEmpty()
    assert network.path_between(edges, 1, 4).isEmpty() and network.path_between(edges, 1, 1).isEmpty() and network.path_between(edges, 9, 1).isEmpty()


@pytest.mark.parametrize("seed", [3, 4])
def test_components_and_levels_of_directed_graphs(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.randrange(40), rng.randrange(40), 1) for _ in range(45)} | {(50, 51, 1), (51, 52, 1), (52, 50, 1), (52, 53, 1), (60, 60, 1)}
    used = {v for a, b, _ in rows for v in (a, b)}
    label = K.strong_components(61, sorted(rows))
    assert {r["v"]: r["component"] for r in network.strong_components(directed(spark, rows)).collect()} == {v: label[v] for v in used}
    order, blocked = K.topological(61, sorted(rows))
    level = dict.fromkeys(order, 0)
    for v in order:
        for a, b, _ in rows:
            if a == v and b in level:
                level[b] = max(level[b], level[v] + 1)
    got = {r["v"]: r["level"] for r in network.topological_levels(directed(spark, rows)).collect()}
    assert got == {v: None if v in blocked else level[v] for v in used}


@pytest.mark.parametrize("seed", [5, 6])
def test_negative_cycles(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(30), rng.randrange(30), rng.randint(-1, 6)) for _ in range(45)] + [(0, 1, 2), (31, 32, -5), (32, 31, 1)]
    if seed != 5:
        rows += [(1, 33, 1), (33, 34, -4), (34, 33, 2), (34, 35, 7)]
    want = {v: d for v, d in enumerate(K.bellman_ford(36, [(a, b, float(c)) for a, b, c in rows], 0)) if d < K.INF}
    start = spark.createDataFrame([(0,)], "v long")
    for every in (3,):
        assert {r["v"]: r["distance"] for r in network.signed_distances(directed(spark, rows), start, every).collect()} == want
    assert seed == 5 or want[35] == float("-inf")


def test_empty_graphs(spark):
    none = directed(spark, [])
    assert network.strong_components(none).isEmpty() and network.topological_levels(none).isEmpty()
    assert network.distances(none, 1).isEmpty() and network.signed_distances(none, spark.createDataFrame([], "v long")).isEmpty()
