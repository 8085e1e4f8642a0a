"""The set cover of rounds against the greedy kernel."""

import random

import pytest

from plumbline.functions import kernels as K
from plumbline.operators.cover import greedy_cover


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cover_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    sets = [(i, float(rng.choice([1, 1, 2])), float(rng.choice([1, 1, 3]))) for i in range(25)] + [(25, 0.0, 1.0)]
    held = {i: set(rng.sample(range(40), rng.randint(0, 9))) for i, _, _ in sets}
    held[25] = {38, 39, 99}
    rows = [(i, e) for i in held for e in held[i]] + [(None, 100), (77, 101)]
    rows += rows[:5]
    chosen, left = greedy_cover(spark.createDataFrame(rows, "set long, element long"), spark.createDataFrame(sets, "set long, relevance double, cost double"))
    want = K.greedy_select([(held[i], r, c) for i, r, c in sets])
    assert [r["set"] for r in chosen.orderBy("place").collect()] == want
    covered = set().union(*(held[i] for i in want))
    assert {r["element"] for r in left.collect()} == {e for _, e in rows} - covered


def test_cover_of_an_empty_table(spark):
    chosen, left = greedy_cover(spark.createDataFrame([], "set long, element long"), spark.createDataFrame([], "set long, relevance double, cost double"))
    assert chosen.isEmpty() and left.isEmpty()
