"""Assignment with exclusions against maximum flow and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.operators.matching import assign_suited, matching


def most(pairs, capacity):
    """The size of a greatest matching, by augmenting paths case by case."""
    held = {r: [] for r in capacity}

    def place(case, seen):
        for r in sorted(r for c, r in pairs if c == case and r in capacity and r not in seen):
            seen.add(r)
            if len(held[r]) < capacity[r]:
                held[r].append(case)
                return True
            for other in list(held[r]):
                if place(other, seen):
                    held[r].remove(other)
                    held[r].append(case)
                    return True
        return False

    return sum(place(c, set()) for c in sorted({c for c, _ in pairs}))


def check(spark, pairs, capacity):
    suits = spark.createDataFrame(sorted(pairs) * 2, "case_id string, reviewer_id string")
    who = spark.createDataFrame([(i, r, f"Name {r}", n) for i, (r, n) in enumerate(sorted(capacity.items()))], "pos int, id string, name string, capacity int")
    got = [tuple(r) for r in matching(suits, who).collect()]
    assert set(got) <= set(pairs)
    assert len({c for c, _ in got}) == len(got)
    assert all(sum(r == x for _, x in got) <= n for r, n in capacity.items())
    return len(got)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_as_many_as_brute_force(spark, seed):
    rng = random.Random(seed)
    capacity = {f"R{i}": rng.choice([0, 1, 1, 2, 4]) for i in range(7)}
    pairs = {(f"C{c}", f"R{r}") for c in range(24) for r in rng.sample(range(7), rng.choice([0, 1, 1, 2]))}
    want = most(pairs, {r: n for r, n in capacity.items() if n})
    assert check(spark, pairs, capacity) == want
    number = {v: i + 2 for i, v in enumerate(sorted({c for c, _ in pairs} | set(capacity)))}
    edges = [(0, number[c], 1) for c in sorted({c for c, _ in pairs})] + [(number[c], number[r], 1) for c, r in sorted(pairs)] + [(number[r], 1, n) for r, n in capacity.items()]
    assert K.max_flow(len(number) + 2, edges, 0, 1)[0] == want


def test_a_long_chain_of_moves(spark):
    n = 6  # the last case finds room only if every other one moves on
    pairs = {(f"C{i}", f"R{i}") for i in range(n)} | {(f"C{i}", f"R{i + 1}") for i in range(n - 1)} | {("D", "R0")}
    assert check(spark, pairs, {f"R{i}": 1 for i in range(n + 1)} | {"R6": 0}) == n
    assert check(spark, pairs | {("C5", "R6")}, {f"R{i}": 1 for i in range(n + 1)}) == n + 1


def test_a_reviewer_of_most_cases(spark):
    pairs = {(f"C{i}", "hot") for i in range(300)} | {(f"C{i}", "cold") for i in range(0, 300, 10)}
    assert check(spark, pairs, {"hot": 270, "cold": 40}) == 300
    assert check(spark, pairs, {"hot": 100, "cold": 20}) == 120


def test_odd_rows(spark):
    who = spark.createDataFrame([(0, "A", "a", 1), (1, "A", "b", 2), (2, None, "c", 5), (3, "B", "d", -1)], "pos int, id string, name string, capacity int")
    suits = spark.createDataFrame([("x", "A"), ("y", "A"), ("z", "A"), (None, "A"), ("w", None), ("w", "B"), ("w", "unknown")], "case_id string, reviewer_id string").withColumn("step", F.lit("kept out"))
    assert matching(suits, who).count() == 2
    assert matching(suits.limit(0), who).isEmpty() and matching(suits, who.limit(0)).isEmpty()


def test_excluded_reviewers_of_a_queue(spark):
    cases = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.1)], "case_id string, total double")
    who = spark.createDataFrame([(0, "R1", "One", 2), (1, "R2", "Two", 1)], "pos int, id string, name string, capacity int")
    suits = spark.createDataFrame([("a", "R1"), ("a", "R2"), ("b", "R1"), ("c", "R1"), ("d", "R2")], "case_id string, reviewer_id string")
    got = {r["case_id"]: (r["reviewer_id"], r["reviewer_name"], r["place"]) for r in assign_suited(cases, who, suits, 0.3).collect()}
    assert got == {"a": ("R2", "Two", 1), "b": ("R1", "One", 2), "c": ("R1", "One", 3)}
