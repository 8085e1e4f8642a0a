"""Distributed ranks and running sums against Python's own sort."""

import random

from pyspark.sql import functions as F

from plumbline.operators import ranking
from plumbline.operators.ordering import along


def test_ranks_and_sums_with_skew_and_ties(spark):
    rng = random.Random(7)
    rows = [(i, 0.5 if rng.random() < 0.7 else rng.random(), rng.choice([None, -3, 0, 1, 5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double, n int").repartition(7)
    out = along(df, [F.col("score").desc(), F.col("id").asc()], "place", 1, upto=F.col("n"), count=F.lit(1)).collect()
    order, total = sorted(rows, key=lambda r: (-r[1], r[0])), 0
    got = sorted(out, key=lambda r: r["place"])
    assert [r["place"] for r in got] == list(range(1, 3001)) == [r["count"] for r in got]
    for r, want in zip(got, order, strict=True):
        total += want[2] or 0
        assert (r["id"], r["upto"]) == (want[0], total)


def test_nulls_of_the_order_and_an_empty_table(spark):
    df = spark.createDataFrame([(None,), (2,), (1,), (None,)], "x int")
    assert [(r["x"], r["k"]) for r in along(df, [F.col("x").asc_nulls_last()], "k", 0).orderBy("k").collect()] == [(1, 0), (2, 1), (None, 2), (None, 3)]
    empty = along(df.limit(0), [F.col("x").asc()], "k", s=F.col("x"))
    assert empty.columns == ["x", "s", "k"] and empty.isEmpty()


def test_slots_follow_reviewers_of_any_capacity(spark):
    cases = spark.createDataFrame([(f"c{i:03}", 0.9 - 0.001 * (i // 3)) for i in range(50)], "case_id string, total double")
    reviewers = spark.createDataFrame([(2, "z", "Z", 1_000_000_000), (0, "a", "A", 0), (1, "b", "B", 7), (1, "c", "C", 4)], "pos long, id string, name string, capacity long")
    got = {r["case_id"]: r["reviewer_id"] for r in ranking.assign(cases, reviewers, 0.0).collect()}
    assert [got[f"c{i:03}"] for i in range(50)] == ["b"] * 7 + ["c"] * 4 + ["z"] * 39


def test_ranking_plans_have_no_window_over_all_rows(spark):
    cases = spark.createDataFrame([("a", 0.5), ("b", 0.7)], "case_id string, total double")
    seq = ranking.sequence(cases, 0.6)
    for df in (seq, ranking.prefix_flagged(seq), ranking.review_queue(cases, 0.1), ranking.placed(cases)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
