"""Assignment of cases to reviewers where not every case suits every reviewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ranking import review_queue
from plumbline.scratch import discard, materialise, scope

#: Rows of one reviewer are numbered in this many parts.
PARTS = 64


def assign_suited(cases: DataFrame, reviewers: DataFrame, suits: DataFrame, threshold: float) -> DataFrame:
    """``ranking.assign`` where only the pairs (case_id, reviewer_id) of ``suits``
    may meet: as many cases of the review queue as can be assigned at once."""
    queue = review_queue(cases, threshold)
    found = matching(suits.join(queue.select("case_id"), "case_id", "left_semi"), reviewers)
    names = reviewers.filter("capacity > 0").groupBy(F.col("id").alias("reviewer_id")).agg(F.min("name").alias("reviewer_name"))
    return queue.join(found, "case_id").join(names, "reviewer_id").select(*queue.columns, "reviewer_id", "reviewer_name")


def matching(suits: DataFrame, reviewers: DataFrame) -> DataFrame:
    """``(case_id, reviewer_id)``: a greatest set of the pairs of ``suits`` in
    which no case occurs twice and no reviewer more often than their capacity.

    Phases over frames.  Reviewers get their distance from one with room, where
    one step moves a case to another reviewer that suits it.  Free cases go to a
    nearest reviewer; from the farthest reviewers down, each takes as many as it
    can pass cases on, and those without a place stay free.  Every phase assigns
    at least one case more, most at a time: the first is a greedy assignment.
    The end is proved: no free case reaches a reviewer with room.

    Repeated pairs are one, pairs with nulls or unknown reviewers none; of
    several rows of one reviewer the greatest capacity holds.  Ties, and which
    cases stay free, go by hashes: the number is fixed, and reruns agree.  An
    empty table gives an empty one; other columns are not looked at."""
    with scope(suits.sparkSession) as keep:
        seats = reviewers.filter("capacity > 0 AND id IS NOT NULL").groupBy(F.col("id").alias("reviewer_id"))
        seats = materialise(seats.agg(F.max("capacity").cast("long").alias("capacity")), "seats")
        pairs = suits.select("case_id", "reviewer_id").dropna().join(seats, "reviewer_id", "left_semi")
        pairs = materialise(pairs.select("case_id", "reviewer_id").distinct(), "suits")
        held = materialise(pairs.limit(0), "held")
        phase = 0
        while (better := _phase(pairs, seats, held, phase)) is not None:
            discard(held)
            held, phase = better, phase + 1
        return keep(held)


def _phase(pairs: DataFrame, seats: DataFrame, held: DataFrame, phase: int) -> DataFrame | None:
    """The assignment after one phase; None if no free case can be placed."""
    with scope(pairs.sparkSession) as keep:
        free = materialise(pairs.join(held, "case_id", "left_anti"), "free")
        if free.isEmpty():
            return None
        used = held.groupBy("reviewer_id").agg(F.count("*").alias("used"))
        room = F.col("capacity") - F.coalesce("used", F.lit(0))
        rooms = materialise(seats.join(used, "reviewer_id", "left").select("reviewer_id", room.alias("room")).filter("room > 0"), "room")
        moves = held.select("case_id", F.col("reviewer_id").alias("now")).join(pairs, "case_id").filter("now <> reviewer_id")
        steps = _distances(materialise(moves.select("now", "reviewer_id").distinct(), "moves"), rooms)
        bids = materialise(_one_each(free.join(steps, "reviewer_id"), phase), "bids")
        farthest = bids.agg(F.max("step")).first()[0]
        if farthest is None:
            return None
        coming, taken, left = bids.filter(F.col("step") == farthest), None, held.select("case_id").limit(0)
        for step in range(farthest, -1, -1):
            coming = coming.select("case_id", "reviewer_id")
            if step == 0:
                accepted = _first(coming, rooms)
            else:
                asked = coming.select(F.col("reviewer_id").alias("now")).distinct()
                onward = moves.join(asked, "now", "left_semi").join(steps.filter(F.col("step") == step - 1), "reviewer_id")
                onward = _one_each(onward, phase).select("case_id", F.col("now").alias("reviewer_id"), F.col("reviewer_id").alias("target"))
                onward = materialise(onward, "onward")
                accepted = materialise(_first(coming, _counts(onward)), "accepted")
                moved = materialise(_first(onward, _counts(accepted)), "moved")
                left = left.union(moved.select("case_id"))
                coming = moved.select("case_id", F.col("target").alias("reviewer_id")).union(bids.filter(F.col("step") == step - 1).select("case_id", "reviewer_id"))
            taken = accepted if taken is None else taken.union(accepted)
        return keep(materialise(held.join(left, "case_id", "left_anti").select("case_id", "reviewer_id").union(taken), "held"))


def _distances(moves: DataFrame, rooms: DataFrame) -> DataFrame:
    """``(reviewer_id, step)``: how many moves lead to a reviewer with room."""
    found = frontier = rooms.select("reviewer_id", F.lit(0).alias("step"))
    step = 0
    while True:
        step += 1
        back = moves.join(frontier.select("reviewer_id"), "reviewer_id", "left_semi").select(F.col("now").alias("reviewer_id")).distinct()
        frontier = materialise(back.join(found, "reviewer_id", "left_anti").withColumn("step", F.lit(step)), "reached")
        if frontier.isEmpty():
            return found
        found = found.union(frontier)


def _one_each(rows: DataFrame, phase: int) -> DataFrame:
    """One row a case: least step, then a hash that each phase draws anew."""
    rest = [c for c in rows.columns if c not in ("case_id", "step")]
    key: Column = F.struct("step", F.xxhash64("case_id", "reviewer_id", F.lit(phase)).alias("draw"), *rest)
    return rows.groupBy("case_id").agg(F.min(key).alias("best")).select("case_id", "best.step", *[f"best.{c}" for c in rest])


def _counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reviewer_id").agg(F.count("*").alias("room"))


def _first(rows: DataFrame, rooms: DataFrame) -> DataFrame:
    """As many rows of each reviewer as ``rooms`` has for them, numbered in parts
    so that a reviewer of very many cases is not one task."""
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("case_id"), F.lit(PARTS)))
    sizes = dealt.groupBy("reviewer_id", "part").agg(F.count("*").alias("n")).join(rooms, "reviewer_id")
    ahead = F.sum("n").over(Window.partitionBy("reviewer_id").orderBy("part")) - F.col("n")
    within = F.row_number().over(Window.partitionBy("reviewer_id", "part").orderBy("case_id"))
    placed = dealt.withColumn("place", within).join(sizes.withColumn("ahead", ahead), ["reviewer_id", "part"])
    return placed.filter(F.col("ahead") + F.col("place") <= F.col("room")).select(*rows.columns)
