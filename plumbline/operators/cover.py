"""Greedy weighted set cover over a membership table.

The greedy rule takes the set of the greatest (new elements * relevance / cost)
again and again; ties go to more new elements, then to higher relevance, then to
the smaller set.  A set's worth never grows, so a set is the next pick as soon as
no other set's worth before it can have come from the elements it shares with
better ones: in each round every set that comes first, in the rule's order, among
all sets that share an uncovered element with it is taken.  Those picks touch no
common element, so one does not change the worth of another, and the greedy rule
would take exactly them too, each before any set that shares an element with it.
A round is an aggregation over the uncovered memberships; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ordering import along
from plumbline.scratch import materialise


def greedy_cover(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``set, place, new, worth`` of the chosen sets in the order in which the
    greedy rule takes them, ``element`` of what no set covers) of ``members``
    (set, element) and ``sets`` (set, relevance, cost above 0).

    The universe is the elements of ``members``; those whose ``set`` is null, or
    stands in no row of ``sets``, or has no worth, can stay uncovered.  Repeated
    memberships count once; an empty table gives empty results."""
    left = materialise(members.select("set", "element").filter("element is not null").distinct(), "cover-members")
    worthy = sets.filter("relevance > 0 and cost > 0").select("set", "relevance", "cost")
    chosen = sets.sparkSession.createDataFrame([], f"set {_type(members, 'set')}, new long, worth double, relevance double")
    while True:
        sizes = left.groupBy("set").agg(F.count("*").alias("new")).join(worthy, "set")
        # Ascending struct, so the best set of an element is its least one.
        rank = F.struct((-F.col("new") * F.col("relevance") / F.col("cost")).alias("a"), (-F.col("new")).alias("b"), (-F.col("relevance")).alias("c"), F.col("set").alias("d"))
        ranked = sizes.withColumn("rank", rank).select("set", "new", "relevance", "rank")
        at = left.join(ranked.select("set", "rank"), "set")
        best = at.groupBy("element").agg(F.min("rank").alias("best"))
        led = at.join(best, "element").groupBy("set").agg(F.bool_and(F.col("rank") == F.col("best")).alias("first")).filter("first")
        picked = materialise(ranked.join(led, "set").select("set", "new", (-F.col("rank.a")).alias("worth"), "relevance"), "cover-picked")
        if picked.isEmpty():
            break
        chosen = materialise(chosen.unionByName(picked), "cover-chosen")
        done = left.join(picked.select("set"), "set", "left_semi").select("element").distinct()
        left = materialise(left.join(done, "element", "left_anti").select("set", "element"), "cover-members")
    order = [F.col("worth").desc(), F.col("new").desc(), F.col("relevance").desc(), F.col("set").asc()]
    placed = along(chosen, order, "place").select("set", "place", "new", "worth")
    return placed, left.select("element").distinct()


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()

