"""Rankings, range analytics and reviewer assignment over scored cases."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.ordering import along

#: Fixed point of the range analytics.
SCALE = 1_000_000


def _order(descending: bool) -> list[Column]:
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    return [way("total"), way("case_id")]


def ranked(cases: DataFrame, descending: bool = True) -> DataFrame:
    """By (score, case id), both in one direction."""
    return cases.orderBy(*_order(descending))


def placed(cases: DataFrame, descending: bool = True) -> DataFrame:
    """``cases`` with their ``place`` in the ranking, from 1."""
    return along(cases, _order(descending), "place")


def top(cases: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("n is not negative")
    return ranked(cases).limit(n)


def by_score(cases: DataFrame, low: float, high: float) -> DataFrame:
    """Scores from low to high, both included; none if low > high."""
    if not (0 <= low <= 1 and 0 <= high <= 1):
        raise ValueError("bounds lie between 0 and 1")
    return cases.filter(F.col("total").between(low, high))


def best_per_submission(cases: DataFrame) -> DataFrame:
    w = Window.partitionBy("sub_id").orderBy(F.col("total").desc(), F.col("case_id").desc())
    return cases.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def filtered(cases: DataFrame, term: str = "", risk: str = "ALL", descending: bool = True) -> DataFrame:
    """Best case of each submission; risk equal and term contained in the id or
    (if there is a ``sub_title``) the title, whatever the letter case; blank or
    ALL is no condition.  In ranking order."""
    out = best_per_submission(cases)
    if risk.strip() and risk.strip().upper() != "ALL":
        out = out.filter(F.upper("risk") == risk.strip().upper())
    if term.strip():
        holds = [F.coalesce(F.lower(c).contains(term.strip().lower()), F.lit(False)) for c in ("sub_id", "sub_title") if c in cases.columns]
        out = out.filter(reduce(or_, holds))
    return ranked(out, descending)


def cases_of(cases: DataFrame, sub_id: str) -> DataFrame:
    """All cases of one submission, in ranking order."""
    return ranked(cases.filter(F.col("sub_id") == sub_id))


def case_by_id(cases: DataFrame, case_id: str) -> DataFrame:
    return cases.filter(F.col("case_id") == case_id)


def scaled(score: Column) -> Column:
    """floor(s * 1e6 + 0.5)."""
    return F.floor(score * SCALE + 0.5).cast("long")


def sequence(cases: DataFrame, threshold: float) -> DataFrame:
    """``(at, case_id, total, score, flag)``: cases in ranking order with their
    place, fixed-point score and flag."""
    limit = int(threshold * SCALE + 0.5)
    scores = cases.select("case_id", "total", scaled(F.col("total")).alias("score")).withColumn("flag", (F.col("score") >= limit).cast("int"))
    return along(scores, _order(True), "at", 0).select("at", "case_id", "total", "score", "flag")


def prefix_flagged(seq: DataFrame) -> DataFrame:
    """``seq`` with the number of flagged cases up to and with each place."""
    return along(seq, [F.col("at").asc()], flagged=F.col("flag"))


def summarize(seq: DataFrame, first: int, last: int) -> DataFrame:
    """Minimum, maximum, sum, mean and flagged count of places first..last."""
    if first < 0 or last < first:
        raise ValueError("0 <= first <= last")
    if seq.filter(F.col("at") == last).isEmpty():
        raise IndexError(f"there is no place {last}")
    part = seq.filter(F.col("at").between(first, last))
    return part.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.sum("score").alias("total"), F.avg("score").alias("mean"), F.sum("flag").alias("flagged"))


def update_score(seq: DataFrame, at: int, score: float, threshold: float) -> DataFrame:
    new = F.when(F.col("at") == at, scaled(F.lit(score))).otherwise(F.col("score"))
    return seq.withColumn("score", new).withColumn("flag", (F.col("score") >= int(threshold * SCALE + 0.5)).cast("int"))


def add_to_range(seq: DataFrame, first: int, last: int, delta: float, threshold: float, bounded: bool = True) -> DataFrame:
    """Adds to the scores of a range.  If ``bounded``, refused if one would
    leave [0, 1]; else the sums stand as they are."""
    step = int(delta * SCALE + (0.5 if delta >= 0 else -0.5))
    if bounded:
        least, greatest = seq.filter(F.col("at").between(first, last)).agg(F.min("score"), F.max("score")).first()
        if least is not None and not (0 <= least + step and greatest + step <= SCALE):
            raise ValueError("a score would leave [0, 1]")
    new = F.when(F.col("at").between(first, last), F.col("score") + step).otherwise(F.col("score"))
    return seq.withColumn("score", new).withColumn("flag", (F.col("score") >= int(threshold * SCALE + 0.5)).cast("int"))


def review_queue(cases: DataFrame, threshold: float) -> DataFrame:
    """Cases to review with their place: score down, case id up."""
    return along(cases.filter(F.col("total") >= threshold), [F.col("total").desc(), F.col("case_id").asc()], "place")


def assign(cases: DataFrame, reviewers: DataFrame, threshold: float) -> DataFrame:
    """Queue places fill the reviewers (pos, id, name, capacity) in their
    order: every case suits every reviewer, so the maximum flow matches places
    with slots.  A reviewer has a slot for each case that they can take, up to
    the length of the queue, and slots are numbered along the reviewers, so this
    is a join of equal places."""
    queue = review_queue(cases, threshold)
    waiting = queue.count()
    run = along(reviewers.filter("capacity > 0"), [F.col("pos").asc(), F.col("id").asc()], upto=F.col("capacity"))
    used = run.withColumn("first", F.col("upto") - F.col("capacity") + 1).filter(F.col("first") <= waiting)
    slots = used.select(F.col("id").alias("reviewer_id"), F.col("name").alias("reviewer_name"), F.explode(F.sequence("first", F.least("upto", F.lit(waiting)))).alias("place"))
    return queue.join(slots, "place").select(*queue.columns, "reviewer_id", "reviewer_name")


def unassigned(cases: DataFrame, assigned: DataFrame, threshold: float) -> DataFrame:
    return cases.filter(F.col("total") >= threshold).join(assigned.select("case_id"), "case_id", "left_anti")


def utilisation(assigned: DataFrame, reviewers: DataFrame) -> DataFrame:
    used = assigned.groupBy("reviewer_id").agg(F.count("*").alias("used"))
    out = reviewers.join(used, F.col("id") == F.col("reviewer_id"), "left").withColumn("used", F.coalesce("used", F.lit(0)))
    ratio = F.when(F.col("capacity") > 0, F.col("used") / F.col("capacity")).otherwise(0.0)
    return out.select(F.col("id").alias("reviewer_id"), "capacity", "used", F.greatest(F.lit(0), F.col("capacity") - F.col("used")).alias("remaining"), ratio.alias("ratio"))


def reassign(assigned: DataFrame, reviewers: DataFrame, case_id: str, reviewer_id: str | None) -> DataFrame:
    """A manual change; ``None`` takes the case from its reviewer.  Capacity is
    counted over the other cases."""
    rest = assigned.filter(F.col("case_id") != case_id)
    if reviewer_id is None:
        return rest
    who = reviewers.filter(F.col("id") == reviewer_id).first()
    if who is None:
        raise KeyError(f"unknown reviewer {reviewer_id}")
    if rest.filter(F.col("reviewer_id") == reviewer_id).count() >= who["capacity"]:
        raise ValueError(f"{reviewer_id} has no capacity left")
    moved = assigned.filter(F.col("case_id") == case_id)
    if moved.isEmpty():
        raise KeyError(f"unknown case {case_id}")
    return rest.unionByName(moved.withColumn("reviewer_id", F.lit(reviewer_id)).withColumn("reviewer_name", F.lit(who["name"])))
