"""The similarity graph: edges, degrees, enrichment, groups, paths, forests.

Edge lists stay DataFrames.  Where the result depends on visiting order, or the
method is a small-graph one, the edges come to the driver under a checked bound
(``DRIVER_EDGES``); components, distances, levels and forests have distributed
forms that take over beyond it, with equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import kernels as K
from plumbline.operators.components import connected_components
from plumbline.operators.ordering import along
from plumbline.scratch import materialise

DRIVER_EDGES = 1_000_000
#: Rounds of a walk before chains are drawn together for it.
PLAIN_ROUNDS = 8
#: Vertices that are sent to the edges; of more, Spark decides how they are joined.
SENT = 1 << 17
LEAST_COST = 1e-6


def edges_of(pairs: DataFrame, a: str, b: str, similarity: str, threshold: float) -> DataFrame:
    """``(src, dst, similarity, cost)``: one edge per unordered pair of
    different vertices with its greatest similarity, at the threshold or more
    and above 0."""
    kept = pairs.filter((F.col(similarity) >= threshold) & (F.col(similarity) > 0) & (F.col(a) != F.col(b)))
    ends = kept.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), F.col(similarity).alias("similarity"))
    best = ends.groupBy("src", "dst").agg(F.max("similarity").alias("similarity"))
    return best.withColumn("cost", F.greatest(F.lit(LEAST_COST), 1.0 - F.col("similarity")))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "cost").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))


def with_members(edges: DataFrame, members: DataFrame) -> DataFrame:
    """``edges`` between representatives, and a star for each class: its other
    members (pos, representative) at similarity 1.  The stars stand for the
    edges between all copies, which need not be written."""
    return edges.select("src", "dst", "similarity", "cost").unionByName(stars(members))


def stars(members: DataFrame) -> DataFrame:
    return members.filter("pos <> representative").select(F.col("representative").alias("src"), F.col("pos").alias("dst"), F.lit(1.0).alias("similarity"), F.lit(LEAST_COST).alias("cost"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    """``(v, degree)`` of the vertices that have edges, from the edges alone."""
    return both_ways(edges).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def degrees(edges: DataFrame, members: DataFrame, vertices: DataFrame) -> DataFrame:
    """``(v, degree)`` of every vertex of ``vertices`` (v), all copies counted:
    a document is next to the rest of its class and to every member of the
    classes next to it (``edges`` join representatives)."""
    size = members.groupBy("representative").agg(F.count("*").alias("members"))
    way = both_ways(edges).join(size.withColumnRenamed("representative", "dst"), "dst")
    around = way.groupBy(F.col("src").alias("representative")).agg(F.sum("members").alias("around"))
    own = size.join(around, "representative", "left").select("representative", (F.col("members") - 1 + F.coalesce("around", F.lit(0))).alias("degree"))
    counted = members.join(own, "representative").select(F.col("pos").alias("v"), "degree")
    return vertices.join(counted, "v", "left").select("v", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def signals(edges: DataFrame, degree: DataFrame, n_vertices: int) -> DataFrame:
    """``edges`` with the graph signal: similarity and mean degree share."""
    a, b = degree.select(F.col("v").alias("src"), F.col("degree").alias("ds")), degree.select(F.col("v").alias("dst"), F.col("degree").alias("dd"))
    density = (F.col("ds") + F.col("dd")) / (2.0 * max(1, n_vertices - 1))
    return edges.join(a, "src").join(b, "dst").withColumn("signal", F.least(F.lit(1.0), 0.75 * F.col("similarity") + 0.25 * density)).drop("ds", "dd")


def for_members(found: DataFrame, members: DataFrame, source: int, value: str, own: float) -> DataFrame:
    """What is ``found`` (v, value) of representatives from the representative
    ``source`` on, for all members: copies of a class have the same ways, those
    of the source are at ``own``."""
    named = found.join(members.select(F.col("representative").alias("v"), "pos"), "v")
    at_home = (F.col("v") == source) & (F.col("pos") != source)
    return named.select(F.col("pos").alias("v"), F.when(at_home, F.lit(own).cast(found.schema[value].dataType)).otherwise(F.col(value)).alias(value))


def groups(edges: DataFrame) -> DataFrame:
    """``(group_id, v)`` of the components of two vertices or more, numbered by
    their least vertex."""
    parts = materialise(connected_components(edges), "groups")
    heads = along(parts.select("component").distinct(), [F.col("component").asc()], "group_number")
    heads = heads.select("component", F.concat(F.lit("GROUP-"), F.col("group_number").cast("string")).alias("group_id"))
    return parts.join(heads, "component").select("group_id", F.col("node").alias("v"))


def levels(edges: DataFrame, source: int) -> DataFrame:
    """``(v, level)``: the least number of edges from ``source``, of what it
    reaches.  An id without an edge gives no rows."""
    found = distances(edges.select("src", "dst", F.lit(1.0).alias("cost")), source)
    return found.select("v", F.col("distance").cast("int").alias("level"))


def distances(edges: DataFrame, source: int, directed: bool = False) -> DataFrame:
    """``(v, distance)`` of what ``source`` reaches over non-negative costs.  An
    id without an edge gives no rows.

    The first rounds relax the edges as they are, and read ``edges`` (best a
    stored table) once each: most walks end there, and only what they reach is
    written.  For longer ones undirected chains, whose inner vertices have two
    neighbours, are drawn together by pointer doubling, so that long ones take
    the logarithm of their length in rounds; what stays is relaxed round by round
    until nothing gets shorter, however many rounds that takes."""
    if directed:
        return _relaxed(materialise(edges.select("src", "dst", "cost"), "path-edges"), source)[0]
    found, settled = _relaxed(both_ways(edges), source, PLAIN_ROUNDS)
    if settled:
        return found
    ways = both_ways(edges).filter("src <> dst").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    half = materialise(_to_ends(materialise(ways, "path-edges"), source), "path-chains")
    # Half-edges that lead around a ring without an end are out of reach.
    inner = half.filter("inner").select(F.col("src").alias("v")).distinct()
    short = half.filter("not inner and done").groupBy("src", F.col("stop").alias("dst")).agg(F.min("total").alias("cost"))
    ends = materialise(_relaxed(short, source)[0], "path-ends")
    along = half.filter("inner and done").join(ends.select(F.col("v").alias("stop"), "distance"), "stop")
    within = along.groupBy(F.col("src").alias("v")).agg(F.min(F.col("distance") + F.col("total")).alias("distance"))
    return ends.join(inner, "v", "left_anti").unionByName(within)


def _to_ends(ways: DataFrame, source: int) -> DataFrame:
    """Each way (src, dst, cost) with the first vertex at or behind ``dst`` that
    is no inner one (``stop``) and the cost to it (``total``); ``inner`` says
    whether ``src`` is one, ``done`` whether there is such a stop."""
    two = ways.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("n"), F.min("dst").alias("p"), F.max("dst").alias("q")).filter((F.col("n") == 2) & (F.col("v") != source))
    two = materialise(two.drop("n"), "path-inner")
    joined = ways.join(two.select(F.col("v").alias("dst"), "p", "q"), "dst", "left").join(two.select(F.col("v").alias("src"), F.lit(True).alias("inner")), "src", "left")
    # (at, to) is the last way taken; from an inner end it goes on to the other neighbour.
    onward = F.when(F.col("p").isNotNull(), F.when(F.col("p") == F.col("src"), F.col("q")).otherwise(F.col("p")))
    half = joined.select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"), F.col("dst").alias("at"), onward.alias("to"), F.col("cost").alias("total"))
    stored = materialise(half, "path-half")
    # Ways between two vertices that are no inner ones are done, and none goes on along them.
    half, apart = stored.filter("inner or to is not null"), stored.filter("not inner and to is null")
    open_before = None
    while True:
        open_now = half.filter("to is not null").count()
        # A ring of inner vertices alone never ends: then no way gets done any more.
        if not open_now or open_now == open_before:
            return half.unionByName(apart).select("src", "dst", "inner", F.col("at").alias("stop"), "total", F.col("to").isNull().alias("done"))
        open_before = open_now
        ahead = half.filter("inner").select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("at").alias("next_at"), F.col("to").alias("next_to"), F.col("total").alias("more"))
        going = half.filter("to is not null").join(ahead, ["at", "to"]).select("src", "dst", "inner", F.col("next_at").alias("at"), F.col("next_to").alias("to"), (F.col("total") + F.col("more")).alias("total"))
        half = materialise(half.filter("to is null").unionByName(going), "path-half")


def _relaxed(way: DataFrame, source: int, rounds: int | None = None) -> tuple[DataFrame, bool]:
    """Distances from ``source`` by rounds of relaxation until none changes, and
    whether that is so; of ``rounds`` at most, if given."""
    there = way.filter((F.col("src") == source) | (F.col("dst") == source)).limit(1).isEmpty()
    best = way.sparkSession.createDataFrame([] if there else [(source, 0.0)], "v long, distance double")
    changed, n, done = best, 0 if there else 1, 0
    while n:
        if done == rounds:
            return best, False
        step = way.join(_sent(changed, n), F.col("src") == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.min(F.col("distance") + F.col("cost")).alias("new"))
        merged = materialise(best.join(step, "v", "full").withColumn("better", F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new") < F.col("distance")))), "path-round")
        best = merged.select("v", F.least("distance", "new").alias("distance"))
        changed = merged.filter("better").select("v", F.col("new").alias("distance"))
        n, done = changed.count(), done + 1
    return best, True


def _sent(few: DataFrame, n: int) -> DataFrame:
    """``few``, a table of ``n`` rows, to join with the edges: these stay where
    they are if it is small."""
    return F.broadcast(few) if n <= SENT else few


def ancestors(previous: DataFrame, start: int) -> DataFrame:
    """``(v, steps)``: the vertices on the way from ``start`` along ``previous``
    (v, p), with their steps from it; pointers are doubled, so the rounds are
    the logarithm of the way's length."""
    jumps = [materialise(previous.select("v", "p"), "path-jumps")]
    while True:
        last = jumps[-1]
        ahead = last.select(F.col("v").alias("p"), F.col("p").alias("far"))
        more = materialise(last.join(ahead, "p").select("v", F.col("far").alias("p")), "path-jumps")
        if more.filter(F.col("v") == start).isEmpty():
            break
        jumps.append(more)
    seen = previous.sparkSession.createDataFrame([(start, 0)], "v long, steps long")
    for k in reversed(range(len(jumps))):
        further = seen.join(jumps[k], "v").select(F.col("p").alias("v"), (F.col("steps") + (1 << k)).alias("steps"))
        seen = materialise(seen.unionByName(further), "path-steps")
    return seen


def path_between(edges: DataFrame, source: int, target: int, far: DataFrame | None = None) -> DataFrame:
    """``(step, src, dst, cost, similarity)`` of one shortest path, its edges in
    order; of equal ways back (to 9 decimals) the smallest vertex is taken.  No
    rows if there is no path or no way to go.  ``far``: the stored ``distances``
    from ``source``, if they are known."""
    far = materialise(distances(edges, source), "path-distances") if far is None else far
    n = far.count()
    both = edges.select("src", "dst", "cost", "similarity").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost", "similarity"))
    # Of parallel ways the least is the least of its end's, too.
    near = both.join(_sent(far.select(F.col("v").alias("src"), F.col("distance").alias("a")), n), "src").join(_sent(far.select(F.col("v").alias("dst"), F.col("distance").alias("b")), n), "dst").filter("a < b")
    back = near.groupBy("dst").agg(F.min(F.struct(F.round(F.col("a") + F.col("cost"), 9).alias("d"), "src", "cost", "similarity")).alias("w"))
    back = materialise(back.select(F.col("dst").alias("v"), F.col("w.src").alias("p"), "w.cost", "w.similarity"), "path-previous")
    seen = ancestors(back.select("v", "p"), target)
    n = seen.agg(F.max("steps")).first()[0]
    steps = seen.join(back, "v").select((F.lit(n - 1) - F.col("steps")).cast("int").alias("step"), F.col("p").alias("src"), F.col("v").alias("dst"), "cost", "similarity")
    return steps if target != source else steps.limit(0)


# ------------------------------------------------------------------ directed graphs
def _stored(df: DataFrame, label: str) -> DataFrame:
    """A table of a round.  It is joined by shuffles: broadcasts, though small
    each, would add up at the driver over the rounds."""
    return materialise(df, label).hint("merge")


def strong_components(edges: DataFrame) -> DataFrame:
    """``(v, component)`` of every vertex of the directed ``edges``: the smallest
    vertex that it reaches and that reaches it.

    Ways that end, or begin, nowhere are trimmed.  Then every vertex takes the
    smallest vertex that reaches it for its colour, and of each colour those
    that lead back to that vertex are a component; the rest goes on."""
    vertices = edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()
    left = _stored(edges.filter("src <> dst").select("src", "dst").distinct(), "scc-edges")
    found = edges.sparkSession.createDataFrame([], "v long, component long")
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            alone = vertices.join(found, "v", "left_anti").select("v", F.col("v").alias("component"))
            return found.unionByName(alone)
        colour = _colours(left)
        ends = lambda side, name: colour.select(F.col("v").alias(side), F.col("colour").alias(name))
        within = _stored(left.join(ends("src", "c"), "src").join(ends("dst", "d"), "dst").filter("c = d").select("src", "dst"), "scc-within")
        roots = colour.filter("v = colour").select("v")
        back = _reached(within.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
        found = _stored(found.unionByName(back.join(colour, "v").select("v", F.col("colour").alias("component"))), "scc-found")
        gone = found.select("v")
        left = left.join(gone.withColumnRenamed("v", "src"), "src", "left_anti").join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti")
        left = _stored(left.select("src", "dst"), "scc-edges")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Without edges that come from a vertex that none leads to, or lead to one
    that none comes from; again until none is left."""
    n = edges.count()
    while n:
        kept = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        kept = _stored(kept.select("src", "dst"), "scc-edges")
        before, n, edges = n, kept.count(), kept
        if n == before:
            break
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """``(v, colour)``: the smallest vertex that reaches each, itself included."""
    best = _stored(edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().withColumn("colour", F.col("v")), "scc-colours")
    changed = best
    while not changed.isEmpty():
        step = edges.join(changed, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("v")).agg(F.min("colour").alias("new"))
        merged = _stored(best.join(step, "v", "left").withColumn("better", F.coalesce(F.col("new") < F.col("colour"), F.lit(False))), "scc-colours")
        best = merged.select("v", F.least("colour", "new").alias("colour"))
        changed = merged.filter("better").select("v", F.col("new").alias("colour"))
    return best


def _reached(edges: DataFrame, start: DataFrame) -> DataFrame:
    """``(v)`` of what the vertices of ``start`` (v) reach, themselves included."""
    seen = frontier = _stored(start.select("v").distinct(), "reached")
    while not frontier.isEmpty():
        step = edges.join(frontier, F.col("src") == F.col("v")).select(F.col("dst").alias("v")).distinct()
        frontier = _stored(step.join(seen, "v", "left_anti"), "reached-new")
        seen = _stored(seen.unionByName(frontier), "reached")
    return seen


def topological_levels(edges: DataFrame) -> DataFrame:
    """``(v, level)`` of every vertex of the directed ``edges``: the most edges
    of a way to it; null for those on or behind a cycle.  Vertices that no
    remaining edge leads to are peeled off round by round, their edges taken
    off the number that each vertex waits for."""
    way = materialise(edges.select("src", "dst"), "levels-edges")
    waits = way.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n"))
    waits = materialise(way.select(F.col("src").alias("v")).union(way.select("dst")).distinct().join(waits, "v", "left").select("v", F.coalesce("n", F.lit(0)).alias("n"), F.lit(None).cast("int").alias("level")), "levels")
    level = 0
    while True:
        free = waits.filter("n = 0 and level is null").select("v")
        if free.isEmpty():
            return waits.select("v", "level")
        off = way.join(free, F.col("src") == F.col("v")).groupBy(F.col("dst").alias("w")).agg(F.count("*").alias("off"))
        done = F.when((F.col("n") == 0) & F.col("level").isNull(), F.lit(level)).otherwise(F.col("level"))
        waits = materialise(waits.join(off, F.col("v") == F.col("w"), "left").select("v", (F.col("n") - F.coalesce("off", F.lit(0))).alias("n"), done.alias("level")), "levels")
        level += 1


def signed_distances(edges: DataFrame, sources: DataFrame, every: int = 8) -> DataFrame:
    """``(v, distance)`` from the vertices of ``sources`` (v) over directed
    ``edges`` of any costs; minus infinity for what a negative cycle reaches.

    Rounds of relaxation keep each vertex's predecessor.  Every few rounds the
    predecessors are followed by pointer doubling: those whose way back does not
    end came around a negative cycle.  They and what they reach are minus
    infinity and leave the graph; the rest goes on until nothing changes."""
    way = materialise(edges.select("src", "dst", "cost"), "signed-edges")
    best = materialise(sources.select("v").distinct().select("v", F.lit(0.0).alias("distance"), F.lit(None).cast("long").alias("p")), "signed")
    changed, sunk, rounds = best, None, 0
    while not changed.isEmpty():
        step = way.join(changed.select(F.col("v").alias("src"), "distance"), "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.struct((F.col("distance") + F.col("cost")).alias("d"), F.col("src").alias("p"))).alias("new"))
        better = F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new.d") < F.col("distance")))
        merged = materialise(best.join(step, "v", "full").select("v", F.when(better, F.col("new.d")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("new.p")).otherwise(F.col("p")).alias("p"), better.alias("better")), "signed")
        best, changed, rounds = merged.drop("better"), merged.filter("better").drop("better"), rounds + 1
        if rounds % every == 0 and not changed.isEmpty():
            around = _endless(best.filter("p is not null").select("v", "p"), best.count())
            if not around.isEmpty():
                down = _reached(way.select("src", "dst"), around)
                sunk = down if sunk is None else materialise(sunk.unionByName(down), "signed-sunk")
                way = materialise(way.join(down.withColumnRenamed("v", "src"), "src", "left_anti").join(down.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst", "cost"), "signed-edges")
                best, changed = best.join(down, "v", "left_anti"), changed.join(down, "v", "left_anti")
    out = best.select("v", "distance")
    return out if sunk is None else out.unionByName(sunk.distinct().select("v", F.lit(float("-inf")).alias("distance")))


def _endless(previous: DataFrame, n: int) -> DataFrame:
    """``(v)`` whose way along ``previous`` (v, p) is longer than ``n`` steps."""
    jump, length = previous, 1
    while length <= n:
        jump = materialise(jump.join(jump.select(F.col("v").alias("p"), F.col("p").alias("far")), "p").select("v", F.col("far").alias("p")), "signed-jumps")
        length *= 2
        if jump.isEmpty():
            break
    return jump.select("v")


def on_path(edges: DataFrame, path: DataFrame) -> DataFrame:
    """``edges`` with ``selected``: whether the path uses them, either way."""
    used = materialise(path.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), F.lit(True).alias("selected")).distinct(), "path-used")
    used = _sent(used, used.count())
    same = (F.least("src", "dst") == F.col("p")) & (F.greatest("src", "dst") == F.col("q"))
    return edges.join(used, same, "left").drop("p", "q").withColumn("selected", F.coalesce("selected", F.lit(False)))


def put_edge(edges: DataFrame, a: int, b: int, similarity: float) -> DataFrame:
    """``edges`` with the edge added, or changed if it is there."""
    if a == b or not 0 < similarity <= 1:
        raise ValueError("an edge joins two vertices with a similarity above 0 and up to 1")
    new = edges.sparkSession.createDataFrame([(min(a, b), max(a, b), similarity, max(LEAST_COST, 1.0 - similarity))], "src long, dst long, similarity double, cost double")
    return remove_edge(edges, a, b).unionByName(new)


def remove_edge(edges: DataFrame, a: int, b: int) -> DataFrame:
    return edges.filter((F.col("src") != min(a, b)) | (F.col("dst") != max(a, b)))


def weight_of(edges: DataFrame, a: int, b: int) -> float:
    """The edge's cost, infinite without one."""
    row = edges.filter((F.col("src") == min(a, b)) & (F.col("dst") == max(a, b))).select("cost").first()
    return row["cost"] if row else float("inf")


def minimum_forest(edges: DataFrame) -> DataFrame:
    """``(src, dst, cost)`` of the minimum spanning forest, equal costs by
    (src, dst): Kruskal on the driver up to the bound, else Boruvka rounds.  The
    edges are counted first: too many are not sent to the driver at all."""
    edges = materialise(edges.select("src", "dst", "cost"), "forest-all")
    if edges.count() <= DRIVER_EDGES:
        few = edges.toArrow()
        rows = list(zip(*(few.column(c).to_pylist() for c in ("src", "dst", "cost")), strict=True))
        names = sorted({v for a, b, _ in rows for v in (a, b)})
        at = {v: i for i, v in enumerate(names)}
        forest = K.kruskal(len(names), [(at[a], at[b], w) for a, b, w in rows])
        return edges.sparkSession.createDataFrame([(names[a], names[b], w) for a, b, w in forest], edges.select("src", "dst", "cost").schema)
    return boruvka(edges)


def boruvka(edges: DataFrame) -> DataFrame:
    """Each round every part takes its cheapest way out; parts then merge.
    Tables of a round are joined by shuffles: broadcasts would add up."""
    own = materialise(edges.select("src", "dst", "cost"), "forest-edges")
    chosen = own.limit(0)
    left = own.withColumns({"p": F.col("src"), "q": F.col("dst")})
    while True:
        order = F.struct("cost", "src", "dst")
        ways = left.select("p", order.alias("e")).unionByName(left.select(F.col("q").alias("p"), order.alias("e")))
        picked = materialise(ways.groupBy("p").agg(F.min("e").alias("e")).select("e.src", "e.dst", "e.cost").distinct(), "forest-picked")
        if picked.isEmpty():
            return chosen
        chosen = materialise(chosen.unionByName(picked), "forest")
        parts = _stored(connected_components(chosen, shuffled=True), "forest-parts")
        side = lambda v, p: parts.select(F.col("node").alias(v), F.col("component").alias(p))
        left = materialise(own.join(side("src", "p"), "src").join(side("dst", "q"), "dst").filter("p <> q").select("src", "dst", "cost", "p", "q"), "forest-left")


def on_driver(edges: DataFrame, kernel: Callable[[int, list[K.Edge]], list[tuple]], schema: str, vertices: int = 1) -> DataFrame:
    """A small-graph kernel over the vertices that edges name, numbered in order
    and named again in the first ``vertices`` columns, under the checked
    bound."""
    few = edges.select("src", "dst", "cost").orderBy("src", "dst").limit(DRIVER_EDGES + 1).toArrow()
    if few.num_rows > DRIVER_EDGES:
        raise ValueError(f"more than {DRIVER_EDGES} edges; thin the graph first")
    rows = list(zip(*(few.column(c).to_pylist() for c in ("src", "dst", "cost")), strict=True))
    names = sorted({v for a, b, _ in rows for v in (a, b)})
    at = {v: i for i, v in enumerate(names)}
    found = kernel(len(names), [(at[a], at[b], w) for a, b, w in rows])
    return edges.sparkSession.createDataFrame([(*(names[v] for v in r[:vertices]), *r[vertices:]) for r in found], schema)


def snapshot_nodes(vertices: DataFrame, cases: DataFrame, grouped: DataFrame) -> DataFrame:
    """``(v, group_id, worst)``: group ("" for none) and the greatest score of
    the cases that touch the vertex."""
    ends = cases.select(F.col("src").alias("v"), "similarity").unionByName(cases.select(F.col("dst").alias("v"), "similarity"))
    worst = ends.groupBy("v").agg(F.max("similarity").alias("worst"))
    return vertices.join(worst, "v", "left").join(grouped, "v", "left").select("v", F.coalesce("group_id", F.lit("")).alias("group_id"), F.coalesce("worst", F.lit(0.0)).alias("worst"))
