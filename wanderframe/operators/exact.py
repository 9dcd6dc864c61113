"""What walks give in expectation, without sampling: each step is a join with the transition table and a sum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .analytics import DECAY
from .graph import Graph
from .walker import CUT_EVERY

FOLLOW = 0.85


def transitions(graph: Graph) -> DataFrame:
    """(src, dst, p): the chance of each neighbour, parallel edges counting."""
    pairs = graph.stored.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    return cut(pairs.join(graph.degrees, "src").select("src", "dst", (F.col("m") / F.col("outd")).alias("p")), "transitions")


def _moved(mass: DataFrame, p: DataFrame, share: float) -> DataFrame:
    return mass.join(p, mass["vertex"] == p["src"]).groupBy(F.col("dst").alias("vertex")).agg((F.sum(F.col("e") * F.col("p")) * share).alias("e"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("vertex").agg(F.round(F.sum("e"), 6).alias("expected"))


def expected_visits(graph: Graph, starts: DataFrame, kernel: str, length: int, source: int | None = None) -> DataFrame:
    """(vertex, expected) for starts(vertex, e) and the kernels stop, simple, jump and restart (of one source)."""
    p, mass, parts = transitions(graph), starts, [starts]
    for hop in range(length - 1):
        share = 1.0 if kernel == "simple" else FOLLOW
        moved = _moved(mass, p, share)
        if kernel in ("jump", "restart"):
            lost = mass.join(graph.degrees, mass["vertex"] == graph.degrees["src"], "left").agg(
                F.sum(F.when(F.col("outd").isNull(), F.col("e")).otherwise((1 - FOLLOW) * F.col("e"))).alias("lost"))
            if kernel == "jump":  # one row meets all vertices: a scalar, not a pairing
                back = graph.vertices().join(F.broadcast(lost), how="cross").select(F.col("id").alias("vertex"), (F.col("lost") / graph.n).alias("e"))
            else:
                back = lost.select(F.lit(source).cast("long").alias("vertex"), F.col("lost").alias("e"))
            moved = moved.unionByName(back).groupBy("vertex").agg(F.sum("e").alias("e"))
        mass = cut(moved, "mass") if hop % 3 == 2 or kernel in ("jump", "restart") else moved
        parts.append(mass)
    return _summed(parts)


def graphlet_ratio(graph: Graph) -> DataFrame:
    """(expected): the chance that a stopping walk of length 4 from a uniform vertex closes a triangle.

    Each closed path a -> b -> c -> a has its three vertices in some order of (degree, id). Edges are turned towards the
    greater vertex; a triangle is found once, from its least vertex, by pairing that vertex's edges to greater ones: the
    pairs of a hub's many lesser neighbours are never made. Both directions around a triangle count.
    """
    p = transitions(graph)
    # both directions of each pair of neighbours in one row, 0 where there is no edge
    ab = p.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.when(F.col("src") < F.col("dst"), F.col("p")).otherwise(0.0).alias("up"), F.when(F.col("src") > F.col("dst"), F.col("p")).otherwise(0.0).alias("down"))
    pairs = cut(ab.groupBy("x", "y").agg(F.sum("up").alias("up"), F.sum("down").alias("down")), "pairs")
    ends = pairs.select("x").unionByName(pairs.select(F.col("y").alias("x"))).groupBy("x").agg(F.count(F.lit(1)).alias("deg"))
    ranked = pairs.join(ends, "x").join(ends.select(F.col("x").alias("y"), F.col("deg").alias("deg_y")), "y")
    forward = F.struct("deg", "x") < F.struct(F.col("deg_y").alias("deg"), F.col("y").alias("x"))
    turned = cut(ranked.select(F.when(forward, F.col("x")).otherwise(F.col("y")).alias("lo"), F.when(forward, F.col("y")).otherwise(F.col("x")).alias("hi"),
                               F.when(forward, F.col("up")).otherwise(F.col("down")).alias("out"), F.when(forward, F.col("down")).otherwise(F.col("up")).alias("back")), "turned-pairs")
    one, two, three = turned.toDF("a", "b", "ab", "ba"), turned.toDF("a", "c", "ac", "ca"), turned.toDF("b", "c", "bc", "cb")
    closed = one.join(two, "a").join(three, ["b", "c"])
    # three starting points around either direction
    share = 3 * (F.col("ab") * F.col("bc") * F.col("ca") + F.col("ac") * F.col("cb") * F.col("ba"))
    return closed.agg(F.sum(share).alias("t")).select(F.round(F.coalesce("t", F.lit(0.0)) * FOLLOW**3 / graph.n, 9).alias("expected"))


def bfs(graph: Graph, source: int, most: int | None = None) -> DataFrame:
    """(vertex, distance) of all that the source reaches, or only of what a path of at most so many edges reaches."""
    frontier = cut(graph.spark.range(source, source + 1).select(F.col("id").alias("vertex"), F.lit(0).alias("distance")), "frontier")
    seen, d = frontier, 0
    edges = cut(graph.stored.distinct(), "distinct-edges")
    while most is None or d < most:
        d += 1
        reached = frontier.join(edges, frontier["vertex"] == edges["src"]).select(F.col("dst").alias("vertex")).distinct()
        frontier = cut(reached.join(seen.select("vertex"), "vertex", "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if d % CUT_EVERY == 0:
            seen = cut(seen, "seen")
    return seen


def simrank(graph: Graph, a: int, b: int, length: int) -> DataFrame:
    """(expected): the pair chain over positions of two restarting walks that have not met. For small neighbourhoods."""
    p = transitions(graph)

    def advanced(state: DataFrame, x: str, home: int) -> DataFrame:
        follows = state.join(p, state[x] == p["src"]).select(*[c for c in state.columns if c not in (x, "w")], F.col("dst").alias(x), (F.col("w") * F.col("p") * FOLLOW).alias("w"))
        known = p.select(F.col("src").alias(x)).distinct().withColumn("out", F.lit(True))
        back = state.join(known, x, "left").select(*[c for c in state.columns if c not in (x, "w")], F.lit(home).cast("long").alias(x),
                                                   (F.col("w") * F.when(F.col("out"), 1 - FOLLOW).otherwise(1.0)).alias("w"))
        both = follows.unionByName(back)
        return both.groupBy(*[c for c in both.columns if c != "w"]).agg(F.sum("w").alias("w"))

    state = graph.spark.range(1).select(F.lit(a).cast("long").alias("x"), F.lit(b).cast("long").alias("y"), F.lit(1.0).alias("w"))
    parts = []
    for hop in range(max(1, length - 1)):
        parts.append(state.filter("x = y").agg((F.coalesce(F.sum("w"), F.lit(0.0)) * DECAY**hop).alias("s")))
        state = cut(advanced(advanced(state.filter("x <> y"), "x", a), "y", b), "pairs")
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.agg(F.round(F.sum("s"), 9).alias("expected"))
