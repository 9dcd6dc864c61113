"""Connected components in Spark, by alternating large and small stars. Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (large: the greater ones, else the smaller) are tied to the least of its neighbourhood.

    The minima are summed up before the shuffle and written, so that the join with a hub's many edges is one of
    two plain exchanges, which adaptive execution can split.
    """
    up = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    sides = up.unionByName(up.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else up
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star")
    if large:
        out = sides.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = sides.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    new = written(out.filter("u <> v").distinct(), "edges")
    discard(least)
    return new


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v): every node of edges(u, v) that is not the least of its component, with that least node.

    Self-edges and repeated edges change nothing; an empty table gives an empty one. The number of rounds grows
    with the logarithm of the longest path.
    """
    now = written(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    state = None
    for _ in range(rounds):
        after_large = _star(now, True)
        new = _star(after_large, False)
        discard(after_large)
        discard(now)
        now = new
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return now
        state = tuple(seen)
    raise RuntimeError("components did not settle")
