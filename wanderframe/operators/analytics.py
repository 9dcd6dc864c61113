"""What walks are for: visits, PageRank, PPR, triangles, SimRank, reachability, average degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from . import kernels, seeds
from .graph import Graph
from .walker import CUT_EVERY, step, visit_counts, visits, walk

DECAY = 0.8


def top_k(counts: DataFrame, k: int, value: str = "cnt", key: str = "vertex", by: str | None = None) -> DataFrame:
    """The k greatest by value, ties by key; for each group if by is given."""
    if by is None:
        return counts.orderBy(F.desc(value), key).limit(k)
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), key))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def approximate_top_k(visited: DataFrame, k: int, tracked: int = 10000) -> DataFrame:
    """(vertex, cnt) of the heaviest vertices by a sketch that tracks so many; exact counts if there are no more than
    three quarters of that."""
    return visited.agg(F.expr(f"approx_top_k(vertex, {k}, {tracked})").alias("top")).select(F.explode("top").alias("x")).select(
        F.col("x.item").alias("vertex"), F.col("x.count").alias("cnt"))


def raw_walks(graph: Graph, walks: int = 10000, length: int = 4, seed: int = 42) -> DataFrame:
    return walk(graph, seeds.uniform(graph, walks, seed), kernels.jump, length, seed)


def domination(graph: Graph, walks: int = 1, length: int = 6, seed: int = 42) -> DataFrame:
    """Visits of each vertex by jumping walks from all."""
    return visit_counts(graph, seeds.every_vertex(graph, walks), kernels.jump, length, seed)


def graphlet(graph: Graph, walks: int = 100000, length: int = 4, seed: int = 42) -> DataFrame:
    """(closed, walks, ratio): walks back at their source after length - 1 steps."""
    paths = walk(graph, seeds.uniform(graph, walks, seed), kernels.stop, length, seed)
    back = (F.size("path") == length) & (F.element_at("path", -1) == F.col("source"))
    return paths.agg(F.coalesce(F.sum(back.cast("long")), F.lit(0)).alias("closed"), F.count(F.lit(1)).alias("walks")).withColumn("ratio", F.col("closed") / F.col("walks"))


def multi_source_ppr(graph: Graph, first: int = 0, sources: int = 1, walks: int = 2000, length: int = 10, seed: int = 42) -> DataFrame:
    """(source, vertex, cnt) by stopping walks."""
    return visit_counts(graph, seeds.source_range(graph.spark, first, sources, walks), kernels.stop, length, seed, ("source", "vertex"))


def unbounded_ppr(graph: Graph, first: int = 0, sources: int = 1, walks: int = 1, seed: int = 42) -> DataFrame:
    """(source, vertex, cnt) by walks that only end by themselves, followed until none is alive."""
    return visit_counts(graph, seeds.source_range(graph.spark, first, sources, walks), kernels.prob, None, seed, ("source", "vertex"))


def pagerank(graph: Graph, walks: int = 1, length: int = 20, seed: int = 42) -> DataFrame:
    """(vertex, cnt, prob): the share of visits by jumping walks from all vertices."""
    counts = visit_counts(graph, seeds.every_vertex(graph, walks), kernels.jump, length, seed)
    total = graph.n * walks * length  # a jumping walk makes all its visits
    return counts.withColumn("prob", F.col("cnt") / F.lit(total))


def relative_error(estimated: DataFrame, accurate: DataFrame, top: int = 20) -> DataFrame:
    """(error): mean of |prob - value| / value over the top vertices of accurate(vertex, value)."""
    best = top_k(accurate, top, "value")
    return best.join(estimated, "vertex", "left").agg(F.avg(F.abs(F.coalesce("prob", F.lit(0.0)) - F.col("value")) / F.col("value")).alias("error"))


def personalized_pagerank(graph: Graph, source: int = 0, walks: int = 2000, length: int = 10, seed: int = 42) -> DataFrame:
    """(vertex, cnt) by walks that restart at the source."""
    return visit_counts(graph, seeds.single(graph.spark, source, walks), kernels.restart, length, seed)


def restarting_walks(graph: Graph, source: int = 0, walks: int = 10000, length: int = 4, seed: int = 42) -> DataFrame:
    return walk(graph, seeds.single(graph.spark, source, walks), kernels.restart, length, seed)


def simrank(graph: Graph, a: int = 1, b: int = 2, walks: int = 1000, length: int = 11, seed: int = 42) -> DataFrame:
    """(met, score): pairs of walks that meet, and the mean of DECAY to the first common position, 0 without one.

    Positions are joined on (hop, vertex) and a pair's first meeting is a minimum: no loop over pairs. Equal
    vertices score 1 by definition.
    """
    if a == b:
        return graph.spark.range(1).select((F.lit(walks) * walks).cast("long").alias("met"), F.lit(1.0).alias("score"))
    at = visits(walk(graph, seeds.pair(graph.spark, a, b, walks), kernels.restart_joint, length, seed)).select("side", "walk_no", "hop", "vertex")
    left = at.filter("side = 0").select(F.col("walk_no").alias("i"), "hop", "vertex")
    right = at.filter("side = 1").select(F.col("walk_no").alias("j"), "hop", "vertex")
    firsts = left.join(right, ["hop", "vertex"]).groupBy("i", "j").agg(F.min("hop").alias("l"))
    by_hop = firsts.groupBy("l").agg(F.count(F.lit(1)).alias("c"))
    return by_hop.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("met"), F.coalesce(F.round(F.sum(F.pow(F.lit(DECAY), F.col("l")) * F.col("c")) / (walks * walks), 9), F.lit(0.0)).alias("score"))


def reachability(graph: Graph, a: int = 1, b: int = 2, walks: int = 1000, length: int = 100, seed: int = 42) -> DataFrame:
    """(reached): whether restarting walks from a visit b. Where steps are joins, walks go on only while none has seen b."""
    if graph.small:
        counts = visit_counts(graph, seeds.single(graph.spark, a, walks), kernels.restart, length, seed)
        return counts.agg(F.coalesce(F.bool_or(F.col("vertex") == b), F.lit(False)).alias("reached"))
    now, hops, done, reached = seeds.single(graph.spark, a, walks).withColumn("current", F.col("source")), kernels.restart.visits(length), 0, a == b
    while done < hops - 1 and not reached:
        part = now.withColumn("seen", F.lit(False))
        for hop in range(done, min(done + CUT_EVERY, hops - 1)):
            part = step(graph, part, kernels.restart, hop, seed).withColumn("seen", F.col("seen") | (F.col("current") == b))
        part = cut(part, "walks")
        reached, now, done = not part.filter("seen").isEmpty(), part.drop("seen"), done + CUT_EVERY
    return graph.spark.range(1).select(F.lit(reached).alias("reached"))


def average_degree(graph: Graph, walks: int = 1000, length: int = 1000, seed: int = 42) -> DataFrame:
    """(samples, avg_degree): harmonic mean of the degrees that simple walks see."""
    counts = visit_counts(graph, seeds.uniform(graph, walks, seed), kernels.simple, length, seed)
    seen = counts.join(graph.degrees, counts["vertex"] == graph.degrees["src"]).groupBy("outd").agg(F.sum("cnt").alias("c"))
    return seen.agg(F.sum("c").alias("samples"), F.round(F.sum("c") / F.sum(F.col("c") / F.col("outd")), 6).alias("avg_degree"))


def constant_error(value: float, constant: float = 13.5988) -> float:
    return abs(value - constant) / constant


def utilisation(used: DataFrame, loaded: DataFrame, on: str) -> DataFrame:
    """(on, used, loaded, ratio): edges that walks used against edges read, for each block."""
    return loaded.join(used, on, "left").withColumn("ratio", F.coalesce("used", F.lit(0)) / F.col("loaded"))
