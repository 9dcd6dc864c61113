"""Blocks of consecutive vertices, and the state of walks within them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .graph import Graph

EDGE_BYTES = 4
MEMORY_KB = 44 << 20
#: Vertices to a partial sum.
STRIDE = 1 << 14


def block_kilobytes(walks: Column) -> Column:
    """2 ** (11 + decimal digits of the number of walks)."""
    return F.pow(F.lit(2), F.lit(11) + F.when(walks == 0, 0).otherwise(F.length(walks.cast("string")))).cast("long")


def cached_blocks(kilobytes: int, memory_kb: int = MEMORY_KB) -> int:
    return memory_kb // kilobytes


def begin_positions(graph: Graph) -> DataFrame:
    """(id, outd, begin): how many edges go out of the vertices before each. Sums by stride, then within it."""
    degrees = graph.all_degrees().withColumn("stride", F.expr(f"id div {STRIDE}"))
    sums = degrees.groupBy("stride").agg(F.sum("outd").alias("total"))
    before = sums.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum("outd").over(Window.partitionBy("stride").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return degrees.withColumn("inside", inside).join(before.select("stride", "base"), "stride").select("id", "outd", (F.col("base") + F.col("inside")).alias("begin"))


def equal_blocks(graph: Graph, kilobytes: int) -> DataFrame:
    """(block, first, last, edges): vertices by the block's share of edges that they begin in. One pass."""
    most = kilobytes * 1024 // EDGE_BYTES
    return begin_positions(graph).groupBy(F.expr(f"begin div {most}").alias("share")).agg(
        F.min("id").alias("first"), F.max("id").alias("last"), F.sum("outd").alias("edges")).select(F.col("share").alias("block"), "first", "last", "edges")


def greedy_blocks(graph: Graph, edges_per_block: int) -> DataFrame:
    """(first, last, edges): each block takes vertices in order while its edges fit; one that does not fit alone
    is a block by itself.

    Where a block that began at a vertex would end is found for all vertices at once: the last begin position
    within reach lies in the same or the next stretch of edges_per_block positions. The blocks are then the
    vertices that the first one reaches, found by doubling jumps, so the rounds are the logarithm of their number. A
    graph that is small by its counts is cut on the driver, by binary searches in the resident begin positions.
    """
    most = edges_per_block
    if graph.small:
        begins, starts = graph.resident[0].value, [0] if graph.n else []
        while starts and starts[-1] < graph.n:
            at = starts[-1]
            starts.append(max(at + 1, int(np.searchsorted(begins, begins[at] + most, side="right")) - 1))
        rows = [(a, b - 1, int(begins[b] - begins[a])) for a, b in zip(starts, starts[1:])]
        return graph.spark.createDataFrame(rows, "first long, last long, edges long")
    at = cut(begin_positions(graph).withColumn("stretch", F.expr(f"begin div {most}")), "begins")
    last_in = at.groupBy("stretch").agg(F.max("id").alias("stretch_last"))
    marks = at.select(F.col("stretch"), F.col("begin").alias("at"), F.lit(0).alias("asks"), "id").unionByName(
        at.select((F.col("stretch") + 1).alias("stretch"), (F.col("begin") + most).alias("at"), F.lit(1).alias("asks"), "id"))
    upto = Window.partitionBy("stretch").orderBy("at", "asks", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = marks.withColumn("reach", F.max(F.when(F.col("asks") == 0, F.col("id"))).over(upto)).filter("asks = 1").select("id", "reach")
    # begin positions reach through the total, which is where a block that holds the last vertex ends
    total = graph.counted[0]
    n = graph.n
    jumps = at.join(reach, "id").join(last_in, "stretch").select("id", F.when(F.lit(total) <= F.col("begin") + most, F.lit(n)).otherwise(
        F.greatest(F.coalesce("reach", "stretch_last"), F.col("id") + 1)).alias("next"))
    jumps = cut(jumps, "jumps")
    starts = cut(jumps.filter("id = 0").select("id"), "starts")
    doubled = jumps
    while True:
        more = starts.join(doubled, "id").select(F.col("next").alias("id")).filter(F.col("id") < n)
        grown = cut(starts.unionByName(more).distinct(), "starts")
        if grown.count() == starts.count():
            break
        starts = grown
        doubled = cut(doubled.join(doubled.select(F.col("id").alias("next"), F.col("next").alias("after")), "next").select("id", F.col("after").alias("next")), "jumps")
    ends = starts.join(jumps, "id").join(at.select("id", "begin"), "id")
    beyond = at.select(F.col("id").alias("next"), F.col("begin").alias("end"))
    return ends.join(beyond, "next", "left").select(F.col("id").alias("first"), (F.col("next") - 1).alias("last"), (F.coalesce("end", F.lit(total)) - F.col("begin")).alias("edges"))


def block_of(walks: DataFrame, blocks: DataFrame, stride: int = STRIDE) -> DataFrame:
    """walks with the block, by its first vertex, of their position. An equal join on strides of vertices; within a
    stride there are no more blocks than vertices."""
    met = blocks.select("first", "last", F.explode(F.sequence(F.expr(f"first div {stride}"), F.expr(f"last div {stride}"))).alias("stride"))
    at = walks.withColumn("stride", F.expr(f"current div {stride}"))
    return at.join(met, (at["stride"] == met["stride"]) & at["current"].between(met["first"], met["last"])).select(*[at[c] for c in walks.columns], F.col("first").alias("block"))


def block_state(walks: DataFrame) -> DataFrame:
    """(block, walks, min_hop) from walks(block, hop)."""
    return walks.groupBy("block").agg(F.count(F.lit(1)).alias("walks"), F.min("hop").alias("min_hop"))


def chosen_block(state: DataFrame, blocks: int, draw: int, prob: float = 0.2) -> DataFrame:
    """(random_block, chosen): a block drawn from 0 .. blocks - 1, and what the mixed rule loads next: with a chance of
    prob the block of the least hop, else that of most walks. draw: a number in [0, 2 ** 32)."""
    rules = next_blocks(state)
    return rules.select(F.lit(draw % blocks).cast("long").alias("random_block"), F.col("min_step" if draw < prob * 2**32 else "max_walks").alias("chosen"))


def next_blocks(state: DataFrame) -> DataFrame:
    """(max_walks, min_step, max_weight): the block that each scheduling rule would load next, least number on ties."""
    least = -F.col("block")
    chosen = state.agg(
        F.max_by("block", F.struct("walks", least)).alias("max_walks"), F.min_by("block", F.struct("min_hop", "block")).alias("min_step"),
        F.max_by("block", F.struct(F.col("walks") / F.col("min_hop"), least)).alias("max_weight"))
    return chosen
