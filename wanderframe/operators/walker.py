"""Advancing many walks at once, a superstep for each hop."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..plans.scratch import cut
from .graph import CHUNK, Graph
from .kernels import Kernel, ended

#: Supersteps between two written tables.
CUT_EVERY = 10
#: Walks that a task advances together over a resident adjacency.
WALKS_AT_ONCE = 1 << 16


def step(graph: Graph, walks: DataFrame, kernel: Kernel, hop: int, seed: int) -> DataFrame:
    """walks(walk_id, source, current, ...) with current moved on; null where the walk has ended.

    The position's row of neighbours comes by a left join, broadcast or shuffled as the graph's counts say.
    Only for picks beyond a hub's first CHUNK neighbours is there a second join, on hub and chunk.
    """
    kept = [c for c in walks.columns if c != "current"]
    goes = F.col("outd").isNotNull()
    if kernel.damped:
        goes = goes & (rng.draw(F.col("walk_id"), hop, rng.CONTINUE, seed) > rng.STOP_BELOW)
    moved = walks.join(graph.first_chunks(), F.col("current") == F.col("src"), "left")
    moved = moved.withColumn("pick", F.when(goes, rng.draw(F.col("walk_id"), hop, rng.NEIGHBOUR, seed) % F.col("outd")))
    chosen = F.get("nbrs", F.col("pick").cast("int"))
    if graph.has_hubs:
        moved = moved.withColumn("near", F.when(F.col("pick") < CHUNK, F.get("nbrs", F.col("pick").cast("int")))).drop("nbrs")
        moved = moved.join(graph.further_chunks(), (F.col("current") == F.col("hub")) & (F.floor(F.col("pick") / CHUNK) == F.col("chunk")), "left")
        chosen = F.coalesce("near", F.get("more", (F.col("pick") % CHUNK).cast("int")))
    target = rng.draw(F.col("walk_id"), hop, rng.JUMP, seed) % graph.n
    other = kernel.otherwise(F.col("source"), target) if kernel.otherwise else ended()
    following = F.when(F.col("pick").isNotNull(), chosen).when(F.col("current").isNotNull(), other)
    return moved.select(*kept, following.alias("current"))


def _positions(graph: Graph, kernel: Kernel, hops: int | None, seed: int) -> Callable:
    """A function of walk ids and sources, as arrays, that gives hop by hop (numbers of the walks alive, their vertices).

    It runs on executors over the resident adjacency and is self-contained, so that executors need not have this
    package. The draws are those of functions.rng.
    """
    (offsets, targets), n = graph.resident, max(1, graph.n)
    damped, otherwise = kernel.damped, kernel.otherwise_sql
    mask, multiplier, stop_below, purposes = rng.MASK, rng.MULTIPLIER, rng.STOP_BELOW, (rng.CONTINUE, rng.NEIGHBOUR, rng.JUMP)

    def draw(walk_id, hop, purpose):
        x = (walk_id * 1000003 + (hop * 7919 + purpose * 104729 + seed)) & mask
        for _ in range(2):
            x = ((x ^ (x >> 16)) * multiplier) & mask
        return x ^ (x >> 16)

    def positions(walk_id, source):
        begin_of, target_of = offsets.value, targets.value
        alive, ids, home, at, hop = np.arange(len(walk_id)), walk_id, source, source, 0
        while len(alive):
            yield alive, at
            if hops is not None and hop >= hops - 1:
                return
            known = at < len(begin_of) - 1
            begin = np.where(known, begin_of[np.where(known, at, 0)], 0)
            degree = np.where(known, begin_of[np.where(known, at + 1, 0)], 0) - begin
            goes = degree > 0
            if damped:
                goes &= draw(ids, hop, purposes[0]) > stop_below
            following = target_of[np.where(goes, begin + draw(ids, hop, purposes[1]) % np.maximum(degree, 1), 0)]
            if otherwise is None:
                alive, ids, home, at = alive[goes], ids[goes], home[goes], following[goes]
            else:
                at = np.where(goes, following, home if otherwise == "source" else draw(ids, hop, purposes[2]) % n)
            hop += 1

    return positions


def _resident_paths(graph: Graph, seeds: DataFrame, kernel: Kernel, hops: int, seed: int) -> DataFrame:
    positions, names, rows = _positions(graph, kernel, hops, seed), seeds.columns, WALKS_AT_ONCE

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                walk_id, source = (batch.column(names.index(c)).to_numpy() for c in ("walk_id", "source"))
                seen = np.full((batch.num_rows, hops), -1, np.int64)
                for hop, (alive, at) in enumerate(positions(walk_id, source)):
                    seen[alive, hop] = at
                there = seen >= 0
                ends = np.append(0, np.cumsum(there.sum(1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(seen[there]))], [*names, "path"])

    return seeds.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in seeds.schema) + ", path array<long>")


def _resident_counts(graph: Graph, seeds: DataFrame, kernel: Kernel, hops: int | None, seed: int, by: tuple[str, ...]) -> DataFrame:
    positions, by_source, rows = _positions(graph, kernel, hops, seed), "source" in by, WALKS_AT_ONCE

    def counted(source, vertex, times):
        """Each pair once, with its times summed."""
        order = np.lexsort((vertex, source))
        source, vertex, times = source[order], vertex[order], times[order]
        first = np.flatnonzero(np.append(True, (source[1:] != source[:-1]) | (vertex[1:] != vertex[:-1])))
        return source[first], vertex[first], np.add.reduceat(times, first)

    def run(batches):
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, whole.num_rows, rows)):
                walk_id, source = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                parts, size = [], 0
                for alive, at in positions(walk_id, source):
                    parts.append((source[alive] if by_source else np.zeros(len(at), np.int64), at, np.ones(len(at), np.int64)))
                    size += len(at)
                    if size > 4 * rows:
                        parts = [counted(*map(np.concatenate, zip(*parts)))]
                        size = len(parts[0][0])
                of, vertex, times = counted(*map(np.concatenate, zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(vertex), pa.array(times)], ["source", "vertex", "cnt"])

    part = seeds.select("walk_id", "source").mapInArrow(run, "source long, vertex long, cnt long")
    return part.groupBy(*by).agg(F.sum("cnt").alias("cnt"))


def walk(graph: Graph, seeds: DataFrame, kernel: Kernel, length: int, seed: int = 42) -> DataFrame:
    """paths(seeds' columns, path): the vertices that each walk visits, hop 0 first. Paths are for short walks, of a
    kernel with a limit; visit_counts() keeps none and takes any kernel.

    Over a small graph, by its counts, walks are made where their seeds are, in one pass over the resident adjacency;
    else each hop is a join.
    """
    hops = kernel.visits(length)
    if hops is None:
        raise ValueError(f"walks of kernel {kernel.name} have no limit: count their visits")
    if graph.small and kernel.resident:
        return _resident_paths(graph, seeds, kernel, hops, seed)
    paths = seeds.withColumns({"current": F.col("source"), "path": F.array("source")})
    for hop in range(hops - 1):
        paths = step(graph, paths, kernel, hop, seed)
        paths = paths.withColumn("path", F.when(F.col("current").isNull(), F.col("path")).otherwise(F.concat("path", F.array("current"))))
        if (hop + 1) % CUT_EVERY == 0:
            paths = cut(paths, "walks")
    return paths.drop("current")


def visits(paths: DataFrame) -> DataFrame:
    """(paths' other columns, hop, vertex)"""
    return paths.select(*[c for c in paths.columns if c != "path"], F.posexplode("path").alias("hop", "vertex"))


def visit_counts(graph: Graph, seeds: DataFrame, kernel: Kernel, length: int | None = None, seed: int = 42, by: tuple[str, ...] = ("vertex",)) -> DataFrame:
    """(by, cnt): visits by vertex, or by source and vertex, for walks of any length; without a limit until no walk is
    alive.

    Over a small graph, by its counts, walks run and are counted where their seeds are; only counts move. Else a hop is a
    join of positions alone, which is written, so that what is moved grows with the hops and not with their square.
    """
    hops = kernel.visits(length)
    if graph.small and kernel.resident:
        return _resident_counts(graph, seeds, kernel, hops, seed, by)
    now, total, hop = cut(seeds.select("walk_id", "source", F.col("source").alias("current")), "walks"), None, 0
    pending = [now]
    while hops is None or hop < hops - 1:
        now = cut(step(graph, now, kernel, hop, seed).filter("current IS NOT NULL"), "walks")
        hop += 1
        if kernel.otherwise is None and now.isEmpty():
            break
        pending.append(now)
        if len(pending) >= CUT_EVERY:
            total, pending = _added(pending, total, by), []
    return _added(pending, total, by) if pending else total


def _added(positions: list[DataFrame], total: DataFrame | None, by: tuple[str, ...]) -> DataFrame:
    counts = reduce(DataFrame.unionByName, [x.withColumnRenamed("current", "vertex").select(*by) for x in positions]).groupBy(*by).agg(F.count(F.lit(1)).alias("cnt"))
    return cut(counts if total is None else counts.unionByName(total).groupBy(*by).agg(F.sum("cnt").alias("cnt")), "visit-counts")


def alive_by_hop(paths: DataFrame) -> DataFrame:
    """(hop, walks): how many walks make each hop."""
    return visits(paths).groupBy("hop").agg(F.count(F.lit(1)).alias("walks"))
