"""A directed multigraph as DataFrames."""

from __future__ import annotations

from functools import cached_property

import numpy as np
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import cut

#: Neighbours that one adjacency row holds; a vertex with more has further rows.
CHUNK = 4096
#: Largest adjacency, by counted vertices and edges, that is broadcast.
BROADCAST_BYTES = 32 << 20


class Graph:
    """edges(src, dst): parallel edges count, self-edges are dropped. Vertices are 0 .. n - 1.

    n is one more than the greatest id of a kept edge, or of any edge if self_edges_count. A graph is built once: its
    edges are written, one aggregate over them counts vertices, edges and the greatest degree, which decide the
    physical plan of a step, and the adjacency is made of them. saved() and opened() keep all that for other jobs.
    """

    def __init__(self, edges: DataFrame, n: int | None = None, self_edges_count: bool = False):
        raw = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        self.spark, self.edges = edges.sparkSession, raw.filter("src <> dst")
        self._given, self._bounds = n, raw if self_edges_count else None

    @cached_property
    def stored(self) -> DataFrame:
        """The edges, written once: whatever made them does not run again."""
        return cut(self.edges, "edges")

    @cached_property
    def sizes(self) -> tuple[int, int, int]:
        """Vertices, edges, greatest out-degree."""
        by = self.stored.groupBy("src").agg(F.count(F.lit(1)).alias("outd"), F.max("dst").alias("top"))
        top, e, d = by.agg(F.max(F.greatest("src", "top")), F.sum("outd"), F.max("outd")).first()
        if self._given is not None:
            n = self._given
        elif self._bounds is not None:
            far = self._bounds.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n = 0 if far is None else far + 1
        else:
            n = 0 if top is None else top + 1
        return n, e or 0, d or 0

    @property
    def n(self) -> int:
        return self.sizes[0]

    @property
    def counted(self) -> tuple[int, int]:
        """Edges and the greatest out-degree."""
        return self.sizes[1:]

    @cached_property
    def degrees(self) -> DataFrame:
        """(src, outd) of the vertices with an out-edge."""
        return self.stored.groupBy("src").agg(F.count(F.lit(1)).alias("outd"))

    def saved(self, path: str) -> "Graph":
        """This graph with its sizes and adjacency as tables under path, opened."""
        n, e, d = self.sizes
        self.stored.write.parquet(f"{path}/edges")
        self.adjacency.write.parquet(f"{path}/adjacency")
        # written last: a folder without it is not finished
        self.spark.range(1).select(*[F.lit(v).cast("long").alias(k) for k, v in (("n", n), ("edges", e), ("greatest", d), ("chunk", CHUNK))]).coalesce(1).write.parquet(f"{path}/sizes")
        return Graph.opened(self.spark, path)

    @staticmethod
    def opened(spark: SparkSession, path: str) -> "Graph":
        """A graph that saved() has written; nothing is computed."""
        g = Graph(spark.read.parquet(f"{path}/edges"))
        r = spark.read.parquet(f"{path}/sizes").first()
        if r["chunk"] != CHUNK:
            raise ValueError(f"{path} has {r['chunk']} neighbours to a row, not {CHUNK}: save the graph anew")
        g.stored, g.sizes, g.adjacency = g.edges, (r["n"], r["edges"], r["greatest"]), spark.read.parquet(f"{path}/adjacency")
        return g

    def vertices(self) -> DataFrame:
        return self.spark.range(self.n)

    def in_degrees(self) -> DataFrame:
        return self.edges.groupBy("dst").agg(F.count(F.lit(1)).alias("ind"))

    def all_degrees(self) -> DataFrame:
        """(id, outd) of every vertex, 0 where it has no out-edge."""
        return self.vertices().join(self.degrees.withColumnRenamed("src", "id"), "id", "left").select("id", F.coalesce("outd", F.lit(0)).alias("outd"))

    def dead_ends(self) -> DataFrame:
        return self.vertices().join(self.degrees.select(F.col("src").alias("id")), "id", "left_anti")

    def degree_histogram(self) -> DataFrame:
        return self.all_degrees().groupBy("outd").agg(F.count(F.lit(1)).alias("vertices"))

    def numbered_edges(self) -> DataFrame:
        """(src, idx, dst): each vertex's edges numbered from 0 by target, without bringing a hub into one task.

        Edges are ranged over (src, dst); within a range they are numbered, and the ranges' counts are added up.
        """
        ranged = cut(self.stored.repartitionByRange("src", "dst").withColumn("part", F.spark_partition_id()), "ranged-edges")
        before = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = ranged.groupBy("src", "part").agg(F.count(F.lit(1)).alias("c")).withColumn("offset", F.coalesce(F.sum("c").over(before), F.lit(0)))
        within = ranged.withColumn("k", F.row_number().over(Window.partitionBy("src", "part").orderBy("dst")) - 1)
        return within.join(offsets.select("src", "part", "offset"), ["src", "part"]).select("src", (F.col("k") + F.col("offset")).alias("idx"), "dst")

    @cached_property
    def has_hubs(self) -> bool:
        return self.counted[1] > CHUNK

    @cached_property
    def adjacency(self) -> DataFrame:
        """(src, chunk, outd, nbrs): sorted neighbours, CHUNK to a row. Written once, as every step joins it.

        One too large for a broadcast is written by ranges of ids and sorted, so that a scan of an id range skips files
        and row groups.
        """
        if not self.has_hubs:
            edges = self.stored if self.small else self.stored.repartitionByRange("src")
            out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("outd"), F.sort_array(F.collect_list("dst")).alias("nbrs")).select("src", F.lit(0).cast("long").alias("chunk"), "outd", "nbrs")
        else:
            numbered = self.numbered_edges().withColumn("chunk", F.floor(F.col("idx") / CHUNK))
            chunks = numbered.groupBy("src", "chunk").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
            out = chunks.join(self.degrees, "src").select("src", "chunk", "outd", "nbrs")
            out = out if self.small else out.repartitionByRange("src", "chunk")
        return cut(out if self.small else out.sortWithinPartitions("src", "chunk"), "adjacency")

    def of_range(self, first: int, last: int) -> DataFrame:
        """The adjacency rows of the vertices first to last: the bounds are pushed to the scan of the sorted table."""
        return self.adjacency.filter(F.col("src").between(first, last))

    @cached_property
    def small(self) -> bool:
        return 40 * self.n + 8 * self.counted[0] <= BROADCAST_BYTES

    @cached_property
    def resident(self) -> tuple[Broadcast, Broadcast]:
        """(offsets, targets): where each vertex's sorted neighbours begin, and the neighbours, as int64 arrays on every
        executor. Only for a graph that is small by its counted vertices and edges."""
        if not self.small:
            raise ValueError("the adjacency is too large to be resident")
        edges = self.stored.toArrow()
        src, dst = (edges[c].to_numpy() for c in ("src", "dst"))
        targets = dst[np.lexsort((dst, src))]
        offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.bincount(src, minlength=self.n), out=offsets[1:])
        return tuple(self.spark.sparkContext.broadcast(x) for x in (offsets, targets if len(targets) else np.zeros(1, np.int64)))

    def first_chunks(self) -> DataFrame:
        """(src, outd, nbrs) to join a walk's position with: broadcast if the counts say it is small."""
        out = self.adjacency.filter("chunk = 0").select("src", "outd", "nbrs")
        return F.broadcast(out) if self.small else out

    def further_chunks(self) -> DataFrame:
        return self.adjacency.filter("chunk > 0").select(F.col("src").alias("hub"), "chunk", F.col("nbrs").alias("more"))
