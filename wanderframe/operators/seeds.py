"""Where walks start: DataFrames (walk_id, source)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rng
from .graph import Graph


def uniform(graph: Graph, walks: int, seed: int) -> DataFrame:
    """Starts drawn with replacement from all vertices, isolated ones too."""
    return graph.spark.range(walks).select(F.col("id").alias("walk_id"), (rng.draw(F.col("id"), 0, rng.SEEDING, seed) % graph.n).alias("source"))


def every_vertex(graph: Graph, walks: int) -> DataFrame:
    return graph.spark.range(graph.n * walks).select(F.col("id").alias("walk_id"), F.expr(f"id div {walks}").alias("source"))


def source_range(spark: SparkSession, first: int, sources: int, walks: int) -> DataFrame:
    return spark.range(sources * walks).select(F.col("id").alias("walk_id"), F.expr(f"{first} + id div {walks}").alias("source"))


def single(spark: SparkSession, source: int, walks: int) -> DataFrame:
    return source_range(spark, source, 1, walks)


def pair(spark: SparkSession, a: int, b: int, walks: int) -> DataFrame:
    """(walk_id, source, side, walk_no): so many walks from a (side 0), then as many from b (side 1)."""
    return spark.range(2 * walks).select(
        F.col("id").alias("walk_id"), F.when(F.col("id") < walks, F.lit(a)).otherwise(F.lit(b)).cast("long").alias("source"),
        F.expr(f"cast(id div {walks} as int)").alias("side"), (F.col("id") % walks).alias("walk_no"))
