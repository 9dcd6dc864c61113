"""Edges that arrive as text files: degrees kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.edgelist import parse_lines


def streamed_edges(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return parse_lines(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder))


def streamed_degrees(edges: DataFrame) -> DataFrame:
    """(src, outd), to be written in update or complete mode; the state is a count for each vertex."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("outd"))
