"""Flat binary files of numbers, little-endian, as other tools leave them: offsets and neighbours of a graph, vertex values.

A file is split into records that are read where they lie; a number's place comes from the count of those before it, so
the files of a folder are taken in the order of their names.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed formats: 64-bit offsets, 32-bit ids and counts, 32-bit floats.
OFFSET, ID, FLOAT = "<Q", "<I", "<f"


def read_numbers(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(place, value) of a file of numbers of one kind."""
    rows = spark.sparkContext.binaryRecords(path, struct.calcsize(kind)).zipWithIndex().map(lambda x: (x[1], struct.unpack(kind, x[0])[0]))
    return spark.createDataFrame(rows, f"place long, value {'double' if kind == FLOAT else 'long'}")


def read_csr(spark: SparkSession, offsets: str, neighbours: str, vertices_at_once: int = 1 << 14) -> DataFrame:
    """edges(src, dst) from a file of n + 1 offsets and one of all neighbours."""
    at = read_numbers(spark, offsets, OFFSET).withColumnRenamed("place", "src")
    # the offset behind a vertex is the next one's: within a stride by a window, from the next stride by its first row
    both = at.select("src", "value", F.expr(f"src div {vertices_at_once}").alias("stride")).unionByName(
        at.filter(f"src % {vertices_at_once} = 0 AND src > 0").select("src", "value", F.expr(f"src div {vertices_at_once} - 1").alias("stride")))
    ends = both.withColumn("end", F.lead("value").over(Window.partitionBy("stride").orderBy("src"))).filter("end > value")
    places = ends.select("src", F.explode(F.sequence("value", F.col("end") - 1)).alias("place"))
    return places.join(read_numbers(spark, neighbours, ID), "place").select("src", F.col("value").alias("dst"))


def read_vertex_values(spark: SparkSession, path: str, kind: str = ID) -> DataFrame:
    """values(vertex, value) of a file with one number for each vertex."""
    return read_numbers(spark, path, kind).withColumnRenamed("place", "vertex")
