"""Edge lists and other small text files of a graph job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """edges(src, dst) from text lines: two ids between tabs, commas or blanks; more columns are ignored.

    Lines that begin with # or % and self-edges are dropped, parallel edges stay. A blank line, a line of one
    token or an id that is no number raises an error when the edges are read.
    """
    text = F.col(column)
    parts = F.split(F.regexp_replace(text, "^[\t, \r]+", ""), "[\t, \r]+")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.substring(text, 1, 80))).cast("long")

    def vertex(i: int) -> F.Column:
        token = F.get(parts, F.lit(i))
        return F.when(token.rlike("^[0-9]+$"), token.cast("long")).otherwise(bad)

    return lines.filter(~text.rlike("^[#%]")).select(vertex(0).alias("src"), vertex(1).alias("dst")).filter("src <> dst")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def write_edge_list(edges: DataFrame, path: str, rows_per_file: int = 0) -> None:
    """Tab-separated lines, in files of so many rows at most (0: as the partitions are)."""
    edges.select(F.concat_ws("\t", "src", "dst")).write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).text(path)


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """values(vertex, value) from lines of an id, a blank and a number."""
    return spark.read.schema("vertex long, value double").option("sep", " ").option("mode", "FAILFAST").csv(path)


def write_values(values: DataFrame, path: str) -> None:
    values.select("vertex", "value").write.mode("overwrite").option("sep", " ").csv(path)


def append_measurement(spark: SparkSession, path: str, **values: float) -> None:
    """A row of named numbers appended to a CSV log."""
    spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in values.items()]).coalesce(1).write.mode("append").option("header", True).csv(path)
