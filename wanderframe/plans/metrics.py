"""Named measurements of a job, and their reports."""

from __future__ import annotations

import html
import json
import time
from collections import defaultdict
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class Metrics:
    def __init__(self):
        self.values: dict[str, list[float]] = defaultdict(list)
        self.labels: dict[str, str] = {}

    def add(self, name: str, value: float) -> None:
        self.values[name].append(value)

    def label(self, name: str, value: str) -> None:
        self.labels[name] = value

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(name, time.perf_counter() - began)

    def summary(self) -> dict[str, dict[str, float]]:
        return {k: {"count": len(v), "sum": sum(v), "min": min(v), "max": max(v)} for k, v in sorted(self.values.items())}

    def as_json(self) -> str:
        return json.dumps({"labels": self.labels, "metrics": self.summary()}, sort_keys=True)

    def as_text(self) -> str:
        return "\n".join([*(f"{k}: {v}" for k, v in sorted(self.labels.items())), *(f"{k}: {s['sum']:g} ({s['count']})" for k, s in self.summary().items())])

    def as_html(self) -> str:
        cells = [(k, v) for k, v in sorted(self.labels.items())] + [(k, f"{s['sum']:g}") for k, s in self.summary().items()]
        return "<table>" + "".join(f"<tr><td>{html.escape(k)}</td><td>{html.escape(v)}</td></tr>" for k, v in cells) + "</table>"

    def written(self, spark: SparkSession, path: str) -> None:
        """The text, JSON and HTML reports, as text files in folders of these names under path."""
        for name, report in (("text", self.as_text()), ("json", self.as_json()), ("html", self.as_html())):
            spark.range(1).select(F.lit(report).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
