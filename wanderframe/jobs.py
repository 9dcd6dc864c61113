"""Walk jobs from the command line: python -m wanderframe.jobs JOB file=EDGES out=FOLDER [key=value ...]

An edge list is prepared once, beside it, and opened by later jobs. Results go to out/result as CSV, the top of them
to out/top, measurements to out/metrics (text, JSON, HTML) and the log to the log option's file. Options can also stand
in a file named by config. Every job takes those of Common and its own, with the defaults of the operators.
"""

from __future__ import annotations

import dataclasses
import logging
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analytics
from .operators.graph import Graph
from .plans.metrics import Metrics
from .plans.options import options, read_arguments
from .sources.edgelist import append_measurement, read_edge_list, read_values

log = logging.getLogger("wanderframe")


@dataclass
class Common:
    file: str = ""
    out: str = ""
    N: int = 0  # vertices; 0: as the edges say
    seed: int = 42
    ntop: int = 20
    log: str = ""


@dataclass
class Raw(Common):
    R: int = 10000
    L: int = 4


@dataclass
class Domination(Common):
    R: int = 1
    L: int = 6


@dataclass
class Graphlet(Common):
    R: int = 100000
    L: int = 4


@dataclass
class SimRank(Common):
    a: int = 1
    b: int = 2
    R: int = 1000
    L: int = 11


@dataclass
class Sources(Common):
    firstsource: int = 0
    numsources: int = 1
    walkspersource: int = 2000
    maxwalklength: int = 10


@dataclass
class Unbounded(Common):
    firstsource: int = 0
    numsources: int = 1
    walkspersource: int = 1


@dataclass
class PageRank(Common):
    R: int = 1
    L: int = 20
    accurate: str = ""  # a file of vertices and values to measure the error against


@dataclass
class Personal(Common):
    source: int = 0
    R: int = 2000
    L: int = 10


@dataclass
class Restart(Common):
    s: int = 0
    R: int = 10000
    L: int = 4


@dataclass
class Reachability(Common):
    a: int = 1
    b: int = 2
    R: int = 1000
    L: int = 100


@dataclass
class AverageDegree(Common):
    R: int = 1000
    L: int = 1000


#: Name to its options and what it computes.
JOBS: dict[str, tuple[type[Common], Callable[[Graph, Common], DataFrame]]] = {
    "rawrandomwalks": (Raw, lambda g, o: analytics.visits(analytics.raw_walks(g, o.R, o.L, o.seed)).groupBy("vertex").agg(F.count(F.lit(1)).alias("cnt"))),
    "rwdomination": (Domination, lambda g, o: analytics.domination(g, o.R, o.L, o.seed)),
    "graphlet": (Graphlet, lambda g, o: analytics.graphlet(g, o.R, o.L, o.seed)),
    "simrank": (SimRank, lambda g, o: analytics.simrank(g, o.a, o.b, o.R, o.L, o.seed)),
    "msppr": (Sources, lambda g, o: analytics.multi_source_ppr(g, o.firstsource, o.numsources, o.walkspersource, o.maxwalklength, o.seed)),
    "kk_ppr": (Unbounded, lambda g, o: analytics.unbounded_ppr(g, o.firstsource, o.numsources, o.walkspersource, o.seed)),
    "pagerank": (PageRank, lambda g, o: analytics.pagerank(g, o.R, o.L, o.seed)),
    "personalizedpagerank": (Personal, lambda g, o: analytics.personalized_pagerank(g, o.source, o.R, o.L, o.seed)),
    "randomwalkswithrestart": (Restart, lambda g, o: analytics.visits(analytics.restarting_walks(g, o.s, o.R, o.L, o.seed)).groupBy("vertex").agg(F.count(F.lit(1)).alias("cnt"))),
    "reachability": (Reachability, lambda g, o: analytics.reachability(g, o.a, o.b, o.R, o.L, o.seed)),
    "avgdegree": (AverageDegree, lambda g, o: analytics.average_degree(g, o.R, o.L, o.seed)),
}


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def prepared(spark: SparkSession, edges: str, n: int = 0) -> Graph:
    """The graph of an edge list, from the folder beside it; made there if there is none, or only part of one."""
    folder = f"{edges.rstrip('/')}_graph" + (f"_{n}" if n else "")
    if _there(spark, f"{folder}/sizes/_SUCCESS"):
        log.info("opened %s", folder)
        return Graph.opened(spark, folder)
    if _there(spark, folder):
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        log.info("removed the unfinished %s", folder)
    log.info("preparing %s", folder)
    return Graph(read_edge_list(spark, edges), n or None).saved(folder)


def run(spark: SparkSession, job: str, given: list[str]) -> DataFrame:
    """Runs a job with options given as on the command line; the result, as read back from out/result."""
    kind, compute = JOBS[job]
    words = read_arguments(given)
    config = "\n".join(r[0] for r in spark.read.text(words.pop("config")).collect()) if "config" in words else ""
    o = options(kind, config, [f"{k}={v}" for k, v in words.items()])
    if not o.file or not o.out:
        raise ValueError("file and out must be given")
    handler = logging.FileHandler(o.log) if o.log else logging.StreamHandler()
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    try:
        metrics = Metrics()
        metrics.label("job", job)
        for f in dataclasses.fields(o):
            metrics.label(f.name, str(getattr(o, f.name)))
        with metrics.timed("runtime"):
            with metrics.timed("preprocessing"):
                graph = prepared(spark, o.file, o.N)
            metrics.add("vertices", graph.n)
            metrics.add("edges", graph.counted[0])
            with metrics.timed("walks"):
                compute(graph, o).write.mode("overwrite").option("header", True).csv(f"{o.out}/result")
        found = spark.read.option("header", True).option("inferSchema", True).csv(f"{o.out}/result")
        if "cnt" in found.columns:
            top = analytics.top_k(found, o.ntop, by="source") if "source" in found.columns else analytics.top_k(found, o.ntop)
            top.write.mode("overwrite").option("header", True).csv(f"{o.out}/top")
        if getattr(o, "accurate", ""):
            error = analytics.relative_error(found, read_values(spark, o.accurate), o.ntop).first()["error"]
            metrics.add("error", error)
            append_measurement(spark, f"{o.out}/error", error=error)
        metrics.written(spark, f"{o.out}/metrics")
        log.info("%s ended after %.1f s", job, metrics.summary()["runtime"]["sum"])
        return found
    finally:
        log.removeHandler(handler)
        handler.close()


def main(args: list[str]) -> int:
    if not args or args[0] not in JOBS:
        print(f"{__doc__}\nJobs and their options:")
        for name, (kind, _) in JOBS.items():
            print(f"  {name}: " + ", ".join(f"{f.name}={f.default}" for f in dataclasses.fields(kind)))
        return 2
    spark = SparkSession.builder.appName(args[0]).getOrCreate()
    run(spark, args[0], args[1:]).show(20, False)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
