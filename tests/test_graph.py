"""Hand-made graphs, invariants, statistics and agreement with SQL."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from tests.oracle import same
from wanderframe import catalog, jobs
from wanderframe.functions import packing, rng
from wanderframe.operators import analytics, blocks, exact, kernels, seeds
from wanderframe.operators import graph as graph_module
from wanderframe.operators.graph import Graph
from wanderframe.operators.walker import visit_counts, visits, walk
from wanderframe.plans.metrics import Metrics
from wanderframe.plans.options import options, read_arguments, read_config
from wanderframe.sources import binary, edgelist
from wanderframe.streaming.edge_stream import streamed_degrees, streamed_edges

SF = "/root/testdata/sf0.001"


def graph(spark, edges, **kw):
    return Graph(spark.createDataFrame(edges, "src long, dst long"), **kw)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    same(catalog.queries()[name](spark, SF), catalog.oracle_sql()[name], SF)


def test_text_scan(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# c\n% c\n0 1\n0,2\n1\t2\n2 2\n2 0 0.5\n0 1\n5 0\n")
    g = Graph(edgelist.read_edge_list(spark, str(tmp_path / "e.txt")))
    assert rows(g.edges) == [(0, 1), (0, 1), (0, 2), (1, 2), (2, 0), (5, 0)] and g.n == 6
    assert rows(g.dead_ends()) == [(3,), (4,)]
    edgelist.write_edge_list(g.edges, str(tmp_path / "out"), 2)
    assert rows(edgelist.read_edge_list(spark, str(tmp_path / "out"))) == rows(g.edges)


@pytest.mark.parametrize("line", ["", "7", "a b"])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "e.txt").write_text(f"0 1\n{line}\n")
    with pytest.raises(Exception, match="not an edge"):
        edgelist.read_edge_list(spark, str(tmp_path / "e.txt")).collect()


def test_values_round_trip(spark, tmp_path):
    values = spark.createDataFrame([(1, 0.5), (2, 0.25)], "vertex long, value double")
    edgelist.write_values(values, str(tmp_path / "v"))
    assert rows(edgelist.read_values(spark, str(tmp_path / "v"))) == rows(values)
    for x in (1.0, 2.0):
        edgelist.append_measurement(spark, str(tmp_path / "log"), error=x)
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2


def test_self_edges_do_not_extend_the_graph_by_default(spark):
    assert graph(spark, [(0, 1), (9, 9)]).n == 2
    assert graph(spark, [(0, 1), (9, 9)], self_edges_count=True).n == 10


def test_empty_graph(spark):
    g = graph(spark, [])
    assert g.n == 0 and g.counted == (0, 0) and rows(analytics.domination(g)) == []


def test_draws_fit_32_bits_and_differ(spark):
    d = spark.range(100_000).select(rng.draw(F.col("id"), 3, rng.CONTINUE, 42).alias("x"))
    low, high, kinds, above = d.agg(F.min("x"), F.max("x"), F.countDistinct("x"), F.avg((F.col("x") > rng.STOP_BELOW).cast("int"))).first()
    assert 0 <= low and high < 1 << 32 and kinds > 99_990 and abs(above - 0.85) < 0.006


def test_packing_refuses_what_does_not_fit(spark):
    r = spark.range(1).select(packing.encode(F.lit(1 << 24), F.lit(0), F.lit(0)), packing.encode(F.lit(1), F.lit(2), F.lit(1 << 14))).first()
    assert tuple(r) == (None, None)


def test_toy_walks_decode(spark):
    words = spark.createDataFrame([(0,), (2,), (16384,), (16385,)], "w long")
    assert rows(words.select(packing.source_of(F.col("w")), packing.offset_of(F.col("w")), packing.hop_of(F.col("w")))) == [(0, 0, 0), (0, 0, 2), (0, 1, 0), (0, 1, 1)]


def test_steps_follow_edges(spark):
    edges = [(0, 1), (0, 3), (0, 4), (1, 2), (2, 0), (2, 6), (2, 7)]
    g = graph(spark, edges, n=10)
    for (_, source, path) in rows(walk(g, seeds.every_vertex(g, 20), kernels.stop, 6)):
        assert path[0] == source and all(e in edges for e in zip(path, path[1:]))
    for k in (kernels.jump, kernels.restart):
        assert {len(r["path"]) for r in walk(g, seeds.every_vertex(g, 5), k, 6).collect()} == {6}


def test_equal_results_for_any_partitioning(spark):
    g = graph(spark, [(i, (i * 7 + k) % 50) for i in range(50) for k in (1, 2, 5)])
    start = seeds.every_vertex(g, 3)
    assert rows(walk(g, start, kernels.jump, 5)) == rows(walk(g, start.repartition(7, "source"), kernels.jump, 5))


@pytest.mark.parametrize("kernel", sorted(kernels.KERNELS))
def test_joined_and_resident_walks_are_the_same(spark, kernel):
    edges = [(i, (i * 7 + k) % 40) for i in range(38) for k in (1, 2, 2, 5)]
    near, far, k = graph(spark, edges), graph(spark, edges), kernels.KERNELS[kernel]
    far.small = False
    start = seeds.source_range(spark, 30, 15, 4)  # some sources are no vertices
    if k.visits(7) is not None:
        assert rows(walk(near, start, k, 7, 3)) == rows(walk(far, start, k, 7, 3))
    for by in (("vertex",), ("source", "vertex")):
        assert rows(visit_counts(near, start, k, 7, 3, by)) == rows(visit_counts(far, start, k, 7, 3, by))


@pytest.mark.parametrize("chunk", [2, 3])
def test_hubs_walk_as_others(spark, chunk, monkeypatch):
    edges = [(0, k) for k in range(1, 12)] + [(k, 0) for k in range(1, 12)] + [(0, 5)]
    plain = graph(spark, edges)
    want = rows(walk(plain, seeds.every_vertex(plain, 10), kernels.jump, 6))
    import wanderframe.operators.walker as walker
    monkeypatch.setattr(graph_module, "CHUNK", chunk)
    monkeypatch.setattr(walker, "CHUNK", chunk)
    hub = graph(spark, edges)
    hub.small = False
    assert hub.has_hubs and rows(walk(hub, seeds.every_vertex(hub, 10), kernels.jump, 6)) == want


def test_long_walks_count_like_short_ones(spark):
    g = graph(spark, [(i, (i + k) % 30) for i in range(29) for k in (1, 3)])
    large = graph(spark, [(i, (i + k) % 30) for i in range(29) for k in (1, 3)])
    large.small = False  # its steps shuffle
    for k in (kernels.jump, kernels.stop, kernels.simple):
        start = seeds.every_vertex(g, 2)
        short = visits(walk(g, start, k, 25)).groupBy("vertex").count()
        assert rows(visit_counts(g, start, k, 25)) == rows(short)
        assert rows(visit_counts(large, start, k, 12)) == rows(visits(walk(g, start, k, 12)).groupBy("vertex").count())


def test_cycle_closes(spark):
    g = graph(spark, [(0, 1), (1, 2), (2, 0)])
    closed, walks, ratio = analytics.graphlet(g, 20000, 4).first()
    assert walks == 20000 and abs(ratio - 0.614125) < 4 * math.sqrt(0.614 * 0.386 / 20000)
    assert exact.graphlet_ratio(g).first()[0] == pytest.approx(0.614125)


def test_dead_end_is_visited_at_most_once(spark):
    g = graph(spark, [(0, 1)])
    seen = visits(walk(g, seeds.single(spark, 0, 500), kernels.stop, 10)).filter("vertex = 1").groupBy("walk_id").count()
    assert seen.agg(F.max("count")).first()[0] == 1


def test_simrank(spark):
    g = graph(spark, [(0, 2), (1, 2)])
    assert exact.simrank(g, 0, 1, 3).first()[0] == pytest.approx(0.578)
    assert abs(analytics.simrank(g, 0, 1, 400, 3).first()["score"] - 0.578) < 0.06
    assert analytics.simrank(g, 1, 1).first()["score"] == 1.0


def test_restart_joint_records_one_visit_less(spark):
    g = graph(spark, [(0, 1), (1, 0)])
    assert {len(r["path"]) for r in walk(g, seeds.single(spark, 0, 5), kernels.restart_joint, 4).collect()} == {3}
    assert {len(r["path"]) for r in walk(g, seeds.single(spark, 0, 5), kernels.restart_joint, 1).collect()} == {1}


@pytest.mark.parametrize("kernel", ["stop", "jump", "simple"])
def test_samples_agree_with_expectation(spark, kernel):
    g = graph(spark, [(i, (i * 3 + k) % 20) for i in range(18) for k in (1, 4)], n=20)
    walks = 2000
    want = dict(rows(exact.expected_visits(g, g.vertices().select(F.col("id").alias("vertex"), F.lit(float(walks)).alias("e")), kernel, 5)))
    got = dict(rows(analytics.visit_counts(g, seeds.every_vertex(g, walks), kernels.KERNELS[kernel], 5)))
    assert all(abs(got.get(v, 0) - e) < 6 * math.sqrt(5 * e) + 1 for v, e in want.items())


def test_reachability(spark):
    g = graph(spark, [(0, 1), (1, 2), (3, 0)])
    for small in (True, False):
        g.small = small
        assert analytics.reachability(g, 0, 2, 100, 20).first()[0] and not analytics.reachability(g, 0, 3, 100, 20).first()[0]
    assert rows(exact.bfs(g, 0)) == [(0, 0), (1, 1), (2, 2)]


def test_top_k_breaks_ties_by_vertex(spark):
    c = spark.createDataFrame([(1, 5), (0, 5), (2, 9)], "vertex long, cnt long")
    assert [r["vertex"] for r in analytics.top_k(c, 2).collect()] == [2, 0]
    assert rows(analytics.approximate_top_k(spark.createDataFrame([(1,), (1,), (2,)], "vertex long"), 1)) == [(1, 2)]


def test_greedy_blocks_isolate_a_large_vertex(spark):
    edges = [(0, 1), (1, 0), (2, 0), (2, 1), (2, 3), (2, 4), (2, 5), (3, 1), (4, 1), (5, 1)]
    for small in (True, False):
        g = graph(spark, edges)
        g.small = small
        assert rows(blocks.greedy_blocks(g, 3)) == [(0, 1, 2), (2, 2, 5), (3, 5, 3)]


def test_greedy_blocks_are_the_same_either_way(spark):
    edges = [(i, (i + k) % 200) for i in range(200) if i % 7 for k in range(1, 2 + i % 5)]
    near, far = graph(spark, edges), graph(spark, edges)
    far.small = False
    for most in (1, 10, 1000):
        assert rows(blocks.greedy_blocks(near, most)) == rows(blocks.greedy_blocks(far, most))


def test_prob_walks_end(spark):
    g = graph(spark, [(0, 1), (1, 0)])
    seen = analytics.unbounded_ppr(g, 0, 1, 2000)
    assert abs(sum(r["cnt"] for r in seen.collect()) / 2000 - 1 / 0.15) < 0.6
    with pytest.raises(ValueError, match="no limit"):
        walk(g, seeds.single(spark, 0, 1), kernels.prob, 5)


def test_saved_graphs_open_without_work(spark, tmp_path, monkeypatch):
    edges = [(0, k) for k in range(1, 9)] + [(k, 0) for k in range(1, 9)]
    made = graph(spark, edges, n=12)
    g = made.saved(str(tmp_path / "g"))
    assert (g.n, g.counted) == (12, (16, 8)) and rows(g.adjacency) == rows(made.adjacency)
    assert rows(walk(g, seeds.every_vertex(g, 2), kernels.jump, 4)) == rows(walk(made, seeds.every_vertex(made, 2), kernels.jump, 4))
    monkeypatch.setattr(graph_module, "CHUNK", 2)
    with pytest.raises(ValueError, match="save the graph anew"):
        Graph.opened(spark, str(tmp_path / "g"))


def test_id_ranges_are_pushed_to_the_scan(spark):
    g = graph(spark, [(i, (i + 1) % 500) for i in range(500)])
    g.small = False
    some = g.of_range(100, 120)
    assert [r[0] for r in rows(some)] == list(range(100, 121))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(src,100)" in plan and "LessThanOrEqual(src,120)" in plan


def test_blocks_of_positions(spark):
    blocks_ = spark.createDataFrame([(0, 1), (2, 2), (3, 40)], "first long, last long")
    at = spark.createDataFrame([(1, 0), (2, 2), (3, 39), (4, 17)], "walk_id long, current long")
    assert rows(blocks.block_of(at, blocks_, 16)) == [(1, 0, 0), (2, 2, 2), (3, 39, 3), (4, 17, 3)]


def test_utilisation_and_constant():
    assert analytics.constant_error(13.5988 * 2) == pytest.approx(1.0)


def test_options_and_metrics():
    from dataclasses import dataclass

    @dataclass
    class Job:
        walks: int = 1
        prob: float = 0.2
        file: str = ""

    assert options(Job, "walks = 7 # c\nfile=a", ["--prob=0.5", "walks", "9"]) == Job(9, 0.5, "a")
    assert read_config("\n# x\n") == {} and read_arguments(["--a", "b"]) == {"a": "b"}
    for bad in ((Job, "nothing"), (Job, "", ["--unknown=1"])):
        with pytest.raises(ValueError):
            options(*bad)
    m = Metrics()
    with m.timed("t"):
        m.add("x", 2)
    m.label("app", "walks")
    assert m.summary()["x"]["sum"] == 2 and "walks" in m.as_json() and "app: walks" in m.as_text()


def test_streamed_degrees(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("0 1\n0 2\n# c\n")
    (folder / "b.txt").write_text("0 3\n1 1\n2 0\n")
    q = streamed_degrees(streamed_edges(spark, str(folder), 1)).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    try:
        q.processAllAvailable()
        assert rows(spark.table("degrees")) == [(0, 3), (2, 1)]
    finally:
        q.stop()


def test_kernels_and_consumers_of_ones_own(spark):
    """A kernel that goes to vertex 0 where it follows no edge, and a consumer that takes the last vertex of each walk."""
    home = kernels.Kernel("home", lambda source, target: F.lit(0).cast("long"), None)
    g = graph(spark, [(0, 1), (1, 2), (2, 3)])
    paths = walk(g, seeds.every_vertex(g, 50), home, 6)
    assert not home.resident and {len(r["path"]) for r in paths.collect()} == {6}
    ends = dict(rows(visits(paths).filter("hop = 5").groupBy("vertex").count()))
    assert sum(ends.values()) == 200 and ends[0] > 20
    counts = dict(rows(visit_counts(g, seeds.every_vertex(g, 50), home, 6)))
    assert counts == dict(rows(visits(paths).groupBy("vertex").count()))


@pytest.mark.parametrize("job", sorted(jobs.JOBS))
def test_jobs_run_from_an_edge_file(spark, tmp_path, job):
    (tmp_path / "e.txt").write_text("# c\n" + "".join(f"{i}\t{(i * 3 + k) % 30}\n" for i in range(29) for k in (1, 4)))
    (tmp_path / "conf").write_text("R = 20 # few\n" if hasattr(jobs.JOBS[job][0], "R") else "walkspersource=20\n")
    given = [f"file={tmp_path}/e.txt", "--out", f"{tmp_path}/out", f"--config={tmp_path}/conf", f"log={tmp_path}/log"]
    found = jobs.run(spark, job, given)
    assert found.count() > 0
    jobs.run(spark, job, given)
    said = (tmp_path / "log").read_text()
    assert said.count("preparing") == 1 and said.count("opened") == 1 and said.count("ended after") == 2
    assert f"job: {job}" in "".join(r[0] + "\n" for r in spark.read.text(f"{tmp_path}/out/metrics/text").collect())
    if "cnt" in found.columns:
        assert 0 < spark.read.option("header", True).csv(f"{tmp_path}/out/top").count() <= 20


def test_jobs_measure_errors_and_mend_unfinished_graphs(spark, tmp_path):
    (tmp_path / "e.txt").write_text("0 1\n1 0\n1 2\n2 0\n")
    (tmp_path / "accurate").write_text("0 0.4\n1 0.4\n2 0.2\n")
    (tmp_path / "e.txt_graph").mkdir()
    jobs.run(spark, "pagerank", [f"file={tmp_path}/e.txt", f"out={tmp_path}/out", f"accurate={tmp_path}/accurate", "R=200", f"log={tmp_path}/log"])
    assert "removed the unfinished" in (tmp_path / "log").read_text()
    assert 0 < float(spark.read.option("header", True).csv(f"{tmp_path}/out/error").first()["error"]) < 0.5
    with pytest.raises(ValueError, match="file and out"):
        jobs.run(spark, "pagerank", [])
    assert jobs.main(["nothing"]) == 2


@pytest.mark.parametrize("stride", [2, 1 << 14])
def test_binary_files(spark, tmp_path, stride):
    (tmp_path / "beg_pos").write_bytes(struct.pack("<11Q", 0, 3, 4, 7, 7, 7, 7, 7, 7, 7, 7))
    (tmp_path / "csr").write_bytes(struct.pack("<7I", 1, 3, 4, 2, 0, 6, 7))
    assert rows(binary.read_csr(spark, str(tmp_path / "beg_pos"), str(tmp_path / "csr"), stride)) == [(0, 1), (0, 3), (0, 4), (1, 2), (2, 0), (2, 6), (2, 7)]
    (tmp_path / "v").write_bytes(struct.pack("<3f", 0.5, 0.25, 4))
    assert rows(binary.read_vertex_values(spark, str(tmp_path / "v"), binary.FLOAT)) == [(0, 0.5), (1, 0.25), (2, 4.0)]
    (tmp_path / "c").write_bytes(struct.pack("<2I", 7, 4_000_000_000))
    assert rows(binary.read_vertex_values(spark, str(tmp_path / "c"))) == [(0, 7), (1, 4_000_000_000)]
