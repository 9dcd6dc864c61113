"""The graph queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import packing, rng
from .operators import analytics, blocks, exact, kernels, seeds
from .operators.graph import Graph
from .operators.walker import alive_by_hop, step, visit_counts, visits, walk
from .plans import walk_sql as Q
from .sources.edgelist import parse_lines

SEED = 42
#: A hand-made graph of ten vertices.
TOY = ((0, 1), (0, 3), (0, 4), (1, 2), (2, 0), (2, 6), (2, 7))
#: Vertices that approx_topk tracks: more than the tables here have, so its counts are exact. Which of several vertices
#: with one count it names is open, so the query gives ranks and counts.
TRACKED = 60_000
LINES = ("# c", "% c", "0 1", "0,2", "1\t2", "2 2", "2 0 0.5", "0 1", "5 0", " 3,, 4")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def graph_of(spark: SparkSession, sf_dir: str, name: str = "g_part") -> Graph:
    """Graphs over the tables, for the queries."""
    item = _table(spark, sf_dir, "lineitem")
    if name == "g_cust_supp":
        customers = _table(spark, sf_dir, "customer").count()
        orders = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("src"))
        return Graph(orders.join(item.select("l_orderkey", (F.col("l_suppkey") + customers).alias("dst")), F.col("o_orderkey") == F.col("l_orderkey")))
    a = item.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("src"), "l_returnflag")
    if name == "g_part_returns":
        a = a.filter("l_returnflag = 'R'")
    b = item.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("dst"))
    return Graph(a.join(b, ["l_orderkey", "line"]).select("src", "dst"))


def _lines(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in LINES])).alias("value"))


def _on(name: str, query: Callable[[Graph], DataFrame]):
    """A query over one of the graphs, which is built once for it."""
    return lambda spark, sf_dir: query(graph_of(spark, sf_dir, name))


def _one_step(kernel: kernels.Kernel):
    def query(g: Graph) -> DataFrame:
        start = seeds.every_vertex(g, 2).withColumn("current", F.col("source"))
        return step(g, start, kernel, 0, SEED).select("walk_id", "source", F.coalesce("current", F.lit(-1)).alias("next"))

    return query


def _positions(g: Graph) -> DataFrame:
    """Where walks of three hops end, with the next hop."""
    at = visits(walk(g, seeds.every_vertex(g, 1), kernels.stop, 3, SEED)).groupBy("walk_id").agg(F.max("hop").alias("hop"), F.max_by("vertex", "hop").alias("current"))
    return at.select("walk_id", "current", (F.col("hop") + 1).alias("hop"))


def _state(g: Graph) -> DataFrame:
    """The state of blocks of 64 vertices."""
    return blocks.block_state(_positions(g).select(F.expr("current div 64").alias("block"), "hop"))


def _located(g: Graph) -> DataFrame:
    """How many walks are in each greedy block."""
    return blocks.block_of(_positions(g), blocks.greedy_blocks(g, 1000), 256).groupBy("block").agg(F.count(F.lit(1)).alias("walks"))


def _accurate(g: Graph) -> DataFrame:
    """Degree shares as values to measure an error against."""
    total = g.counted[0]
    return g.in_degrees().select(F.col("dst").alias("vertex"), (F.col("ind") / total).alias("value"))


def _utilisation(g: Graph) -> DataFrame:
    used = visits(walk(g, seeds.every_vertex(g, 1), kernels.stop, 3, SEED)).groupBy(F.expr("vertex div 64").alias("block")).agg(F.count(F.lit(1)).alias("used"))
    return analytics.utilisation(used, g.degrees.groupBy(F.expr("src div 64").alias("block")).agg(F.sum("outd").alias("loaded")), "block")


def _ones(g: Graph) -> DataFrame:
    return g.vertices().select(F.col("id").alias("vertex"), F.lit(1.0).alias("e"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    part, returns, bipartite = "g_part", "g_part_returns", "g_cust_supp"
    col = F.col
    return {
        "edges_clean": _on(part, lambda g: g.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("copies"))),
        "vertex_count": _on(part, lambda g: g.spark.range(1).select(F.lit(g.n).cast("long").alias("n"))),
        "out_degree": _on(returns, lambda g: g.all_degrees().select(col("id").alias("vertex"), "outd")),
        "in_degree": _on(part, lambda g: g.in_degrees().select(col("dst").alias("vertex"), "ind")),
        "degree_histogram": _on(returns, lambda g: g.degree_histogram()),
        "dead_ends": _on(bipartite, lambda g: g.dead_ends().select(col("id").alias("vertex"))),
        "adjacency_stats": _on(part, lambda g: g.adjacency.select("src", "outd", F.element_at("nbrs", 1).alias("least"), F.element_at("nbrs", -1).alias("greatest"), F.size(F.array_distinct("nbrs")).cast("long").alias("distinct_nbrs"))),
        "adjacency_range": _on(part, lambda g: g.of_range(50, 149).select("src", "outd", F.array_join("nbrs", ",").alias("nbrs"))),
        "numbered_edges": _on(part, lambda g: g.numbered_edges().select("src", col("idx").cast("long").alias("idx"), "dst")),
        "edgelist_text_scan": lambda s, d: parse_lines(_lines(s)),
        "toy_walks": lambda s, d: visits(walk(Graph(s.createDataFrame(TOY, "src long, dst long"), n=10), seeds.source_range(s, 0, 10, 5), kernels.simple, 6, SEED)).select("walk_id", col("hop").cast("long").alias("hop"), "vertex"),
        "begin_positions": _on(returns, lambda g: blocks.begin_positions(g).select("id", "outd", col("begin").cast("long").alias("begin"))),
        "block_partition_equal": _on(part, lambda g: blocks.equal_blocks(g, 4)),
        "block_partition_greedy": _on(part, lambda g: blocks.greedy_blocks(g, 1000).select("first", "last", col("edges").cast("long").alias("edges"))),
        "block_location": _on(part, _located),
        "block_size": lambda s, d: s.range(0, 2_000_000, 100_000).select("id", blocks.block_kilobytes(col("id")).alias("kilobytes")),
        "cached_blocks": lambda s, d: s.createDataFrame([(k, blocks.cached_blocks(k)) for k in (2048, 8192, 1 << 20)], "kilobytes long, blocks long"),
        "block_state": _on(returns, _state),
        "block_schedule": _on(returns, lambda g: blocks.next_blocks(_state(g))),
        "block_choice": _on(returns, lambda g: reduce(DataFrame.unionByName, [blocks.chosen_block(_state(g), 4, draw).select(F.lit(draw).cast("long").alias("draw"), "random_block", "chosen") for draw in (5, 2_000_000_003)])),
        "walk_encode_decode": lambda s, d: s.range(0, 1 << 14, 7).select("id", packing.encode(col("id") * 511, col("id") * 4093, col("id")).alias("packed")).select(
            "id", "packed", packing.source_of(col("packed")).alias("source"), packing.offset_of(col("packed")).alias("in_block"), packing.hop_of(col("packed")).alias("hop")),
        "seed_uniform": _on(part, lambda g: seeds.uniform(g, 1000, SEED)),
        "seed_all": _on(part, lambda g: seeds.every_vertex(g, 2)),
        "seed_range": lambda s, d: seeds.source_range(s, 5, 7, 11).withColumn("source_index", col("source") - 5),
        "seed_pair": lambda s, d: seeds.pair(s, 1, 2, 50),
        **{f"step_{k}": _on(returns, _one_step(kernels.KERNELS[k])) for k in ("jump", "stop", "restart", "simple")},
        "raw_walks_total": _on(part, lambda g: visits(analytics.raw_walks(g, 10000, 4, SEED)).agg(F.count(F.lit(1)).alias("visits"), F.sum("vertex").alias("vertex_sum"))),
        "walk_trace_by_hop": _on(returns, lambda g: alive_by_hop(walk(g, seeds.every_vertex(g, 2), kernels.stop, 10, SEED)).select(col("hop").cast("long").alias("hop"), "walks")),
        "rwdomination_counts": _on(part, lambda g: analytics.domination(g, 1, 6, SEED)),
        "rwdomination_topk": _on(returns, lambda g: analytics.top_k(analytics.domination(g, 2, 6, SEED), 20)),
        "msppr_counts": _on(part, lambda g: analytics.multi_source_ppr(g, 0, 10, 500, 10, SEED)),
        "msppr_top20": _on(part, lambda g: analytics.top_k(analytics.multi_source_ppr(g, 0, 10, 500, 10, SEED), 20, by="source").select("source", "vertex", "cnt", col("rank").cast("long").alias("rank"))),
        "ppr_restart_counts": _on(returns, lambda g: analytics.personalized_pagerank(g, 3, 2000, 10, SEED)),
        "rwr_visits": _on(returns, lambda g: visits(analytics.restarting_walks(g, 3, 5000, 4, SEED)).groupBy("hop", "vertex").agg(F.count(F.lit(1)).alias("cnt")).withColumn("hop", col("hop").cast("long"))),
        "kk_ppr_counts": _on(part, lambda g: analytics.unbounded_ppr(g, 0, 100, 5, SEED)),
        "kk_ppr_top20": _on(part, lambda g: analytics.top_k(analytics.unbounded_ppr(g, 0, 100, 5, SEED), 20, by="source").select("source", "vertex", "cnt", col("rank").cast("long").alias("rank"))),
        "pagerank_prob": _on(returns, lambda g: analytics.pagerank(g, seed=SEED).withColumn("prob", F.round("prob", 12))),
        "pagerank_error": _on(part, lambda g: analytics.relative_error(analytics.pagerank(g, seed=SEED), _accurate(g)).select(F.round("error", 9).alias("error"))),
        "graphlet_ratio": _on(returns, lambda g: analytics.graphlet(g, seed=SEED)),
        "graphlet_exact": _on(part, exact.graphlet_ratio),
        "simrank_mc": _on(part, lambda g: analytics.simrank(g, 1, 2, seed=SEED)),
        "simrank_exact_small": _on(part, lambda g: exact.simrank(g, 1, 2, 4)),
        "reachability_mc": _on(part, lambda g: analytics.reachability(g, 1, 2, seed=SEED)),
        "reachability_bfs": _on(returns, lambda g: exact.bfs(g, 1).select("vertex", col("distance").cast("long").alias("distance"))),
        "avgdegree_harmonic": _on(returns, lambda g: analytics.average_degree(g, seed=SEED)),
        "domination_expected": _on(returns, lambda g: exact.expected_visits(g, _ones(g), "jump", 6)),
        "ppr_expected": _on(returns, lambda g: exact.expected_visits(g, g.spark.range(1).select(F.lit(3).cast("long").alias("vertex"), F.lit(2000.0).alias("e")), "restart", 10, 3)),
        "stop_expected": _on(returns, lambda g: exact.expected_visits(g, _ones(g), "stop", 4)),
        "approx_topk": _on(part, lambda g: analytics.approximate_top_k(visits(analytics.raw_walks(g, 10000, 4, SEED)), 20, TRACKED).select(F.row_number().over(Window.orderBy(F.desc("cnt"))).cast("long").alias("rank"), "cnt")),
        "long_walk_counts": _on(returns, lambda g: visit_counts(g, seeds.uniform(g, 300, SEED), kernels.jump, 24, SEED)),
        "utilisation": _on(part, _utilisation),
    }


def _expected_sql(kernel: str, length: int, start: str, source: int = 0) -> str:
    ctes = [f"e0 AS MATERIALIZED ({start})"]
    for h in range(length - 1):
        share = 1.0 if kernel == "simple" else 0.85
        moved = f"SELECT p.dst AS vertex, e * p.p * {share} AS e FROM e{h} JOIN p ON vertex = p.src"
        lost = f"(SELECT sum(CASE WHEN outd IS NULL THEN e ELSE 0.15 * e END) FROM e{h} LEFT JOIN adj ON vertex = src)"
        if kernel == "jump":
            moved += f" UNION ALL SELECT id, {lost} / (SELECT n FROM sz) FROM vertices"
        if kernel == "restart":
            moved += f" UNION ALL SELECT {source}, {lost}"
        ctes.append(f"e{h + 1} AS MATERIALIZED (SELECT vertex, sum(e) AS e FROM ({moved}) GROUP BY vertex)")
    union = " UNION ALL ".join(f"SELECT * FROM e{h}" for h in range(length))
    return f"WITH {Q.graph_ctes('g_part_returns')}, p AS (SELECT src, dst, count(*)::DOUBLE / any_value(outd) AS p FROM edges JOIN adj USING (src) GROUP BY src, dst), {', '.join(ctes)} SELECT vertex, round(sum(e), 6) AS expected FROM ({union}) GROUP BY vertex"


def oracle_sql() -> dict[str, str]:
    R, K = "g_part_returns", kernels
    g = lambda name, select: f"WITH {Q.graph_ctes(name)} {select}"
    counts = "SELECT vertex, count(*) AS cnt FROM visits GROUP BY vertex"
    by_source = "SELECT source, vertex, count(*) AS cnt FROM visits GROUP BY source, vertex"
    one = lambda k: Q.walked(R, Q.seeds_every(2), k, 2 if k is not K.restart_joint else 3, SEED, 'SELECT walk_id, source, coalesce(current, -1) AS "next" FROM w1')
    begins = "SELECT id, coalesce(outd, 0) AS outd, coalesce(sum(coalesce(outd, 0)) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin FROM vertices LEFT JOIN adj ON id = src"
    greedy = f"""bp AS MATERIALIZED (SELECT id, begin FROM ({begins}) UNION ALL SELECT n, (SELECT count(*) FROM edges) FROM sz),
ch AS (WITH RECURSIVE c(s) AS (SELECT 0::BIGINT UNION ALL SELECT greatest(c.s + 1, (SELECT max(b.id) FROM bp b WHERE b.begin - a.begin <= 1000)) FROM c JOIN bp a ON a.id = c.s WHERE c.s < (SELECT n FROM sz)) SELECT s FROM c),
gb AS MATERIALIZED (SELECT s AS first, lead(s) OVER (ORDER BY s) - 1 AS last, (lead(b.begin) OVER (ORDER BY s) - b.begin)::BIGINT AS edges FROM ch JOIN bp b ON b.id = s QUALIFY lead(s) OVER (ORDER BY s) IS NOT NULL)"""
    state = Q.walked(R, Q.seeds_every(1), K.stop, 3, SEED, "").rstrip() + """,
st AS (SELECT max(hop) + 1 AS hop, arg_max(vertex, hop) // 64 AS block FROM visits GROUP BY walk_id),
bs AS (SELECT block, count(*) AS walks, min(hop) AS min_hop FROM st GROUP BY block)"""
    chain = "p AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE / any_value(outd) AS p FROM edges JOIN adj USING (src) GROUP BY src, dst)"
    side = lambda home: f"(SELECT src, dst, 0.85 * p AS q FROM p UNION ALL SELECT id, {home}, CASE WHEN outd IS NULL THEN 1.0 ELSE 0.15 END FROM vertices LEFT JOIN adj ON id = src)"
    pairs = ["s0 AS (SELECT 1::BIGINT AS x, 2::BIGINT AS y, 1.0::DOUBLE AS w)"] + [
        f"s{h + 1} AS MATERIALIZED (SELECT a.dst AS x, b.dst AS y, sum(w * a.q * b.q) AS w FROM s{h} JOIN ta a ON a.src = x JOIN tb b ON b.src = y WHERE x <> y GROUP BY 1, 2)" for h in range(2)]
    lines = " UNION ALL ".join(f"SELECT '{x}' AS l" for x in LINES)
    return {
        "edges_clean": g("g_part", "SELECT src, dst, count(*) AS copies FROM edges GROUP BY src, dst"),
        "vertex_count": g("g_part", "SELECT n FROM sz"),
        "out_degree": g(R, "SELECT id AS vertex, coalesce(outd, 0) AS outd FROM vertices LEFT JOIN adj ON id = src"),
        "in_degree": g("g_part", "SELECT dst AS vertex, count(*) AS ind FROM edges GROUP BY dst"),
        "degree_histogram": g(R, "SELECT coalesce(outd, 0) AS outd, count(*) AS vertices FROM vertices LEFT JOIN adj ON id = src GROUP BY 1"),
        "dead_ends": g("g_cust_supp", "SELECT id AS vertex FROM vertices WHERE id NOT IN (SELECT src FROM edges)"),
        "adjacency_stats": g("g_part", "SELECT src, outd, nbrs[1] AS least, nbrs[-1] AS greatest, len(list_distinct(nbrs))::BIGINT AS distinct_nbrs FROM adj"),
        "adjacency_range": g("g_part", "SELECT src, outd, array_to_string(nbrs, ',') AS nbrs FROM adj WHERE src BETWEEN 50 AND 149"),
        "toy_walks": Q.walked("toy", Q.seeds_range(0, 10, 5), K.simple, 6, SEED, "SELECT walk_id, hop::BIGINT AS hop, vertex FROM visits"),
        "cached_blocks": "SELECT k::BIGINT AS kilobytes, ((44 << 20) // k)::BIGINT AS blocks FROM (VALUES (2048), (8192), (1 << 20)) t(k)",
        "numbered_edges": g("g_part", "SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS idx, dst FROM edges"),
        "edgelist_text_scan": f"WITH t AS ({lines}), p AS (SELECT list_filter(string_split_regex(l, '[\\t, ]+'), lambda x: x <> '') AS f FROM t WHERE NOT regexp_matches(l, '^[#%]')) SELECT f[1]::BIGINT AS src, f[2]::BIGINT AS dst FROM p WHERE f[1] <> f[2]",
        "begin_positions": g(R, begins),
        "block_partition_equal": g("g_part", f"SELECT begin // 1024 AS block, min(id) AS first, max(id) AS last, sum(outd)::BIGINT AS edges FROM ({begins}) GROUP BY 1"),
        "block_partition_greedy": f"WITH {Q.graph_ctes('g_part')}, {greedy} SELECT * FROM gb",
        "block_location": Q.walked("g_part", Q.seeds_every(1), K.stop, 3, SEED, f""", {greedy}, spot AS (SELECT arg_max(vertex, hop) AS v FROM visits GROUP BY walk_id)
SELECT "first" AS block, count(*) AS walks FROM spot JOIN gb ON v BETWEEN "first" AND "last" GROUP BY 1""").replace(")\n,", "),\n"),
        "block_size": "SELECT id, pow(2, 11 + CASE WHEN id = 0 THEN 0 ELSE length(id::VARCHAR) END)::BIGINT AS kilobytes FROM (SELECT unnest(range(0, 2000000, 100000)) AS id)",
        "block_state": state + " SELECT block, walks, min_hop FROM bs",
        "block_choice": state + """ SELECT draw, draw % 4 AS random_block, CASE WHEN draw < 0.2 * 4294967296 THEN (SELECT block FROM bs ORDER BY min_hop, block LIMIT 1) ELSE (SELECT block FROM bs ORDER BY walks DESC, block LIMIT 1) END AS chosen
FROM (VALUES (5::BIGINT), (2000000003::BIGINT)) t(draw)""",
        "block_schedule": state + " SELECT (SELECT block FROM bs ORDER BY walks DESC, block LIMIT 1) AS max_walks, (SELECT block FROM bs ORDER BY min_hop, block LIMIT 1) AS min_step, (SELECT block FROM bs ORDER BY walks / min_hop DESC, block LIMIT 1) AS max_weight",
        "walk_encode_decode": "SELECT id, ((id * 511) << 40) | ((id * 4093) << 14) | id AS packed, id * 511 AS source, id * 4093 AS in_block, id AS hop FROM (SELECT unnest(range(0, 16384, 7)) AS id)",
        "seed_uniform": g("g_part", Q.seeds_uniform(1000, SEED)),
        "seed_all": g("g_part", Q.seeds_every(2)),
        "seed_range": f"SELECT *, source - 5 AS source_index FROM ({Q.seeds_range(5, 7, 11)})",
        "seed_pair": f"SELECT *, (walk_id // 50)::INTEGER AS side, walk_id % 50 AS walk_no FROM ({Q.seeds_pair(1, 2, 50)})",
        **{f"step_{k}": one(K.KERNELS[k]) for k in ("jump", "stop", "restart", "simple")},
        "raw_walks_total": Q.walked("g_part", Q.seeds_uniform(10000, SEED), K.jump, 4, SEED, "SELECT count(*) AS visits, sum(vertex)::BIGINT AS vertex_sum FROM visits"),
        "walk_trace_by_hop": Q.walked(R, Q.seeds_every(2), K.stop, 10, SEED, "SELECT hop::BIGINT AS hop, count(*) AS walks FROM visits GROUP BY hop"),
        "rwdomination_counts": Q.walked("g_part", Q.seeds_every(1), K.jump, 6, SEED, counts),
        "rwdomination_topk": Q.walked(R, Q.seeds_every(2), K.jump, 6, SEED, counts + " ORDER BY cnt DESC, vertex LIMIT 20"),
        "msppr_counts": Q.walked("g_part", Q.seeds_range(0, 10, 500), K.stop, 10, SEED, by_source),
        "msppr_top20": Q.walked("g_part", Q.seeds_range(0, 10, 500), K.stop, 10, SEED, f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, vertex) AS rank FROM ({by_source}) QUALIFY rank <= 20"),
        "ppr_restart_counts": Q.walked(R, Q.seeds_range(3, 1, 2000), K.restart, 10, SEED, counts),
        "rwr_visits": Q.walked(R, Q.seeds_range(3, 1, 5000), K.restart, 4, SEED, "SELECT hop::BIGINT AS hop, vertex, count(*) AS cnt FROM visits GROUP BY hop, vertex"),
        "kk_ppr_counts": Q.recursive_walked("g_part", Q.seeds_range(0, 100, 5), K.prob, None, SEED, by_source),
        "kk_ppr_top20": Q.recursive_walked("g_part", Q.seeds_range(0, 100, 5), K.prob, None, SEED, f"SELECT *, row_number() OVER (PARTITION BY source ORDER BY cnt DESC, vertex) AS rank FROM ({by_source}) QUALIFY rank <= 20"),
        "pagerank_prob": Q.walked(R, Q.seeds_every(1), K.jump, 20, SEED, f"SELECT vertex, cnt, round(cnt / sum(cnt) OVER (), 12) AS prob FROM ({counts})"),
        "pagerank_error": Q.walked("g_part", Q.seeds_every(1), K.jump, 20, SEED, f""", c AS (SELECT vertex, cnt / sum(cnt) OVER () AS prob FROM ({counts})),
acc AS (SELECT dst AS vertex, count(*) / (SELECT count(*) FROM edges) AS value FROM edges GROUP BY dst ORDER BY value DESC, vertex LIMIT 20)
SELECT round(avg(abs(coalesce(prob, 0) - value) / value), 9) AS error FROM acc LEFT JOIN c USING (vertex)""").replace(")\n, c AS", "),\nc AS"),
        "graphlet_ratio": Q.walked(R, Q.seeds_uniform(100000, SEED), K.stop, 4, SEED, "SELECT count(*) FILTER (WHERE hop = 3 AND vertex = source) AS closed, 100000::BIGINT AS walks, count(*) FILTER (WHERE hop = 3 AND vertex = source) / 100000 AS ratio FROM visits"),
        "graphlet_exact": f"WITH {Q.graph_ctes('g_part')}, {chain} SELECT round(coalesce(sum(a.p * b.p * c.p), 0) * 0.614125 / (SELECT n FROM sz), 9) AS expected FROM p a JOIN p b ON a.dst = b.src JOIN p c ON b.dst = c.src AND c.dst = a.src",
        "simrank_mc": Q.walked("g_part", Q.seeds_pair(1, 2, 1000), K.restart_joint, 11, SEED, """, f AS (SELECT a.walk_id AS i, b.walk_id AS j, min(a.hop) AS l FROM visits a JOIN visits b ON a.hop = b.hop AND a.vertex = b.vertex WHERE a.walk_id < 1000 AND b.walk_id >= 1000 GROUP BY 1, 2)
SELECT count(*) AS met, round(coalesce(sum(pow(0.8, l)), 0) / 1000000, 9) AS score FROM f""").replace(")\n, f AS", "),\nf AS"),
        "simrank_exact_small": f"WITH {Q.graph_ctes('g_part')}, {chain}, ta AS ({side(1)}), tb AS ({side(2)}), {', '.join(pairs)} SELECT round(coalesce(sum(v), 0), 9) AS expected FROM ({' UNION ALL '.join(f'SELECT w * pow(0.8, {h}) AS v FROM s{h} WHERE x = y' for h in range(3))})",
        "reachability_mc": Q.recursive_walked("g_part", Q.seeds_range(1, 1, 1000), K.restart, 100, SEED, "SELECT coalesce(bool_or(vertex = 2), false) AS reached FROM visits"),
        "reachability_bfs": f"""WITH RECURSIVE {Q.graph_ctes(R)}, r(vertex, distance) USING KEY (vertex) AS (SELECT 1::BIGINT, 0::BIGINT UNION
SELECT dst, min(distance) + 1 FROM r JOIN edges ON src = r.vertex WHERE dst NOT IN (SELECT vertex FROM recurring.r) GROUP BY dst) SELECT vertex, distance FROM r""",
        "avgdegree_harmonic": Q.recursive_walked(R, Q.seeds_uniform(1000, SEED), K.simple, 1000, SEED, "SELECT count(*) AS samples, round(count(*) / sum(1.0::DOUBLE / outd), 6) AS avg_degree FROM visits JOIN adj ON vertex = src"),
        "domination_expected": _expected_sql("jump", 6, "SELECT id AS vertex, 1.0::DOUBLE AS e FROM vertices"),
        "ppr_expected": _expected_sql("restart", 10, "SELECT 3::BIGINT AS vertex, 2000.0::DOUBLE AS e", 3),
        "stop_expected": _expected_sql("stop", 4, "SELECT id AS vertex, 1.0::DOUBLE AS e FROM vertices"),
        "approx_topk": Q.walked("g_part", Q.seeds_uniform(10000, SEED), K.jump, 4, SEED, f"SELECT row_number() OVER (ORDER BY cnt DESC) AS rank, cnt FROM ({counts}) QUALIFY rank <= 20"),
        "long_walk_counts": Q.walked(R, Q.seeds_uniform(300, SEED), K.jump, 24, SEED, counts),
        "utilisation": Q.walked("g_part", Q.seeds_every(1), K.stop, 3, SEED, """SELECT block, used, loaded, coalesce(used, 0) / loaded AS ratio FROM (SELECT src // 64 AS block, count(*) AS loaded FROM edges GROUP BY 1)
LEFT JOIN (SELECT vertex // 64 AS block, count(*) AS used FROM visits GROUP BY 1) USING (block)"""),
    }
