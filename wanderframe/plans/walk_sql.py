"""The walks of operators.walker as plain SQL, to check them on another engine: one CTE for each hop."""

from __future__ import annotations

from ..functions import rng
from ..operators.kernels import Kernel

GRAPHS = {
    "g_part": "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey",
    "g_part_returns": "SELECT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey AND a.l_returnflag = 'R'",
    "toy": "SELECT a::BIGINT AS src, b::BIGINT AS dst FROM (VALUES (0, 1), (0, 3), (0, 4), (1, 2), (2, 0), (2, 6), (2, 7)) t(a, b)",
    "g_cust_supp": "SELECT o_custkey AS src, (SELECT count(*) FROM customer) + l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
}


def graph_ctes(name: str) -> str:
    return f"""edges AS MATERIALIZED ({GRAPHS[name]}),
sz AS MATERIALIZED (SELECT max(greatest(src, dst)) + 1 AS n FROM edges),
vertices AS (SELECT unnest(range(0, (SELECT n FROM sz))) AS id),
adj AS MATERIALIZED (SELECT src, count(*) AS outd, list_sort(list(dst)) AS nbrs FROM edges GROUP BY src)"""


def seeds_uniform(walks: int, seed: int) -> str:
    return f"SELECT w AS walk_id, {rng.draw_sql('w', 0, rng.SEEDING, seed)} % (SELECT n FROM sz) AS source FROM (SELECT unnest(range(0, {walks})) AS w)"


def seeds_every(walks: int) -> str:
    return f"SELECT w AS walk_id, w // {walks} AS source FROM (SELECT unnest(range(0, (SELECT n FROM sz) * {walks})) AS w)"


def seeds_range(first: int, sources: int, walks: int) -> str:
    return f"SELECT w AS walk_id, {first} + w // {walks} AS source FROM (SELECT unnest(range(0, {sources * walks})) AS w)"


def seeds_pair(a: int, b: int, walks: int) -> str:
    return f"SELECT w AS walk_id, (CASE WHEN w < {walks} THEN {a} ELSE {b} END)::BIGINT AS source FROM (SELECT unnest(range(0, {2 * walks})) AS w)"


def walk_ctes(seeds: str, kernel: Kernel, length: int, seed: int) -> str:
    """CTEs w0, w1, ... (walk_id, source, current) and visits(walk_id, source, hop, vertex)."""
    hops = kernel.visits(length) or length
    out = [f"w0 AS MATERIALIZED (SELECT walk_id, source, source AS current FROM ({seeds}))"]
    for hop in range(hops - 1):
        goes = "outd IS NOT NULL"
        if kernel.damped:
            goes += f" AND {rng.draw_sql('walk_id', hop, rng.CONTINUE, seed)} > {rng.STOP_BELOW}"
        target = f"{rng.draw_sql('walk_id', hop, rng.JUMP, seed)} % (SELECT n FROM sz)"
        other = {None: "NULL", "target": target, "source": "source"}[kernel.otherwise_sql]
        pick = f"list_extract(nbrs, {rng.draw_sql('walk_id', hop, rng.NEIGHBOUR, seed)} % outd + 1)"
        out.append(f"w{hop + 1} AS MATERIALIZED (SELECT walk_id, source, CASE WHEN {goes} THEN {pick} WHEN current IS NOT NULL THEN {other} END AS current FROM w{hop} LEFT JOIN adj ON current = src)")
    union = " UNION ALL ".join(f"SELECT walk_id, source, {hop} AS hop, current AS vertex FROM w{hop} WHERE current IS NOT NULL" for hop in range(hops))
    return ",\n".join([*out, f"visits AS MATERIALIZED ({union})"])


def walked(graph: str, seeds: str, kernel: Kernel, length: int, seed: int, select: str) -> str:
    return f"WITH {graph_ctes(graph)},\n{walk_ctes(seeds, kernel, length, seed)}\n{select}"


def recursive_walked(graph: str, seeds: str, kernel: Kernel, length: int | None, seed: int, select: str) -> str:
    """The same for long walks and those without a limit, as a recursion: visits(walk_id, source, hop, vertex)."""
    hops = None if length is None else kernel.visits(length)
    goes = "outd IS NOT NULL"
    if kernel.damped:
        goes += f" AND {rng.draw_sql('walk_id', 'hop', rng.CONTINUE, seed)} > {rng.STOP_BELOW}"
    target = f"{rng.draw_sql('walk_id', 'hop', rng.JUMP, seed)} % (SELECT n FROM sz)"
    other = {None: "NULL", "target": target, "source": "source"}[kernel.otherwise_sql]
    pick = f"list_extract(nbrs, {rng.draw_sql('walk_id', 'hop', rng.NEIGHBOUR, seed)} % outd + 1)"
    upto = "" if hops is None else f"WHERE hop < {hops - 1}"
    return f"""WITH RECURSIVE {graph_ctes(graph)},
visits(walk_id, source, hop, vertex) AS (SELECT walk_id, source, 0::BIGINT, source FROM ({seeds}) UNION ALL
  SELECT walk_id, source, hop + 1, following FROM (SELECT walk_id, source, hop, CASE WHEN {goes} THEN {pick} ELSE {other} END AS following FROM visits LEFT JOIN adj ON vertex = src {upto}) WHERE following IS NOT NULL)
{select}"""
