"""Registered queries do the whole job: small tables on which a cut shows."""

import pytest

from wanderframe import catalog


def paths(spark, folder, *orders):
    """lineitem of one order for each path, all returned."""
    lines = [(k, part, i + 1, "R") for k, order in enumerate(orders) for i, part in enumerate(order)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_reachability_bfs_reaches_the_end_of_a_path(spark, tmp_path):
    found = catalog.queries()["reachability_bfs"](spark, paths(spark, tmp_path, range(13)))
    assert rows(found) == [(k, k - 1) for k in range(1, 13)]


def test_reachability_mc_walks_further_than_16_positions(spark, tmp_path):
    assert rows(catalog.queries()["reachability_mc"](spark, paths(spark, tmp_path, [1, *range(3, 20), 2]))) == [(True,)]


def test_simrank_mc_counts_meetings_at_the_seventh_hop(spark, tmp_path):
    d = paths(spark, tmp_path, [1, *range(3, 9), 20], [2, *range(9, 15), 20])
    follows = 0.85**7
    expected = sum((follows * late) ** 2 * 0.8**hop for hop, late in ((7, 1), (8, 0.15), (9, 0.15)))
    assert catalog.queries()["simrank_mc"](spark, d).first()["score"] == pytest.approx(expected, rel=0.25)
