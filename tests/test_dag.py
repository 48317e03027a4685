"""Walks over graphs: broadcast and joined alike, deep paths, and orders."""

import random

import pytest
from ckptlake.operators import dag
from pyspark.sql import functions as F


def history(spark, n=300):
    rng = random.Random(1)
    rows = [(k, max(0, k - rng.randrange(1, 4)), 0) for k in range(1, n)] + [(k, rng.randrange(k), 1) for k in range(5, n, 7)]
    return spark.createDataFrame(rows, "child long, parent long, ord int"), rows


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_joined_walks_equal_broadcast_ones(spark, monkeypatch):
    edges, _ = history(spark)
    roots = spark.createDataFrame([(299,), (298,), (40,)], "node long")
    pairs = spark.createDataFrame([(299, 298), (40, 299), (7, 7)], "ours long, theirs long")
    walks = lambda: [rows_of(x) for x in (dag.ancestors(edges, roots), dag.reachable(edges, roots), dag.first_parents(edges, 299, 20), dag.merge_bases(edges, pairs))]
    small = walks()
    monkeypatch.setattr(dag, "BROADCAST_EDGES", 3)
    assert walks() == small and all(small)


def test_levels_put_parents_first_by_the_longest_way(spark, monkeypatch):
    edges, rows = history(spark)
    longest = {}
    for k in range(300):
        longest[k] = max((longest[p] + 1 for c, p, _ in rows if c == k), default=0)
    nodes = spark.range(300).select(F.col("id").alias("node"))
    assert dict(rows_of(dag.levels(edges, nodes))) == longest
    monkeypatch.setattr(dag, "BROADCAST_EDGES", 3)
    assert dict(rows_of(dag.levels(edges, nodes))) == longest


@pytest.mark.parametrize("most", [3, 200_000])
def test_levels_of_some_nodes_only(spark, monkeypatch, most):
    monkeypatch.setattr(dag, "BROADCAST_EDGES", most)
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (3, 9, 1), (4, 3, 0), (4, 1, 1), (8, 4, 0)], "child long, parent long, ord int")
    nodes = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 5)], "node long")  # 9 and 8 are not of the graph
    assert rows_of(dag.levels(edges, nodes)) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 0)]


@pytest.mark.parametrize("most", [1, 200_000])
def test_components_of_texts_and_nulls(spark, monkeypatch, most):
    monkeypatch.setattr(dag, "BROADCAST_EDGES", most)
    edges = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b"), ("d", "d"), (None, "e"), ("g", "f")], "a string, b string")
    nodes = spark.createDataFrame([("z",), ("a",), (None,)], "node string")
    want = [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e"), ("f", "f"), ("g", "f"), ("z", "z")]
    assert rows_of(dag.components(edges, nodes)) == want
    assert rows_of(dag.components(edges.limit(0), nodes)) == [("a", "a"), ("z", "z")]


@pytest.mark.parametrize("order", ["worst", "shuffled"])
def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch, order):
    n, rounds = 4000, []
    path = [0, *range(n - 1, 0, -1)]
    if order == "shuffled":
        random.Random(3).shuffle(path)
    counted = dag.Scratch.counted
    monkeypatch.setattr(dag.Scratch, "counted", lambda *a, **k: rounds.append(1) or counted(*a, **k))
    edges = spark.createDataFrame(list(zip(path, path[1:], strict=False)), "a long, b long")
    nodes = spark.createDataFrame([(9999,)], "node long")
    want = dict.fromkeys(range(n), 0) | {9999: 9999}
    assert dict(rows_of(dag.components(edges, nodes))) == want and not rounds  # broadcast
    monkeypatch.setattr(dag, "BROADCAST_EDGES", 3)
    assert dict(rows_of(dag.components(edges, nodes))) == want and 1 < len(rounds) < 30


def test_nearest_full_over_a_long_history(spark):
    rows = [(f"c{k}", f"c{k - 1}" if k else None, k == 3) for k in range(1500)]
    got = {r["node"]: (r["anchor"], r["since"]) for r in dag.nearest_full(spark.createDataFrame(rows, "node string, parent string, full boolean")).collect()}
    assert got["c1499"] == ("c3", 1496) and got["c3"] == ("c3", 0) and got["c2"] == (None, 0)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_deep_walks_of_large_graphs_take_few_tables(spark, monkeypatch, kind):
    """Two branches of 1,500 commits from a trunk of 1,500; tables were written for every 16 layers of them."""
    n, tables = 1500, []
    rows = [(k, k - 1 if k != 2 * n else n - 1) for k in range(1, 3 * n)]
    edges = spark.createDataFrame(rows, "child long, parent long").selectExpr(f"cast(child as {kind}) child", f"cast(parent as {kind}) parent", "0 ord")
    roots = spark.createDataFrame([(3 * n - 1,), (2 * n - 1,)], "node long").selectExpr(f"cast(node as {kind}) node")
    pairs = roots.selectExpr("node ours", f"cast({2 * n - 1} as {kind}) theirs")
    walks = lambda: [rows_of(x) for x in (dag.ancestors(edges, roots), dag.merge_bases(edges, pairs))]
    small = walks()
    saved = dag.Scratch.save
    monkeypatch.setattr(dag.Scratch, "save", lambda *a, **k: tables.append(1) or saved(*a, **k))
    monkeypatch.setattr(dag, "BROADCAST_EDGES", 3)
    monkeypatch.setattr("ckptlake.operators.packed.BLOCK", 1000)
    assert walks() == small and len(small[0]) == 4 * n and len(small[1]) == 2
    assert len(tables) < 20


@pytest.mark.parametrize("most", [2, 200_000])
def test_walks_meet_nulls_ties_and_strangers(spark, monkeypatch, most):
    monkeypatch.setattr(dag, "BROADCAST_EDGES", most)
    edges = spark.createDataFrame([("m", "a", 0), ("m", "b", 1), ("n", "b", 0), ("n", "a", 1), ("a", "é", 0), ("q", "", 0), ("q", "", 0), ("x", "y", 0), ("y", "x", 0)], "child string, parent string, ord int")
    roots = spark.createDataFrame([("m",), ("m",), ("q",), ("lone",), ("x",)], "node string")
    assert rows_of(dag.ancestors(edges, roots)) == sorted([("m", "m", 0), ("m", "a", 1), ("m", "b", 1), ("m", "é", 2), ("q", "q", 0), ("q", "", 1), ("lone", "lone", 0), ("x", "x", 0), ("x", "y", 1)])
    assert dag.ancestors(edges, spark.createDataFrame([(None,)], "node string")).collect() == [(None, None, 0)]
    pairs = spark.createDataFrame([("m", "n"), ("m", "q"), ("q", "q"), ("m", "é"), ("x", "y"), ("lone", "lone")], "ours string, theirs string")
    assert rows_of(dag.merge_bases(edges, pairs)) == sorted([("m", "n", "a", 1, 1), ("q", "q", "q", 0, 0), ("m", "é", "é", 2, 0), ("x", "y", "x", 0, 1), ("lone", "lone", "lone", 0, 0)])
