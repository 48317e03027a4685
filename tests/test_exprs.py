"""Scalar functions and small relational operators against plain Python."""

import math

import pytest
from ckptlake.functions import exprs
from ckptlake.operators import dag, relational
from pyspark.sql import functions as F


def test_bit_arithmetic_over_a_range(spark):
    rows = spark.range(0, 70000, 7).select(F.col("id").bitwiseAND(65535).alias("t"), (F.col("id") * 31).bitwiseAND(65535).alias("b"))
    d = exprs.delta16(F.col("t"), F.col("b"))
    z = exprs.zigzag16(d)
    back = exprs.add16(F.col("b"), exprs.unzigzag16(z))
    assert rows.where(back != F.col("t")).count() == 0
    assert [r[0] for r in spark.createDataFrame([(0,), (65535,), (1,), (32768,)], "d int").select(exprs.zigzag16(F.col("d"))).collect()] == [0, 1, 2, 65535]


@pytest.mark.parametrize("name,ok", [("main", True), ("", False), ("-x", False), ("a/b", False), ("a\\b", False), ("a..b", False)])
def test_branch_names(spark, name, ok):
    from ckptlake.operators.lake import valid_branch

    assert spark.createDataFrame([(name,)], "n string").select(exprs.branch_name_ok(F.col("n"))).first()[0] is ok and valid_branch(name) is ok


def test_names(spark):
    names = ["features.10.weight", "features.2.weight", "bn"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.orderBy(exprs.natural_key(F.col("n"))).collect()] == ["bn", "features.2.weight", "features.10.weight"]
    got = {r[0]: r[1:] for r in df.select("n", exprs.stem(F.col("n")), exprs.suffix(F.col("n")), exprs.trailing_index(exprs.stem(F.col("n"))), exprs.shared_prefix(F.col("n"), F.lit("features.2.bias"))).collect()}
    assert got["features.10.weight"] == ("features.10", "weight", 10, 1) and got["features.2.weight"][3] == 2 and got["bn"] == ("", "bn", None, 0)


def test_decisions_and_sizes(spark):
    df = spark.createDataFrame([(0.5, 1), (0.9, 0), (0.1, 3)], "r double, d int").select(exprs.anchor_decision(F.col("r"), F.col("d")))
    assert [r[0] for r in df.collect()] == ["delta", "anchor", "anchor"]
    sizes = spark.createDataFrame([(5,), (2048,), (3 << 20,), (1 << 40,)], "n long").select(exprs.human_bytes(F.col("n")))
    assert [r[0] for r in sizes.collect()] == ["5 B", "2.0 KiB", "3.0 MiB", "1.0 TiB"]
    gain = spark.createDataFrame([(1.0, 0.5), (1.0, 0.0), (0.0, 0.0), (float("inf"), 1.0), (1.0, 1e-9)], "a double, b double").select(exprs.clipped_log_gain(F.col("a"), F.col("b"), F.lit(10.0)))
    assert [r[0] if r[0] is None else round(r[0], 6) for r in gain.collect()] == [round(10 * math.log(0.5), 6), -80.0, None, None, -80.0]
    assert spark.range(1).select(exprs.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string")})).first()[0] == '{"a":null,"b":1}'
    assert spark.range(1).select(exprs.rows_per_chunk(100, F.lit(33).cast("long")), exprs.rows_per_chunk(10, F.lit(33).cast("long"))).first()[:] == (3, 1)


def test_merge_truth_table(spark):
    mk = lambda d: spark.createDataFrame(list(d.items()), "k string, v string")
    ours, theirs, base = {"a": "1", "b": "2", "c": "1", "d": "2", "e": "9", "f": "2"}, {"a": "1", "b": "1", "c": "2", "d": "3", "g": "5", "f": "3"}, {"a": "1", "b": "1", "c": "1", "d": "1", "e": "9"}
    got = {r["k"]: r["action"] for r in relational.merge_plan(mk(ours), mk(theirs), mk(base), "k", "v").collect()}
    assert got == {"a": "unchanged", "b": "take-ours", "c": "take-theirs", "d": "averaged", "e": "only-ours", "g": "only-theirs", "f": "averaged"}


def test_graphs(spark):
    edges = spark.createDataFrame([("d", "b", 0), ("d", "c", 1), ("b", "a", 0), ("c", "a", 0), ("a", "gone", 0)], "child string, parent string, ord int")
    got = {r["node"]: r["depth"] for r in dag.ancestors(edges, spark.createDataFrame([("d",)], "node string")).collect()}
    assert got == {"d": 0, "b": 1, "c": 1, "a": 2, "gone": 3}
    assert [r["node"] for r in dag.first_parents(edges, "d", 3).orderBy("depth").collect()] == ["d", "b", "a"]
    assert dag.merge_base(edges, "b", "c").first()["node"] == "a" and dag.merge_base(edges, "b", "z").first() is None
    chains = spark.createDataFrame([("m0", None), ("m1", "m0"), ("m2", "m1"), ("m3", "m2"), ("x", None)], "manifest string, base string")
    assert {r["manifest"]: (r["root"], r["hops"]) for r in dag.chain_roots(chains).collect()} == {"m0": ("m0", 0), "m1": ("m0", 1), "m2": ("m0", 2), "m3": ("m0", 3), "x": ("x", 0)}
    pairs = spark.createDataFrame([(k, k + 1) for k in range(0, 40) if k % 10 != 9], "a long, b long")
    assert {r["node"]: r["label"] for r in dag.components(pairs, spark.range(0, 41).withColumnRenamed("id", "node")).collect()} == {k: k // 10 * 10 for k in range(41)}


def test_residuals_and_permutations(spark):
    rows = spark.createDataFrame([("a", [3.0, 4.0], [3.0, 0.0]), ("z", [0.0], [0.0]), ("n", [float("nan")], [1.0])], "g string, t array<double>, b array<double>")
    got = {r[0]: r[1] for r in relational.residual_norms(rows, "g", "t", "b").collect()}
    assert got["a"] == 0.8 and got["z"] == 0 and got["n"] == math.inf
    p = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "idx long, val long")
    assert sorted((r["idx"], r["val"]) for r in relational.compose(p, p).collect()) == [(0, 2), (1, 0), (2, 1)]
    assert relational.permutation_problems(p, 3).count() == 0 and relational.permutation_problems(p, 2).count() == 1
    gathered = relational.permuted_gather(spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "row long, v string"), "row", p.select(F.col("idx").alias("target_idx"), F.col("val").alias("base_idx")), ["v"])
    assert {r["target_idx"]: r["v"] for r in gathered.collect()} == {0: "y", 1: "z", 2: "x"}


def test_intervals_and_tiling(spark):
    chunks = spark.createDataFrame([(0, 0, 3), (1, 4, 7)], "chunk_no long, row_start long, row_end long")
    wanted = spark.createDataFrame([(3,), (4,), (9,)], "i long")
    for per in (None, 4):
        assert sorted((r["i"], r["chunk_no"]) for r in relational.interval_gather(wanted, "i", chunks, per).where("i between row_start and row_end").collect()) == [(3, 0), (4, 1)]
    segments = spark.createDataFrame([("a", 0, 4), ("b", 5, 6), ("c", 6, 7)], "n string, s long, e long")
    assert [r["n"] for r in relational.tiling_violations(segments, None, "s", "e").collect()] == ["b"]


def test_first_failures(spark):
    f = spark.range(5).withColumnRenamed("id", "k")
    got = relational.first_failures(f, 3, ["k"]).collect()
    assert [r["k"] for r in got] == [0, 1, 2] and all(r["truncated"] for r in got)
