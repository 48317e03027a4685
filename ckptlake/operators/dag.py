"""Walks over the commit graph and over chains of manifests.

Edges are a relation (child, parent, ord). First-parent chains are recursive SQL
with a bound, or pointers that are doubled. Closures over all parents go by
frontier: a round joins the newest nodes with the edges and drops those seen, so
diamonds cost each node once. A graph of at most ``BROADCAST_EDGES`` edges is
broadcast instead, and each root is walked where it is; the results are the same.
Ancestors of each of many roots, and merge bases, of larger graphs are walked over
files of the graph on the executors (``packed``), which no round of joins is spent on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ckptlake.operators.packed import ROWS, Packed
from ckptlake.store import Scratch, cut

STRIDE = 16
#: Graphs of so many edges (some tens of MB at most) are broadcast; longer ones are joined.
BROADCAST_EDGES = 200_000


def _ends(edges: DataFrame, *columns: str) -> list[tuple] | None:
    """The rows of a graph that is small enough to pass the driver; None of a larger one."""
    rows = edges.select(*columns).limit(BROADCAST_EDGES + 1).toArrow()
    if rows.num_rows > BROADCAST_EDGES:
        return None
    return list(zip(*(rows[c].to_pylist() for c in columns), strict=True))


def _parents(edges: DataFrame) -> dict | None:
    """Node -> its parents, of a graph that is small enough."""
    if (rows := _ends(edges, "child", "parent")) is None:
        return None
    out: dict = {}
    for child, parent in rows:
        out.setdefault(child, []).append(parent)
    return out


def _looked_up(nodes: DataFrame, found: dict, value: str, kind: pa.DataType) -> DataFrame:
    """(node, value) of a small graph's nodes, null for the others: found has two entries an edge at most, so it is broadcast."""
    node = to_arrow_schema(nodes.schema).field("node").type
    table = pa.table({"node": pa.array(list(found), node), value: pa.array(list(found.values()), kind)})
    return nodes.join(F.broadcast(nodes.sparkSession.createDataFrame(table)), "node", "left")


def _walk(parents: dict, roots: list) -> dict:
    """Node -> depth, by the shortest way from any root."""
    depth, layer = dict.fromkeys(roots, 0), roots
    while layer:
        after = []
        for x in layer:
            for p in parents.get(x, ()):
                if p not in depth:
                    depth[p] = depth[x] + 1
                    after.append(p)
        layer = after
    return depth


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): every node that a root leads to, itself at 0, by the shortest way. Missing parents are nodes too."""
    starts, kind = roots.select(F.col("node").alias("root")).distinct(), dict(edges.dtypes)["child"]
    if (small := _parents(edges)) is None:
        return _packed_ancestors(edges, starts, kind)
    parents = edges.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        for batch in batches:
            for root in batch.column("root").to_pylist():
                found = _walk(parents.value, [root])
                node = pa.array(list(found), batch.schema.field("root").type)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(found), node.type), node, pa.array(list(found.values()), pa.int32())], ["root", "node", "depth"])

    return starts.mapInArrow(run, f"root {kind}, node {kind}, depth int")


def _packed_ancestors(edges: DataFrame, starts: DataFrame, kind: str) -> DataFrame:
    scratch = Scratch(edges.sparkSession, "reach")
    starts = scratch.save(starts, "starts")
    graph = Packed(edges, starts.select(F.col("root").alias("node")), scratch)
    opened = graph.opened()

    def run(batches):
        names = opened.names()

        def batch():
            root, node, depth = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([names(root), names(node), pa.array(depth)], ["root", "node", "depth"])

        held, n = [], 0
        for root, nodes, depths in opened.walks(x for b in batches for x in b.column("root").to_pylist()):
            held.append((np.full(len(nodes), root), nodes, depths))
            n += len(nodes)
            if n >= ROWS:
                yield batch()
                held, n = [], 0
        if held:
            yield batch()

    return graph.numbered(starts, "root").mapInArrow(run, f"root {kind}, node {kind}, depth int")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth): every node that some root leads to, by the shortest way from any. Each node is one row, however many roots lead to it."""
    starts = roots.select("node").distinct()
    if (small := _parents(edges)) is None:
        return _reach(edges, starts, ["node"])
    parents = edges.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        found = _walk(parents.value, [x for batch in batches for x in batch.column("node").to_pylist()])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), kind), pa.array(list(found.values()), pa.int32())], ["node", "depth"])

    kind = to_arrow_schema(starts.schema)[0].type
    # Each task's roots are walked together; what several tasks reach is one row at its least depth.
    return starts.mapInArrow(run, f"node {dict(starts.dtypes)['node']}, depth int").groupBy("node").agg(F.min("depth").alias("depth"))


def _reach(edges: DataFrame, starts: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    scratch = Scratch(edges.sparkSession, "reach")
    strides = _strides(edges, scratch)
    layer, n = scratch.counted(starts.withColumn("depth", F.lit(0)), "layer")
    seen, depth = layer, 0
    while n and (limit is None or depth < limit - 1):
        new = _onward(layer, strides, keys).join(seen, keys, "left_anti")
        depth += STRIDE
        new, n = scratch.counted(new if limit is None else new.where(F.col("depth") < limit), "layer", f"depth = {depth}")
        layer = new.where(F.col("depth") == depth)
        seen = seen.unionByName(new)  # written tables, side by side
    return seen


def _strides(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(child, far, steps): what each node leads to within STRIDE steps, and how near. The table is doubled from the edges, so a walk of many layers joins it once for STRIDE of them."""
    table, steps = edges.select("child", F.col("parent").alias("far"), F.lit(1).alias("steps")).distinct(), 1
    table, n = scratch.counted(table, "strides")
    while n and steps < STRIDE:
        onward = table.select(F.col("child").alias("far"), F.col("far").alias("farther"), F.col("steps").alias("more"))
        both = table.unionByName(table.join(onward, "far").select("child", F.col("farther").alias("far"), (F.col("steps") + F.col("more")).alias("steps")))
        table, n = scratch.counted(both.groupBy("child", "far").agg(F.min("steps").alias("steps")), "strides", f"steps > {steps}")
        steps *= 2
    return table


def _onward(layer: DataFrame, strides: DataFrame, keys: list[str]) -> DataFrame:
    """What the nodes of a layer lead to within a stride. All of them have one depth, and every shortest way onward passes one of them."""
    found = layer.join(strides, F.col("node") == F.col("child")).select(*keys[:-1], F.col("far").alias("node"), (F.col("depth") + F.col("steps")).alias("depth"))
    return found.groupBy(*keys).agg(F.min("depth").alias("depth"))


def first_parents(edges: DataFrame, tip, limit: int = 1000) -> DataFrame:
    """(depth, node) of the chain of first parents from tip, at most limit nodes, newest first."""
    spark, kind = edges.sparkSession, dict(edges.dtypes)["child"]
    first = edges.where("ord = 0").groupBy("child").agg(F.min("parent").alias("parent"))
    if (small := _parents(first)) is not None:
        chain = [tip]
        while len(chain) < limit and (up := small.get(chain[-1])):
            chain += up
        return spark.createDataFrame(list(enumerate(chain)), f"depth int, node {kind}")
    return _reach(first, spark.createDataFrame([(tip,)], f"node {kind}"), ["node"], limit).select("depth", "node").orderBy("depth")


def merge_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ours, theirs, node, ours_depth, theirs_depth): the nearest common ancestor of each pair (ours, theirs); of several, the least name. Pairs without one have no row."""
    if (small := _parents(edges)) is not None:
        return _small_bases(edges.sparkSession.sparkContext.broadcast(small), pairs)
    return _packed_bases(edges, pairs.select("ours", "theirs"))


def _packed_bases(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    scratch, kind = Scratch(edges.sparkSession, "bases"), dict(edges.dtypes)["child"]
    pairs = scratch.save(pairs, "tips")
    graph = Packed(edges, pairs.select(F.col("ours").alias("node")).unionByName(pairs.select(F.col("theirs").alias("node"))), scratch)
    opened = graph.opened()

    def run(batches):
        names = opened.names()
        for batch in batches:
            if found := list(opened.bases(zip(*(batch.column(c).to_pylist() for c in ("ours", "theirs")), strict=True))):
                ours, theirs, node, *depths = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([names(ours), names(theirs), names(node), *(pa.array(x.astype(np.int32)) for x in depths)], ["ours", "theirs", "node", "ours_depth", "theirs_depth"])

    return graph.numbered(pairs, "ours", "theirs").mapInArrow(run, f"ours {kind}, theirs {kind}, node {kind}, ours_depth int, theirs_depth int")


def _small_bases(parents, pairs: DataFrame) -> DataFrame:
    kind = dict(pairs.dtypes)["ours"]

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch.column("ours").to_pylist(), batch.column("theirs").to_pylist(), strict=True):
                x, y = _walk(parents.value, [a]), _walk(parents.value, [b])
                if met := x.keys() & y.keys():
                    far, node = min((x[n] + y[n], n) for n in met)
                    out.append((a, b, node, x[node], far - x[node]))
            node = batch.schema.field("ours").type
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (node, node, node, pa.int32(), pa.int32()), strict=True)], ["ours", "theirs", "node", "ours_depth", "theirs_depth"])

    return pairs.select("ours", "theirs").mapInArrow(run, f"ours {kind}, theirs {kind}, node {kind}, ours_depth int, theirs_depth int")


def merge_base(edges: DataFrame, ours, theirs) -> DataFrame:
    """The same for one pair: (node, ours_depth, theirs_depth)."""
    kind = dict(edges.dtypes)["child"]
    return merge_bases(edges, edges.sparkSession.createDataFrame([(ours, theirs)], f"ours {kind}, theirs {kind}")).drop("ours", "theirs")


def chain_roots(bases: DataFrame) -> DataFrame:
    """(manifest, root, hops) of residual chains (manifest, base): pointers are doubled, so a chain of n links takes log n joins."""
    return _doubled(bases.select("manifest", F.coalesce("base", "manifest").alias("root"), F.col("base").isNotNull().cast("int").alias("hops")), Scratch(bases.sparkSession, "chains"))[-1]


def _doubled(pointers: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Pointers (manifest, root, hops) after 1, 2, 4 ... steps, until all stand at a root; one that leads out of the table stays there."""
    at, n = scratch.counted(pointers, "pointers", "hops > 0")
    tables = [at]
    while n and len(tables) < 64:
        jump = at.select(F.col("manifest").alias("root"), F.col("root").alias("far"), F.col("hops").alias("more"))
        step = at.join(jump, "root", "left").select("manifest", F.coalesce("far", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), (F.coalesce("more", F.lit(0)) > 0).alias("moved"))
        at, n = scratch.counted(step, "pointers", "moved")
        at = at.drop("moved")
        if n:
            tables.append(at)
    return tables


def nearest_full(commits: DataFrame) -> DataFrame:
    """(node, anchor, since) of commits (node, parent, full): the last full commit at or before each along first parents (null without one), and the commits since."""
    chains = commits.select(F.col("node").alias("manifest"), F.when(~F.col("full"), F.col("parent")).alias("base"))
    full = commits.where("full").select(F.col("node").alias("root"), F.col("node").alias("anchor"))
    return chain_roots(chains).join(full, "root", "left").select(F.col("manifest").alias("node"), "anchor", F.when(F.col("anchor").isNotNull(), F.col("hops")).otherwise(0).alias("since"))


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): the length of the longest way from a node to one without parents. Sent in ascending order, parents always come before their children.

    First parents make a forest, in which depths come by doubling pointers. Another
    parent lifts its child, and all that the child leads to in the forest, by what
    it lies higher; lifts travel by the doubled pointers too. A round settles all
    ways that leave the first parents once more, so rounds grow with how often the
    longest way does that and not with its length.
    """
    own = nodes.select("node").distinct()
    among = edges.join(own.withColumnRenamed("node", "child"), "child", "left_semi").join(own.withColumnRenamed("node", "parent"), "parent", "left_semi")
    if (small := _parents(among)) is not None:
        return _looked_up(own, _small_levels(small), "level", pa.int32()).select("node", F.coalesce("level", F.lit(0)).alias("level"))
    scratch = Scratch(edges.sparkSession, "levels")
    up = edges.where("ord = 0").groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("up"))
    there = own.select(F.col("node").alias("up"), F.lit(True).alias("there"))
    first = own.join(up, "node", "left").join(there, "up", "left").select(F.col("node").alias("manifest"), F.when(F.col("there"), F.col("up")).otherwise(F.col("node")).alias("root"), F.coalesce("there", F.lit(False)).cast("int").alias("hops"))
    jumps = _doubled(first, scratch)
    level = jumps[-1].select(F.col("manifest").alias("node"), F.col("hops").alias("level"))
    others = scratch.save(edges.join(jumps[0].select(F.col("manifest").alias("child"), "root", "hops"), "child").where("hops = 0 or parent <> root").select("child", "parent").distinct(), "others")
    while True:
        of = lambda end: level.select(F.col("node").alias(end), F.col("level").alias(f"{end}_level"))  # noqa: B023, E731
        lift = others.join(of("parent"), "parent").join(of("child"), "child").where("parent_level >= child_level").groupBy(F.col("child").alias("node")).agg((F.max("parent_level") + 1).alias("level"))
        lift, n = scratch.counted(lift, "lift")
        if not n:
            return level
        level = scratch.save(level.unionByName(lift).groupBy("node").agg(F.max("level").alias("level")), "level")
        for jump in jumps:
            above = jump.join(level.select(F.col("node").alias("root"), F.col("level").alias("from")), "root").select(F.col("manifest").alias("node"), (F.col("from") + F.col("hops")).alias("level"))
            level = scratch.save(level.unionByName(above).groupBy("node").agg(F.max("level").alias("level")), "level")


def _small_levels(parents: dict) -> dict:
    """Node -> the longest way to one without parents, for the nodes that have any."""
    waiting = {child: len(of) for child, of in parents.items()}
    children: dict = {}
    for child, of in parents.items():
        for p in of:
            children.setdefault(p, []).append(child)
    level, ready = {}, [p for p in children if p not in parents]
    while ready:
        at = ready.pop()
        for child in children.get(at, ()):
            level[child] = max(level.get(child, 0), level.get(at, 0) + 1)
            waiting[child] -= 1
            if not waiting[child]:
                ready.append(child)
    if any(waiting.values()):
        raise ValueError("the graph has a cycle")
    return level


def _small_components(edges: list[tuple]) -> dict:
    """Node -> the least node of its component, for the ends of edges."""
    up: dict = {}

    def root(x):
        while (above := up.setdefault(x, x)) != x:
            up[x] = x = up[above]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        up[high] = low
    return {x: root(x) for x in list(up)}


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of edges (a, b), isolated nodes included; null is no node."""
    every = nodes.select("node").unionByName(edges.select(F.col("a").alias("node"))).unionByName(edges.select(F.col("b").alias("node"))).where("node is not null").distinct()
    if (small := _ends(edges.where("a <> b"), "a", "b")) is not None:
        label = to_arrow_schema(every.schema).field("node").type
        return _looked_up(every, _small_components(small), "label", label).select("node", F.coalesce("label", "node").alias("label"))
    return hooked(edges, every, Scratch(edges.sparkSession, "components"))


def hooked(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) by hooking and jumping.

    Every node has a parent of its component, no greater than itself. A round gives
    each node, and each node's parent too, the least grandparent that its
    neighbours have, and jumps to its own grandparent. Parents that hook pull
    whole trees along, so rounds grow with the logarithm of the longest path
    (14 for a path of 4,000 in the worst order). Labels meet in partial aggregates;
    no node's neighbours are gathered.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = scratch.save(both.where("a <> b").distinct(), "links")
    near = links.groupBy("a").agg(F.min("b").alias("m"))
    first = nodes.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("node", F.coalesce("m", "node")).alias("f"))
    parents = scratch.save(first, "parents")
    while True:
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        grand = parents.join(up, "f").select("node", "f", "gf")
        least = links.join(grand.select(F.col("node").alias("b"), "gf"), "b").groupBy(F.col("a").alias("node")).agg(F.min("gf").alias("m"))
        seen = grand.join(least, "node", "left").select("node", "f", F.least("f", "gf", F.coalesce("m", "gf")).alias("m"))
        told = seen.select("node", "m", F.col("f").alias("old")).unionByName(seen.select(F.col("f").alias("node"), "m", F.lit(None).cast(dict(seen.dtypes)["f"]).alias("old")))
        after, n = scratch.counted(told.groupBy("node").agg(F.min("m").alias("f"), F.max("old").alias("old")), "parents", "f <> old")
        scratch.drop(parents)
        parents = after
        if not n:
            return after.select("node", F.col("f").alias("label"))
