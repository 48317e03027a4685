"""Queries over a lake of checkpoints made from the driver's vectors, and what SQL says of them.

A label's vectors, by vec_id, are the rows of one tensor ``layer.<label>.weight``.
The history: ``base``; ``tuned`` on main doubles every fifth row; ``side``, from
the base, multiplies every seventh row of the labels below 5 by four; ``merged``
averages what both changed. Doublings are exact, so SQL can tell every bit. The
files, commits and merge go through the same calls that a user makes, once a
session for each folder of tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ckptlake.operators import align, dag
from ckptlake.operators.lake import Lake, merge, sync, verify
from ckptlake.sources import safetensors as st
from ckptlake.store import Scratch

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CHUNK = 4096  # 16 rows of 64 numbers of 4 bytes
TUNED, SIDE = "CASE WHEN row % 5 = 0 THEN 2 ELSE 1 END", "CASE WHEN row % 7 = 0 AND label < 5 THEN 4 ELSE 1 END"
_made: dict[tuple[str, str], tuple] = {}

_ROWS = "v AS (SELECT 'layer.' || label || '.weight' AS name, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, embedding AS e FROM embeddings)"
_BITS = "list_sum(list_transform(range(1, 65), lambda i: (CAST(CAST(CAST(e[i] AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295) * i))"


def query(sql: str):
    def put(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return put


def _tensor_rows(vectors: DataFrame, factor: str) -> DataFrame:
    """(name, row, bits) of the vectors, each times its factor."""
    rows = vectors.select("label", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long").alias("row"))

    def run(batches):
        for batch in batches:
            numbers = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(batch.num_rows, -1)
            numbers = numbers * batch.column("factor").to_numpy()[:, None].astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("row"), pa.array([r.tobytes() for r in numbers], pa.binary())], ["name", "row", "bits"])

    named = rows.select(F.concat(F.lit("layer."), F.col("label").cast("string"), F.lit(".weight")).alias("name"), "row", "embedding", F.expr(factor).cast("int").alias("factor"))
    return named.mapInArrow(run, "name string, row long, bits binary")


def _history(spark: SparkSession, sf_dir: str) -> tuple[Lake, dict[str, str], str]:
    """The lake, its commits by message, and the folder of the files."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        folder = Scratch(spark, "history").root
        vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
        layers = vectors.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row a layer
        tensors = [(f"layer.{r['label']}.weight", "F32", [r["n"], 64]) for r in layers]
        for name, factor in (("base", "1"), ("tuned", TUNED), ("side", SIDE)):
            st.write_rows(spark, f"{folder}/{name}.safetensors", tensors, _tensor_rows(vectors, factor), {"format": "pt"})
        lake = Lake.init(spark, f"{folder}/lake", chunk_bytes=CHUNK)
        commits = {"base": lake.commit(f"{folder}/base.safetensors", "base", config=b"{}")["commit"]}
        lake.create_branch("side")
        commits["tuned"] = lake.commit(f"{folder}/tuned.safetensors", "tuned")["commit"]
        lake.set_head("side")
        commits["side"] = lake.commit(f"{folder}/side.safetensors", "side")["commit"]
        lake.set_head("main")
        commits["merged"] = merge(lake, "side", average=True, message="merged")["commit"]
        _made[key] = lake, commits, folder
    return _made[key]


def _checksums(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunk_no, row_start, row_end, checksum): the bit patterns of each chunk's rows, weighted by their place."""

    def run(batches):
        for batch in batches:
            sums = [int((np.frombuffer(b.as_buffer(), "<u4").reshape(-1, 64).astype(np.int64) @ np.arange(1, 65)).sum()) for b in batch.column("bits")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], [*batch.schema.names[:-1], "checksum"])

    kept = blocks.select(*keys, F.col("chunk_no").cast("long").alias("chunk_no"), "row_start", "row_end", "bits")
    return kept.mapInArrow(run, ", ".join([*(f"{k} string" for k in keys), "chunk_no long, row_start long, row_end long, checksum long"]))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
  SELECT 'layer.' || label || '.weight' AS name, 'F32' AS dtype, n AS num_rows, 64::BIGINT AS row_elems, n * 256 AS nbytes, CAST(256 * (sum(n) OVER (ORDER BY label) - n) AS BIGINT) AS seg_begin, CAST(256 * sum(n) OVER (ORDER BY label) AS BIGINT) AS seg_end FROM n""")
def checkpoint_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tensors of a checkpoint file, from its header."""
    folder = _history(spark, sf_dir)[2]
    return st.scan_headers(spark, f"{folder}/base.safetensors").select("name", "dtype", "num_rows", "row_elems", "nbytes", "seg_begin", "seg_end")


@query(f"WITH {_ROWS} SELECT name, row // 16 AS chunk_no, min(row) AS row_start, max(row) AS row_end, CAST(sum({_BITS}) AS BIGINT) AS checksum FROM v GROUP BY 1, 2")
def checkpoint_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of a checkpoint file, as tasks read them by ranges of rows."""
    folder = _history(spark, sf_dir)[2]
    return _checksums(st.scan_blocks(spark, f"{folder}/base.safetensors", CHUNK), "name")


@query("SELECT * FROM (VALUES (0, 'merged', true, 2, 'main'), (1, 'tuned', false, 1, ''), (2, 'base', true, 0, '')) t(depth, message, is_full, n_parents, branches)")
def lake_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of main with its decorations: a merge is full and has two parents, a first residual commit isn't."""
    lake = _history(spark, sf_dir)[0]
    log = lake.log(lake.resolve("main"))
    return log.select("depth", "message", F.col("full").alias("is_full"), F.size("parents").alias("n_parents"), F.coalesce(F.array_join("branches", ","), F.lit("")).alias("branches"))


@query(f"""WITH {_ROWS}, f AS (SELECT *, {TUNED} AS t, {SIDE} AS s FROM v),
  r AS (SELECT 'base' AS message, name, row, e FROM f UNION ALL SELECT 'tuned', name, row, list_transform(e, lambda x: CAST(x * t AS FLOAT)) FROM f UNION ALL SELECT 'side', name, row, list_transform(e, lambda x: CAST(x * s AS FLOAT)) FROM f
    UNION ALL SELECT 'merged', name, row, list_transform(e, lambda x: CASE WHEN label < 5 THEN CAST((CAST(x * t AS FLOAT) + CAST(x * s AS FLOAT)) / 2 AS FLOAT) ELSE CAST(x * t AS FLOAT) END) FROM f)
  SELECT message, name, row // 16 AS chunk_no, min(row) AS row_start, max(row) AS row_end, CAST(sum({_BITS}) AS BIGINT) AS checksum FROM r GROUP BY 1, 2, 3""")
def lake_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk of every commit, rebuilt from its residuals and bases, to the bit; the merge's are the averages."""
    lake, commits, _ = _history(spark, sf_dir)
    out = None
    for message, commit in commits.items():
        names = lake.tensors(commit).select("name", "tensor_manifest")
        blocks = lake.blocks(names.select("tensor_manifest")).drop("name").join(names, "tensor_manifest").withColumn("message", F.lit(message))
        own = _checksums(blocks, "message", "name")
        out = own if out is None else out.unionByName(own)
    return out


@query(f"""WITH {_ROWS}, x AS (SELECT name, row, unnest(e) AS x FROM v), d AS (SELECT name, CASE WHEN row % 5 = 0 THEN abs(x)::DOUBLE END AS d FROM x)
  SELECT name, 'mismatched' AS status, count(*) AS n, count(d) AS mismatched, round(max(d), 6) AS max_abs_diff, round(avg(d), 6) AS mean_abs_diff, 8388608::BIGINT AS max_bit_gap FROM d GROUP BY 1""")
def lake_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base against the tuned commit, element by element: doubling moves a pattern by one step of the exponent."""
    lake, commits, _ = _history(spark, sf_dir)
    found = lake.compare(commits["base"], commits["tuned"])
    return found.select("name", "status", "n", "mismatched", F.round("max_abs_diff", 6).alias("max_abs_diff"), F.round("mean_abs_diff", 6).alias("mean_abs_diff"), "max_bit_gap")


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), s AS (SELECT CAST(256 * sum(n) AS BIGINT) AS original_bytes, CAST(sum(ceil(n / 16.0)) AS BIGINT) AS n_refs, count(*) AS n_tensors, count(*) FILTER (WHERE label < 5) AS n_low FROM n)
  SELECT message, original_bytes, n_refs, n_tensors, CASE message WHEN 'side' THEN n_tensors - n_low ELSE 0 END AS n_reused, message <> 'side' AS all_new FROM s, (VALUES ('base'), ('tuned'), ('side'), ('merged')) t(message)""")
def lake_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, chunk references and tensors of each commit, and how many tensors are those of the base as they were."""
    lake, commits, _ = _history(spark, sf_dir)
    base = lake.tensors(commits["base"]).select("name", F.col("tensor_manifest").alias("of_base"))
    out = None
    for message, commit in commits.items():
        tensors = lake.tensors(commit)
        refs = tensors.select("tensor_manifest").join(lake.table("manifest_chunks").dropDuplicates(["tensor_manifest", "chunk_no"]), "tensor_manifest").groupBy("tensor_manifest").agg(F.count("*").alias("refs"))
        reused = F.lit(False) if message == "base" else F.col("tensor_manifest") == F.col("of_base")
        own = tensors.join(refs, "tensor_manifest", "left").join(base, "name", "left").agg(
            F.sum(F.col("num_rows") * F.col("row_elems") * 4).alias("original_bytes"), F.sum("refs").alias("n_refs"), F.count("*").alias("n_tensors"), F.count_if(reused).alias("n_reused")
        ).select(F.lit(message).alias("message"), "*", (F.col("n_reused") == 0).alias("all_new"))
        out = own if out is None else out.unionByName(own)
    return out


@query("""SELECT * FROM (VALUES ('structure', 'sound', 0), ('checksum', 'sound', 0), ('content', 'sound', 0), ('tensors', 'sound', 0),
  ('structure', 'missing-chunk', 1), ('checksum', 'missing-chunk', 1), ('checksum', 'chunk-checksum', 1), ('content', 'missing-chunk', 1), ('content', 'chunk-checksum', 1)) t(tier, kind, n)""")
def lake_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four tiers over the sound lake, and three over a copy of it that lacks one chunk and has another changed."""
    lake, commits, folder = _history(spark, sf_dir)
    copy = Lake.init(spark, Scratch(spark, "damaged").root + "/lake", chunk_bytes=CHUNK)
    sync(lake, copy, "main")
    [gone, changed] = [r["object"] for r in copy.tensors(commits["base"]).join(copy.table("manifest_chunks"), "tensor_manifest").where("name = 'layer.0.weight' and chunk_no < 2").select("object", "chunk_no").distinct().orderBy("chunk_no").collect()]
    damaged = dag.cut(copy.table("chunks").where(F.col("object") != gone).withColumn("payload", F.when(F.col("object") == changed, F.concat("payload", F.lit(b"!"))).otherwise(F.col("payload"))))
    path, fs = copy._path("tables/chunks")
    fs.delete(path, True)
    copy.append("chunks", damaged)
    rows = [(tier, "sound", verify(lake, tier=tier)[1]["failures"]) for tier in ("structure", "checksum", "content", "tensors")]
    for tier in ("structure", "checksum", "content"):
        rows += [(tier, r["kind"], r["n"]) for r in verify(copy, ["main"], tier)[0].groupBy("kind").agg(F.count("*").alias("n")).collect()]
    return spark.createDataFrame(rows, "tier string, kind string, n int")


@query("""WITH n AS (SELECT count(DISTINCT label) AS n, count(DISTINCT CASE WHEN label < 5 THEN label END) AS low FROM embeddings)
  SELECT 6 + n + low AS objects, true AS same_tip, 0::BIGINT AS objects_again, 0::BIGINT AS chunks_again, 0::BIGINT AS failures FROM n""")
def lake_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A branch sent to an empty lake: two commits and checkpoints, a header, a config and their tensors' manifests; nothing is left to send, and what arrived is sound."""
    lake, commits, _ = _history(spark, sf_dir)
    target = Lake.init(spark, Scratch(spark, "peer").root + "/lake", chunk_bytes=CHUNK)
    first, again = sync(lake, target, "side"), sync(lake, target, "side", dry_run=True)
    failures = verify(target, ["side"], "tensors")[1]["failures"]
    return spark.createDataFrame([(first["objects"], target.branches()["side"] == commits["side"], again["objects"], again["chunks"], failures)], "objects long, same_tip boolean, objects_again long, chunks_again long, failures long")


@query("SELECT 'file' AS what, 2::BIGINT AS n, true AS exact UNION ALL SELECT 'range', 3, true UNION ALL SELECT 'size', 1, true")
def lake_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restored files and byte ranges (over the header's end, inside a tensor, over the file's end) against the files that were committed."""
    lake, commits, folder = _history(spark, sf_dir)
    whole = {m: b"".join(lake.file_bytes(commits[m])) for m in ("base", "tuned")}  # small files
    own = {m: bytes(spark.read.format("binaryFile").load(f"{folder}/{m}.safetensors").select("content").first()[0]) for m in whole}
    data = own["tuned"]
    begin = 8 + int.from_bytes(data[:8], "little")
    ranges = [(begin - 20, 700), (begin + 9000, 5000), (len(data) - 300, 1000)]
    exact = [lake.byte_range(commits["tuned"], a, n) == data[a : a + n] for a, n in ranges]
    return spark.createDataFrame([("file", 2, whole == own), ("range", len(exact), all(exact)), ("size", 1, lake.total_size(commits["tuned"]) == len(data))], "what string, n long, exact boolean")


@query("""WITH n AS (SELECT count(*) // 192 AS nets FROM embeddings) SELECT 'net.' || k || '.fc.' || g AS gid, 64::BIGINT AS units, 1.0::DOUBLE AS accuracy, true AS aligned FROM (SELECT unnest(range(nets)) AS k FROM n), range(2) t(g)""")
def aligned_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of three layers of 64 vectors each, whose two hidden layers are permuted: the descent finds every unit, and no residual is left."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    place = vectors.withColumnRenamed("vec_id", "at")  # numbered from 0
    nets = vectors.count() // 192

    def hidden(net: int, layer: int) -> np.ndarray:
        return (np.arange(64) * (2 * ((net + layer) % 30) + 3) + net) % 64

    def layer(table: pa.Table) -> pa.Table:
        order = np.argsort(table["at"].to_numpy())
        net, k = table["net"][0].as_py(), table["layer"][0].as_py()
        base = np.array(table["embedding"].to_pylist(), "<f4")[order]
        target = base[hidden(net, k)] if k < 2 else base
        target = np.ascontiguousarray(target[:, hidden(net, k - 1)] if k else target)
        return pa.table({"name": [f"net.{net}.fc.{k}.weight"], "dtype": ["F32"], "num_rows": pa.array([64], pa.int64()), "target": pa.array([target.tobytes()], pa.binary()), "base": pa.array([base.tobytes()], pa.binary())})

    dealt = place.where(F.col("at") < nets * 192).select("at", "embedding", F.floor(F.col("at") / 192).alias("net"), F.floor(F.pmod("at", F.lit(192)) / 64).alias("layer"))
    pairs = dag.cut(dealt.groupBy("net", "layer").applyInArrow(layer, "name string, dtype string, num_rows long, target binary, base binary"))
    groups = {}
    for k in range(nets):
        for n in range(3):
            gid = f"net.{k}.fc.{n}"
            groups[gid] = align.Group(gid, 64, [f"{gid}.weight"], [(f"net.{k}.fc.{n + 1}.weight", 1)] if n < 2 else [], pinned=n == 2)
    found = align.align(pairs, groups)
    post = {r["group"]: r["post"] for r in found.report}
    rows = [(f"net.{k}.fc.{n}", 64, align.agreement(found.perms[f"net.{k}.fc.{n}"], hidden(k, n)), post[f"net.{k}.fc.{n}"] < 1e-6) for k in range(nets) for n in range(2)]
    return spark.createDataFrame(rows, "gid string, units long, accuracy double, aligned boolean")
