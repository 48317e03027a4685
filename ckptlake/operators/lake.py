"""A lake of versioned checkpoints: content-addressed Parquet tables and a few small refs.

Tables are append-only. A commit writes objects, then manifests, then the commit
itself, and moves the branch last, so a job that dies leaves nothing that a ref
leads to, and a retry writes only what is missing. The bytes of tensors never
pass the driver; it handles names, hashes and refs.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ckptlake import ship
from ckptlake.functions import bits as bits_of
from ckptlake.functions import codec, exprs
from ckptlake.operators import dag, relational
from ckptlake.sources import safetensors as st
from ckptlake.store import Scratch
from ckptlake.types import TABLES, ConflictError, IntegrityError, NotAlignableError, NotFoundError, UsageError, width_of

BLOCK_COLUMNS = "tensor_manifest string, name string, dtype string, row_elems long, chunk_no int, row_start long, row_end long, bits binary"
#: A new full commit after so many residual ones.
REBASE_INTERVAL = 4


def canonical(value) -> bytes:
    """JSON with sorted keys and no blanks: its bytes are hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def name_of(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def valid_branch(name: str) -> bool:
    return bool(name) and not name.startswith("-") and not any(x in name for x in ("/", "\\", ".."))


def working_name(recorded: str | None) -> str:
    """The last part of a recorded file name: whatever came with a commit, nothing is written outside the folder."""
    name = re.split(r"[/\\\\]", recorded or "")[-1]
    return name if name not in ("", ".", "..") else "model.safetensors"


class Lake:
    def __init__(self, spark: SparkSession, root: str, chunk_bytes: int = 1 << 20):
        self.spark, self.root, self.chunk_bytes = spark, root.rstrip("/"), chunk_bytes
        ship(spark)

    # ---- small files, through Spark's file systems -------------------------------------------------

    def _path(self, rel: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read_small(self, rel: str) -> str | None:
        p, fs = self._path(rel)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write_small(self, rel: str, text: str) -> None:
        """Staged, then renamed to a name that isn't there yet."""
        p, fs = self._path(rel)
        staged, _ = self._path(f"tmp/{uuid.uuid4().hex}")
        out = fs.create(staged, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        if fs.exists(p) or not fs.rename(staged, p):
            fs.delete(staged, False)
            raise ConflictError(f"{rel} has been written by another")

    def _versions(self, rel: str) -> list[int]:
        p, fs = self._path(rel)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []

    def _read_ref(self, rel: str) -> str | None:
        """A ref is a folder of numbered versions, of which the last counts; an empty one says that there is none."""
        have = self._versions(rel)
        return (self._read_small(f"{rel}/{have[-1]:012d}") or None) if have else None

    def _write_ref(self, rel: str, text: str) -> None:
        """The next version, which appears whole or not at all, whatever dies; then versions before the last one go. Of two writers of one version the second fails."""
        have = self._versions(rel)
        self._write_small(f"{rel}/{have[-1] + 1 if have else 0:012d}", text)
        for n in have[:-1]:
            p, fs = self._path(f"{rel}/{n:012d}")
            fs.delete(p, False)

    def collect_garbage(self, min_age_s: float = 900) -> int:
        """Delete staging files that are older than min_age_s; the number of them."""
        p, fs = self._path("tmp")
        if not fs.exists(p):
            return 0
        old = [s.getPath() for s in fs.listStatus(p) if time.time() - s.getModificationTime() / 1000 > min_age_s]
        for path in old:
            fs.delete(path, True)
        return len(old)

    # ---- tables -------------------------------------------------------------------------------------

    def table(self, name: str) -> DataFrame:
        p, fs = self._path(f"tables/{name}")
        if not fs.exists(p):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name] + (", shard string" if name in ("chunks", "objects") else "")).parquet(f"{self.root}/tables/{name}").select(*[c.split()[0] for c in TABLES[name].split(", ")])

    def append(self, name: str, df: DataFrame) -> None:
        writer = df.select(*[c.split()[0] for c in TABLES[name].split(", ")])
        if name in ("chunks", "objects"):
            writer.withColumn("shard", F.substring("object", 1, 1)).write.partitionBy("shard").mode("append").parquet(f"{self.root}/tables/{name}")
        else:
            writer.write.mode("append").parquet(f"{self.root}/tables/{name}")

    def put_objects(self, rows: list[tuple[str, str, bytes]]) -> None:
        """Metadata objects (name, kind, bytes) that aren't there yet."""
        if rows:
            new = self.spark.createDataFrame([(o, k, bytearray(p)) for o, k, p in dict.fromkeys(rows)], TABLES["objects"]).coalesce(1)  # one file a shard
            self.append("objects", relational.absent(new, self.table("objects")))

    def get_object(self, name: str) -> bytes:
        row = self.table("objects").where(F.col("object") == name).select("payload").first()
        if row is None:
            raise NotFoundError(f"no object {name}")
        return bytes(row[0])

    # ---- refs ---------------------------------------------------------------------------------------

    @classmethod
    def init(cls, spark: SparkSession, root: str, branch: str = "main", chunk_bytes: int = 1 << 20) -> Lake:
        if not valid_branch(branch):
            raise UsageError(f"{branch!r} can't name a branch")
        lake = cls(spark, root, chunk_bytes)
        if lake._read_ref("HEAD") is not None:
            raise UsageError(f"{root} is a lake already")
        lake._write_small("config", json.dumps({"chunk_bytes": chunk_bytes}))
        lake._write_ref("HEAD", f"ref: {branch}")
        return lake

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Lake:
        lake = cls(spark, root)
        config = lake._read_small("config")
        if config is None:
            raise NotFoundError(f"no lake at {root}")
        lake.chunk_bytes = json.loads(config)["chunk_bytes"]
        return lake

    def head(self) -> tuple[str | None, str | None]:
        """(branch, commit): no branch if detached, no commit if the branch is unborn."""
        text = self._read_ref("HEAD") or ""
        if text.startswith("ref: "):
            return text[5:], self._read_ref(f"refs/{text[5:]}")
        return None, text

    def branches(self) -> dict[str, str]:
        p, fs = self._path("refs")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return {n: commit for n in names if (commit := self._read_ref(f"refs/{n}"))}

    def update_ref(self, branch: str, commit: str) -> None:
        if not valid_branch(branch):
            raise UsageError(f"{branch!r} can't name a branch")
        self._write_ref(f"refs/{branch}", commit)

    def create_branch(self, branch: str, at: str = "HEAD") -> None:
        if branch in self.branches():
            raise UsageError(f"there is a branch {branch}")
        self.update_ref(branch, self.resolve(at))

    def delete_branch(self, branch: str) -> None:
        if branch == self.head()[0]:
            raise UsageError("the branch is checked out")
        if branch not in self.branches():
            raise NotFoundError(f"no branch {branch}")
        self._write_ref(f"refs/{branch}", "")  # from here on there is no such branch
        p, fs = self._path(f"refs/{branch}")
        fs.delete(p, True)

    def rename_branch(self, old: str, new: str) -> None:
        """The new ref first, the old one's end after it, HEAD last."""
        commit = self.branches().get(old)
        if commit is None:
            raise NotFoundError(f"no branch {old}")
        attached = self.head()[0] == old
        self.create_branch(new, commit)
        if attached:
            self._write_ref("HEAD", f"ref: {new}")
        self.delete_branch(old)

    def set_head(self, target: str) -> None:
        self._write_ref("HEAD", f"ref: {target}" if target in self.branches() else self.resolve(target))

    def resolve(self, ref: str) -> str:
        """A commit by HEAD, branch, hash, or at least 6 digits of one; with ~N, the Nth first parent of it."""
        if m := re.fullmatch(r"(.+)~(\d+)", ref):
            chain = {r["depth"]: r["commit"] for r in self.log(self.resolve(m[1]), int(m[2]) + 1).collect()}
            if int(m[2]) not in chain:
                raise NotFoundError(f"{ref} is before the first commit")
            return chain[int(m[2])]
        if ref == "HEAD":
            if (commit := self.head()[1]) is None:
                raise NotFoundError("HEAD has no commit yet")
            return commit
        if valid_branch(ref) and (commit := self._read_ref(f"refs/{ref}")) is not None:
            return commit
        if not re.fullmatch(r"[0-9a-f]{6,64}", ref):
            raise NotFoundError(f"no branch or commit {ref}")
        found = self.table("commits").where(F.col("commit").startswith(ref)).select("commit").distinct().limit(2).collect()
        if not found:
            raise NotFoundError(f"no commit {ref}")
        if len(found) > 1:
            raise UsageError(f"{ref} is the start of several commits")
        return found[0][0]

    # ---- graph --------------------------------------------------------------------------------------

    def edges(self) -> DataFrame:
        return self.table("commits").dropDuplicates(["commit"]).select(F.col("commit").alias("child"), F.posexplode("parents").alias("ord", "parent"))

    def log(self, commit: str, limit: int = 1000) -> DataFrame:
        if limit < 1:
            raise UsageError("a log of no commits")
        chain = dag.first_parents(self.edges(), commit, limit).withColumnRenamed("node", "commit")
        labels = self.spark.createDataFrame([(c, b) for b, c in self.branches().items()], "commit string, branch string").groupBy("commit").agg(F.array_sort(F.collect_list("branch")).alias("branches"))
        commits = self.table("commits").dropDuplicates(["commit"])
        return chain.join(commits, "commit", "left").join(labels, "commit", "left").orderBy("depth")

    def merge_base(self, ours: str, theirs: str) -> str | None:
        row = dag.merge_base(self.edges(), ours, theirs).first()
        return row["node"] if row else None

    def star_state(self, commit: str | None) -> tuple[str | None, int]:
        """The last full commit along first parents, and the commits since."""
        if commit is None:
            return None, 0
        for r in self.log(commit, REBASE_INTERVAL + 1).select("depth", "commit", "full").collect():  # where it mostly is
            if r["full"]:
                return r["commit"], r["depth"]
        commits = self.table("commits").dropDuplicates(["commit"]).select(F.col("commit").alias("node"), F.get("parents", F.lit(0)).alias("parent"), "full")
        found = dag.nearest_full(commits).where(F.col("node") == commit).first()
        return (found["anchor"], found["since"]) if found else (None, 0)

    def tensors(self, commit: str) -> DataFrame:
        """The tensor manifests of a commit, with their names."""
        checkpoint = self.table("commits").where(F.col("commit") == commit).select("checkpoint").distinct()
        names = self.table("checkpoint_tensors").join(checkpoint, "checkpoint").select("name", "tensor_manifest").distinct()
        return names.join(self.table("tensor_manifests").dropDuplicates(["tensor_manifest"]).drop("name"), "tensor_manifest")

    # ---- reconstruction -----------------------------------------------------------------------------

    def permutations(self, names: DataFrame) -> DataFrame:
        """(perm, target_idx, base_idx) of stored permutations, checked."""

        def run(batches):
            for batch in batches:
                for name, payload in zip(batch.column("object").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                    if len(payload) % 4:
                        raise IntegrityError(f"permutation {name} has {len(payload)} bytes")
                    p = np.frombuffer(payload, "<i4")
                    if not np.array_equal(np.sort(p), np.arange(len(p))):
                        raise IntegrityError(f"{name} isn't a permutation")
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(p)), pa.array(np.arange(len(p), dtype=np.int64)), pa.array(p.astype(np.int64))], ["perm", "target_idx", "base_idx"])

        wanted = names.where("perm is not null").select(F.col("perm").alias("object")).distinct()
        return self.table("objects").join(wanted, "object").select("object", "payload").dropDuplicates(["object"]).mapInArrow(run, "perm string, target_idx long, base_idx long")

    def align_blocks(self, blocks: DataFrame, plan: DataFrame) -> DataFrame:
        """Base blocks in the order of their targets: (target, chunk_no, base_bits).

        blocks: (key, row_elems, dtype, chunk_no, row_start, row_end, bits); plan:
        (target, key, row_perm, col_perm, col_block, rows_per_chunk). Targets without
        permutation keep their blocks; only the others are taken apart into rows.
        """
        straight = plan.where("row_perm is null and col_perm is null").join(blocks, "key").select("target", "chunk_no", F.col("bits").alias("base_bits"))
        moved = plan.where("row_perm is not null or col_perm is not null")
        if not moved.limit(1).count():
            return straight

        def rows(batches):
            for batch in batches:
                for key, elems, dtype, start, end, data in zip(*(batch.column(c).to_pylist() for c in ("key", "row_elems", "dtype", "row_start", "row_end", "bits")), strict=True):
                    step = elems * width_of(dtype)
                    n = end - start + 1
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array(np.arange(start, end + 1)), pa.array([data[k * step : (k + 1) * step] for k in range(n)], pa.binary())], ["key", "base_idx", "row_bits"])

        taken = blocks.join(moved.select("key").distinct(), "key").select("key", "row_elems", "dtype", "row_start", "row_end", "bits").mapInArrow(rows, "key string, base_idx long, row_bits binary")
        perms = self.permutations(moved.select(F.col("row_perm").alias("perm"))).withColumnRenamed("perm", "row_perm")
        by_perm = moved.where("row_perm is not null").join(taken, "key").join(perms, ["row_perm", "base_idx"])
        own = moved.where("row_perm is null").join(taken, "key").withColumn("target_idx", F.col("base_idx"))
        columns = ["target", "col_perm", "col_block", "width", "rows_per_chunk", "target_idx", "row_bits"]
        cols = self.table("objects").select(F.col("object").alias("col_perm"), F.col("payload").alias("col_order")).dropDuplicates(["col_perm"])
        all_rows = by_perm.select(*columns).unionByName(own.select(*columns)).join(cols, "col_perm", "left").withColumn("chunk_no", F.floor(F.col("target_idx") / F.col("rows_per_chunk")).cast("int"))

        def chunk(table: pa.Table) -> pa.Table:
            order = np.argsort(table["target_idx"].to_numpy())
            data = [table["row_bits"][int(k)].as_py() for k in order]
            width, block, perm = table["width"][0].as_py(), table["col_block"][0].as_py(), table["col_order"][0].as_py()
            joined = b"".join(data)
            if perm is not None:
                m = np.frombuffer(joined, f"<u{width}").reshape(len(data), -1, block or 1)
                joined = np.ascontiguousarray(m[:, np.frombuffer(perm, "<i4")]).tobytes()
            return pa.table({"target": [table["target"][0].as_py()], "chunk_no": pa.array([table["chunk_no"][0].as_py()], pa.int32()), "base_bits": pa.array([joined], pa.binary())})

        gathered = all_rows.groupBy("target", "chunk_no").applyInArrow(chunk, "target string, chunk_no int, base_bits binary")
        return straight.unionByName(gathered)

    def blocks(self, wanted: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """Decoded blocks of manifests (tensor_manifest), level by level from the roots of their chains.

        rows: (tensor_manifest, start, stop) keeps the chunks that hold some of those rows, at the last level only.
        """
        manifests = self.table("tensor_manifests").dropDuplicates(["tensor_manifest"])
        refs = self.table("manifest_chunks").dropDuplicates(["tensor_manifest", "chunk_no"])
        chunks = self.table("chunks").dropDuplicates(["object"]).select("object", "payload")
        scratch = Scratch(self.spark, "blocks")
        levels = [scratch.save(wanted.select("tensor_manifest").distinct(), "level")]
        while True:
            below = manifests.join(levels[-1], "tensor_manifest").where("base_manifest is not null").select(F.col("base_manifest").alias("tensor_manifest")).distinct()
            below, n = scratch.counted(below, "level")
            if not n:
                break
            levels.append(below)
        decoded = None

        def decode(batches):
            keep = ["tensor_manifest", "name", "dtype", "row_elems", "chunk_no", "row_start", "row_end"]
            for batch in batches:
                for k in range(batch.num_rows):
                    one = batch.slice(k, 1)
                    get = lambda c, one=one: one.column(c)[0].as_py()
                    if get("payload") is None:
                        raise IntegrityError(f"chunk {get('object')} is missing")
                    base = get("base_bits") if get("encoding") in (codec.DELTA, codec.ZIGZAG) else None
                    data = codec.decode_chunk(get("encoding"), get("payload"), base, get("dtype"))
                    yield pa.RecordBatch.from_arrays([*(one.column(c) for c in keep), pa.array([data], pa.binary())], [*keep, "bits"])

        for k, level in reversed(list(enumerate(levels))):
            at = level.join(manifests, "tensor_manifest").join(refs, "tensor_manifest")
            if rows is not None and k == 0:
                at = at.join(rows, "tensor_manifest").where(exprs.overlaps(F.col("row_start"), F.col("row_end") + 1, F.col("start"), F.col("stop"))).drop("start", "stop").dropDuplicates(["tensor_manifest", "chunk_no"])
            at = at.join(chunks, "object", "left")
            if decoded is None:
                at = at.withColumn("base_bits", F.lit(None).cast("binary"))
            else:
                steps = refs.groupBy("tensor_manifest").agg(F.max(F.col("row_end") - F.col("row_start") + 1).alias("rows_per_chunk"))
                plan = level.join(manifests, "tensor_manifest").where("base_manifest is not null").join(steps, "tensor_manifest").select(F.col("tensor_manifest").alias("target"), F.col("base_manifest").alias("key"), "row_perm", "col_perm", "col_block", "rows_per_chunk", _width().alias("width"))
                base = self.align_blocks(decoded.withColumnRenamed("tensor_manifest", "key"), plan).withColumnRenamed("target", "tensor_manifest")
                at = at.join(base, ["tensor_manifest", "chunk_no"], "left")
            decoded = dag.cut(at.mapInArrow(decode, BLOCK_COLUMNS)) if k else at.mapInArrow(decode, BLOCK_COLUMNS)
        return decoded

    def read_rows(self, commit: str, name: str, start: int, stop: int) -> np.ndarray:
        """Rows [start, stop) of a tensor; only the chunks that hold them are read."""
        row = self.tensors(commit).where(F.col("name") == name).first()
        if row is None:
            raise NotFoundError(f"no tensor {name}")
        wanted = self.spark.createDataFrame([(row["tensor_manifest"], start, stop)], "tensor_manifest string, start long, stop long")
        parts = sorted((r["row_start"], bytes(r["bits"])) for r in self.blocks(wanted, wanted).collect())
        kind = f"<u{width_of(row['dtype'])}"
        if not parts:
            return np.zeros((0, row["row_elems"]), kind)
        all_rows = np.frombuffer(b"".join(b for _, b in parts), kind).reshape(-1, row["row_elems"])
        return all_rows[start - parts[0][0] : stop - parts[0][0]]

    def header(self, commit: str) -> bytes:
        row = self.table("commits").where(F.col("commit") == commit).join(self.table("checkpoints"), "checkpoint").select("header_object").first()
        if row is None:
            raise NotFoundError(f"no commit {commit}")
        return self.get_object(row[0])

    def file_bytes(self, commit: str):
        """The committed file's bytes, part by part in order: header, then chunks by offset; one at a time on the driver."""
        header = self.header(commit)
        layout = st.header_layout(header)
        st.check_tiling(layout)
        yield len(header).to_bytes(8, "little") + header
        place = self.spark.createDataFrame(layout, "name string, begin long, end long")
        names = self.tensors(commit).select("tensor_manifest", "name")
        blocks = self.blocks(names).drop("name").join(names, "tensor_manifest").join(place, "name")
        for r in blocks.select("begin", "row_start", "bits").orderBy("begin", "row_start").toLocalIterator():
            yield bytes(r["bits"])

    def restore(self, commit: str, path: str) -> str:
        """Write the committed file to a path of this machine, staged; its digest."""
        import os

        h, staged = hashlib.sha256(), f"{path}.{uuid.uuid4().hex}"
        try:
            with open(staged, "wb") as f:
                for part in self.file_bytes(commit):
                    f.write(part)
                    h.update(part)
                f.flush()
                os.fsync(f.fileno())
            os.replace(staged, path)
        finally:
            if os.path.exists(staged):
                os.unlink(staged)
        return h.hexdigest()

    def byte_range(self, commit: str, offset: int, size: int) -> bytes:
        """Bytes of the committed file: whichever of header and chunks lie in the range."""
        header = self.header(commit)
        head = len(header).to_bytes(8, "little") + header
        out = head[offset : offset + size]
        begin, end = max(0, offset - len(head)), offset + size - len(head)
        specs = [s for s in st.parse_header(header) if s.begin < end and begin < s.end]
        for s in sorted(specs, key=lambda s: s.begin):
            a, b = max(begin, s.begin) - s.begin, min(end, s.end) - s.begin
            first, last = a // s.row_bytes, -(-b // s.row_bytes)
            data = self.read_rows(commit, s.name, first, last).tobytes()
            out += data[a - first * s.row_bytes : b - first * s.row_bytes]
        return out

    def config(self, commit: str) -> dict | None:
        """The commit's config, if it is a JSON object."""
        row = self.table("commits").where(F.col("commit") == commit).join(self.table("checkpoints"), "checkpoint").select("config_object").first()
        try:
            found = json.loads(self.get_object(row[0])) if row else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def checkout(self, ref: str, folder: str | None = None) -> dict:
        """Write the commit's file to a folder of this machine (none: write nothing), then move HEAD: to the branch, or detached."""
        commit = self.resolve(ref)
        row = self.table("commits").where(F.col("commit") == commit).first()
        if row is None:
            raise NotFoundError(f"no commit {commit}")
        path = None if folder is None else f"{folder.rstrip('/')}/{working_name(row['checkpoint_name'])}"
        digest = self.restore(commit, path) if path else None
        self.set_head(ref if ref in self.branches() else commit)
        return {"commit": commit, "branch": ref if ref in self.branches() else None, "path": path, "sha256": digest, "message": row["message"]}

    def namespace(self) -> DataFrame:
        """(path, commit, size) of every file that can be read: the tips by branch, and all commits that branches lead to by hash; sizes come from headers alone."""
        tips = self.spark.createDataFrame(list(self.branches().items()), "branch string, commit string")
        all_ = dag.reachable(self.edges(), tips.select(F.col("commit").alias("node"))).select(F.col("node").alias("commit"))
        commits = all_.join(self.table("commits").dropDuplicates(["commit"]), "commit")
        headers = commits.select("commit", "checkpoint", "checkpoint_name").join(self.table("checkpoints").dropDuplicates(["checkpoint"]), "checkpoint")
        tensors = headers.join(self.table("checkpoint_tensors").distinct(), "checkpoint").join(self.table("tensor_manifests").dropDuplicates(["tensor_manifest"]).select("tensor_manifest", "num_rows", "row_elems", _width().alias("width")), "tensor_manifest")
        data = tensors.groupBy("commit").agg(F.sum(F.col("num_rows") * F.col("row_elems") * F.col("width")).alias("data"))
        objects = self.table("objects").dropDuplicates(["object"]).select(F.col("object").alias("header_object"), F.length("payload").alias("head"))
        sized = headers.join(objects, "header_object").join(data, "commit", "left").select("commit", F.col("checkpoint_name").alias("name"), (F.col("head") + 8 + F.coalesce("data", F.lit(0))).cast("long").alias("size"))
        by_branch = sized.join(tips, "commit").select(F.concat(F.lit("/"), "branch", F.lit("/"), "name").alias("path"), "commit", "size")
        return sized.select(F.concat(F.lit("/commits/"), "commit", F.lit("/"), "name").alias("path"), "commit", "size").unionByName(by_branch)

    @classmethod
    def discover(cls, spark: SparkSession, start: str) -> Lake:
        """The lake at a folder, or at the nearest folder above it."""
        at = spark._jvm.org.apache.hadoop.fs.Path(start)
        while at is not None:
            if cls(spark, at.toString())._read_ref("HEAD") is not None:
                return cls.open(spark, at.toString())
            at = at.getParent()
        raise NotFoundError(f"no lake at {start} or above it")

    def total_size(self, commit: str) -> int:
        header = self.header(commit)
        return 8 + len(header) + max((s.end for s in st.parse_header(header)), default=0)

    # ---- commit -------------------------------------------------------------------------------------

    def commit(self, path: str, message: str, config: bytes | None = None, alignment: dict[str, tuple] | None = None, full: bool | None = None, parents: list[str] | None = None, ts: str | None = None, adaptive: bool = False, align: bool = False) -> dict:
        """Commit a checkpoint file to the branch that HEAD is on.

        Residuals are taken from the last full commit, and every fourth commit is
        full. adaptive: they are taken from the commit before instead, and a tensor
        whose residual saves too little, or whose chain is long, starts anew; if most
        do, the commit is full. alignment: name -> (row permutation, column
        permutation, columns a block), of base indices for target indices, None for
        the identity. align: find it; if most tensors can't be aligned, the commit is
        full.
        """
        branch, tip = self.head()
        if branch is None:
            raise UsageError("HEAD is detached")
        base, since = self.star_state(tip)
        base = tip if adaptive else base
        full = full if full is not None else base is None or not adaptive and since >= REBASE_INTERVAL - 1
        base = None if full else base
        notes: list[str] = []
        if align and base is not None:
            from ckptlake.operators.align import align_commit

            found = align_commit(self, path, base)
            poor = sum(not r["alignable"] for r in found.report)
            if 2 * poor > len(found.report):
                notes.append(f"{poor} of {len(found.report)} tensors can't be aligned: stored in full")
                base, full = None, True
            else:
                alignment = found.plan()
        if config is None and tip is None:
            raise UsageError("a first commit needs its config")
        specs = [r.asDict() for r in st.scan_headers(self.spark, path).collect()]
        target = st.scan_blocks(self.spark, path, self.chunk_bytes)
        digests = {r["name"]: r["content_hash"] for r in st.scan_digests(self.spark, path).collect()}
        return self._store(specs, target, digests, st.header_bytes(self.spark, path), message, path.rpartition("/")[2], branch, tip, base, full, config, alignment, parents, ts, adaptive, notes)

    def commit_blocks(self, blocks: DataFrame, header: bytes, message: str, parents: list[str], config: bytes | None = None, name: str = "model.safetensors", ts: str | None = None) -> dict:
        """Commit, in full, a written table of blocks (as scan_blocks gives them) under a header. No tensor passes the driver: digests are taken from the blocks in their order, a tensor a group."""
        branch, tip = self.head()
        specs = [dict(zip([c.split()[0] for c in st.HEADER_FIELDS.split(", ")], s.fields(), strict=True)) for s in st.parse_header(header)]
        digests = {s["name"]: name_of(b"") for s in specs} | {r["name"]: r["actual"] for r in _ordered_digests(blocks, "name").collect()}
        return self._store(specs, blocks, digests, header, message, name, branch, tip, None, True, config, None, parents, ts, False, [])

    def _store(self, specs: list[dict], target: DataFrame, digests: dict[str, str], header: bytes, message: str, file_name: str, branch: str, tip, base, full, config, alignment, parents, ts, adaptive: bool, notes: list[str]) -> dict:
        staged = f"{self.root}/tmp/{uuid.uuid4().hex}"
        known: dict[str, str] = {}
        if base is not None:
            have = {r["name"]: r for r in self.tensors(base).collect()}
            for s in specs:
                r = have.get(s["name"])
                if r is None:
                    notes.append(f"{s['name']}: not in the base")
                elif list(r["shape"]) != list(s["shape"]) or r["dtype"] != s["dtype"]:
                    notes.append(f"{s['name']}: another shape or type in the base")
                else:
                    known[s["name"]] = r["tensor_manifest"]
        perm_names: dict[str, tuple] = {}
        perm_rows = []
        for name, (row, col, block) in (alignment or {}).items():
            if name in known:
                found = []
                for p in (row, col):
                    data = None if p is None else np.asarray(p, "<i4").tobytes()
                    found.append(None if data is None else name_of(data))
                    if data is not None:
                        perm_rows.append((found[-1], "permutation", data))
                perm_names[name] = (*found, block)
        self.put_objects(perm_rows)
        plan_rows = [(s["name"], known[s["name"]], *perm_names.get(s["name"], (None, None, None)), max(1, self.chunk_bytes // max(1, s["row_elems"] * s["width"])), s["width"]) for s in specs if s["name"] in known]
        plan = self.spark.createDataFrame(plan_rows, "target string, key string, row_perm string, col_perm string, col_block long, rows_per_chunk long, width int")
        if plan_rows:
            decoded = self.blocks(plan.select(F.col("key").alias("tensor_manifest"))).withColumnRenamed("tensor_manifest", "key")
            pairs = target.join(self.align_blocks(decoded, plan).withColumnRenamed("target", "name"), ["name", "chunk_no"], "left")
        else:
            pairs = target.withColumn("base_bits", F.lit(None).cast("binary"))
        pairs.mapInArrow(_encode, _ENCODED).write.parquet(staged)
        encoded = self.spark.read.schema(_ENCODED).parquet(staged)
        promoted: list[str] = []
        if adaptive and known:
            promoted = self._promoted(encoded, specs, known)
            if 2 * len(promoted) > len(known):
                notes.append(f"{len(promoted)} of {len(known)} tensors start anew: stored in full")
                promoted, full, base = list(known), True, None
            if promoted:
                again = target.where(F.col("name").isin(promoted)).withColumn("base_bits", F.lit(None).cast("binary"))
                again.mapInArrow(_encode, _ENCODED).write.parquet(f"{staged}-anew")
                encoded = encoded.where(~F.col("name").isin(promoted)).unionByName(self.spark.read.schema(_ENCODED).parquet(f"{staged}-anew"))
                for name in promoted:
                    known.pop(name)
        new = relational.absent(encoded.select("object", "plain_len", F.length("payload").cast("long").alias("stored_len"), F.col("checksum").alias("stored_checksum"), "payload"), self.table("chunks"))
        rows = encoded.select("name", "chunk_no", "row_start", "row_end", "encoding", "object", "plain_len", "checksum", "identical", F.length("payload").alias("stored")).orderBy("name", "chunk_no").collect()
        by_name: dict[str, list] = {}
        for r in rows:
            by_name.setdefault(r["name"], []).append(r)
        manifests, entries, manifest_chunks, reused = {}, [], [], []
        for s in specs:
            own = by_name.get(s["name"], [])
            base_manifest, perms = known.get(s["name"]), perm_names.get(s["name"], (None, None, None))
            if base_manifest and perms[:2] == (None, None) and all(r["identical"] for r in own):
                manifests[s["name"]] = base_manifest
                reused.append(s["name"])
                continue
            pointer = base_manifest if any(r["encoding"] in (codec.DELTA, codec.ZIGZAG) for r in own) else None
            perms = perms if pointer else (None, None, None)
            body = {
                "name": s["name"], "dtype": s["dtype"], "shape": list(s["shape"]), "content_hash": digests[s["name"]], "base_tensor_manifest": pointer,
                "base_row_permutation": perms[0], "base_col_permutation": perms[1], "col_block_size": perms[2],
                "chunks": [{"row_start": r["row_start"], "row_end": r["row_end"], "encoding": r["encoding"], "object": r["object"], "plain_len": r["plain_len"], "stored_checksum": r["checksum"]} for r in own],
            }
            data = canonical(body)
            m = name_of(data)
            manifests[s["name"]] = m
            entries.append((m, data, (m, s["name"], s["dtype"], list(s["shape"]), s["num_rows"], s["row_elems"], digests[s["name"]], pointer, *perms)))
            manifest_chunks += [(m, r["chunk_no"], r["row_start"], r["row_end"], r["encoding"], r["object"], r["plain_len"], r["checksum"]) for r in own]
        kept = {m for m, _, _ in entries}
        used = self.spark.createDataFrame(list({(r[5],) for r in manifest_chunks}), "object string")
        self.append("chunks", new.join(used, "object", "left_semi"))
        stored_new = [r for r in rows if r["name"] not in reused]
        config_name = name_of(config) if config is not None else self.table("commits").where(F.col("commit") == tip).join(self.table("checkpoints"), "checkpoint").select("config_object").first()[0]
        checkpoint_body = canonical({"header_object": name_of(header), "tensors": manifests, "topology_config_hash": config_name})
        checkpoint = name_of(checkpoint_body)
        self.put_objects([(name_of(header), "header", header), *([(config_name, "config", config)] if config is not None else []), *((m, "tensor-manifest", d) for m, d, _ in entries), (checkpoint, "checkpoint", checkpoint_body)])
        have_manifests = {r[0] for r in self.table("tensor_manifests").where(F.col("tensor_manifest").isin(list(kept) or [""])).select("tensor_manifest").distinct().collect()}
        if fresh := [e for _, _, e in entries if e[0] not in have_manifests]:
            self.append("tensor_manifests", self.spark.createDataFrame(list(dict((e[0], e) for e in fresh).values()), TABLES["tensor_manifests"]).coalesce(1))
            if own_chunks := [c for c in manifest_chunks if c[0] not in have_manifests]:
                self.append("manifest_chunks", self.spark.createDataFrame(list(dict.fromkeys(own_chunks)), TABLES["manifest_chunks"]).coalesce(1))
        if not self.table("checkpoints").where(F.col("checkpoint") == checkpoint).limit(1).count():
            if manifests:
                self.append("checkpoint_tensors", self.spark.createDataFrame([(checkpoint, n, m) for n, m in manifests.items()], TABLES["checkpoint_tensors"]).coalesce(1))
            self.append("checkpoints", self.spark.createDataFrame([(checkpoint, name_of(header), config_name)], TABLES["checkpoints"]).coalesce(1))
        commit = self.write_commit(checkpoint, parents or ([tip] if tip else []), message, full, file_name, ts)
        self.update_ref(branch, commit)
        for made in (staged, f"{staged}-anew"):
            p, fs = self._path(made[len(self.root) + 1 :])
            fs.delete(p, True)
        original = sum(s["nbytes"] for s in specs)
        stored = sum({r["object"]: r["stored"] for r in stored_new}.values())
        return {"commit": commit, "full": full, "base": base, "tensors": len(specs), "reused": sorted(reused), "original_bytes": original, "stored_bytes": stored, "ratio": stored / original if original else 0.0, "promoted": sorted(promoted), "notes": notes}

    def _promoted(self, encoded: DataFrame, specs, known: dict[str, str]) -> list[str]:
        """Tensors that start a new chain, by the ratio of their residual and the depth of their base."""
        bases = self.spark.createDataFrame(list(known.items()), "name string, manifest string")
        chains = dag.chain_roots(self.table("tensor_manifests").select(F.col("tensor_manifest").alias("manifest"), F.col("base_manifest").alias("base")).distinct())
        sizes = self.spark.createDataFrame([(s["name"], s["nbytes"]) for s in specs], "name string, nbytes long")
        stored = encoded.groupBy("name").agg(F.sum(F.when(F.col("identical"), 0).otherwise(F.length("payload"))).alias("stored"))
        at = bases.join(chains, "manifest", "left").join(sizes, "name").join(stored, "name")
        decision = exprs.anchor_decision(F.coalesce(F.try_divide("stored", "nbytes"), F.lit(0.0)), F.coalesce("hops", F.lit(0)))
        return [r["name"] for r in at.where((decision == "anchor") & (F.col("stored") > 0)).select("name").collect()]

    def write_commit(self, checkpoint: str, parents: list[str], message: str, full: bool, checkpoint_name: str, ts: str | None = None) -> str:
        ts = ts or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        body = canonical({"checkpoint_manifest": checkpoint, "parents": parents, "timestamp": ts, "message": message, "full": full, "checkpoint_name": checkpoint_name})
        commit = name_of(body)
        self.put_objects([(commit, "commit", body)])
        if not self.table("commits").where(F.col("commit") == commit).limit(1).count():
            self.append("commits", self.spark.createDataFrame([(commit, checkpoint, parents, ts, message, full, checkpoint_name)], TABLES["commits"]).coalesce(1))
        return commit

    def sizes(self, commit: str) -> dict:
        """Original bytes, and references and distinct chunks with their stored bytes."""
        names = self.tensors(commit).select("tensor_manifest", "dtype", "num_rows", "row_elems")
        refs = names.join(self.table("manifest_chunks").dropDuplicates(["tensor_manifest", "chunk_no"]), "tensor_manifest").join(self.table("chunks").dropDuplicates(["object"]).select("object", "stored_len"), "object")
        original = names.select((F.col("num_rows") * F.col("row_elems") * _width()).alias("n")).agg(F.sum("n")).first()[0]
        r = relational.checkpoint_sizes(refs.withColumn("g", F.lit(0)), "g", "object", "stored_len").first()
        return {"original_bytes": original or 0, "n_refs": r["n_refs"] if r else 0, "n_objects": r["n_objects"] if r else 0, "stored_bytes": r["stored_bytes"] if r else 0}

    def minimum_bytes(self, commits: list[str]) -> int:
        """Stored bytes of the distinct chunks that it takes to rebuild the commits, bases included."""
        own = self.spark.createDataFrame([(c,) for c in commits], "commit string").join(self.table("commits").select("commit", "checkpoint").distinct(), "commit").join(self.table("checkpoint_tensors").distinct(), "checkpoint")
        manifests = self.table("tensor_manifests").dropDuplicates(["tensor_manifest"])
        edges = manifests.where("base_manifest is not null").select(F.col("tensor_manifest").alias("child"), F.col("base_manifest").alias("parent"))
        needed = dag.reachable(edges, own.select(F.col("tensor_manifest").alias("node"))).select(F.col("node").alias("tensor_manifest"))
        objects = needed.join(self.table("manifest_chunks"), "tensor_manifest").select("object").distinct()
        return objects.join(self.table("chunks").dropDuplicates(["object"]), "object").agg(F.sum("stored_len")).first()[0] or 0

    # ---- compare ------------------------------------------------------------------------------------

    def compare(self, left: str, right: str) -> DataFrame:
        """(name, status, n, mismatched, max_abs_diff, mean_abs_diff, max_bit_gap) for the tensors of two commits."""
        sides = []
        for commit, tag in ((left, "l"), (right, "r")):
            names = self.tensors(commit).select("name", "tensor_manifest", "dtype", "shape")
            sides.append(names.select("name", *(F.col(c).alias(f"{tag}_{c}") for c in ("tensor_manifest", "dtype", "shape"))))
        both = sides[0].join(sides[1], "name", "full_outer")
        status = F.when(F.col("l_tensor_manifest").isNull(), "missing_left").when(F.col("r_tensor_manifest").isNull(), "missing_right").when((F.col("l_shape") != F.col("r_shape")) | (F.col("l_dtype") != F.col("r_dtype")), "incompatible")
        both = dag.cut(both.withColumn("status", status))
        same = both.where("status is null")
        blocks = []
        for tag in "lr":
            own = self.blocks(same.select(F.col(f"{tag}_tensor_manifest").alias("tensor_manifest"))).drop("name").join(same.select("name", F.col(f"{tag}_tensor_manifest").alias("tensor_manifest")), "tensor_manifest")
            blocks.append(own.select("name", "chunk_no", "dtype", F.col("bits").alias(f"{tag}_bits")))
        parts = blocks[0].join(blocks[1].drop("dtype"), ["name", "chunk_no"]).mapInArrow(_compare, "name string, n long, bad long, worst double, total double, gap long")
        sums = parts.groupBy("name").agg(F.sum("n").alias("n"), F.sum("bad").alias("mismatched"), F.max("worst").alias("max_abs_diff"), F.try_divide(F.sum("total"), F.sum("bad")).alias("mean_abs_diff"), F.max("gap").alias("max_bit_gap"))
        return both.select("name", "status").join(sums, "name", "left").withColumn("status", F.coalesce("status", F.when(F.coalesce("mismatched", F.lit(0)) == 0, "equal").otherwise("mismatched"))).orderBy("name")


def _width():
    out = F.lit(None).cast("int")
    for name in ("F16", "BF16", "F32", "I64"):
        out = F.when(F.col("dtype") == name, width_of(name)).otherwise(out)
    return out


_ENCODED = "name string, chunk_no int, row_start long, row_end long, encoding string, object string, checksum string, plain_len long, identical boolean, payload binary"


def _encode(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            one = batch.slice(k, 1)
            e = codec.encode_chunk(one.column("bits")[0].as_py(), one.column("base_bits")[0].as_py(), one.column("dtype")[0].as_py())
            yield pa.RecordBatch.from_arrays(
                [*(one.column(c) for c in ("name", "chunk_no", "row_start", "row_end")), pa.array([e.encoding]), pa.array([e.object]), pa.array([e.checksum]), pa.array([e.plain_len], pa.int64()), pa.array([bool(e.identical)]), pa.array([e.payload], pa.binary())],
                ["name", "chunk_no", "row_start", "row_end", "encoding", "object", "checksum", "plain_len", "identical", "payload"],
            )


def _compare(batches):
    for batch in batches:
        out = []
        for name, dtype, a, b in zip(*(batch.column(c).to_pylist() for c in ("name", "dtype", "l_bits", "r_bits")), strict=True):
            kind = f"<u{width_of(dtype)}"
            x, y = np.frombuffer(a, kind), np.frombuffer(b, kind)
            differ = x != y
            if not differ.any():
                out.append((name, len(x), 0, 0.0, 0.0, 0))
                continue
            with np.errstate(all="ignore"):
                d = np.abs(bits_of.widen(x[differ], dtype).astype(np.float64) - bits_of.widen(y[differ], dtype).astype(np.float64))
            d = d[np.isfinite(d)]
            gap = 0 if kind == "<u8" else int(np.abs(x[differ].astype(np.int64) - y[differ].astype(np.int64)).max())
            out.append((name, len(x), int(differ.sum()), float(d.max(initial=0)), float(d.sum()), gap))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["name", "n", "bad", "worst", "total", "gap"])


# ---- verify ---------------------------------------------------------------------------------------------

TIERS = ("structure", "checksum", "content", "tensors")


def verify(lake: Lake, refs: list[str] | None = None, tier: str = "content", most: int = 100) -> tuple[DataFrame, dict]:
    """Failures (kind, object, referenced_by) of all that the refs lead to, at most ``most`` of them, and counters.

    structure: metadata objects hash to their names and chunks exist; checksum: and
    stored bytes match their manifests; content: and decompress to what they are
    named after; tensors: and every tensor, decoded, has its content hash.
    """
    spark, level = lake.spark, TIERS.index(tier)
    roots = [lake.resolve(r) for r in refs] if refs else sorted({*lake.branches().values(), *filter(None, [lake.head()[1]])})
    reach = dag.reachable(lake.edges(), spark.createDataFrame([(r,) for r in roots], "node string")).select(F.col("node").alias("commit"))
    commits = dag.cut(reach.join(lake.table("commits").dropDuplicates(["commit"]), "commit", "left"))
    checkpoints = commits.where("checkpoint is not null").select("commit", "checkpoint").join(lake.table("checkpoints").dropDuplicates(["checkpoint"]), "checkpoint", "left")
    own = checkpoints.join(lake.table("checkpoint_tensors").distinct(), "checkpoint").select("checkpoint", "tensor_manifest")
    chain = own.select("tensor_manifest").distinct()
    manifests = lake.table("tensor_manifests").dropDuplicates(["tensor_manifest"])
    edges = manifests.where("base_manifest is not null").select(F.col("tensor_manifest").alias("child"), F.col("base_manifest").alias("parent"))
    needed = dag.cut(dag.reachable(edges, chain.select(F.col("tensor_manifest").alias("node"))).select(F.col("node").alias("tensor_manifest")))
    used = needed.join(manifests, "tensor_manifest", "left")
    by = lambda df, obj, ref: df.select(F.col(obj).alias("object"), F.col(ref).alias("referenced_by"))
    links = by(commits, "commit", "commit")
    for df, obj, ref in ((checkpoints, "checkpoint", "commit"), (checkpoints, "header_object", "checkpoint"), (checkpoints, "config_object", "checkpoint"), (own, "tensor_manifest", "checkpoint"), (used, "tensor_manifest", "tensor_manifest"), (used, "row_perm", "tensor_manifest"), (used, "col_perm", "tensor_manifest")):
        links = links.unionByName(by(df, obj, ref))
    links = links.where("object is not null").groupBy("object").agg(F.min("referenced_by").alias("referenced_by"))
    objects = lake.table("objects").dropDuplicates(["object"]).select("object", F.sha2("payload", 256).alias("actual"), F.lit(True).alias("there"))
    kind = F.when(F.col("there").isNull(), "missing-object").when(F.col("actual") != F.col("object"), "object-hash-mismatch")
    failures = links.join(objects, "object", "left").withColumn("kind", kind).where("kind is not null").select("kind", "object", "referenced_by")
    refs_ = needed.join(lake.table("manifest_chunks").dropDuplicates(["tensor_manifest", "chunk_no"]), "tensor_manifest")
    wanted = refs_.groupBy("object").agg(F.min("tensor_manifest").alias("referenced_by"), F.min("encoding").alias("encoding"), F.min("stored_checksum").alias("checksum"), F.count("*").alias("n"))
    chunks = lake.table("chunks").dropDuplicates(["object"])
    if level == 0:
        bad = wanted.join(chunks.select("object", F.lit(True).alias("there")), "object", "left").where("there is null").withColumn("kind", F.lit("missing-chunk"))
    else:
        joined = wanted.join(chunks.select("object", "payload"), "object", "left")
        kind = F.when(F.col("payload").isNull(), "missing-chunk").when(F.substring(F.sha2("payload", 256), 1, 16) != F.col("checksum"), "chunk-checksum")
        bad = joined.withColumn("kind", kind)
        if level > 1:
            broken = bad.where("kind is not null").select("object", "referenced_by", "kind")
            bad = bad.where("kind is null").select("object", "referenced_by", "encoding", "payload").mapInArrow(_check_content, "object string, referenced_by string, kind string").unionByName(broken)
    failures = dag.cut(failures.unionByName(bad.where("kind is not null").select("kind", "object", "referenced_by")))
    if level == 3 and not failures.limit(1).count():
        failures = dag.cut(failures.unionByName(_check_tensors(lake, used)))
    n = failures.count()
    report = {"tier": tier, "commits": commits.count(), "objects": links.count(), "tensor_manifests": needed.count(), "chunk_refs": refs_.count(), "chunks": wanted.count(), "failures": n, "truncated": n > most}
    return failures.orderBy("kind", "object").limit(most), report


def _check_content(batches):
    for batch in batches:
        out = []
        for obj, ref, encoding, payload in zip(*(batch.column(c).to_pylist() for c in ("object", "referenced_by", "encoding", "payload")), strict=True):
            try:
                kind = None if name_of(codec.plain_stream(encoding, payload)) == obj else "chunk-content-mismatch"
            except IntegrityError:
                kind = "decode-error"
            out.append((obj, ref, kind))
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["object", "referenced_by", "kind"])


def _ordered_digests(blocks: DataFrame, key: str) -> DataFrame:
    """(key, actual): the digest of each tensor's blocks in their order, fed a block at a time."""

    def run(batches):
        at = h = None
        for batch in batches:
            for m, data in zip(batch.column(key).to_pylist(), batch.column("bits").to_pylist(), strict=True):
                if m != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], [key, "actual"])
                    at, h = m, hashlib.sha256()
                h.update(data)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([h.hexdigest()])], [key, "actual"])

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.select(key, "chunk_no", "bits").repartition(parts, key).sortWithinPartitions(key, "chunk_no").select(key, "bits").mapInArrow(run, f"{key} string, actual string")


def _check_tensors(lake: Lake, used: DataFrame) -> DataFrame:
    """Tensors whose decoded bytes don't have their content hash."""
    digests = _ordered_digests(lake.blocks(used.select("tensor_manifest")), "tensor_manifest")
    bad = used.where("num_rows * row_elems > 0").join(digests, "tensor_manifest", "left").where("actual is null or actual <> content_hash")
    return bad.select(F.lit("tensor-content-mismatch").alias("kind"), F.col("tensor_manifest").alias("object"), F.col("name").alias("referenced_by"))


# ---- merge ----------------------------------------------------------------------------------------------


def merge_plan(lake: Lake, ours: str, theirs: str, base: str | None) -> DataFrame:
    side = lambda c: lake.tensors(c).select("name", "content_hash") if c else lake.spark.createDataFrame([], "name string, content_hash string")
    return relational.merge_plan(side(ours), side(theirs), side(base), "name", "content_hash")


def stale_statistics(plan: DataFrame) -> DataFrame:
    """Averaged running statistics, which want recalibration."""
    return plan.where((F.col("action") == "averaged") & exprs.suffix(F.col("name")).isin("running_mean", "running_var")).orderBy("name")


def _average(batches):
    for batch in batches:
        out = []
        for action, dtype, a, b in zip(*(batch.column(c).to_pylist() for c in ("action", "dtype", "o_bits", "t_bits")), strict=True):
            if action == "take-theirs":
                out.append(b)
            elif action != "averaged" or dtype == "I64":
                out.append(a)
            else:
                kind = f"<u{width_of(dtype)}"
                with np.errstate(all="ignore"):
                    mean = (bits_of.widen(np.frombuffer(a, kind), dtype) + bits_of.widen(np.frombuffer(b, kind), dtype)) / np.float32(2)
                out.append(bits_of.narrow(mean, dtype).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("chunk_no"), pa.array(out, pa.binary())], ["name", "chunk_no", "bits"])


def _alignment_of(lake: Lake, ours: str, theirs: str, notes: list[str]) -> dict[str, tuple] | None:
    """What brings theirs into the order of ours, where that can be told and lessens the residuals."""
    from ckptlake.operators import align

    pairs, shapes = align.pairs_of_commits(lake, ours, theirs)
    try:
        groups = align.topology(shapes, config=lake.config(ours))
        return align.align(dag.cut(pairs), groups).plan() or None
    except (UsageError, NotAlignableError) as e:
        notes.append(f"not aligned: {e}")
        return None


def merge(lake: Lake, theirs: str, average: bool = False, ff_only: bool = False, no_ff: bool = False, message: str | None = None, alignment: dict[str, tuple] | None = None) -> dict:
    """Merge a ref into the branch that HEAD is on. Where both sides changed tensors, theirs are aligned with ours first; alignment: theirs' rows in ours' order, as for commit, if it is known ({} for none)."""
    branch, ours = lake.head()
    theirs = lake.resolve(theirs)
    if branch is None or ours is None:
        raise UsageError("a merge needs a branch with a commit")
    base = lake.merge_base(ours, theirs)
    if theirs == ours or base == theirs:
        return {"result": "up-to-date", "commit": ours}
    if base == ours and not no_ff:
        lake.update_ref(branch, theirs)
        return {"result": "fast-forward", "commit": theirs}
    if ff_only:
        raise UsageError("the branch can't be moved forward")
    if base is None:
        raise UsageError("the branches have no commit in common")
    plan = dag.cut(merge_plan(lake, ours, theirs, base))
    counts = {r["action"]: r["n"] for r in plan.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if counts.get("averaged") and not average:
        raise ConflictError(f"{counts['averaged']} tensors changed on both sides")
    names = plan.where("action <> 'only-theirs'").select("name", "action")
    notes: list[str] = []
    if alignment is None and counts.get("averaged"):
        alignment = _alignment_of(lake, ours, theirs, notes)
    o = names.join(lake.tensors(ours).select("name", "tensor_manifest", "shape", "num_rows", "row_elems", "dtype"), "name")
    t = names.where("action in ('take-theirs', 'averaged')").join(lake.tensors(theirs).select("name", "tensor_manifest", "dtype", "row_elems"), "name")
    o_blocks = lake.blocks(o.select("tensor_manifest")).drop("name", "dtype", "row_elems").join(o, "tensor_manifest").select("name", "action", "dtype", "chunk_no", "row_start", "row_end", F.col("bits").alias("o_bits"))
    perm_names = {}
    perm_rows = []
    for name, (row, col, block) in (alignment or {}).items():
        found = []
        for p in (row, col):
            data = None if p is None else np.asarray(p, "<i4").tobytes()
            found.append(None if data is None else name_of(data))
            if data is not None:
                perm_rows.append((found[-1], "permutation", data))
        perm_names[name] = (*found, block)
    lake.put_objects(perm_rows)
    t_rows = [(r["name"], r["tensor_manifest"], *perm_names.get(r["name"], (None, None, None)), max(1, lake.chunk_bytes // max(1, r["row_elems"] * width_of(r["dtype"]))), width_of(r["dtype"])) for r in t.collect()]
    t_plan = lake.spark.createDataFrame(t_rows, "target string, key string, row_perm string, col_perm string, col_block long, rows_per_chunk long, width int")
    t_blocks = lake.align_blocks(lake.blocks(t_plan.select(F.col("key").alias("tensor_manifest"))).withColumnRenamed("tensor_manifest", "key"), t_plan).select(F.col("target").alias("name"), "chunk_no", F.col("base_bits").alias("t_bits")) if t_rows else lake.spark.createDataFrame([], "name string, chunk_no int, t_bits binary")
    merged = o_blocks.join(t_blocks, ["name", "chunk_no"], "left").select("name", "chunk_no", "action", "dtype", "o_bits", "t_bits").mapInArrow(_average, "name string, chunk_no int, bits binary")
    header = lake.header(ours)
    shapes = o.select("name", "shape", "num_rows", "row_elems", "dtype")
    ordinals = lake.spark.createDataFrame([(x.name, x.ordinal) for x in st.parse_header(header)], "name string, ordinal int")
    blocks = dag.cut(merged.join(o_blocks.select("name", "chunk_no", "row_start", "row_end"), ["name", "chunk_no"]).join(shapes, "name").join(ordinals, "name"))
    done = lake.commit_blocks(blocks, header, message or f"merge {theirs[:12]}", parents=[ours, theirs])
    stale = [r["name"] for r in stale_statistics(plan).collect()]
    return {"result": "merged", "commit": done["commit"], "counts": counts, "notes": notes, "stale_statistics": stale, "dropped": [r[0] for r in plan.where("action = 'only-theirs'").select("name").orderBy("name").collect()]}


# ---- sync -----------------------------------------------------------------------------------------------


def reachable_objects(lake: Lake, commit: str) -> tuple[DataFrame, DataFrame]:
    """(metadata objects, chunk objects) that a commit needs, bases of residuals included."""
    reach = dag.reachable(lake.edges(), lake.spark.createDataFrame([(commit,)], "node string")).select(F.col("node").alias("commit"))
    points = reach.join(lake.table("commits").dropDuplicates(["commit"]), "commit").select("commit", "checkpoint").join(lake.table("checkpoints").dropDuplicates(["checkpoint"]), "checkpoint", "left")
    own = points.join(lake.table("checkpoint_tensors").distinct(), "checkpoint").select("tensor_manifest").distinct()
    manifests = lake.table("tensor_manifests").dropDuplicates(["tensor_manifest"])
    edges = manifests.where("base_manifest is not null").select(F.col("tensor_manifest").alias("child"), F.col("base_manifest").alias("parent"))
    needed = dag.cut(dag.reachable(edges, own.select(F.col("tensor_manifest").alias("node"))).select(F.col("node").alias("tensor_manifest")))
    used = needed.join(manifests, "tensor_manifest")
    meta = reach.select(F.col("commit").alias("object"))
    for df, c in ((points, "checkpoint"), (points, "header_object"), (points, "config_object"), (needed, "tensor_manifest"), (used, "row_perm"), (used, "col_perm")):
        meta = meta.unionByName(df.select(F.col(c).alias("object")))
    chunks = needed.join(lake.table("manifest_chunks"), "tensor_manifest").select("object").distinct()
    return meta.where("object is not null").distinct(), chunks


def sync(source: Lake, target: Lake, branch: str, dry_run: bool = False, read_only: bool = False) -> dict:
    """Bring a branch and all that it needs from source to target: only what is absent travels, is checked on arrival, and the ref comes last."""
    from ckptlake.types import SyncError

    commit = source.branches().get(branch)
    if commit is None:
        raise NotFoundError(f"no branch {branch}")
    meta, chunks = reachable_objects(source, commit)
    want_meta, want_chunks = dag.cut(relational.absent(meta, target.table("objects"))), dag.cut(relational.absent(chunks, target.table("chunks")))
    report = {"branch": branch, "commit": commit, "objects": want_meta.count(), "chunks": want_chunks.count()}
    if dry_run:
        return report
    if read_only:
        raise SyncError("the target is read-only")
    arriving = source.table("chunks").dropDuplicates(["object"]).join(want_chunks, "object")
    if arriving.where(F.substring(F.sha2("payload", 256), 1, 16) != F.col("stored_checksum")).limit(1).count():
        raise SyncError("a chunk arrived damaged")
    objects = source.table("objects").dropDuplicates(["object"]).join(want_meta, "object")
    if objects.where(F.sha2("payload", 256) != F.col("object")).limit(1).count():
        raise SyncError("an object arrived damaged")
    target.append("chunks", arriving)
    target.append("objects", objects)
    for name, key in (("tensor_manifests", "tensor_manifest"), ("manifest_chunks", "tensor_manifest"), ("checkpoint_tensors", "checkpoint"), ("checkpoints", "checkpoint"), ("commits", "commit")):
        present = target.table(name).select(key).distinct()
        target.append(name, dag.cut(source.table(name).join(meta.select(F.col("object").alias(key)), key, "left_semi").join(present, key, "left_anti")))
    target.update_ref(branch, commit)
    return report
