"""Checkpoint files: an 8-byte header length, a JSON header, then the tensors' bytes.

``scan_headers``, ``scan_blocks`` and ``scan_digests`` read them as tables through
a data source of their own: the driver reads headers only, a task reads a run of
chunks of one tensor (at most ``PIECE`` bytes) by its byte range, so files of any
size are read and tensors or rows that aren't asked for are never touched. File
systems that Arrow can't seek in go through Spark's binaryFile source instead, a
file a task. ``TensorFile`` is the same for one file in memory or on this machine;
``write_file`` and ``write_rows`` make such files.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ckptlake import ship
from ckptlake.types import DTYPES, UsageError

MAX_HEADER = 100 << 20
HEADER_FIELDS = "name string, dtype string, shape array<long>, width int, num_rows long, row_elems long, nbytes long, seg_begin long, seg_end long, ordinal int"


class TensorSpec:
    """A tensor as rows along its first axis; one without axes is one row of one element."""

    def __init__(self, name: str, dtype: str, shape: list[int], begin: int, end: int, ordinal: int):
        self.name, self.dtype, self.shape, self.begin, self.end, self.ordinal = name, dtype, list(shape), begin, end, ordinal
        self.width = DTYPES[dtype][0]
        self.num_rows = shape[0] if shape else 1
        self.row_elems = int(np.prod(shape[1:], dtype=np.int64)) if len(shape) > 1 else 1
        self.nbytes = self.width * int(np.prod(shape, dtype=np.int64)) if shape else self.width

    @property
    def row_bytes(self) -> int:
        return self.row_elems * self.width

    def fields(self) -> tuple:
        return self.name, self.dtype, self.shape, self.width, self.num_rows, self.row_elems, self.nbytes, self.begin, self.end, self.ordinal


def parse_header(header: bytes, data_len: int | None = None) -> list[TensorSpec]:
    """The tensors of a header in its own order, checked: types, shapes, and ranges inside the data."""
    try:
        entries = json.loads(header)
    except ValueError as e:
        raise UsageError(f"the header isn't JSON: {e}") from None
    if not isinstance(entries, dict):
        raise UsageError("the header isn't an object")
    specs = []
    for k, (name, entry) in enumerate(entries.items()):
        if name == "__metadata__":
            continue
        try:
            dtype, shape, (begin, end) = entry["dtype"], entry["shape"], entry["data_offsets"]
        except (KeyError, TypeError, ValueError):
            raise UsageError(f"{name}: dtype, shape and two data_offsets are needed") from None
        if dtype not in DTYPES:
            raise UsageError(f"{name}: unknown number type {dtype!r}")
        if not all(isinstance(n, int) and n >= 0 for n in [*shape, begin, end]):
            raise UsageError(f"{name}: sizes and offsets are whole numbers from 0")
        spec = TensorSpec(name, dtype, shape, begin, end, k)
        if end - begin != spec.nbytes:
            raise UsageError(f"{name}: {end - begin} bytes for {spec.nbytes}")
        if data_len is not None and end > data_len:
            raise UsageError(f"{name}: ends at {end} of {data_len} bytes")
        specs.append(spec)
    return specs


class TensorFile:
    """A checkpoint file's bytes."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        if len(data) < 8:
            raise UsageError("shorter than its header's length")
        size = int.from_bytes(self.data[:8], "little")
        if size > MAX_HEADER or 8 + size > len(data):
            raise UsageError(f"a header of {size} bytes in a file of {len(data)}")
        self.header = bytes(self.data[8 : 8 + size])
        self.body = self.data[8 + size :]
        self.specs = {s.name: s for s in parse_header(self.header, len(self.body))}

    @classmethod
    def open(cls, path: str) -> TensorFile:
        with open(path, "rb") as f:
            return cls(f.read())

    def rows(self, name: str, start: int, stop: int) -> np.ndarray:
        """Rows [start, stop) as unsigned patterns, (rows, elements)."""
        s = self.specs[name]
        if not 0 <= start <= stop <= s.num_rows:
            raise UsageError(f"{name}: rows {start} to {stop} of {s.num_rows}")
        flat = np.frombuffer(self.body, f"<u{s.width}", (stop - start) * s.row_elems, s.begin + start * s.row_bytes) if (stop - start) * s.row_elems else np.zeros(0, f"<u{s.width}")
        return flat.reshape(stop - start, s.row_elems)

    def whole(self, name: str) -> np.ndarray:
        return self.rows(name, 0, self.specs[name].num_rows)

    def gather(self, name: str, indices) -> np.ndarray:
        """Rows at any places, in their order; nothing else is read."""
        return np.concatenate([self.rows(name, int(i), int(i) + 1) for i in indices]) if len(indices) else self.rows(name, 0, 0)


def write_file(tensors: dict[str, tuple[str, list[int], bytes]], metadata: dict[str, str] | None = None, order: list[str] | None = None) -> bytes:
    """A checkpoint file of name -> (dtype, shape, bytes); order: of the data, if not that of the sorted names."""
    header: dict = {"__metadata__": metadata} if metadata else {}
    at, offsets = 0, {}
    for name in order or sorted(tensors):
        offsets[name] = [at, at + len(tensors[name][2])]
        at = offsets[name][1]
    for name in sorted(tensors):
        header[name] = {"dtype": tensors[name][0], "shape": list(tensors[name][1]), "data_offsets": offsets[name]}
    text = json.dumps(header, separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-len(text) % 8)
    return len(text).to_bytes(8, "little") + text + b"".join(tensors[n][2] for n in order or sorted(tensors))


def write_rows(spark: SparkSession, path: str, tensors: list[tuple[str, str, list[int]]], rows: DataFrame, metadata: dict[str, str] | None = None) -> None:
    """A checkpoint file of a table (name, row, bits), for tensors (name, dtype, shape) in the order of their data: rows pass the driver one by one, sorted by the cluster."""
    header: dict = {"__metadata__": metadata} if metadata else {}
    at = 0
    for k, (name, dtype, shape) in enumerate(tensors):
        size = TensorSpec(name, dtype, shape, 0, 0, k).nbytes
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + size]}
        at += size
    text = json.dumps(dict(sorted(header.items())), separators=(",", ":"), ensure_ascii=False).encode()
    text += b" " * (-len(text) % 8)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(len(text).to_bytes(8, "little") + text))
    place = spark.createDataFrame([(n, k) for k, (n, _, _) in enumerate(tensors)], "name string, place int")
    held = bytearray()
    for r in rows.join(place, "name").orderBy("place", "row").select("bits").toLocalIterator():
        held += r["bits"]
        if len(held) > 4 << 20:
            out.write(held)
            held = bytearray()
    out.write(held)
    out.close()


def header_layout(header: bytes) -> list[tuple[str, int, int]]:
    """(name, begin, end) in the order of the data."""
    return sorted(((s.name, s.begin, s.end) for s in parse_header(header)), key=lambda x: (x[1], x[2]))


def check_tiling(layout: list[tuple[str, int, int]]) -> None:
    at = 0
    for name, begin, end in layout:
        if begin != at:
            raise UsageError(f"{name} begins at {begin}, not at {at}")
        at = end


#: Bytes that one task reads.
PIECE = 64 << 20
BLOCK_FIELDS = "file string, name string, dtype string, shape array<long>, num_rows long, row_elems long, ordinal int, chunk_no int, row_start long, row_end long, bits binary"
DIGEST_FIELDS = "file string, name string, content_hash string"
#: What Arrow's file systems open by themselves.
SEEKABLE = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def _open(uri: str):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


def read_header(f) -> tuple[bytes, int]:
    """The header of an open file, and where its data begin."""
    total = f.size()
    if total < 8:
        raise UsageError("shorter than its header's length")
    size = int.from_bytes(f.read_at(8, 0), "little")
    if size > MAX_HEADER or 8 + size > total:
        raise UsageError(f"a header of {size} bytes in a file of {total}")
    return f.read_at(size, 8), 8 + size


class Piece(InputPartition):
    """A run of rows of one tensor, or all tensors of a file."""

    def __init__(self, file: str, spec: TensorSpec | None = None, data: int = 0, start: int = 0, stop: int = 0):
        self.file, self.spec, self.data, self.start, self.stop = file, spec, data, start, stop


class CheckpointReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.what, self.files = options["what"], json.loads(options["files"])
        self.chunk_bytes = int(options.get("chunk_bytes", 1 << 20))
        self.names = json.loads(options.get("names", "null"))
        self.rows = json.loads(options.get("rows", "null"))

    def partitions(self) -> list[Piece]:
        pieces = []
        for file in self.files:
            if self.what == "headers":
                pieces.append(Piece(file))
                continue
            with _open(file) as f:
                header, data = read_header(f)
                specs = parse_header(header, f.size() - data)
            for s in specs:
                if self.names is not None and s.name not in self.names:
                    continue
                if self.what == "digests":
                    pieces.append(Piece(file, s, data, 0, s.num_rows))
                    continue
                step = chunk_rows(s, self.chunk_bytes)
                first, last = self.rows or (0, s.num_rows)
                first, last = first // step * step, min(s.num_rows, last)  # chunks are read whole
                most = max(1, PIECE // max(1, step * s.row_bytes)) * step
                for at in range(first, last, most):
                    pieces.append(Piece(file, s, data, at, min(at + most, -(-last // step) * step, s.num_rows)))
        return pieces or [Piece("")]

    def read(self, piece: Piece) -> Iterator[tuple]:
        if not piece.file:
            return
        with _open(piece.file) as f:
            if self.what == "headers":
                header, data = read_header(f)
                for s in parse_header(header, f.size() - data):
                    yield (piece.file, *s.fields())
                return
            s, begin = piece.spec, piece.data + piece.spec.begin
            if self.what == "digests":
                h = hashlib.sha256()
                for at in range(0, s.nbytes, 8 << 20):
                    h.update(f.read_at(min(8 << 20, s.nbytes - at), begin + at))
                yield piece.file, s.name, h.hexdigest()
                return
            step = chunk_rows(s, self.chunk_bytes)
            for at in range(piece.start, piece.stop, step):
                to = min(at + step, s.num_rows)
                yield piece.file, s.name, s.dtype, s.shape, s.num_rows, s.row_elems, s.ordinal, at // step, at, to - 1, f.read_at((to - at) * s.row_bytes, begin + at * s.row_bytes)


class CheckpointSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checkpoint"

    def schema(self) -> str:
        return {"headers": f"file string, {HEADER_FIELDS}", "blocks": BLOCK_FIELDS, "digests": DIGEST_FIELDS}[self.options["what"]]

    def reader(self, schema) -> CheckpointReader:
        return CheckpointReader(self.options)


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or pattern names, or that a folder has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in (fs.globStatus(at) or [])]
    found = [x for s in found for x in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if not x.isDirectory()]
    if not found:
        raise UsageError(f"no file at {path}")
    return sorted(s.getPath().toString() for s in found)


def _source(spark: SparkSession, what: str, path: str, **options) -> DataFrame | None:
    """The data source's table, or none where Arrow can't seek in the files."""
    ship(spark)
    files = files_of(spark, path)
    if any(f.partition(":")[0] not in SEEKABLE for f in files):
        return None
    spark.dataSource.register(CheckpointSource)
    reader = spark.read.format("checkpoint").option("what", what).option("files", json.dumps(files))
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v))
    return reader.load()


def _binary(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a tensor: file, header_object fields, and where its bytes lie."""
    found = _source(spark, "headers", path)
    if found is not None:
        return found

    def run(batches) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("width", pa.int32()), ("num_rows", pa.int64()), ("row_elems", pa.int64()), ("nbytes", pa.int64()), ("seg_begin", pa.int64()), ("seg_end", pa.int64()), ("ordinal", pa.int32())])
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                specs = list(TensorFile(content.as_buffer()).specs.values())
                columns = list(zip(*((file, *s.fields()) for s in specs), strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return _binary(spark, path).mapInArrow(run, f"file string, {HEADER_FIELDS}")


def header_bytes(spark: SparkSession, path: str) -> bytes:
    """The header of one file, as it is."""
    [file] = files_of(spark, path)
    if file.partition(":")[0] in SEEKABLE:
        with _open(file) as f:
            return read_header(f)[0]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([TensorFile(c.as_buffer()).header for c in batch.column("content")], pa.binary())], ["header"])

    return bytes(_binary(spark, path).select("content").mapInArrow(run, "header binary").first()[0])


def scan_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, content_hash): digests of the tensors' bytes as they lie, whatever the chunks; a tensor is a task, which holds a few MB at a time."""
    found = _source(spark, "digests", path)
    if found is not None:
        return found

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                f = TensorFile(content.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(f.specs)), pa.array(list(f.specs), pa.string()), pa.array([hashlib.sha256(f.body[s.begin : s.end]).hexdigest() for s in f.specs.values()], pa.string())], ["file", "name", "content_hash"])

    return _binary(spark, path).mapInArrow(run, DIGEST_FIELDS)


def chunk_rows(spec: TensorSpec, chunk_bytes: int) -> int:
    return max(1, chunk_bytes // max(1, spec.row_bytes))


def scan_blocks(spark: SparkSession, path: str, chunk_bytes: int = 1 << 20, names: list[str] | None = None, rows: tuple[int, int] | None = None) -> DataFrame:
    """Chunks of whole rows: (file, name, dtype, shape, num_rows, row_elems, ordinal, chunk_no, row_start, row_end, bits), row_end inclusive.

    names, rows: only chunks of those tensors that hold some of rows [start, stop)
    are read. A tensor without rows has no chunk.
    """
    found = _source(spark, "blocks", path, chunk_bytes=chunk_bytes, names=names, rows=rows)
    if found is not None:
        return found
    wanted = set(names) if names is not None else None
    first, last = rows or (0, 1 << 62)

    def run(batches):
        fields = ["file", "name", "dtype", "shape", "num_rows", "row_elems", "ordinal", "chunk_no", "row_start", "row_end", "bits"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                source = TensorFile(content.as_buffer())
                for s in source.specs.values():
                    if wanted is not None and s.name not in wanted:
                        continue
                    step = chunk_rows(s, chunk_bytes)
                    for k, at in enumerate(range(0, s.num_rows, step)):
                        to = min(at + step, s.num_rows)
                        if to <= first or at >= last:
                            continue
                        row = [file, s.name, s.dtype, s.shape, s.num_rows, s.row_elems, s.ordinal, k, at, to - 1, source.rows(s.name, at, to).tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], fields)

    return _binary(spark, path).mapInArrow(run, BLOCK_FIELDS)
