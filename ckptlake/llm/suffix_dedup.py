"""Removal of repeated byte strings, by block-wise sorting of suffixes over a cover of samples.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id. Suffixes are compared to that depth only.

The cover. A difference cover gives every two suffixes an offset, below some
period, at which both are samples whose ranks were computed before. Positions
modulo a period would make a quarter of all suffixes samples and would need all
their ranks in one place; here the cover is chosen by content instead: the
sample of a suffix is the leftmost of its ``WINDOW`` first ``GRAM``-grams of least
hash. Equal strings have their sample at the same offset, which is all that the
comparison needs, and one position in sixteen is a sample.

The blocks. A sample that occurs in one document only can't lie in a repeated
string; so samples are counted first (32-bit remainders of their hashes, dealt
to shards; a bit for each comes back). Around the others, the runs of suffixes
with one sample (a piece: at most 80 bytes) go to the shard of the sample, each
distinct piece once for each group of documents. A shard is a block: it ranks
the samples by what follows them and by what precedes them, backward, with the
common prefixes of neighbours. Then it sorts one bucket of suffixes at a time, the
bucket of all suffixes that stand r bytes before their sample: two of them are
equal if their samples share 50 - r bytes on the right and r on the left, which
the ranks tell without looking at the text. Memory is bounded by the block, and
long ties cost no more than short ones.

Documents travel in groups of a few megabytes, compressed; they are shuffled
twice. A frequent string is one piece a group, so no block grows with a string's
frequency alone. Pieces of one group are told apart by 64-bit hashes; between
groups, bytes are compared by the sort.

Defined cases: null counts as empty text; texts of fewer than 50 bytes lose
nothing; rows of equal id never remove each other's bytes; null ids are above all
others; repeats within one document stay; an empty table gives an empty table;
other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ckptlake.llm import _text
from ckptlake.llm.store import Scratch, shards_for

LENGTH, GRAM = 50, 20
WINDOW = LENGTH - GRAM + 1
GROUP_BYTES = 3 << 19
CHUNK = 1 << 19
TOP = np.iinfo(np.int64).max
#: Text whose pieces make one block, on average; a block is ranked in memory.
SHARD_BYTES = 48 << 20


def samples(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place where LENGTH bytes start: where its sample stands; the hash of the GRAM-gram that starts at each place."""
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _text._power_table(CHUNK + LENGTH + 1)
    where, grams = np.empty(n - LENGTH + 1, np.int64), np.empty(n - GRAM + 1, np.uint64)
    for at in range(0, n - LENGTH + 1, CHUNK):
        part = buf[at : at + CHUNK + LENGTH - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        h = (sums[GRAM:] - sums[:-GRAM]) * down[: len(part) - GRAM + 1]
        h = _text.mix(h)
        grams[at : at + len(h)] = h
        key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < WINDOW:
            key = np.minimum(key[: len(key) - (WINDOW - width)], key[WINDOW - width :])
        where[at : at + len(key)] = (key & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return where, grams


class Group:
    """The pieces of a group of documents: runs of starts that share a sample."""

    def __init__(self, column: pa.Array, ids: np.ndarray):
        parts = list(_text.slices(column, 1 << 62))
        self.buf, self.offsets = (parts[0][2], parts[0][3]) if parts else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.ids = ids
        where, grams = samples(self.buf)
        n = len(where)
        row = np.searchsorted(self.offsets, np.arange(n), "right") - 1 if n < 1 else np.repeat(np.arange(len(ids)), np.diff(self.offsets))[:n]
        valid = np.arange(n) + LENGTH <= self.offsets[row + 1] if n else np.zeros(0, bool)
        opens = valid.copy()
        opens[1:] &= ~valid[:-1] | (where[1:] != where[:-1]) | (row[1:] != row[:-1])
        closes = valid.copy()
        closes[:-1] &= ~valid[1:] | opens[1:]
        self.first = np.flatnonzero(opens)
        self.starts = np.flatnonzero(closes) - self.first + 1
        self.row = row[self.first]
        self.sample = where[self.first]
        self.hash = _text.mix(grams[self.sample] * np.uint64(0xDA942042E4DD58B5)) if n else np.zeros(0, np.uint64)  # samples have small hashes; these are even again
        self.names, self.of = np.unique(self.hash, return_inverse=True)

    def counted(self) -> np.ndarray:
        """Whether each distinct sample stands in two documents of the group or more."""
        id_of = self.ids[self.row]
        low, high = np.full(len(self.names), TOP), np.full(len(self.names), np.iinfo(np.int64).min)
        np.minimum.at(low, self.of, id_of)
        np.maximum.at(high, self.of, id_of)
        return low < high

    def pieces(self, shared: np.ndarray) -> None:
        """Keep the pieces whose sample is shared, and find the distinct ones."""
        keep = shared[self.of] if len(self.of) else np.zeros(0, bool)
        for k in ("first", "starts", "row", "sample", "hash"):
            setattr(self, k, getattr(self, k)[keep])
        sizes = self.starts + LENGTH - 1
        if len(sizes):
            up, down = _text._power_table(len(self.buf) + 1)
            sums = np.zeros(len(self.buf) + 1, np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=sums[1:])
            content = (sums[self.first + sizes] - sums[self.first]) * down[self.first]
        else:
            content = np.zeros(0, np.uint64)
        content = _text.mix(content ^ _text.mix(sizes.astype(np.uint64)))
        order = np.lexsort((content, self.hash))
        new = np.ones(len(order), bool)
        new[1:] = (content[order][1:] != content[order][:-1]) | (self.hash[order][1:] != self.hash[order][:-1])
        heads = np.flatnonzero(new)
        self.distinct = order[heads]  # by the hash of their sample
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        id_of = self.ids[self.row[order]]
        self.low = np.minimum.reduceat(id_of, heads) if len(heads) else np.zeros(0, np.int64)
        self.high = np.maximum.reduceat(id_of, heads) if len(heads) else np.zeros(0, np.int64)

    def removed(self, mins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bytes that go. mins: least id at each start of each distinct piece, laid end to end; bounds: where each begins."""
        edge = np.zeros(len(self.buf) + 1, np.int64)
        if len(self.first):
            owner = np.repeat(np.arange(len(self.first)), self.starts)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(self.starts) - self.starts, self.starts)
            gone = mins[bounds[self.kind[owner]] + step] < self.ids[self.row[owner]]
            at = self.first[owner[gone]] + step[gone]
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + LENGTH, minlength=len(edge))[: len(edge)]
        return np.cumsum(edge[:-1]) > 0


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _pack(data: np.ndarray | bytes) -> bytes:
    return zstandard.compress(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes(), 1)


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _open(blob: bytes, text_col: str, id_col: str) -> tuple[pa.RecordBatch, Group]:
    table = pa.ipc.open_stream(zstandard.decompress(blob)).read_all().combine_chunks()
    batch = table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in table.schema], schema=table.schema)
    ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64()).fill_null(TOP).to_numpy(zero_copy_only=False)
    return batch, Group(batch.column(batch.schema.get_field_index(text_col)), ids)


def _form_groups(text_col: str):
    """Groups of rows with all their columns, as compressed streams."""

    def run(batches):
        from pyspark import TaskContext

        pid, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            for at, to, _, _ in _text.slices(column, GROUP_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch.slice(at, to - at))
                yield pa.RecordBatch.from_arrays([pa.array([(pid << 32) + k]), pa.array([zstandard.compress(sink.getvalue(), 3)], pa.binary())], ["grp", "rows"])
                k += 1

    return run


def _count_samples(shards: int, text_col: str, id_col: str):
    def run(batches):
        for batch in batches:
            for g, blob in zip(batch.column("grp").to_pylist(), batch.column("rows"), strict=True):
                group = _open(blob.as_py(), text_col, id_col)[1]
                many = group.counted()
                cut = np.searchsorted(shard_of(group.names, shards), np.arange(shards + 1))
                out = [(s, g, group.names[a:b].astype(np.uint32).tobytes(), np.packbits(many[a:b]).tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["shard", "grp", "names", "many"])
                del group, many, out
        _text.release()

    return run


def _share(table: pa.Table) -> pa.Table:
    """A bit for each sample that a group has sent: whether another document has it too."""
    rows = table.to_pylist()
    names = [np.frombuffer(r["names"], np.uint32) for r in rows]
    many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8))[: len(n)] for r, n in zip(rows, names, strict=True)]).astype(bool)
    _, inverse, counts = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    shared = counts > 1
    np.logical_or.at(shared, inverse[many], True)
    bits = shared[inverse]
    cut = np.concatenate([[0], np.cumsum([len(n) for n in names])])
    return pa.table({"grp": pa.array([r["grp"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int32()), "bits": pa.array([np.packbits(bits[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())})


def _shared(group: Group, replies: list[dict], shards: int) -> np.ndarray:
    sizes = np.bincount(shard_of(group.names, shards), minlength=shards)
    bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: sizes[r["shard"]]] for r in sorted(replies, key=lambda r: r["shard"])]
    return np.concatenate(bits).astype(bool) if bits else np.zeros(len(group.names), bool)


_PIECES = "shard int, grp long, starts binary, before binary, low binary, high binary, text binary"


def _send_pieces(shards: int, text_col: str, id_col: str):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for g, blob in zip(left["grp"].to_pylist(), left["rows"], strict=True):
            group = _open(blob.as_py(), text_col, id_col)[1]
            group.pieces(_shared(group, replies, shards))
            d = group.distinct
            cut = np.searchsorted(shard_of(group.hash[d], shards), np.arange(shards + 1))
            sizes = group.starts[d] + LENGTH - 1
            total = np.concatenate([[0], np.cumsum(sizes)])
            for s in np.flatnonzero(np.diff(cut)):
                a, b = cut[s], cut[s + 1]
                at = np.repeat(group.first[d[a:b]] - (total[a:b] - total[a]), sizes[a:b]) + np.arange(total[b] - total[a])
                out.append((int(s), g, _pack(group.starts[d[a:b]].astype(np.uint8)), _pack((group.sample - group.first)[d[a:b]].astype(np.uint8)), _pack(group.low[a:b]), _pack(group.high[a:b]), _pack(group.buf[at])))
        _text.release()
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "grp", "starts", "before", "low", "high", "text"])

    return run


def _ranked(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each row in sorted order; common prefix of each place with the one before (the first has none)."""
    width = matrix.shape[1]
    order = np.argsort(np.ascontiguousarray(matrix).view(f"S{width}").ravel(), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ordered = matrix[order]
    differ = ordered[1:] != ordered[:-1]
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), width)
    return place, lcp


def least_ids(starts: np.ndarray, before: np.ndarray, low: np.ndarray, text: np.ndarray) -> np.ndarray:
    """A block: the least id at each start of each piece, as (pieces, WINDOW).

    starts: of each piece; before: bytes between its first start and its sample;
    low: its least id; text: the pieces laid end to end.
    """
    n = len(starts)
    sizes = starts + LENGTH - 1
    begin = np.cumsum(sizes) - sizes
    sample = begin + before
    padded = np.concatenate([text, np.zeros(LENGTH, np.uint8)])
    right = padded[np.minimum(sample[:, None] + np.arange(LENGTH), len(padded) - 1)]
    right[np.arange(LENGTH)[None, :] >= (sizes - before)[:, None]] = 0
    left = text[np.maximum(sample[:, None] - 1 - np.arange(WINDOW - 1), 0)] if n else np.zeros((0, WINDOW - 1), np.uint8)
    left[np.arange(WINDOW - 1)[None, :] >= before[:, None]] = 0
    right_place, right_lcp = _ranked(right)
    left_place, left_lcp = _ranked(left)
    out = np.full((n, WINDOW), TOP, np.int64)
    for r in range(WINDOW):  # the bucket of suffixes that stand r bytes before their sample
        own = np.flatnonzero((before >= r) & (before - r < starts))
        if not len(own):
            continue
        by_right = np.cumsum(right_lcp < LENGTH - r)[right_place[own]]
        by_left = np.cumsum(left_lcp < r)[left_place[own]] if r else np.zeros(len(own), np.int64)
        key = by_left * (n + 1) + by_right
        order = np.argsort(key, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        least = np.minimum.reduceat(low[own[order]], heads)
        out[own[order], before[own[order]] - r] = np.repeat(least, np.diff(np.append(heads, len(own))))
    return out


def _sort_block(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    part = {k: [_unpack(r[k], t) for r in rows] for k, t in (("starts", np.uint8), ("before", np.uint8), ("low", np.int64), ("high", np.int64), ("text", np.uint8))}
    starts = np.concatenate(part["starts"]).astype(np.int64)
    least = least_ids(starts, np.concatenate(part["before"]).astype(np.int64), np.concatenate(part["low"]), np.concatenate(part["text"]))
    inside = np.arange(WINDOW)[None, :] < starts[:, None]
    hit = ((least < np.concatenate(part["high"])[:, None]) & inside).any(1)
    at, out = 0, []
    for r, own in zip(rows, part["starts"], strict=True):
        h = hit[at : at + len(own)]
        values = least[at : at + len(own)][h][inside[at : at + len(own)][h]]
        out.append((r["grp"], r["shard"], np.packbits(h).tobytes(), _pack(values)))
        at += len(own)
    del part, least, inside, hit
    _text.release()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["grp", "shard", "hit", "mins"])


def _apply(shards: int, text_col: str, id_col: str, finish, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = right.to_pylist()
        made = []
        for blob in left["rows"]:
            batch, group = _open(blob.as_py(), text_col, id_col)
            group.pieces(_shared(group, [r for r in replies if r["bits"] is not None], shards))
            starts = group.starts[group.distinct]
            bounds = np.cumsum(starts) - starts
            mins = np.full(int(starts.sum()), TOP, np.int64)
            sizes = np.bincount(shard_of(group.hash[group.distinct], shards), minlength=shards)
            begin = np.cumsum(sizes) - sizes
            for r in replies:
                if r["hit"] is None:
                    continue
                own = np.arange(begin[r["shard"]], begin[r["shard"]] + sizes[r["shard"]])
                own = own[np.unpackbits(np.frombuffer(r["hit"], np.uint8))[: len(own)].astype(bool)]
                at = np.repeat(bounds[own] - (np.cumsum(starts[own]) - starts[own]), starts[own]) + np.arange(int(starts[own].sum()))
                mins[at] = _unpack(r["mins"], np.int64)
            made.append(finish(batch, group.buf, group.offsets, group.removed(mins, bounds)))
        _text.release()
        return pa.Table.from_batches(made, schema) if made else schema.empty_table()

    return run


def spans_of(gone: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the (begin, end) of its maximal removed runs, in bytes from its start."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        own = gone[a:b]
        if not own.any():
            out.append(np.zeros((0, 2), np.int64))
            continue
        out.append(np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]]))).reshape(-1, 2))
    return out


def _rows_schema(docs: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(docs.schema)


def _run(docs: DataFrame, finish, schema: T.StructType, id_col: str, text_col: str, shards: int | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    _text.ship(spark)
    shards = shards or shards_for(docs, SHARD_BYTES, text_col)
    scratch = Scratch(spark, "suffixes")
    groups = scratch.save(docs.mapInArrow(_form_groups(text_col), "grp long, rows binary"), "groups")
    sent = groups.mapInArrow(_count_samples(shards, text_col, id_col), "shard int, grp long, names binary, many binary")
    bits = scratch.save(sent.groupBy("shard").applyInArrow(_share, "grp long, shard int, bits binary"), "shared")
    pieces = groups.groupBy("grp").cogroup(bits.groupBy("grp")).applyInArrow(_send_pieces(shards, text_col, id_col), _PIECES)
    sorted_blocks = scratch.save(pieces.groupBy("shard").applyInArrow(_sort_block, "grp long, shard int, hit binary, mins binary"), "blocks")
    none = F.lit(None).cast("binary")
    replies = bits.select("grp", "shard", "bits", none.alias("hit"), none.alias("mins")).unionByName(sorted_blocks.select("grp", "shard", none.alias("bits"), "hit", "mins"))
    return groups.groupBy("grp").cogroup(replies.groupBy("grp")).applyInArrow(_apply(shards, text_col, id_col, finish, to_arrow_schema(schema)), schema)


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept_sha256, spans) of every document: spans are the removed byte ranges."""
    base = _text.select(docs, id_col, text_col)
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, kept_sha256 string, spans array<struct<begin:long,end:long>>")

    def finish(batch, buf, offsets, gone):
        spans = spans_of(gone, offsets)
        data = buf.tobytes()
        kept = []
        for a, own in zip(offsets[:-1].tolist(), spans, strict=True):
            h, at = hashlib.sha256(), 0
            for x, y in own.tolist():
                h.update(data[a + at : a + x])
                at = y
            kept.append(h)
        for k, (a, b, own) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans, strict=True)):
            kept[k].update(data[a + (int(own[-1, 1]) if len(own) else 0) : b])
        pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.array([int((s[:, 1] - s[:, 0]).sum()) for s in spans], pa.int64()),
                pa.array([h.hexdigest() for h in kept], pa.string()),
                pa.array([[{"begin": x, "end": y} for x, y in s.tolist()] for s in spans], pairs),
            ],
            ["doc_id", "n_bytes", "n_removed", "kept_sha256", "spans"],
        )

    return _run(base, finish, schema, "doc_id", "text", shards)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", shards: int | None = None) -> DataFrame:
    """docs, with all their columns, where the repeated bytes are cut out of the text; parts of characters go with them, and length_col, if there is one, counts the characters left."""
    names = docs.columns

    def finish(batch, buf, offsets, gone):
        data, texts = buf.tobytes(), []
        for a, b, own in zip(offsets[:-1].tolist(), offsets[1:].tolist(), spans_of(gone, offsets), strict=True):
            edges = [0, *own.ravel().tolist(), b - a]
            texts.append(b"".join(data[a + x : a + y] for x, y in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore"))
        columns = []
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if name == text_col:
                was_null = column.is_null().to_pylist()
                column = pa.array([None if n else t for t, n in zip(texts, was_null, strict=True)], column.type)
            elif name == length_col:
                column = pa.array([len(t) for t in texts], pa.int64()).cast(column.type)
            columns.append(column)
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    if len(set(names)) < len(names):
        raise ValueError("columns of equal name can't be told apart")
    return _run(docs, finish, docs.schema, id_col, text_col, shards)
