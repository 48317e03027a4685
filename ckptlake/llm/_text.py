"""Vectorised text primitives shared by the document operators.

Text reaches Python as Arrow batches; everything here works on the UTF-8 bytes
of a slice of such a batch, so that temporary arrays stay near a megabyte of
text (or one document, if that is longer) whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ckptlake import ship

SLICE_BYTES = 1 << 20

#: Bytes that part words: blanks only, or everything in ASCII that is neither a letter nor a digit.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()
#: Lower-cases and turns every separator of NOT_ALNUM into a blank, for bytes.translate.
ALNUM_OR_BLANK = np.where(NOT_ALNUM, 0x20, LOWER).astype(np.uint8).tobytes()

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers.get("up", ()))
    if have < n:
        size = max(n, SLICE_BYTES + 1)
        _powers["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _powers["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _INVERSE)]), dtype=np.uint64)
    return _powers["up"], _powers["down"]


def release() -> None:
    """Give what a task's work has used back to the system: a worker outlives its tasks, and others share its machine."""
    import ctypes
    import gc

    if len(_powers.get("up", ())) > 4 * SLICE_BYTES:
        _powers.clear()  # one very long document has made it large
    gc.collect(0)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another allocator, which needs no asking


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets into them) of runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of a slice: where they start and end, and of which row they are."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, parts: np.ndarray = BLANKS):
        n = len(buf)
        self.rows = len(offsets) - 1
        inside = ~parts[buf]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[firsts] = inside[firsts]
        lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        closes[lasts] = inside[lasts]
        self.starts = np.flatnonzero(opens)
        self.ends = np.flatnonzero(closes) + 1
        self.row_offsets = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.row_offsets)
        self.buf, self.n = buf, n

    def row_ids(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words with A-Z lower-cased."""
        up, down = _power_table(self.n + 1)
        sums = np.empty(self.n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((LOWER[self.buf].astype(np.uint64) + np.uint64(1)) * up[: self.n], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def select(docs, id_col: str = "doc_id", text_col: str = "text"):
    """The two columns an operator reads, under fixed names: other columns, whatever their names, play no part."""
    from pyspark.sql import functions as F

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
