"""Benchmark decontamination with one Aho-Corasick automaton.

Every window of ``width`` consecutive words of a test item is a pattern (an item
of fewer words is one pattern), written as its normalised words with a blank
before, between and after them. Each document is normalised likewise, scanned
once, and what is found is mapped back to words and to byte ranges of the
original text.

The items are read by the driver in blocks of at most ``block_bytes`` of
normalised windows, one block at a time. Each block's automaton is broadcast and
its pass adds what it finds to the rows themselves, which are written between
passes; so a row keeps its own hits whatever its id, and any number of blocks
gives the same result. A benchmark of ordinary size is one block and one pass
without any shuffle.

Defined cases: null or empty texts and items have no words, hit nothing and are
hit by nothing; an item whose windows another item also has counts for both;
repeated item rows count once; windows of items with a null id hit words, but
such an item has no name to be listed or counted by (for
:func:`drop_contaminated` all of them are one more item); repeated documents and
null document ids are rows like others; an empty benchmark leaves every document
clean; other columns are ignored, or passed through by :func:`drop_contaminated`
whatever their names, but two columns may not both bear the text's name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ckptlake.llm import _text
from ckptlake.llm.store import Scratch

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
HITS = "array<struct<item_id:long,first_word:long,last_word:long>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_text.ALNUM_OR_BLANK).split()


def windows(items, width: int) -> dict[str, list[int | None]]:
    """Pattern -> the items that have it; items: (id, text)."""
    found: dict[str, set[int]] = {}
    for item, text in items:
        words = normal_words((text or "").encode())
        for at in range(max(1, len(words) - width + 1) if words else 0):
            found.setdefault(f" {b' '.join(words[at : at + width]).decode('latin-1')} ", set()).add(item)
    return {k: sorted(v, key=lambda i: (i is None, i or 0)) for k, v in found.items()}


class Scanner:
    """The automaton over a block of windows."""

    def __init__(self, patterns: dict[str, list[int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for pattern, items in patterns.items():
            self.automaton.add_word(pattern, (len(pattern), items))
        self.empty = not patterns
        if patterns:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (item, first word, last word) of each place found."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), []
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 0x20)
        ends = np.array([e for e, _ in found])
        sizes = np.array([v[0] for _, v in found])
        last = np.searchsorted(blanks, ends) - 1
        first = np.searchsorted(blanks, ends - sizes + 1)
        return len(words), [(i, f, t) for (_, (_, items)), f, t in zip(found, first.tolist(), last.tolist(), strict=True) for i in items]


def summary(n_words: int, hits: list[tuple[int, int, int]]) -> tuple[int, list[int]]:
    """Number of words hit, and the items."""
    if not hits:
        return 0, []
    edge = np.zeros(n_words + 1, np.int64)
    at = np.array([h[1:] for h in hits], np.int64)
    np.add.at(edge, at[:, 0], 1)
    np.add.at(edge, at[:, 1] + 1, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum()), sorted({h[0] for h in hits} - {None})


def byte_spans(text: bytes, hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of the original that the hit words cover, where neighbours are joined."""
    places = [m.span() for m in _WORD.finditer(text)]
    spans: list[list[int]] = []
    for _, f, t in sorted(hits, key=lambda h: h[1]):
        a, b = places[f][0], places[t][1]
        if spans and f <= spans[-1][2] + 1:
            spans[-1][1:] = [max(b, spans[-1][1]), max(t, spans[-1][2])]
        else:
            spans.append([a, b, t])
    return [(a, b) for a, b, _ in spans]


def _blocks(items: DataFrame, item_id: str, text_col: str, width: int, block_bytes: int) -> Iterator[dict[str, list[int | None]]]:
    """The windows of the items, block by block; rows are dealt by id and text, so a block's size doesn't hang on ids being there."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = (rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) * width
    count = max(1, -(-size // block_bytes))
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield windows(part.collect(), width)


def _passes(docs: DataFrame, text_col: str, blocks: Iterator[dict[str, list[int | None]]]) -> DataFrame:
    """The rows with what all blocks find in them: a column of hits, __hits. A pass for each block; the rows are written between passes."""
    sc, scratch = docs.sparkSession.sparkContext, Scratch(docs.sparkSession, "windows")
    schema = T.StructType([*docs.schema.fields, T.StructField("__hits", T._parse_datatype_string(HITS))])

    def one(patterns):
        def run(batches):
            scanner = Scanner(patterns.value)
            for batch in batches:
                names = batch.schema.names
                found = batch.column(names.index("__hits")).to_pylist() if "__hits" in names else [[] for _ in range(batch.num_rows)]
                at = 0
                for _, _, buf, offsets in _text.slices(batch.column(names.index(text_col))):
                    data, bounds = buf.tobytes(), offsets.tolist()
                    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                        found[at] = found[at] + [{"item_id": i, "first_word": f, "last_word": t} for i, f, t in scanner.scan(data[a:b])[1]]
                        at += 1
                kept = [c for n, c in zip(names, batch.columns, strict=True) if n != "__hits"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, _HIT)], schema.names)
                _text.release()

        return run

    rows, before = docs, None
    for patterns in blocks:
        if before is not None:
            saved = scratch.save(rows, "rows")
            before.unpersist()
            rows = saved
        before = sc.broadcast(patterns)
        rows = rows.mapInArrow(one(before), schema)
    return rows


def find(docs: DataFrame, items: DataFrame, width: int = 8, block_bytes: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every document: the items that occur, and merged byte ranges of the original."""
    found = _passes(_text.select(docs, id_col, text_col), "text", _blocks(items, item_id, item_text, width, block_bytes))
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), span)

    def run(batches):
        for batch in batches:
            hits = batch.column("__hits").to_pylist()
            out, at = [], 0
            for _, _, buf, offsets in _text.slices(batch.column("text")):
                data, bounds = buf.tobytes(), offsets.tolist()
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    own = [(h["item_id"], h["first_word"], h["last_word"]) for h in hits[at]]
                    n = len(normal_words(data[a:b]))
                    out.append((n, *summary(n, own), [{"begin": x, "end": y} for x, y in byte_spans(data[a:b], own)] if own else []))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([g[k] for g in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_words", "n_hit", "items", "spans"])
            _text.release()

    return found.mapInArrow(run, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<begin:long,end:long>>")


def drop_contaminated(docs: DataFrame, items: DataFrame, least_items: int = 2, width: int = 8, block_bytes: int = 48 << 20, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which fewer than least_items items occur."""
    if docs.columns.count(text_col) != 1 or "__hits" in docs.columns:
        raise ValueError(f"one column {text_col} is needed, and none named __hits")
    _text.ship(docs.sparkSession)
    found = _passes(docs, text_col, _blocks(items, item_id, item_text, width, block_bytes))
    items_of = F.array_distinct(F.transform("__hits", lambda h: F.coalesce(h["item_id"].cast("string"), F.lit(""))))
    return found.where(F.size(items_of) < least_items).drop("__hits")
