"""Document fingerprints: canonical exact digests.

The canonical form of a text is its NFKC normalisation, case-folded, normalised
again, with every run of white space as one blank and none at the ends. Its
fingerprint is the 128-bit xxh3 digest in hex. Documents of equal digest make a
bucket; inside a bucket the canonical bytes are compared with those of its first
document, and a text that differs (a collision) gets the digest followed by the
sha256 of its canonical bytes. Likeness of two exact fingerprints is 1 or 0, by
comparison of the canonical bytes behind them.

Defined cases: null counts as empty text, and all texts without anything but
white space share one fingerprint; equal texts always have equal fingerprints;
rows with the same id are each fingerprinted; null ids go last in descending
order; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ckptlake.llm import _text
from ckptlake.llm.store import Scratch, beside


def canonical(text: str) -> bytes:
    if text.isascii():
        return " ".join(text.lower().split()).encode()
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes) of each row, of its canonical form. One pass, no shuffle."""

    def run(batches):
        for batch in batches:
            forms = [canonical(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(f) for f in forms], pa.string()), pa.array([len(f) for f in forms], pa.int64())], ["doc_id", "digest", "n_bytes"])

    return _text.select(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest string, n_bytes long")


def shared(found: DataFrame) -> DataFrame:
    """(doc_id, digest) of the rows whose bucket has more than one row. Counts are taken before the shuffle, so a bucket of any size costs a row a task."""
    buckets = found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    return beside(found.select("doc_id", "digest"), buckets, "digest", F.col("doc_id"))


def collisions(members: DataFrame) -> DataFrame:
    """(doc_id, digest, suffix) of members (doc_id, digest, form) whose canonical bytes differ from their bucket's first; form: zstd of the bytes.

    Each member travels beside its bucket's first document by a join whose key is salted.
    """
    first = members.groupBy("digest").agg(F.min_by("form", F.struct("doc_id", "form")).alias("first_form"))
    paired = beside(members, first, "digest", F.col("doc_id"))

    def run(batches):
        for batch in batches:
            opener, out = zstandard.ZstdDecompressor(), []
            for i, d, form, other in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "digest", "form", "first_form")), strict=True):
                a = opener.decompress(form)
                if a != opener.decompress(other):
                    out.append((i, d, "-" + hashlib.sha256(a).hexdigest()))
            yield pa.RecordBatch.from_pylist([{"doc_id": i, "digest": d, "suffix": s} for i, d, s in out], pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("suffix", pa.string())]))

    return paired.mapInArrow(run, "doc_id long, digest string, suffix string")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, first_id, n_rows): the group of each row and its least id."""

    def run(batches):
        for batch in batches:
            packer = zstandard.ZstdCompressor(3)
            forms = [canonical(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([digest(f) for f in forms], pa.string()), pa.array([packer.compress(f) for f in forms], pa.binary())], ["doc_id", "digest", "form"])

    forms = _text.select(docs, id_col, text_col).mapInArrow(run, "doc_id long, digest string, form binary")
    odd = collisions(forms).dropDuplicates(["doc_id", "digest"])
    rows = digests(docs, id_col, text_col).join(odd, ["doc_id", "digest"], "left").select("doc_id", F.concat("digest", F.coalesce("suffix", F.lit(""))).alias("fingerprint"))
    groups = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_rows"))
    return rows.join(groups, "fingerprint").select("doc_id", "fingerprint", "first_id", "n_rows")


_EDITS = "pid int, kind int, doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double, form binary, text string"


def _edit_row(text: str, form: bytes, following: str, next_form: bytes) -> tuple:
    new = edited(text, following)
    new_form = canonical(new)
    return len(text), hashlib.sha256(new.encode()).hexdigest(), digest(form), digest(new_form), float(form == new_form), float(form == next_form)


def _edit_rows(batches):
    """Rows sorted by descending id, a mark (null text, marked) before the rows of its id.

    kind 0: a row with its successor; 1: the last of the partition, with its
    text; 2: the text of the first.
    """
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId() if TaskContext.get() else 0
    schema = pa.schema([("pid", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_digest", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("form", pa.binary()), ("text", pa.string())])
    packer, marked, last = zstandard.ZstdCompressor(3), (), None
    for batch in batches:
        out, size = [], 0
        for i, text, mark in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "marked")), strict=True):
            if mark:
                marked = (i,)
                continue
            text = text or ""
            form = canonical(text)
            pack = packer.compress(form) if marked == (i,) else None
            if last is None:
                out.append((pid, 2, i, None, None, None, None, None, None, None, text))
            else:
                out.append((pid, 0, last[0], *_edit_row(last[1], last[2], text, form), last[3], None))
            last = i, text, form, pack
            size += len(pack or b"")
            if len(out) >= 2000 or size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((pid, 1, last[0], None, None, None, None, None, None, last[3], last[1]), schema, strict=True)], schema=schema)


def _close(batches):
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next", "form"]
    for batch in batches:
        rows = [_edit_row(t or "", canonical(t or ""), f or "", canonical(f or "")) for t, f in zip(batch.column("text").to_pylist(), batch.column("following").to_pylist(), strict=True)]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)), batch.column("form")], names)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit by the next one in descending id.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). The texts are shuffled once, into ranges of ids sorted downward,
    with a mark for each id whose digest another row also has; marked rows give
    their canonical bytes for the comparison in their bucket. The first and the
    last text of each range are joined afterwards (two rows a range). Repeated
    ids follow each other in the order of their texts.
    """
    spark = docs.sparkSession
    base = _text.select(docs, id_col, text_col)
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "fingerprints")
    found = scratch.save(digests(base), "digests")
    marks = shared(found).select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(True).alias("marked")).distinct()
    order = F.col("doc_id").desc_nulls_last()
    rows = base.withColumn("marked", F.lit(False)).unionByName(marks).repartitionByRange(ranges, order).sortWithinPartitions(order, F.col("marked").desc(), "text")
    rows = scratch.save(rows.mapInArrow(_edit_rows, _EDITS), "rows")
    names = ["doc_id", "n_chars", "edited_sha256", "digest", "edited_digest", "near_edited", "near_next", "form"]
    ends = rows.where("kind > 0").select("pid", "kind", "doc_id", "form", "text")
    heads = Window.orderBy("pid", F.col("kind").desc())  # two rows a range
    whole = heads.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.withColumn("following", F.coalesce(F.lead("text").over(heads), F.first("text").over(whole))).where("kind = 1")
    closed = ends.select("doc_id", "text", "following", "form").mapInArrow(_close, "doc_id long, n_chars long, edited_sha256 string, digest string, edited_digest string, near_edited double, near_next double, form binary")
    rows = rows.where("kind = 0").select(names).unionByName(closed)
    odd = scratch.save(collisions(rows.where("form is not null").select("doc_id", "digest", "form")).dropDuplicates(["doc_id", "digest"]), "collisions")
    return rows.join(odd, ["doc_id", "digest"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.concat("digest", F.coalesce("suffix", F.lit(""))).alias("fingerprint"), F.col("edited_digest").alias("edited_fingerprint"), "near_edited", "near_next"
    )
