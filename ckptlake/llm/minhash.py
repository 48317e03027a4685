"""Near-duplicate groups: one-permutation hashing, banded buckets, star-shaped candidates.

A document's set is its distinct word shingles. One hash of each shingle both
picks a bin and competes in it; empty bins are filled by optimal densification
(each looks up bins in an order of its own until one is filled). Bands of bins
make buckets. In a bucket every member is held against one centre, the most
popular member (the one whose buckets are largest), so candidate pairs grow with
members and not with their square. Every candidate is confirmed on the full sets.

The star alone could lose a link between two members that the centre isn't
linked with. So, after the confirmed links have been joined to components, the
members of each bucket that still are in another component than its centre are
held, in blocks of ``BLOCK``, against all members that share a bucket with the
centre: every pair of one bucket ends in one component or has been compared.

Equal sets are one node from the start, however many documents have them; joins by
bucket, centre and component are salted by node. Bands
and rows are chosen so that a pair at the threshold is missed by all bands with a
probability of at most ``MISS``.

Defined cases: null or empty texts have no shingles and are linked with nothing,
each its own component; fewer words than a shingle are one shingle; rows with the
same id are one document if their texts have the same set; null ids never name a
component; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ckptlake.llm import _text
from ckptlake.llm.store import Scratch, beside
from ckptlake.operators.dag import hooked

BANDS = 32
MISS = 1e-6
BLOCK = 256
#: A side of so many ids (8 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_IDS = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    """The most rows of a band with which a pair at the threshold is missed so seldom."""
    return max([r for r in range(1, 17) if (1 - (percent / 100) ** r) ** bands <= miss], default=1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row of a slice, ascending, and the rows' bounds."""
    words = _text.Words(buf, offsets)
    h, counts, first = words.hashes(), words.counts, words.row_offsets[:-1]
    n = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    row = np.repeat(np.arange(words.rows), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + first[row]
    inside = np.minimum(counts, width)[row]
    total = np.zeros(len(row), np.uint64)
    for k in range(width):
        factor = np.uint64(int.from_bytes(xxhash.xxh64_digest(f"shingle{k}".encode()), "big") | 1)
        have = inside > k
        total[have] += h[at[have] + k] * factor
    s = _text.mix(total + inside.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    s[s == _EMPTY] = np.uint64(0)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[new], row[new]
    return s, np.searchsorted(row, np.arange(words.rows + 1))


def signatures(sets: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation hashes of the rows, densified; rows without shingles stay empty."""
    rows = len(bounds) - 1
    of = np.repeat(np.arange(rows), np.diff(bounds))
    cell = of * bins + ((sets >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # sets ascend, so a bin's least hash comes first
    sig = np.full(rows * bins, _EMPTY)
    sig[cell[first]] = _text.mix(sets[first])
    full = sig != _EMPTY
    open_cells = np.flatnonzero(~full & np.repeat(np.diff(bounds) > 0, bins))
    donors, tries = open_cells % bins, 0
    rest = np.arange(len(open_cells))
    fill = np.zeros(len(open_cells), np.int64)
    while len(rest):
        tries += 1
        if tries <= 4 * bins:
            at = _text.mix(donors[rest].astype(np.uint64) * np.uint64(1_000_003) + np.uint64(tries)) % np.uint64(bins)
        else:  # only a row with very few filled bins comes here: walk on from where the bin stands
            at = ((donors[rest] + tries) % bins).astype(np.uint64)
        source = open_cells[rest] - donors[rest] + at.astype(np.int64)
        hit = full[source]
        fill[rest[hit]] = source[hit]
        rest = rest[~hit]
    sig[open_cells] = sig[fill]
    return sig.reshape(rows, bins)


def band_hashes(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.shape[1] // bands
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows)
    factors = _text.mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    return _text.mix((parts * factors[None]).sum(2, dtype=np.uint64) + factors[None, :, 0]).view(np.int64)


def _sign(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for at, to, buf, offsets in _text.slices(batch.column("text")):
                s, bounds = shingle_sets(buf, offsets, width)
                n = np.diff(bounds)
                h = band_hashes(signatures(s, bounds, bands * rows), bands)
                nodes = [xxhash.xxh3_128_digest(s[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * bands, pa.int32()), pa.array(h.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(nodes, pa.binary()), flat], ["doc_id", "n_shingles", "node", "bands"])
            _text.release()

    return run


def _sets(width: int):
    def run(batches):
        for batch in batches:
            for _, _, buf, offsets in _text.slices(batch.column("text")):
                s, bounds = shingle_sets(buf, offsets, width)
                blobs = [s[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(b) for b in blobs], pa.binary()), pa.array(blobs, pa.binary())], ["node", "members"])

    return run


def _similar(shared: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (a + b - shared)


def _against_centre(percent: int):
    """Rows in the order of (centre, part, whether the centre itself comes): the links of each member with its centre."""

    def run(batches):
        centre, key = None, None
        for batch in batches:
            a, b = [], []
            for c, p, node, members in zip(*(batch.column(k).to_pylist() for k in ("centre", "part", "node", "members")), strict=True):
                mine = np.frombuffer(members, np.uint64)
                if node is None:
                    centre, key = mine, (c, p)
                    continue
                if key != (c, p):
                    raise ValueError("a candidate came without its centre")
                at = np.minimum(np.searchsorted(centre, mine), len(centre) - 1)
                if _similar(np.int64((centre[at] == mine).sum()), len(centre), np.int64(len(mine)), percent):
                    a.append(node)
                    b.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _against_block(percent: int):
    """Rows in the order of (centre, block, part, whether of the block): links between block and members, as pairs of the components they are in so far."""

    def run(batches):
        key, block, told = None, [], set()
        index = owner = sizes = None
        for batch in batches:
            a, b = [], []
            for c, bl, p, inside, node, label, members in zip(*(batch.column(k).to_pylist() for k in ("centre", "block", "part", "inside", "node", "label", "members")), strict=True):
                mine = np.frombuffer(members, np.uint64)
                if key != (c, bl, p):
                    key, block, index, told = (c, bl, p), [], None, set()
                if inside:
                    block.append((node, label, mine))
                    continue
                if index is None:
                    flat = np.concatenate([m for _, _, m in block])
                    order = np.argsort(flat, kind="stable")
                    index, owner = flat[order], np.repeat(np.arange(len(block)), [len(m) for _, _, m in block])[order]
                    sizes = np.array([len(m) for _, _, m in block])
                lo, hi = np.searchsorted(index, mine), np.searchsorted(index, mine, "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                shared = np.bincount(owner[at], minlength=len(block))
                for k in np.flatnonzero(_similar(shared, len(mine), sizes, percent)):
                    if block[k][1] != label and (block[k][1], label) not in told:
                        told.add((block[k][1], label))
                        a.append(block[k][1])
                        b.append(label)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    return hooked(links, ends, scratch)


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the set's size, and the least id that links lead to.

    Two documents are linked if 100 * |A and B| >= percent * |A or B|.
    """
    return _linked(docs, width, percent, id_col, text_col, bands).select("doc_id", "n_shingles", "component_id")


def _linked(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, bands: int = BANDS) -> DataFrame:
    """What groups gives, with each row's node and the label of its component (null without shingles)."""
    spark = docs.sparkSession
    base = _text.select(docs, id_col, text_col)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark, "minhash")
    rows = rows_per_band(percent, bands)
    signed = scratch.save(base.mapInArrow(_sign(width, bands, rows), "doc_id long, n_shingles long, node binary, bands array<long>"), "signed")
    nodes = scratch.save(signed.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.any_value("bands").alias("bands")), "nodes")

    entries = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = scratch.save(beside(entries, sizes, "bucket", F.col("node")), "shared")
    popular = shared.groupBy("node").agg(F.sum("size").alias("popular"))
    centres = shared.join(popular, "node").groupBy("bucket").agg(F.max(F.struct("popular", "node", "n")).alias("c")).select("bucket", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n"))
    pairs = scratch.save(beside(shared, centres, "bucket", F.col("node")).select("node", "n", "centre", "centre_n").distinct(), "pairs")
    alike = (F.col("node") != F.col("centre")) & (100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n"))
    edges = pairs.where(alike).select("node", "centre")

    used = pairs.groupBy("node").agg(F.lit(1).alias("one")).join(nodes.where("first_id is not null"), "node").select(F.col("first_id").alias("doc_id")).distinct()
    count = used.count()
    picked = base.join(F.broadcast(used) if count <= BROADCAST_IDS else used, "doc_id").unionByName(base.where("doc_id is null"))  # some nodes have null ids alone
    sets = scratch.save(picked.select("text").mapInArrow(_sets(width), "node binary, members binary").dropDuplicates(["node"]), "sets")

    degree = edges.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # A centre's set goes to each of its parts; a member goes to one part.
    hubs = degree.join(sets, degree.centre == sets.node).select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("binary").alias("node"), "members")
    spokes = beside(edges, degree, "centre", F.col("node")).join(sets, "node").select("centre", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node", "members")
    meet = hubs.unionByName(spokes).repartition(parts, "centre", "part").sortWithinPartitions("centre", "part", F.col("node").isNotNull())
    links = scratch.save(meet.mapInArrow(_against_centre(percent), "a binary, b binary"), "links")

    labels = _connected(links, scratch)
    of_centre = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    around = pairs.where("node <> centre").select("node", "centre").join(labels, "node", "left")
    around = beside(around, of_centre, "centre", F.col("node"), "left").select("centre", "node", F.coalesce("label", "node").alias("label"), (F.coalesce("label", "node") != F.coalesce("centre_label", "centre")).alias("left_out"))
    spread = around.groupBy("centre").agg(F.ceil(F.sum(F.col("left_out").cast("int")) / BLOCK).cast("int").alias("blocks"), F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("parts"), F.count("*").alias("around")).where("blocks > 0 and around > 1")
    around = beside(around, spread, "centre", F.col("node")).join(sets, "node")
    block = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    inside = around.where("left_out").select("centre", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("inside"), "node", "label", "members")
    outside = around.select("centre", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("inside"), "node", "label", "members")
    held = inside.unionByName(outside).repartition(parts, "centre", "block", "part").sortWithinPartitions("centre", "block", "part", F.col("inside").desc())
    more = scratch.save(held.mapInArrow(_against_block(percent), "a binary, b binary"), "more")
    of = nodes.select("node", "first_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if more.limit(1).count():
        further = _connected(more, scratch).select(F.col("node").alias("label"), F.col("label").alias("root"))
        of = of.join(further, "label", "left").withColumn("label", F.coalesce("root", "label"))
    least = of.groupBy("label").agg(F.min("first_id").alias("component_id"))
    found = scratch.save(beside(of, least, "label", F.col("node")).select("node", "label", "component_id"), "found")
    scratch.drop(nodes, shared, pairs, sets, links, more)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.join(found, "node", "left").select("doc_id", "n_shingles", component.alias("component_id"), "node", "label")


def _with_nodes(text_col: str, width: int):
    """Rows as they are, with the digest of their set."""

    def run(batches):
        for batch in batches:
            nodes = []
            for _, _, buf, offsets in _text.slices(batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string())):
                s, bounds = shingle_sets(buf, offsets, width)
                nodes += [xxhash.xxh3_128_digest(s[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.binary())], [*batch.schema.names, "__node"])
            _text.release()

    return run


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each component: the row of least id, null ids last, then of least set digest, then of least text.

    Of rows without shingles, those with one id are one document; those with null ids all stay.
    """
    spark = docs.sparkSession
    found = Scratch(spark, "near").save(_linked(docs, width, percent, id_col, text_col), "groups")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    own = F.col(id_col).cast("long")
    several = found.where("doc_id is not null").groupBy(F.col("doc_id").alias("__several")).count().where("count > 1").select("__several")
    if not several.limit(1).count() and not found.where("doc_id is null").limit(1).count():
        return docs.join(small(gone), own == F.col("__gone"), "left_anti")
    # An id of one row tells that row; other rows are told by id and set.
    several = small(several)
    kept = docs.where(own.isNotNull()).join(several, own == F.col("__several"), "left_anti").join(small(gone), own == F.col("__gone"), "left_anti")
    rest = docs.where(own.isNull()).unionByName(docs.join(several, own == F.col("__several"), "left_semi"))
    rest = rest.mapInArrow(_with_nodes(text_col, width), StructType([*docs.schema.fields, StructField("__node", BinaryType())]))
    firsts = found.where("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("k"))
    firsts = firsts.select(F.col("k.doc_id").alias("__id"), F.col("k.node").alias("__first"))
    nothing = F.col("__node") == F.lit(bytearray(xxhash.xxh3_128_digest(b"")))
    full = rest.where(~nothing).join(firsts, own.eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__first")), "left_semi")
    once = full.unionByName(rest.where(nothing & own.isNotNull())).groupBy(own.alias("__id"), "__node")
    once = once.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("__row")).select("__row.*")
    return kept.unionByName(once).unionByName(rest.where(nothing & own.isNull()).select(*docs.columns))
