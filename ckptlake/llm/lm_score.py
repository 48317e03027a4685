"""Document log-likelihoods: a word unigram over the whole corpus, and a recurrent model.

One pass over the texts deals the hashes of their words to shards, as blobs: for
each group of documents (a few million tokens) and shard, the distinct hashes
with (document, times) of each. A shard therefore has all occurrences of its
words: it adds up their counts over the training documents, and from these each
document's share of ``sum log10(c + 1/2)``. Hashes of a word that many documents
hold are one entry a group, so no shard grows with a word's frequency alone.

The recurrent model (:mod:`ckptlake.llm.gru`) knows the most frequent training
words; it is trained on every training document where the document lies, from
the same start in every partition, and the partitions' weights are averaged by
their tokens in a tree. Words outside its vocabulary are foretold as one class
times their smoothed share of the corpus counts.

Counts and totals cover all documents and nothing is sent to the driver but
totals, the vocabulary's counts and one model. Words are told apart by 64-bit
hashes.

Defined cases: null or empty texts are one end token; null ids count as training
rows; repeated rows score alike and count again each; an empty table gives an
empty table; without training documents every count is 0 and the base is that of
``V = 0``; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ckptlake.llm import _text, gru
from ckptlake.llm.store import Scratch, shards_for

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a document; no word
GROUP_TOKENS = 2_000_000
GROUP_ROWS = 50_000
#: Text whose words make one shard, on average: their hashes and places take about as much again.
SHARD_BYTES = 16 << 20


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each row of a slice, in order; the tokens of each row."""
    words = _text.Words(buf, offsets)
    return np.insert(words.hashes(), words.row_offsets[1:], END), words.counts + 1


def _groups(batches, columns: tuple[str, ...]):
    """(hashes, lengths, {column: values}) of runs of rows of a few million tokens."""
    held: list = []
    size = rows = 0
    for batch in batches:
        for at, to, buf, offsets in _text.slices(batch.column("text")):
            h, n = tokens(buf, offsets)
            held.append((h, n, [batch.column(c).slice(at, to - at) for c in columns]))
            size, rows = size + len(h), rows + to - at
            if size >= GROUP_TOKENS or rows >= GROUP_ROWS:
                yield _joined(held, columns)
                held, size, rows = [], 0, 0
    if held:
        yield _joined(held, columns)
    _text.release()


def _joined(held, columns):
    return np.concatenate([h for h, _, _ in held]), np.concatenate([n for _, n, _ in held]), {c: pa.concat_arrays([v[k] for _, _, v in held]) for k, c in enumerate(columns)}


_BLOB = "shard int, grp long, hashes binary, sizes binary, docs binary, times binary, train binary, ids binary, lengths binary"


def _deal(shards: int):
    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        for k, (h, n, more) in enumerate(_groups(batches, ("doc_id", "text_hash", "held"))):
            train = ~more["held"].to_numpy(zero_copy_only=False).astype(bool)
            doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(h))).astype(np.int32)
            h, doc = h[at], doc[at]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            names = np.flatnonzero(first)
            size = np.diff(np.append(names, len(h))).astype(np.int32)
            where = ((h[names] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)  # ascending, as the hashes are
            cut = np.searchsorted(where, np.arange(shards + 1))
            group = (pid << 20) + k
            for s in range(shards):
                a, b = cut[s], cut[s + 1]
                if a == b and s:
                    continue
                x, y = (names[a] if a < len(names) else len(h)), (names[b] if b < len(names) else len(h))
                own = [h[names[a:b]].tobytes(), size[a:b].tobytes(), doc[x:y].tobytes(), times[x:y].tobytes(), np.packbits(train).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([group]), *(pa.array([o], pa.binary()) for o in own), pa.array([_pack(more) if not s else b""], pa.binary()), pa.array([n.astype(np.int32).tobytes() if not s else b""], pa.binary())],
                    ["shard", "grp", "hashes", "sizes", "docs", "times", "train", "ids", "lengths"],
                )

    return run


def _pack(columns: dict) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pydict({k: columns[k] for k in ("doc_id", "text_hash", "held")})
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


_REPLY = "kind int, grp long, docs binary, sums binary, known binary, ids binary, lengths binary, train binary, count long"


def _reduce(best: int):
    """A shard: counts of its words over training documents; each group's sums; its most frequent words; its totals."""

    def run(table: pa.Table) -> pa.Table:
        out = {k: [] for k in ("kind", "grp", "docs", "sums", "known", "ids", "lengths", "train", "count")}

        def put(**row):
            for k, v in out.items():
                v.append(row.get(k))

        groups = [{k: v for k, v in zip(table.column_names, row, strict=True)} for row in zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True)]
        if not groups:
            return pa.Table.from_pydict(out, schema)
        hashes = [np.frombuffer(g["hashes"], np.uint64) for g in groups]
        all_names, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        counts = np.zeros(len(all_names), np.int64)
        parsed, at = [], 0
        for g, h in zip(groups, hashes, strict=True):
            which = np.repeat(inverse[at : at + len(h)], np.frombuffer(g["sizes"], np.int32))
            at += len(h)
            doc, times = np.frombuffer(g["docs"], np.int32), np.frombuffer(g["times"], np.int32)
            train = np.unpackbits(np.frombuffer(g["train"], np.uint8)).astype(bool)
            counts += np.bincount(which, times * train[doc] if len(doc) else None, len(all_names)).astype(np.int64)
            parsed.append((which, doc, times))
        logs = np.log10(counts + 0.5)
        for g, (which, doc, times) in zip(groups, parsed, strict=True):
            there = np.unique(doc)
            place = np.searchsorted(there, doc)
            sums = np.bincount(place, logs[which] * times, len(there))
            known = np.bincount(place, (counts[which] > 0) * times, len(there)).astype(np.int32)
            put(kind=0, grp=g["grp"], docs=there.astype(np.int32).tobytes(), sums=sums.tobytes(), known=known.tobytes(), ids=g["ids"], lengths=g["lengths"], train=g["train"] if g["ids"] else b"")
        put(kind=1, grp=int((counts > 0).sum()), count=int(counts.sum()))
        words = np.flatnonzero((counts > 0) & (all_names != END))
        words = words[np.lexsort((all_names[words].view(np.int64), -counts[words]))[:best]]
        put(kind=2, grp=groups[0]["shard"], docs=all_names[words].tobytes(), sums=counts[words].tobytes())
        for k in np.flatnonzero(all_names == END):
            put(kind=3, count=int(counts[k]))
        return pa.Table.from_pydict(out, schema)

    schema = pa.schema([("kind", pa.int32()), ("grp", pa.int64()), *((c, pa.binary()) for c in ("docs", "sums", "known", "ids", "lengths", "train")), ("count", pa.int64())])
    return run


_ROWS = "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, log_sum double"


def _collect(table: pa.Table) -> pa.Table:
    """A group: its documents' tokens, sums and known tokens, from the shards' replies."""
    rows = table.select(["docs", "sums", "known", "ids", "lengths"]).to_pylist()
    head = next(r for r in rows if r["ids"])
    lengths, own = np.frombuffer(head["lengths"], np.int32), pa.ipc.open_stream(head["ids"]).read_all()
    sums, known = np.zeros(len(lengths)), np.zeros(len(lengths), np.int64)
    for r in rows:
        at = np.frombuffer(r["docs"], np.int32)
        sums[at] += np.frombuffer(r["sums"])
        known[at] += np.frombuffer(r["known"], np.int32)
    return pa.table({"doc_id": own["doc_id"], "text_hash": own["text_hash"], "held_out": own["held"], "n_tokens": lengths.astype(np.int64), "n_known": known, "log_sum": sums})


class Vocabulary:
    """The words the recurrent model tells apart: hashes, ascending, with rank and count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, size: int):
        order = np.lexsort((hashes, -counts))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        by_hash = np.argsort(hashes)
        self.hashes, self.ranks, self.size = hashes[by_hash], rank[by_hash].astype(np.int32), size
        self.counts = np.concatenate([counts[order], np.zeros(size - len(order))])

    def rank(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.ranks[at], self.size).astype(np.int32)


def _lanes(lengths: np.ndarray, steps: int, most: int) -> int:
    total = int(lengths.sum())
    return max(1, min(most, total // steps, total // max(1, int(lengths.max(initial=1)))))


def _train(model: gru.Model, words: Vocabulary, stride: int, rate: float):
    def run(batches):
        from pyspark import TaskContext

        own, count = model, 0
        for h, n, _ in _groups(batches, ()):
            lanes = gru.Lanes(words.rank(h), n, words.size + 1, _lanes(n, gru.STEPS * 100, 256))
            own, _ = gru.train(own, lanes, stride, rate, phase=TaskContext.get().partitionId())
            count += len(h)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([float(count)]), pa.array([own.flat().tobytes()], pa.binary())], ["part", "weight", "flat"])

    return run


def _mean(table: pa.Table) -> pa.Table:
    total, weight = None, 0.0
    for w, flat in zip(table["weight"].to_pylist(), table["flat"], strict=True):
        v = np.frombuffer(flat.as_py(), np.float32).astype(np.float64) * w
        total, weight = v if total is None else total + v, weight + w
    return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int64()), "weight": pa.array([weight]), "flat": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary())})


def _best(most: int):
    """The most frequent words of several lists."""

    def run(table: pa.Table) -> pa.Table:
        names = np.concatenate([np.frombuffer(b.as_py(), np.uint64) for b in table["docs"]])
        counts = np.concatenate([np.frombuffer(b.as_py(), np.int64) for b in table["sums"]])
        order = np.lexsort((names.view(np.int64), -counts))[:most]
        return pa.table({"grp": table["grp"].slice(0, 1), "docs": pa.array([names[order].tobytes()], pa.binary()), "sums": pa.array([counts[order].tobytes()], pa.binary())})

    return run


def _average(trained: DataFrame, parts: int, fan: int = 32) -> np.ndarray | None:
    """The mean of the partitions' weights, in a tree of which no node has more than fan children."""
    while parts > 1:
        parts = -(-parts // fan)
        trained = trained.withColumn("part", F.expr(f"part div {fan}").cast("long")).groupBy("part").applyInArrow(_mean, "part long, weight double, flat binary")
    got = trained.collect()
    return np.frombuffer(got[0]["flat"], np.float32) if got else None


def _neural(model: gru.Model, words: Vocabulary):
    logs = np.append(np.log10(words.counts + 0.5), 0.0)

    def run(batches):
        for h, n, more in _groups(batches, ("doc_id", "text_hash")):
            t = words.rank(h)
            lanes = gru.Lanes(t, n, words.size + 1, _lanes(n, gru.STEPS * 16, 512))
            of = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays(
                [more["doc_id"], more["text_hash"], pa.array(gru.score(model, lanes, len(n)) / math.log(10)), pa.array(np.bincount(of, t == words.size, len(n)).astype(np.int64)), pa.array(np.bincount(of, logs[t], len(n)))],
                ["doc_id", "text_hash", "neural", "n_tail", "head_log"],
            )

    return run


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 1024, hidden: int = 16, stride: int = 1, rate: float = 0.02, shards: int | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    held_out: a condition on doc_id; such documents are scored but not learnt
    from. vocabulary: words of the recurrent model, a multiple of its class size.
    stride: the weights move at every stride-th window of a lane, while the state
    goes through all of them; with 1 every training token is learnt from.
    """
    spark = docs.sparkSession
    base = _text.select(docs, id_col, text_col)
    base = base.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.coalesce(held_out, F.lit(False)).alias("held"))
    shards = shards or shards_for(base, SHARD_BYTES)
    scratch = Scratch(spark, "lm")
    replies = scratch.save(base.mapInArrow(_deal(shards), _BLOB).groupBy("shard").applyInArrow(_reduce(vocabulary), _REPLY), "replies")
    totals = replies.where("kind = 1").agg(F.sum("count").alias("n"), F.sum("grp").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    ends = replies.where("kind = 3").agg(F.sum("count")).first()[0] or 0
    top, left = replies.where("kind = 2").select("grp", "docs", "sums"), shards
    while left > 1:
        left = -(-left // 32)
        top = top.withColumn("grp", F.expr("grp div 32")).groupBy("grp").applyInArrow(_best(vocabulary - 1), "grp long, docs binary, sums binary")
    top = top.collect()
    names = np.concatenate([*(np.frombuffer(r["docs"], np.uint64) for r in top), [END]])
    words = Vocabulary(names, np.concatenate([*(np.frombuffer(r["sums"], np.int64) for r in top), [ends]]).astype(float), vocabulary)
    rest, rest_words = n - int(words.counts.sum()), max(0, v - int((words.counts > 0).sum()))
    model = gru.Model.new(words.counts, rest, hidden)
    learn = base.where("not held").select("text")
    flat = _average(learn.mapInArrow(_train(model, words, stride, rate), "part long, weight double, flat binary"), max(1, learn.rdd.getNumPartitions()))
    if flat is not None:
        model = model.with_flat(flat)
    rows = replies.where("kind = 0").groupBy("grp").applyInArrow(_collect, _ROWS)
    neural = base.select("doc_id", "text", "text_hash").mapInArrow(_neural(model, words), "doc_id long, text_hash long, neural double, n_tail long, head_log double").dropDuplicates(["doc_id", "text_hash"])
    both = rows.alias("r").join(neural.alias("n"), F.col("r.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("r.text_hash").eqNullSafe(F.col("n.text_hash")), "left")
    return both.select(
        F.col("r.doc_id").alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_sum") - F.col("n_tokens") * math.log10(n + 0.5 * (v + 1))).alias("base_score"),
        (F.col("neural") + F.col("log_sum") - F.col("head_log") - F.col("n_tail") * math.log10(rest + 0.5 * (rest_words + 1))).alias("score"),
    )
