"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the UTF-8 bytes cuts each text into chunks at places that
depend on the sixteen bytes before them alone, so a passage that occurs in many
documents gives the same chunks wherever it stands. A chunk is reused by the
documents of one task, as long as the task's bounded memory of chunks holds it;
across its tasks a Python worker keeps words and pre-tokens only.

A cut may fall inside a word, so the encoding of chunks can't simply be joined.
What a chunk keeps is the encoding of its words between its first and its last
blank, and the two open fragments at its ends. At each join the fragments are
put together, over as many chunks as have no blank, and re-encoded: the window
grows to the blanks on either side, where both neighbours' encodings agree with
that of the whole text, because the tokenizer's normalizer, special tokens and
pre-tokenizer never carry anything across a blank (checked by ``supports``, and
by tests against the library on whole texts).

Defined cases: null counts as empty text and has no tokens; empty text decodes
to empty text; a text without blanks is one fragment, encoded whole; repeated
rows give equal rows; other columns of the input are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ckptlake.llm import _text

WINDOW = 16
#: Fixed value: how the tokenizer's file writes its pre-tokens; and the same for words of ASCII and Latin-1 letters, which normalisation only lower-cases.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LATIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff]+")
OUTPUTS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def supports(spec: dict) -> bool:
    """Whether blanks part this tokenizer's words for good: white space is folded and dropped before BPE, and no decoder rewrites tokens."""
    steps = spec.get("normalizer") or {}
    kinds = [s["type"] for s in steps.get("normalizers", [steps])]
    pre = json.dumps(spec.get("pre_tokenizer") or {})
    return "Replace" in kinds and set(kinds) <= {"NFC", "Replace", "Lowercase"} and "[^\\\\s" in pre and spec.get("decoder") is None and spec.get("post_processor") is None and not any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))


def cuts(buf: np.ndarray, offsets: np.ndarray, bits: int = 10) -> np.ndarray:
    """Ascending places where the rolling hash cuts the slice, besides its rows' own bounds. Chunks have 2**bits bytes on average."""
    if len(buf) <= WINDOW:
        return np.zeros(0, np.int64)
    h = (buf.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    factor, width = 0x85EBCA6B, 1
    while width < WINDOW:
        h = h[width:] + h[:-width] * np.uint32(factor)
        factor, width = factor * factor & 0xFFFFFFFF, width * 2
    at = np.flatnonzero((h * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits) == 0) + WINDOW
    at = at[at < len(buf)]
    at = at[buf[at] & 0xC0 != 0x80]
    row = np.searchsorted(offsets, at, "right") - 1
    return at[at - offsets[row] >= WINDOW]


class ChunkCodec:
    """Encoder and decoder with a bounded memory of words and chunks."""

    def __init__(self, spec: str, bits: int = 10, most_words: int = 120_000, most_chunk_bytes: int = 12 << 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        if not supports(json.loads(spec)):
            raise ValueError("this tokenizer carries context across blanks")
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bits, self.most_words, self.most_chunk_bytes = bits, most_words, most_chunk_bytes
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.names[i] = token.encode() + b" "
        self.digits = [b"%d " % i for i in range(len(self.names))]
        self.closes = np.array([n.endswith(b"</w> ") for n in self.names])
        self.latin = PATTERN in spec  # else words are encoded whole
        # Each memory has two generations: a full one is kept beside a new one until that is full, so what is in use stays.
        self.pieces: dict[str, tuple[bytes, bytes]] = {}
        self.old_pieces: dict[str, tuple[bytes, bytes]] = {}
        self.old_words: dict[bytes, tuple[bytes, bytes]] = {}
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_bytes = self.encoded = self.reused = 0

    def _encode_many(self, some: list[str]) -> list[list[int]]:
        """The ids of each of some pre-tokens: each ends with a token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids)
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist() if len(ids) else []
        if len(ends) != len(some):
            return [self.tokenizer.encode(s, add_special_tokens=False).ids for s in some]
        ids = ids.tolist()
        return [ids[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: set[bytes]) -> None:
        """Encode words not seen yet: plain Latin ones by their pre-tokens, which many words share, others whole."""
        plain, need = [], set()
        for w in words:
            if w in self.words:
                continue
            if w in self.old_words:
                self.words[w] = self.old_words[w]
                continue
            s = w.decode()
            if self.latin and _LATIN.fullmatch(s) and "<|" not in s:
                parts = _PARTS.findall(s.lower())
                plain.append((w, parts))
                need.update(parts)
            else:
                own = self.tokenizer.encode(s, add_special_tokens=False).ids
                self.words[w] = b"".join([self.digits[i] for i in own]), b"".join([self.names[i] for i in own])
        if len(self.pieces) > self.most_words:
            self.old_pieces, self.pieces = self.pieces, {}
        new = []
        for s in need:
            if s not in self.pieces:
                if s in self.old_pieces:
                    self.pieces[s] = self.old_pieces[s]
                else:
                    new.append(s)
        for a in range(0, len(new), 2048):
            for s, own in zip(new[a : a + 2048], self._encode_many(new[a : a + 2048]), strict=True):
                self.pieces[s] = b"".join([self.digits[i] for i in own]), b"".join([self.names[i] for i in own])
        for w, parts in plain:
            got = [self.pieces[s] for s in parts]
            self.words[w] = got[0] if len(got) == 1 else (b"".join([g[0] for g in got]), b"".join([g[1] for g in got]))

    def rest(self) -> None:
        """Between tasks only the newest words and pre-tokens are kept."""
        self.chunks, self.old_words, self.old_pieces, self.chunk_bytes = {}, {}, {}, 0

    def run(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        """For each row: its ids in decimal, each with a blank after it; its tokens, likewise."""
        if len(self.words) > self.most_words:
            self.old_words, self.words = self.words, {}
        if self.chunk_bytes > self.most_chunk_bytes:
            self.chunks.clear()
            self.chunk_bytes = 0
        data, places = buf.tobytes(), cuts(buf, offsets, self.bits)
        bounds = np.searchsorted(places, offsets)
        places = places.tolist()
        rows: list[list[bytes]] = []
        fresh: dict[bytes, list] = {}
        for a, b, i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ends = [a, *places[i:j], b]
            rows.append(own := [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)])
            for c in own:
                if c not in self.chunks and c not in fresh:
                    fresh[c] = c.split()
        need: set[bytes] = set()
        know, opened = self.words.get, {}
        for c, words in fresh.items():
            head = not c[:1].isspace() and bool(c)
            tail = not c[-1:].isspace() and bool(c)
            if len(words) == 1 and head and tail:
                opened[c] = None
                continue
            body = words[head : len(words) - tail]
            known = list(map(know, body))
            if None in known:
                need.update([w for w, k in zip(body, known, strict=True) if k is None])
                known = None
            opened[c] = (words[0] if head else b"", body, known, words[-1] if tail else b"")
        self._learn(need)
        for c, got in opened.items():
            if got is None:
                self.chunks[c] = ()
            else:
                first, body, known, last = got
                known = known or list(map(know, body))
                self.chunks[c] = (first, b"".join([k[0] for k in known]), b"".join([k[1] for k in known]), last)
                self.chunk_bytes += len(c) + len(self.chunks[c][1]) + len(self.chunks[c][2]) + 300
        self.encoded += len(opened)
        plans, seams = [], set()
        for own in rows:
            self.reused += len(own)
            plan, open_word = [], b""
            for c in own:
                entry = self.chunks[c]
                if not entry:
                    open_word += c
                    continue
                if word := open_word + entry[0]:
                    seams.add(word)
                    plan.append(word)
                plan.append(entry)
                open_word = entry[3]
            if open_word:
                seams.add(open_word)
                plan.append(open_word)
            plans.append(plan)
        self._learn(seams)
        return [
            (b"".join([know(p)[0] if type(p) is bytes else p[1] for p in plan]), b"".join([know(p)[1] if type(p) is bytes else p[2] for p in plan]))
            for plan in plans
        ]


_codecs: dict[tuple, ChunkCodec] = {}


def codec(spec: str, bits: int) -> ChunkCodec:
    """The worker's codec, kept across its tasks."""
    key = (hashlib.sha256(spec.encode()).digest(), bits)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = ChunkCodec(spec, bits)
    return _codecs[key]


def code(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded"), bits: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the outputs asked for (of OUTPUTS) of every whole text.

    ids and decoded are the library's encode(text, add_special_tokens=False).ids and
    decode(ids, skip_special_tokens=False); the digests are sha256 of the ids in
    decimal, joined by blanks, and of the decoded text. The tokenizer's file (a
    few MB at most) is read by the driver and broadcast.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > 64 << 20:
        raise ValueError("a tokenizer of more than 64 MB is not broadcast")
    if not supports(json.loads(text)):
        raise ValueError("this tokenizer carries context across blanks")
    spec = docs.sparkSession.sparkContext.broadcast(text)

    def run(batches):
        own = codec(spec.value, bits)
        gc.disable()  # what the codec keeps has no cycles, and millions of entries make collections slow
        try:
            yield from coded(own, batches)
        finally:
            gc.enable()
            own.rest()
            _text.release()

    def coded(own, batches):
        for batch in batches:
            for at, to, buf, offsets in _text.slices(batch.column("text")):
                got = own.run(buf, offsets)
                made = {"doc_id": batch.column("doc_id").slice(at, to - at)}
                for name in outputs:
                    if name == "n_tokens":
                        made[name] = pa.array([i.count(b" ") for i, _ in got], pa.int64())
                    elif name == "ids":
                        made[name] = pa.array([np.fromstring(i, np.int32, sep=" ") if i else np.zeros(0, np.int32) for i, _ in got], pa.list_(pa.int32()))
                    elif name == "decoded":
                        made[name] = pa.array([t[:-1].decode() for _, t in got], pa.string())
                    elif name == "ids_sha256":
                        made[name] = pa.array([hashlib.sha256(i[:-1]).hexdigest() for i, _ in got], pa.string())
                    else:
                        made[name] = pa.array([hashlib.sha256(t[:-1]).hexdigest() for _, t in got], pa.string())
                yield pa.RecordBatch.from_pydict(made)

    return _text.select(docs, id_col, text_col).mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {OUTPUTS[n]}" for n in outputs)]))
