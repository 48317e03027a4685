"""Every operator over a small table of hard cases, against brute force, and over empty tables."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ckptlake.llm import _text, bpe, decontaminate, fingerprint, gru, html_text, licenses, lm_score, minhash, quality, suffix_dedup, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def blanks(t):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def corpus():
    rng = random.Random(5)
    sentence = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage = sentence(120), sentence(30)
    texts = [base, base, base.replace(" ", "  ", 5), base.upper(), base + " tail end", None, "", " \n\t", "one", "one two", "é" * 70, "Ünïcode ﬁ ½ ß " * 9]
    words = base.split()
    for k in range(12):
        changed = list(words)
        for _ in range(k):
            changed[rng.randrange(len(changed))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(changed))
    for k in range(10):
        texts.append(sentence(20 + k) + " " + passage + " " + sentence(15))
    texts += ["Released under the MIT License. Apache License, Version 2.0; CC BY-NC under the mit license", "under the mit\nlicense", "x" * 3000, "ab" * 400, sentence(4000)]
    return [(k, t) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "a", i, "n", 1.0) for i, t in rows], "doc_id long, text string, digest string, n_shingles long, node string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_bpe_matches_the_library(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = by_id(bpe.code(docs, path, tuple(bpe.OUTPUTS), bits=5))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert list(got[i]["ids"]) == ids and got[i]["decoded"] == text and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.code(empty, path).count() == 0


def test_bpe_joins_of_tiny_chunks():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = bpe.ChunkCodec(f.read(), bits=2)
    rng, signs = random.Random(3), [*"abXY019'!?.<|>- \n\t\x0b\x85  éÉßñ×÷İıſK日́̈ﬁ½Σς😀​", "'s", "'re", "<|startoftext|>", "<|endoftext|>", " the "]
    for _ in range(400):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(4)]
        for _, _, buf, offsets in _text.slices(pa.array(texts)):
            for t, (ids, names) in zip(texts, codec.run(buf, offsets), strict=True):
                want = codec.tokenizer.encode(t, add_special_tokens=False).ids
                assert ids.split() == [b"%d" % i for i in want], t
                assert names[:-1].decode() == codec.tokenizer.decode(want, skip_special_tokens=False), t


def test_minhash_components(docs, rows, empty):
    for width, percent in ((3, 85), (5, 80)):
        sets = {}
        for i, t in rows:
            w = blanks(t)
            sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
        root = {i: i for i in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
        got = by_id(minhash.groups(docs, width, percent))
        assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()}
    kept = minhash.keep_first(docs.unionByName(docs.where("doc_id = 0")), 3, 85)
    assert kept.columns == docs.columns and kept.where("doc_id = 0").count() == 1
    assert minhash.groups(empty).count() == 0


def test_minhash_misses_no_pair_at_the_threshold():
    assert all((1 - (p / 100) ** minhash.rows_per_band(p)) ** minhash.BANDS <= minhash.MISS for p in (80, 85, 90))
    sets, bounds = minhash.shingle_sets(np.frombuffer(b"a b c d", np.uint8), np.array([0, 7, 7]), 3)
    sig = minhash.signatures(sets, bounds, 192)
    assert (sig[0] != minhash._EMPTY).all() and (sig[1] == minhash._EMPTY).all()


def test_minhash_links_beside_the_centre(spark):
    """A large group round a hidden original, in which many pairs aren't linked with any one centre."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for _ in range(300):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [frozenset(zip(w, w[1:], w[2:])) for w in (t.split() for t in texts)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = by_id(minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 3, 85))
    assert {i: find(i) for i in range(300)} == {i: r["component_id"] for i, r in got.items()}


def test_minhash_null_ids_as_centre_and_bridge(spark):
    base = [f"w{k}" for k in range(120)]
    changed = lambda *at: " ".join(f"e{k}" if k in at else w for k, w in enumerate(base))
    # 1 and 2 differ too much; each is near the one between them, whose id is null.
    rows = [(1, changed(20, 40)), (2, changed(80, 100)), (None, changed())]
    assert {r["doc_id"]: r["component_id"] for r in minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()} == {1: 1, 2: 1, None: 1}
    rows = [(k, changed(k, k + 60)) for k in range(5, 55, 5)] + [(None, changed()), (None, changed(110)), (None, None)]
    got = minhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert len(got) == len(rows) and {r["component_id"] for r in got if r["n_shingles"]} == {5}


def test_keep_first_decides_by_row(spark):
    base = [f"w{k}" for k in range(120)]
    text = lambda name, at=-1: " ".join(f"e{k}" if k == at else name + w for k, w in enumerate(base))
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (8, text("b", 9)), (None, text("c")), (None, text("c")), (None, text("c", 5)), (None, text("d")), (9, text("e")), (None, text("e", 3)), (None, None), (None, ""), (3, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, node string")
    kept = minhash.keep_first(docs, 5, 80)
    got = collections.Counter((r["doc_id"], (r["text"] or "")[:2]) for r in kept.collect())
    assert kept.columns == docs.columns
    assert got == {(7, "aw"): 1, (7, "bw"): 1, (None, "cw"): 1, (None, "dw"): 1, (9, "ew"): 1, (None, ""): 2, (3, ""): 1}


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        data = (t or "").encode()
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = bytearray(len(data))
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(grams)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, z in zip(data, gone, strict=True) if not z)).hexdigest())
    return out


def test_suffix_dedup_bytes(docs, rows, empty):
    got = by_id(suffix_dedup.repeats(docs))
    assert brute_repeats(rows) == {i: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for i, r in got.items()}
    cut = suffix_dedup.cut_repeats(docs)
    assert cut.columns == docs.columns
    texts = {i: r["text"] for i, r in by_id(cut).items()}
    assert texts[5] is None and texts[1] == "" and texts[0] == rows[0][1]
    assert suffix_dedup.repeats(empty).count() == 0


def test_suffix_block_against_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        data = ["".join(rng.choice("ab") * rng.randrange(1, 4) for _ in range(rng.randrange(120))) for _ in range(6)]
        data[3] = data[0][5:80] + "xyz" + data[1][:70]
        ids = np.arange(6)
        group = suffix_dedup.Group(pa.array(data), ids)
        group.pieces(np.ones(len(group.names), bool))
        d = group.distinct
        text = np.concatenate([group.buf[a : a + s + 49] for a, s in zip(group.first[d], group.starts[d], strict=True)] or [np.zeros(0, np.uint8)])
        least = suffix_dedup.least_ids(group.starts[d], (group.sample - group.first)[d], group.low, text)
        mins = np.concatenate([least[k, :s] for k, s in enumerate(group.starts[d])] or [np.zeros(0, np.int64)])
        gone = group.removed(mins, np.cumsum(group.starts[d]) - group.starts[d])
        want = brute_repeats(list(enumerate(data)))
        assert [int(gone[a:b].sum()) for a, b in zip(group.offsets[:-1], group.offsets[1:], strict=True)] == [want[i][1] for i in range(6)]


def test_decontamination(spark, docs, rows, empty):
    long_words = alnum(rows[0][1])
    items = [(1, " ".join(long_words[3:20])), (2, "ONE"), (3, None), (4, ""), (5, " ".join(long_words[10:18])), (5, "zzz"), (6, " ".join(alnum(rows[24][1])[25:33]) + "!"), (7, "one two")]
    table = spark.createDataFrame(items, "item_id long, text string")
    patterns = collections.defaultdict(set)
    for i, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - 7) if w else 0):
            patterns[tuple(w[k : k + 8])].add(i)
    whole = by_id(decontaminate.find(docs, table))
    blocks = by_id(decontaminate.find(docs, table, block_bytes=400))
    for i, t in rows:
        w = alnum(t)
        hit, found = set(), set()
        for p, owners in patterns.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    found |= owners
                    hit |= set(range(k, k + len(p)))
        for got in (whole, blocks):
            assert (len(w), len(hit), sorted(found)) == (got[i]["n_words"], got[i]["n_hit"], sorted(got[i]["items"])), i
        covered = b" ".join((t or "").encode()[s["begin"] : s["end"]] for s in whole[i]["spans"]).decode()
        assert len(alnum(covered)) == len(hit)
    assert decontaminate.find(empty, table).count() == 0
    assert decontaminate.find(docs, table.where("false")).where("n_hit > 0").count() == 0
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in whole.items() if len(r["items"]) < 2}


def test_any_number_of_blocks_gives_the_same(spark):
    """Rows of one id with different texts, null ids, items without an id."""
    words = [f"w{k}" for k in range(60)]
    items = spark.createDataFrame([(k, " ".join(words[a : a + 12])) for k, a in ((1, 0), (2, 20), (None, 40), (None, 45), (2, 20))], "item_id long, text string")
    texts = [(1, "x " + " ".join(words[:12])), (1, "y " + " ".join(words[18:34])), (None, " ".join(words[38:54])), (None, "clean"), (2, None), (3, " ".join(words))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = lambda df: sorted([tuple(map(str, r)) for r in df.collect()])
    whole = rows(decontaminate.find(docs, items))
    assert all(rows(decontaminate.find(docs, items, block_bytes=n)) == whole for n in (100, 700, 2000))
    assert [(r["n_words"], r["n_hit"], r["items"]) for r in sorted(decontaminate.find(docs, items).collect(), key=lambda r: (r["n_words"], r["n_hit"]))] == [(0, 0, []), (1, 0, []), (13, 12, [1]), (16, 14, []), (17, 12, [2]), (60, 41, [1, 2])]
    for n in (100, 48 << 20):
        assert rows(decontaminate.drop_contaminated(docs, items, 1, block_bytes=n)) == [("2", "None"), ("None", "clean")]
    with pytest.raises(ValueError):
        decontaminate.drop_contaminated(docs.select("doc_id", "text", F.lit("t").alias("text")), items)


def test_fingerprints_and_edits(docs, rows, empty):
    got = by_id(fingerprint.with_edits(docs, ranges=5))
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    fold = lambda t: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold()).split())
    for k, i in enumerate(order):
        following = texts[order[(k + 1) % len(order)]]
        half = len(texts[i]) // 2
        new = texts[i][: len(texts[i]) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(texts[i]), hashlib.sha256(new.encode()).hexdigest())
        assert (r["near_edited"], r["near_next"]) == (float(fold(texts[i]) == fold(new)), float(fold(texts[i]) == fold(following)))
    for a in texts:
        for b in texts:
            assert (got[a]["fingerprint"] == got[b]["fingerprint"]) == (fold(texts[a]) == fold(texts[b]))
    groups = by_id(fingerprint.exact_groups(docs))
    assert groups[3]["first_id"] == 0 and groups[0]["n_rows"] == 5
    assert fingerprint.with_edits(empty).count() == 0
    assert fingerprint.with_edits(docs.where("doc_id = 4")).first()["near_edited"] in (0.0, 1.0)


def test_fingerprint_collisions_are_told_apart(spark):
    import zstandard

    pack = lambda s: zstandard.compress(s.encode())
    members = spark.createDataFrame([(1, "same", pack("a")), (2, "same", pack("a")), (3, "same", pack("b"))], "doc_id long, digest string, form binary")
    assert [r["doc_id"] for r in fingerprint.collisions(members).collect()] == [3]


def test_licenses(docs, rows, empty):
    got = by_id(licenses.scan(docs))
    for i, t in rows:
        w = alnum(t)
        places = [(k, label) for k in range(len(w)) for phrase, label in licenses.PHRASES.items() if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (len(w), len(places)) == (r["n_words"], r["n_base"])
        assert r["first_word"] == min((k for k, _ in places), default=None) and r["last_word"] == max((k for k, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({n for _, n in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert licenses.scan(empty).count() == 0


def test_license_with_a_word_more_is_still_found(spark):
    text = "Redistribution and use in source and also binary forms, with or without modification, are permitted provided that the following conditions are met"
    r = licenses.scan(spark.createDataFrame([(1, text), (2, "under the mit license K")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0]["labels"] == "bsd" and r[0]["n_base"] == 0 and r[1]["n_base"] == 1


def test_a_whole_license_and_its_opening_words(spark):
    notice = next(t for label, t in licenses.TEMPLATES if label == "zlib")
    words = notice.split()
    texts = [f"before {notice} after", " ".join(words[: len(words) // 2]), " ".join(words[: len(words) * 3 // 4]), "all rights reserved"]
    got = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [(got[k]["labels"], got[k]["score"] >= licenses.COVER) for k in range(4)] == [("zlib", True), ("", False), ("zlib", True), ("", False)]
    assert (got[0]["spans"][0]["first"], got[0]["spans"][0]["last"]) == (1, len(words))


def plain_words(html):
    """What a browser's user could read, by the standard library's parser: words in order, without scripts and styles."""
    import html.parser as hp

    class Reader(hp.HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("script", "style", "title", "head", "template", "noscript")

        def handle_endtag(self, tag):
            self.off -= tag in ("script", "style", "title", "head", "template", "noscript") and self.off > 0

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    reader = Reader()
    reader.feed(html)
    return re.findall(r"\w+", " ".join(reader.out))


def test_html_emits_the_words_of_a_plain_reader(spark, sf_dir):
    """Real pages with no hidden parts: the same words, none twice, none lost."""
    pages = [r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect() if r["html"] and not re.search(r"hidden|display\s*:|<(details|select|textarea|svg|iframe|object|video|audio|canvas)", r["html"])]
    assert pages
    for page in pages:
        assert sorted(re.findall(r"[^\W\d]{2,}", html_text.page_text(page))) == sorted(w for w in re.findall(r"[^\W\d]{2,}", " ".join(plain_words(page))))


def test_html():
    text = html_text.page_text
    assert text(None) == "" and text("") == "" and text("a  b\n c") == "a b c"
    assert text("<p>a<p>b<div>c</div>d") == "a\n\nb\n\nc\nd"
    assert text("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>z") == "- a\n- b\n  3. x\n  4. y\n- c\n\nz"
    assert text("<table><tr><td>one<th>two<tr><td rowspan=2>long cell<td>q<tr><td>z</table>") == "one        two\nlong cell  q\n           z"
    assert text("<pre>\n a\n   b</pre>") == " a\n   b"
    assert text("<style>p{}</style><script>var t='<p>no'</script><p hidden>no<p style='color:red; display : none'>no</p>yes<!-- no -->") == "yes"
    assert text("A&ampB &copy; <b>x<p>y</b>z") == "A&B © x\n\nyz"
    assert text("<details><summary>s</summary>t</details>u<br>v") == "s\nu\nv"
    assert text("<p>cut <a href='x") == "cut"
    assert text("<div>" * 5000 + "deep") == "deep"
    assert text("<table><tr><td>" * 60 + "deep") == "deep"
    assert text("<table><tr><td>" * 3000 + "deep") == "deep"


def test_html_tables_are_laid_out_alike_at_any_depth():
    inner = "<table><tr><td>a<td>b<tr><td>long<td>c</table>"
    for depth in (0, 1, 19, 20, 21, 60):
        assert html_text.page_text("<table><tr><td>" * depth + inner + "</table>" * depth + "z") == "a     b\nlong  c\n\nz"
        assert html_text.page_text("<table>x<tr><td>" * depth + inner) == "x\n" * depth + "a     b\nlong  c"


def test_html_colgroup_ends_without_its_tag():
    text = html_text.page_text
    for columns in ("<colgroup><col><col>", "<colgroup>\n <col><col>\n</colgroup>", "<colgroup><col><template>no</template>", "<colgroup><col><colgroup><col>"):
        for body in ("<tr><td>a<td>b<tr><td>c", "<tbody><tr><td>a<td>b<tr><td>c", "<thead><tr><td>a<td>b<tbody><tr><td>c", "<td>a<td>b<tr><td>c"):
            assert text(f"<table>{columns}{body}</table>z") == "a  b\nc\n\nz", (columns, body)
    assert text("<table><colgroup>x<col><tr><td>a</table>") == "x\na"
    assert text("<table><colgroup><p>x</p><tr><td>a</table>") == "x\na"


def test_html_row_groups_keep_what_is_no_row():
    text = html_text.page_text
    for part in ("tbody", "thead", "tfoot"):
        assert text(f"<table><{part}>x<tr><td>a<td>b</{part}></table>") == "x\na  b"
        assert text(f"<table><{part}><div>x</div><tr><td>a</table>") == "x\na"
        assert text(f"<table><{part}><form><tr><td>x</td></tr></form><tr><td>a</table>") == "x\na"
        assert text(f"<table><{part} hidden>x<tr><td>a</{part}><tbody><tr><td>b</table>") == "b"


def test_html_over_tables(spark):
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (3, ""), (3, "")], "page_id long, html string")
    assert sorted((r[0], r[1]) for r in html_text.extract(pages).collect()) == [(1, "a"), (2, ""), (3, ""), (3, "")]
    assert html_text.extract(pages.where("false")).count() == 0


def test_language_model(docs, rows, empty):
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    counts = collections.Counter(w for i, t in rows if not out(i) for w in [*blanks(t), None])
    n, v = sum(counts.values()), len(counts)
    got = by_id(lm_score.score(docs, toxicity.held_out(remainder=1), vocabulary=64))
    for i, t in rows:
        w = [*blanks(t), None]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(i), len(w), sum(x in counts for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_score.score(empty, toxicity.held_out(remainder=1), vocabulary=64).count() == 0


def test_recurrent_model_gradient_and_normalisation():
    rng = np.random.default_rng(1)
    model = gru.Model.new(rng.integers(1, 50, 64).astype(float), 20.0, 5)
    model.p = {k: v.astype(np.float64) + rng.normal(scale=0.2, size=v.shape) for k, v in model.p.items()}
    lanes = gru.Lanes(rng.integers(0, 65, 150).astype(np.int32), np.array([100, 20, 30]), 65, 3)
    cut = slice(0, gru.STEPS)
    args = (lanes.source[cut], lanes.target[cut], lanes.keep[cut], lanes.doc[cut] >= 0, np.zeros((3, 5)))
    grad, _, _ = model.gradient(*args)
    for name in model.p:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        old, step = model.p[name][at], 1e-3
        model.p[name][at] = old + step
        up = model.gradient(*args)[2]
        model.p[name][at] = old - step
        down = model.gradient(*args)[2]
        model.p[name][at] = old
        assert abs((up - down) / (2 * step) - grad[name][at]) < 2e-3 * max(1, abs(grad[name][at])), name
    states = rng.normal(size=(1, 5))
    total = sum(np.exp(model.emit(states, np.array([k]))[0][0]) for k in range(65))
    assert abs(total - 1) < 1e-6


def test_recurrent_model_learns():
    tokens = np.tile(np.arange(6), 2000).astype(np.int32)
    lengths = np.full(40, 300)
    model = gru.Model.new(np.bincount(tokens, minlength=32).astype(float), 0.0, 8)
    lanes = gru.Lanes(tokens, lengths, 33, 8)
    after, losses = gru.train(model, lanes, 1, 0.03)
    assert gru.score(after, lanes, 40).sum() > 0.7 * gru.score(model, lanes, 40).sum() and losses[-1] < losses[0]


def test_every_window_is_learnt_from(spark):
    """Eight documents of two windows each in one lane: by default none of the windows is only run through."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(63)) for _ in range(8)]
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").coalesce(1)
    got = {stride: {i: r["score"] for i, r in by_id(lm_score.score(frame(texts), F.lit(False), vocabulary=64, **stride_of)).items()} for stride, stride_of in (("default", {}), (1, {"stride": 1}), (4, {"stride": 4}))}
    assert got["default"] == got[1] and got["default"] != got[4]


def labelled(spark, n=400):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(5, 80))]
        toxic, junk = i % 6 == 0, i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(["rotten!", "vile", "Vile,"])
        rows.append((i, " | ".join(w) if junk else " ".join(w)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_and_quality_on_held_out_rows(spark, docs, empty):
    texts, labels = labelled(spark)
    learn = labels.where(~toxicity.held_out())
    model = toxicity.fit(texts, learn)
    assert (np.diff(model.cuts) > 0).all()
    got = toxicity.score(texts, model).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all((r["p_toxic"] >= 0.5) == bool(r["toxic"]) for r in got) and {r["grade"] for r in got} >= {0, 1}
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.score(empty, model).count() == 0
    assert toxicity.reject(texts, model).count() == labels.where("toxic = 0").count()
    ranked = quality.fit(texts, learn)
    scored = quality.score(texts, ranked).join(labels, "doc_id").where(toxicity.held_out()).collect()
    assert all((r["score"] >= 0.3) == bool(r["quality"]) for r in scored)
    some = by_id(quality.score(docs, ranked))
    assert all(0 <= r["score"] <= 1 for r in some.values()) and len(some) == docs.count()
    assert quality.score(empty, ranked).count() == 0
    kept = quality.keep_above(quality.score(texts, ranked), 0.25)
    assert 280 <= kept.count() <= 320 and quality.keep_above(quality.score(empty, ranked), 0.5).count() == 0


def test_scores_by_hand(spark):
    """Both models' scores, word by word and feature by feature."""
    texts, labels = labelled(spark)
    ordinal = toxicity.fit(texts, labels)
    assert len(ordinal.cuts) == 2  # not toxic, toxic, toxic in a text of low quality: the labels' own grades
    one = lambda w: _text.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hashes()[0]
    weights = dict(zip(ordinal.hashes.tolist(), ordinal.weights.tolist(), strict=True))
    ranked = quality.fit(texts, labels)
    got, rank = by_id(toxicity.score(texts, ordinal)), by_id(quality.score(texts, ranked))
    for r in texts.collect():
        s = sum(weights.get(int(one(w)), 0.0) for w in set(alnum(r["text"])))
        exceed = [1 / (1 + math.exp(c - s)) for c in ordinal.cuts]
        assert math.isclose(got[r["doc_id"]]["severity"], sum(exceed), rel_tol=1e-9) and math.isclose(got[r["doc_id"]]["p_toxic"], exceed[0], rel_tol=1e-9)
        data = r["text"].encode()
        x = quality.features(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        z = sum(w * min(8, max(-8, (v - c) * k)) for v, c, k, w in zip(x, ranked.centre, ranked.scale, ranked.weights, strict=True))
        assert math.isclose(rank[r["doc_id"]]["score"], 1 / (1 + math.exp(-(ranked.slope * z + ranked.shift))), rel_tol=1e-6)


def test_repeated_labels_have_one_meaning(spark):
    texts, labels = labelled(spark)
    more = labels.unionByName(labels.where("toxic = 1").withColumn("toxic", F.lit(0))).unionByName(labels.where("quality = 0").withColumn("quality", F.lit(1)))
    assert np.allclose(toxicity.fit(texts, labels.drop("quality")).weights, toxicity.fit(texts, more.drop("quality")).weights)
    assert np.allclose(quality.fit(texts, labels).weights, quality.fit(texts, more).weights)


def test_recurrent_scores_token_by_token():
    """The batched score of packed documents against one document at a time, one token at a time."""
    rng = np.random.default_rng(5)
    model = gru.Model.new(rng.integers(1, 50, 64).astype(float), 20.0, 6)
    model.p = {k: (v + rng.normal(scale=0.3, size=v.shape)).astype(v.dtype) for k, v in model.p.items()}
    lengths = np.array([70, 1, 40, 200, 33])
    tokens = rng.integers(0, 65, lengths.sum()).astype(np.int32)
    packed = gru.score(model, gru.Lanes(tokens, lengths, 65, 3), len(lengths))
    at = 0
    for k, n in enumerate(lengths):
        alone = gru.score(model, gru.Lanes(tokens[at : at + n], np.array([n]), 65, 1), 1)
        assert math.isclose(packed[k], alone[0], rel_tol=1e-4)
        at += n


def test_models_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).where("p_toxic >= 0.5").count() == 0
    assert {round(r["score"], 3) for r in quality.score(docs, quality.fit(docs, none)).collect()} == {0.5}
    nulls = spark.createDataFrame([(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, nulls)).where("p_toxic >= 0.5").count() == 0


def test_repeated_rows_and_null_ids(spark, docs):
    more = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    n = more.count()
    assert minhash.groups(more).count() == n
    assert suffix_dedup.repeats(more).count() == n
    assert suffix_dedup.repeats(more).where("doc_id = 0 and n_removed > 0").count() == 0
    assert fingerprint.with_edits(more).count() == n
    assert licenses.scan(more).count() == n
    assert lm_score.score(more, toxicity.held_out(remainder=1), vocabulary=64).count() == n
