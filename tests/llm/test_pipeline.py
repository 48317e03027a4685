"""The pipeline against a brute-force version of each stage, and the opN queries over the smallest tables."""

import hashlib
import re

import corpus_pipeline
import duckdb
import pytest
from ckptlake.llm import registry, toxicity

from .test_operators import alnum, blanks


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        out.append((name, docs))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return dict([*out, ("end", docs)])


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    first = stages["toxicity"].columns
    assert all(stages[k].columns == first for k in ("near_dedup", "suffix_dedup", "decontamination", "bpe"))


def test_toxicity_rejects_by_its_scores(spark, sf_dir, stages):
    docs = stages["toxicity"]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    assert ids(stages["near_dedup"]) == ids(scored.where("p_toxic < 0.5"))


def test_one_of_each_near_group(stages):
    sets = {}
    for r in stages["near_dedup"].collect():
        w = blanks(r["text"])
        sets[r["doc_id"]] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert ids(stages["suffix_dedup"]) == {i for i in sets if find(i) == i}


def test_repeats_are_cut(stages):
    seen = set()
    after = {r["doc_id"]: r for r in stages["decontamination"].collect()}
    for r in sorted(stages["suffix_dedup"].collect(), key=lambda r: r["doc_id"]):
        data = (r["text"] or "").encode()
        gone = bytearray(len(data))
        grams = [data[k : k + 50] for k in range(len(data) - 49)]
        for k, g in enumerate(grams):
            if g in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update(grams)
        want = bytes(c for c, z in zip(data, gone, strict=True) if not z).decode("utf-8", "ignore")
        assert after[r["doc_id"]]["text"] == want and after[r["doc_id"]]["n_chars"] == len(want)


def test_contaminated_documents_go(spark, sf_dir, stages):
    windows = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = alnum(r["text"])
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r["item_id"])
    keep = set()
    for r in stages["decontamination"].collect():
        w = alnum(r["text"])
        items = set().union(*(windows.get(tuple(w[k : k + n]), set()) for n in range(1, 9) for k in range(len(w) - n + 1)))
        if not items:
            keep.add(r["doc_id"])
    assert ids(stages["bpe"]) == keep


def test_a_document_with_one_whole_item_goes(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first()["text"]
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of any item"), (3, None), (4, " ".join(alnum(item)[:7]))], "doc_id long, text string")
    assert ids(corpus_pipeline.drop_contaminated(spark, docs, sf_dir)) == {2, 3, 4}


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_take_hard_tables(spark, sf_dir, stage):
    """Null ids and texts, empty texts, repeated rows and an empty table; clean rows that occur once stay."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one quiet line of text", "en", "a", 22), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "another line that has no id at all", "en", "b", 34), (1, "one quiet line of text", "en", "a", 22), (4, "x" * 5000, "fr", "c", 5000)]
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, spark.createDataFrame(rows, schema).repartition(3), sf_dir)
    seen = [r["doc_id"] for r in got.collect()]
    assert {1, 2, 3, 4, None} == set(seen) and seen.count(1) == (1 if name == "near_dedup" else 2)
    assert run(spark, spark.createDataFrame([], schema), sf_dir).count() == 0


def test_ids_are_the_library_s(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in stages["bpe"].collect()}
    got = {r["doc_id"]: r for r in stages["end"].collect()}
    assert texts.keys() == got.keys()
    for i, t in texts.items():
        want = library.encode(t, add_special_tokens=False).ids
        assert list(got[i]["ids"]) == want and got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_run_gives_the_same(spark, sf_dir, stages):
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect()} == {(r["doc_id"], r["ids_sha256"]) for r in stages["end"].collect()}


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.ORACLE_SQL[name]).df()
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].convert_dtypes().itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_queries_cover_the_whole_table(spark, sf_dir, name):
    assert re.fullmatch(r"op\d+_\w+", name)
    got = registry.QUERIES[name](spark, sf_dir)
    table, key = ("pages", "page_id") if "page_id" in got.columns else ("documents", "doc_id")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
