"""Commit, restore, compare, verify, merge and sync over small checkpoint files."""

import numpy as np
import pytest
from ckptlake.functions import bits, codec
from ckptlake.operators import lake as lk
from ckptlake.operators.lake import Lake
from ckptlake.sources import safetensors as st
from ckptlake.types import ConflictError, IntegrityError, NotFoundError, SyncError, UsageError


def f16(a):
    return np.asarray(a, np.float16)


def model(rng, change=0.0):
    """Every stored type, without axes, without rows, data in another order than the names."""
    w = {k: rng.normal(size=s) for k, s in (("a.weight", (24, 16)), ("b.weight", (10, 24)), ("a.bias", (24,)))}
    if change:
        w["a.weight"] = w["a.weight"] + change
    return w


def write(path, w, extra=0):
    t = {
        "a.weight": ("F16", [24, 16], f16(w["a.weight"]).tobytes()),
        "b.weight": ("BF16", [10, 24], bits.narrow(w["b.weight"].astype(np.float32), "BF16").tobytes()),
        "a.bias": ("F32", [24], w["a.bias"].astype(np.float32).tobytes()),
        "steps": ("I64", [], np.int64(7 + extra).tobytes()),
        "none": ("F16", [0, 4], b""),
        "odd": ("F16", [6], np.array([0x7E01, 0xFE01, 0x8000, 0x7C00, 0x0001, 0x3C00], "<u2").tobytes()),
    }
    data = st.write_file(t, {"by": "test"}, order=["steps", "b.weight", "none", "a.weight", "odd", "a.bias"])
    path.write_bytes(data)
    return data


@pytest.fixture
def lake(spark, tmp_path):
    return lk.Lake.init(spark, f"file://{tmp_path}/lake", chunk_bytes=128)


def test_series_round_trip_and_reuse(lake, tmp_path):
    rng = np.random.default_rng(1)
    w = model(rng)
    files = [write(tmp_path / "m.safetensors", w)]
    first = lake.commit(f"file://{tmp_path}/m.safetensors", "one", config=b"{}")
    assert first["full"] and first["base"] is None
    w["a.weight"] = w["a.weight"] + rng.normal(scale=1e-3, size=(24, 16))
    files.append(write(tmp_path / "m.safetensors", w, 1))
    second = lake.commit(f"file://{tmp_path}/m.safetensors", "two")
    assert not second["full"] and second["base"] == first["commit"]
    assert second["reused"] == ["a.bias", "b.weight", "none", "odd"] and second["stored_bytes"] < first["stored_bytes"]
    for commit, data in ((first, files[0]), (second, files[1])):
        lake.restore(commit["commit"], str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes() == data and lake.total_size(commit["commit"]) == len(data)
    for a, n in ((0, 20), (5, 300), (len(files[1]) - 90, 90), (400, 1)):
        assert lake.byte_range(second["commit"], a, n) == files[1][a : a + n]
    assert (lake.read_rows(second["commit"], "a.weight", 5, 9) == st.TensorFile(files[1]).rows("a.weight", 5, 9)).all()
    got = {r["name"]: r for r in lake.compare(first["commit"], second["commit"]).collect()}
    assert got["b.weight"]["status"] == "equal" and got["a.weight"]["status"] == "mismatched" and got["steps"]["mismatched"] == 1
    x, y = (st.TensorFile(f).whole("a.weight").view(np.float16).astype(float) for f in files)
    assert abs(got["a.weight"]["max_abs_diff"] - np.abs(x - y).max()) < 1e-9
    log = lake.log("".join(second["commit"])).collect()
    assert [r["message"] for r in log] == ["two", "one"] and log[0]["branches"] == ["main"]
    assert lake.resolve("HEAD~1") == first["commit"] and lake.resolve(second["commit"][:8]) == second["commit"]
    sizes = lake.sizes(second["commit"])
    assert sizes["original_bytes"] == sum(s.nbytes for s in st.TensorFile(files[1]).specs.values()) and sizes["n_objects"] <= sizes["n_refs"]
    failures, report = lk.verify(lake, tier="tensors")
    assert failures.count() == 0 and report["commits"] == 2


def test_permuted_commit_is_exact(lake, tmp_path):
    rng = np.random.default_rng(2)
    w = model(rng)
    write(tmp_path / "m.safetensors", w)
    lake.commit(f"file://{tmp_path}/m.safetensors", "one", config=b"{}")
    p = np.roll(np.arange(24), 7)[rng.permutation(24)]
    w = {"a.weight": w["a.weight"][p], "a.bias": w["a.bias"][p], "b.weight": w["b.weight"][:, p]}
    data = write(tmp_path / "m.safetensors", w)
    done = lake.commit(f"file://{tmp_path}/m.safetensors", "moved", alignment={"a.weight": (p, None, None), "a.bias": (p, None, None), "b.weight": (None, p, 1)})
    lake.restore(done["commit"], str(tmp_path / "out"))
    assert (tmp_path / "out").read_bytes() == data and done["ratio"] < 0.5
    assert lk.verify(lake, tier="tensors")[0].count() == 0


def test_tampering_is_found_by_its_tier(lake, tmp_path, spark):
    import glob

    rng = np.random.default_rng(3)
    write(tmp_path / "m.safetensors", model(rng))
    lake.commit(f"file://{tmp_path}/m.safetensors", "one", config=b"{}")
    chunks = lake.table("chunks").collect()
    victim = chunks[0]["object"]

    def rewrite(change):
        import shutil

        rows = [r for c in chunks if (r := change(c.asDict())) is not None]
        for p in glob.glob(f"{tmp_path}/lake/tables/chunks"):
            shutil.rmtree(p)
        lake.append("chunks", spark.createDataFrame(rows, lk.TABLES["chunks"]))

    def kinds(tier):
        return [r["kind"] for r in lk.verify(lake, tier=tier)[0].collect()]

    rewrite(lambda c: None if c["object"] == victim else c)
    assert kinds("structure") == ["missing-chunk"]
    rewrite(lambda c: c | {"payload": bytearray(b"junk")} if c["object"] == victim else c)
    assert kinds("structure") == [] and kinds("checksum") == ["chunk-checksum"] and kinds("content") == ["chunk-checksum"]
    rewrite(lambda c: c)
    failures, report = lk.verify(lake, tier="content")
    assert failures.count() == 0 and report["failures"] == 0 and not report["truncated"]
    with pytest.raises(NotFoundError):
        lk.verify(lake, ["absent"])


def test_branches_and_merge(lake, tmp_path, spark):
    rng = np.random.default_rng(4)
    w = model(rng)
    path = f"file://{tmp_path}/m.safetensors"
    write(tmp_path / "m.safetensors", w)
    root = lake.commit(path, "root", config=b"{}")["commit"]
    lake.create_branch("side")
    ours = dict(w, **{"a.weight": w["a.weight"] + 1})
    write(tmp_path / "m.safetensors", ours)
    lake.commit(path, "ours")
    lake.set_head("side")
    theirs = dict(w, **{"a.weight": w["a.weight"] - 0.5, "b.weight": w["b.weight"] * 2})
    write(tmp_path / "m.safetensors", theirs, 5)
    tip = lake.commit(path, "theirs")["commit"]
    lake.set_head("main")
    assert lake.merge_base(lake.resolve("main"), tip) == root
    with pytest.raises(ConflictError):
        lk.merge(lake, "side")
    done = lk.merge(lake, "side", average=True)
    assert done["counts"] == {"averaged": 1, "take-theirs": 2, "unchanged": 3}
    a = lake.read_rows(done["commit"], "a.weight", 0, 24).view(np.float16)
    x, y = (f16(v["a.weight"]).astype(np.float32) for v in (ours, theirs))
    assert (a == f16((x + y) / 2)).all()
    assert (lake.read_rows(done["commit"], "b.weight", 0, 10) == bits.narrow(theirs["b.weight"].astype(np.float32), "BF16")).all()
    assert lk.merge(lake, "side")["result"] == "up-to-date"
    lake.set_head("side")
    assert lk.merge(lake, "main")["result"] == "fast-forward"
    lake.rename_branch("side", "other")
    assert sorted(lake.branches()) == ["main", "other"] and lake.head()[0] == "other"
    with pytest.raises(UsageError):
        lake.create_branch("a/b")
    peer = lk.Lake.init(spark, f"file://{tmp_path}/peer")
    plan = lk.sync(lake, peer, "main", dry_run=True)
    assert plan["chunks"] > 0
    with pytest.raises(SyncError):
        lk.sync(lake, peer, "main", read_only=True)
    lk.sync(lake, peer, "main")
    again = lk.sync(lake, peer, "main")
    assert again["objects"] == again["chunks"] == 0
    lake.restore(done["commit"], str(tmp_path / "x"))
    peer.restore(done["commit"], str(tmp_path / "y"))
    assert (tmp_path / "x").read_bytes() == (tmp_path / "y").read_bytes()
    assert lk.verify(peer, tier="tensors")[0].count() == 0


def test_scans(spark, tmp_path):
    data = write(tmp_path / "m.safetensors", model(np.random.default_rng(5)))
    rows = {r["name"]: r for r in st.scan_headers(spark, f"file://{tmp_path}/m.safetensors").collect()}
    assert rows["steps"]["num_rows"] == 1 and rows["none"]["nbytes"] == 0 and rows["a.weight"]["shape"] == [24, 16]
    blocks = st.scan_blocks(spark, f"file://{tmp_path}/m.safetensors", 100, ["a.weight"]).orderBy("chunk_no").collect()
    assert b"".join(bytes(b["bits"]) for b in blocks) == st.TensorFile(data).whole("a.weight").tobytes()
    assert blocks[0]["row_end"] - blocks[0]["row_start"] + 1 == 3
    f = st.TensorFile(data)
    assert (f.gather("a.weight", [3, 3, 0]) == f.whole("a.weight")[[3, 3, 0]]).all()
    st.check_tiling(st.header_layout(f.header))
    with pytest.raises(UsageError):
        st.check_tiling([("a", 0, 4), ("b", 5, 6)])


@pytest.mark.parametrize("bad", [b"", b"\x05" + b"\0" * 7, (4).to_bytes(8, "little") + b"junk", (2).to_bytes(8, "little") + b"[]"])
def test_malformed_files(bad):
    with pytest.raises(UsageError):
        st.TensorFile(bad)


def test_malformed_entries():
    ok = {"dtype": "F16", "shape": [2], "data_offsets": [0, 4]}
    import json

    for change in ({"dtype": "X"}, {"shape": [3]}, {"data_offsets": [2, 6]}, {"shape": [-2]}, {"data_offsets": [0]}):
        with pytest.raises(UsageError):
            st.parse_header(json.dumps({"t": ok | change}).encode(), 4)


@pytest.mark.parametrize("dtype", ["F16", "BF16", "F32", "I64"])
def test_codec_round_trip(dtype):
    rng = np.random.default_rng(6)
    width = {"F16": 2, "BF16": 2, "F32": 4, "I64": 8}[dtype]
    kind = f"<u{width}"
    base = rng.integers(0, 256, 4096, np.uint8).tobytes()
    for step in (0, 1, 200, 70000):
        target = (np.frombuffer(base, kind) + rng.integers(0, step + 1, 4096 // width).astype(kind)).tobytes()
        for b in (None, base):
            e = codec.encode_chunk(target, b, dtype)
            assert codec.decode_chunk(e.encoding, e.payload, b, dtype) == target
            assert e.object == codec.encode_chunk(target, b, dtype, level=9, raw_fallback=False).object or e.encoding == codec.RAW
            assert e.identical == (b is not None and target == b)


def test_zigzag_over_all_patterns():
    d = np.arange(65536, dtype=np.uint16)
    z = codec.zigzag(d)
    assert (np.sort(z) == d).all() and (codec.unzigzag(z) == d).all() and list(z[[0, 65535, 1, 65534]]) == [0, 1, 2, 3]
    assert (codec.unescape_stream(codec.escape_stream(z)) == z).all()
    with pytest.raises(IntegrityError):
        codec.unescape_stream(codec.escape_stream(z)[:-1])


def test_widths():
    x = np.array([1.0, -2.5, 3.1e-3], np.float32)
    assert np.allclose(bits.widen(bits.narrow(x, "BF16"), "BF16"), x, rtol=1e-2) and (bits.widen(bits.narrow(x, "F32"), "F32") == x).all()


def test_adaptive_chains(lake, tmp_path):
    rng = np.random.default_rng(8)
    w = model(rng)
    commits, files = [], []
    for k in range(6):
        w = {n: v + rng.normal(scale=1e-4, size=v.shape) for n, v in w.items()}
        files.append(write(tmp_path / "m.safetensors", w))
        commits.append(lake.commit(f"file://{tmp_path}/m.safetensors", str(k), config=b"{}" if not k else None, adaptive=True))
    depth = {r["hops"] for r in lk.dag.chain_roots(lake.table("tensor_manifests").select(lk.F.col("tensor_manifest").alias("manifest"), lk.F.col("base_manifest").alias("base"))).collect()}
    assert max(depth) <= 3
    for c, data in zip(commits[-2:], files[-2:], strict=True):
        lake.restore(c["commit"], str(tmp_path / "out"))
        assert (tmp_path / "out").read_bytes() == data
    assert 0 < lake.minimum_bytes([commits[-1]["commit"]]) <= lake.minimum_bytes([c["commit"] for c in commits])


def test_refs_survive_a_writer_that_dies(spark, tmp_path):
    lake = Lake.init(spark, f"file://{tmp_path}/lake")
    for commit in ("a" * 64, "b" * 64, "c" * 64):
        lake.update_ref("main", commit)
    assert lake.branches() == {"main": "c" * 64} and len([p for p in (tmp_path / "lake/refs/main").iterdir() if not p.name.startswith(".")]) == 2
    (tmp_path / "lake/tmp").mkdir(exist_ok=True)
    (tmp_path / "lake/tmp/half").write_text("d")  # staged and never renamed
    assert lake.branches() == {"main": "c" * 64}
    with pytest.raises(ConflictError):
        lake._write_small(f"refs/main/{lake._versions('refs/main')[-1]:012d}", "e" * 64)
    assert lake.head() == ("main", "c" * 64)


def test_names_places_and_ranges(spark, tmp_path):
    from ckptlake.operators.lake import working_name

    assert [working_name(n) for n in ("a/b/m.safetensors", "../../x", "..", "", None, "c:\\d\\e")] == ["m.safetensors", "x", "model.safetensors", "model.safetensors", "model.safetensors", "e"]
    lake = Lake.init(spark, f"file://{tmp_path}/lake", chunk_bytes=64)
    rows = np.arange(40, dtype="<f4").reshape(10, 4)
    (tmp_path / "m.safetensors").write_bytes(st.write_file({"w": ("F32", [10, 4], rows.tobytes()), "e": ("F32", [0, 4], b""), "s": ("F32", [], b"abcd")}))
    path = f"file://{tmp_path}/m.safetensors"
    commit = lake.commit(path, "one", config=b"{}")["commit"]
    assert Lake.discover(spark, f"file://{tmp_path}/lake/a/b").root == f"file:{tmp_path}/lake"
    with pytest.raises(NotFoundError):
        Lake.discover(spark, f"file://{tmp_path}")
    size = (tmp_path / "m.safetensors").stat().st_size
    assert {(r["path"], r["size"]) for r in lake.namespace().collect()} == {("/main/m.safetensors", size), (f"/commits/{commit}/m.safetensors", size)}
    (tmp_path / "out").mkdir()
    done = lake.checkout(commit, str(tmp_path / "out"))
    assert (tmp_path / "out/m.safetensors").read_bytes() == (tmp_path / "m.safetensors").read_bytes() and done["branch"] is None and lake.head() == (None, commit)
    assert lake.checkout("main")["path"] is None and lake.head() == ("main", commit)
    some = st.scan_blocks(spark, path, 64, ["w"], (5, 9)).orderBy("row_start").collect()
    assert [(r["row_start"], r["row_end"]) for r in some] == [(4, 7), (8, 9)] and bytes(some[0]["bits"]) == rows[4:8].tobytes()
    assert {r["name"]: r["content_hash"] for r in st.scan_digests(spark, path).collect()}["w"] == __import__("hashlib").sha256(rows.tobytes()).hexdigest()
    assert st.TensorFile.open(str(tmp_path / "m.safetensors")).gather("w", [3, 0, 3]).view("<f4").tolist() == rows[[3, 0, 3]].tolist()
