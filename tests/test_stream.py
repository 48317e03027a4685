"""Ingestion is restart-safe, and state follows the log."""

import numpy as np
from ckptlake.operators.lake import Lake
from ckptlake.sources import safetensors as st
from ckptlake.streaming import ingest


def test_each_file_is_one_commit(spark, tmp_path):
    lake = Lake.init(spark, f"file://{tmp_path}/lake", chunk_bytes=64)
    (tmp_path / "in").mkdir()
    rng = np.random.default_rng(0)

    def put(k):
        data = rng.normal(size=(8, 4)).astype(np.float16)
        (tmp_path / "in" / f"epoch{k}.safetensors").write_bytes(st.write_file({"w": ("F16", [8, 4], data.tobytes())}))

    put(1), put(2)
    ingest.watch(lake, f"file://{tmp_path}/in", f"file://{tmp_path}/log", b"{}")
    put(3)
    ingest.watch(lake, f"file://{tmp_path}/in", f"file://{tmp_path}/log")
    ingest.watch(lake, f"file://{tmp_path}/in", f"file://{tmp_path}/log-lost")
    assert [r["message"] for r in lake.log(lake.resolve("HEAD")).collect()] == [f"ingest epoch{k}.safetensors" for k in (3, 2, 1)]
