"""How a store lays out its files: what a task writes, and what a small file takes."""

import os

from tidelog import store as store_module
from tidelog.model import LOG, Options
from tidelog.store import Store


def test_files_of_a_task(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "s")
    monkeypatch.setattr(store_module, "FILES_A_TASK", 10)
    rows = [(i, f"k{i * 7919 % 3000:05d}", ("v%d-" % i) * (40 if i % 3 == 0 else 1), "P", None) for i in range(1, 3001)]
    store = Store(spark, at, Options(memtable_bytes=2000, file_bytes=4000, separate_from=100))
    store.flush(spark.createDataFrame(rows, LOG))
    files = sorted(store.load()["files"], key=lambda f: f["mn"])
    assert len(files) > 10 and all(a["mx"] < b["mn"] for a, b in zip(files, files[1:])) and sum(f["n"] for f in files) == 3000
    names = [os.path.basename(f["file_id"]).split("-")[1] for f in files]
    assert len(set(names)) <= -(-len(files) // 10) + 1  # tasks
    blobs = [os.path.join(d, f) for d, _, fs in os.walk(f"{at}/blobs") for f in fs if f.endswith(".parquet")]
    assert len(blobs) > 20
    data = [os.path.join(d, f) for d, _, fs in os.walk(f"{at}/data") for f in fs if f.endswith(".parquet")]
    assert max(map(os.path.getsize, blobs + data)) < 100_000  # no filter of 1 MB in a small file
    assert {r["k"]: r["v"] for r in store.scan().collect()} == {k: v for _, k, v, _, _ in rows}
