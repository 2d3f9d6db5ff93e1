"""Replay holds a slice of the log at a time, and sends no payload across an exchange."""

import pyarrow as pa
from pyspark.sql import functions as F

from tidelog import codec
from tidelog.model import LOG, Options
from tidelog.operators import runs
from tidelog.wal import Wal


def test_sliced():
    sizes = [0, 5, 400_000, 700_000, None, 3_000_000, 1, 0, 2_000_000]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if n is None else b"x" * n for n in sizes])], names=["i", "p"])
    got = [[(i, n) for i, n in zip(b.column("i").to_pylist(), map(lambda x: len(x or b""), b.column("p").to_pylist()))] for b in codec.sliced(rows, "p")]
    assert [x for b in got for x in b] == [(i, n or 0) for i, n in enumerate(sizes)]
    assert all(len(b) == 1 or sum(n for _, n in b[1:]) <= codec.SLICE_BYTES for b in got) and len(got) >= 3
    assert list(codec.sliced(rows.slice(0, 0), "p"))[0].num_rows == 0


def test_replay_has_no_window(spark, tmp_path):
    rows = [(i, f"k{i % 40}", f"v{i}", "P", None) for i in range(1, 301)]
    wal = Wal(spark, str(tmp_path / "w"), Options(wal_buffer_bytes=200, wal_segment_bytes=600))
    wal.append(runs.sharded(spark.createDataFrame(rows, LOG), 3))
    got = wal.replay()
    assert sorted((r["seq"], r["k"], r["v"]) for r in got.collect()) == [r[:3] for r in rows]
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan
    held = wal.rows().withColumn("payload", F.when((F.col("shard") == 1) & (F.col("flush_id") == 3), F.substring("payload", 1, 9)).otherwise(F.col("payload")))
    after = Wal(spark, str(tmp_path / "t"), Options())
    held.write.partitionBy("append").parquet(f"{after.path}/segments")
    want = {s for r in wal.rows().collect() if r["shard"] != 1 or r["flush_id"] < 3 for s in [r["flush_id"] * 10 + r["shard"]]}
    assert {r["flush_id"] * 10 + r["shard"] for r in after.whole().collect()} == want and len(want) > 10
