"""Known results of the write log, and the store, folds and hashes against plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import folds, hashing
from tidelog.model import LOG, Options, ProtectedResource, StoreError, as_log, rejected
from tidelog.operators import compaction, reads, runs
from tidelog.sources import tables
from tidelog.sources.tables import events_log, user_key
from tidelog.store import POINTER, ShardedStore, Store
from tidelog.wal import Wal


def two_pass(n):
    out = []
    for name, value, common in (("hello", "world", "first_value"), ("key", "value", "second_value")):
        for i in range(n):
            k, v = (f"common{i // 3}", f"{common}{i // 3}") if i % 3 == 0 else (f"{name}{i}", f"{value}{i}")
            out.append((len(out) + 1, k, v, "P", None))
    return out


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(two_pass(6000), LOG).cache()


def test_two_pass(log):
    live = reads.live(log)
    by = {r[0]: r[1] for r in live.groupBy(F.regexp_extract("k", "^[a-z]+", 0)).count().collect()}
    assert by == {"common": 2000, "hello": 4000, "key": 4000}
    assert reads.get(log, "common0").first()["v"] == "second_value0"
    assert [r["k"] for r in reads.seek(log, "k", 4).orderBy("pos").collect()] == ["key1", "key10", "key100", "key1000"]
    assert reads.scan(log, "c", "k").count() == 6000
    assert runs.with_size(log).agg(F.sum("z")).first()[0] == 278608


@pytest.mark.parametrize("rule", [folds.Rule(100), folds.Rule(100, 2, True), folds.Rule(100, 2), folds.Rule(100, 0, True, 4)])
def test_fold_rules(rule):
    rng = random.Random(1)
    sizes = [rng.randint(1, 60) for _ in range(500)]
    want, held = [], None
    for z in sizes:
        over = held is not None and (held + z + rule.extra > rule.cap if rule.strict else held + z + rule.extra >= rule.cap)
        held = rule.start + z if held is None or over else held + z
        want.append(over)
    got, at, held = [], 0, -1
    for n in (1, 7, 100, 392):
        hits, held = rule.restarts(np.array(sizes[at : at + n]), held)
        got += hits.tolist()
        at += n
    assert got == want


def test_hashes():
    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = ((h ^ x) * 1099511628211) % 2**64
        return h

    keys = [b"", b"a", b"foobar", "é".encode(), b"x" * 99]
    assert hashing.fnv1a_64(keys).tolist() == [fnv(k) for k in keys]
    assert hashing.murmur3_32([b"", b"hello", b"hello, world"], 0).tolist() == [0, 0x248BFA47, 0x149BBB7F]
    assert all(hashing.jump(h, 1) == 0 for h in range(50))
    assert sum(hashing.jump(h * 2654435761, 9) != hashing.jump(h * 2654435761, 10) for h in range(1000)) < 200


def test_checksums_and_bloom(spark, log):
    small = runs.with_size(reads.newest(log).limit(500)).withColumn("f", F.lit(1))
    blocks = runs.with_blocks(small, ["f"], Options()).cache()
    sums = runs.block_checksums(blocks, ["f"])
    first = sorted((r["k"], r["v"]) for r in blocks.where("block_id = 0").collect())
    assert sums.where("block_id = 0").first()["checksum"] == zlib.crc32("\n".join(f"{k}={v}" for k, v in first).encode())
    assert runs.failed_blocks(sums, blocks.withColumn("v", F.when(F.col("block_id") == 1, "x").otherwise(F.col("v"))), ["f"]).count() == 1
    from tidelog.operators import pruning

    asked = small.select("f", "k").union(spark.createDataFrame([(1, f"absent{i}") for i in range(200)], "f int, k string"))
    got = pruning.may_contain(pruning.run_blooms(small, ["f"]), asked, ["f"])
    assert got.where("maybe AND k NOT LIKE 'absent%'").count() == 500
    assert got.where("maybe AND k LIKE 'absent%'").count() < 40


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(level0_files=1))
    make = lambda rows: spark.createDataFrame([(s, k, v, "D" if v == "-" else "P", None) for s, k, v in rows], LOG)
    one = store.flush(make([(1, "a", "1"), (2, "b", "2"), (3, "a", "3")]))
    assert store.flush(make([(2, "b", "2")])) == one  # a batch tried again
    two = store.flush(make([(4, "b", "-"), (5, "c", "5")]))
    state = lambda v=None: {r["k"]: r["v"] for r in store.scan(version=v).collect()}
    assert state(one) == {"a": "3", "b": "2"} and state() == {"a": "3", "c": "5"}
    last = store.compact()
    assert last > two and state() == {"a": "3", "c": "5"} and state(one) == {"a": "3", "b": "2"}
    assert store.get("a").first()["v"] == "3" and store.get("b").count() == 0
    store.pin(one)
    with pytest.raises(ProtectedResource):
        store.vacuum(last)
    store.unpin(one)
    assert store.vacuum(last) == 2 and state() == {"a": "3", "c": "5"}


def test_compaction_rewrites_only_what_overlaps(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(level0_files=1, file_bytes=64 * 1024, level0_bytes=64 * 1024))
    seq = iter(range(1, 100))
    put = lambda **kv: store.flush(spark.createDataFrame([(next(seq), k, v, "D" if v == "-" else "P", None) for k, v in kv.items()], LOG))
    files = lambda: {f["file_id"]: (f["level"], f["mn"], f["mx"]) for f in store.load()["files"]}
    put(a="1", b="2")
    put(a="3")
    store.compact()
    first = files()
    assert list(first.values()) == [(1, "a", "b")]
    put(x="4", y="5")
    put(x="-")
    store.compact()  # the new file is no neighbour of the first; both then move down as they are
    second = files()
    assert sorted(second.values()) == [(2, "a", "b"), (2, "y", "y")] and set(first) < set(second)
    put(a="6")
    put(m="7", y="-")  # two level-0 files apart: two groups, so two files
    store.compact()
    assert {r["k"]: r["v"] for r in store.scan().collect()} == {"a": "6", "b": "2", "m": "7"}
    assert all(sum(lo <= k <= hi and level == at for level, lo, hi in files().values()) <= 1 for k in "abmxy" for at in (1, 2))


def test_touching():
    from tidelog.operators.compaction import touching

    files = [{"mn": a, "mx": b} for a, b in (("e", "g"), ("a", "c"), ("c", "d"), ("f", "f"), ("h", "i"))]
    assert [[f["mn"] + f["mx"] for f in g] for g in touching(files)] == [["ac", "cd"], ["eg", "ff"], ["hi"]]


def make(spark, rows):
    return spark.createDataFrame([(s, k, v, "D" if v == "-" else "P", None) for s, k, v in rows], LOG)


def test_rejects(spark, tmp_path):
    bad = spark.createDataFrame([(1, "a", "1", "P", None), (2, None, "2", "P", None), (3, "", "3", "P", None), (4, "b", None, "P", None)], LOG)
    got = rejected(bad, bad["seq"], bad["k"], bad["v"])
    assert sorted((r["seq"], r["reason"]) for r in got.collect()) == [(2, "no key"), (3, "empty key"), (4, "no value")]
    assert as_log(bad, bad["seq"], bad["k"], bad["v"]).count() == 1
    store = Store(spark, str(tmp_path / "s"), Options())
    with pytest.raises(Exception, match="RejectedRecord"):
        store.flush(bad)
    assert store.versions() == []
    big = make(spark, [(1, "a", "x" * 200), (2, "b", "y")]).withColumn("shard", F.lit(0))
    small = Options(memtable_bytes=100)
    with pytest.raises(Exception, match="RejectedRecord"):
        runs.memtable_runs(big, small).collect()
    assert runs.memtable_runs(big, small, rejects="skip").count() == 1 and runs.oversized(big, small).first()["k"] == "a"


def test_split_row_by_row(spark):
    rng = random.Random(2)
    rows = [(i % 2, f"k{i:05d}", rng.choice([20, 90, 300, 700])) for i in range(3000)]
    opt = Options(block_bytes=1000, file_bytes=5000)
    want, state = {}, {}
    for g, k, z in sorted(rows):
        used, tracked, file_no, block_no = state.get(g, (2, 1000, 0, 0))
        if used + z >= 1000:
            used, tracked, block_no = 2, tracked + 1000, block_no + 1
        if tracked + z >= 5000:
            used, tracked, file_no, block_no = 2, 1000, file_no + 1, 0
        state[g] = (used + z, tracked, file_no, block_no)
        want[k] = (file_no, block_no)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = compaction.split(spark.createDataFrame(rows, "g long, k string, z long"), ["g"], opt).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["k"]: (r["file_no"], r["block_no"]) for r in got} == want and max(f for f, _ in want.values()) > 20


def test_find_files_has_no_nested_loop(spark):
    rng = random.Random(3)
    files = [(f"f{i}", *sorted(f"{rng.randrange(1000):04d}" for _ in range(2))) for i in range(60)]
    keys = [(f"{i:04d}",) for i in range(0, 1100, 7)]
    meta, asked = spark.createDataFrame(files, "file_id string, mn string, mx string"), spark.createDataFrame(keys, "k string")
    found = runs.find_files(meta, asked)
    assert {(r["k"], r["file_id"]) for r in found.collect()} == {(k, f) for (k,) in keys for f, a, b in files if a <= k <= b}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    for closed in (True, False):
        got = [(r["a_id"], r["b_id"]) for r in runs.overlaps(meta, meta, closed).collect()]
        assert sorted(got) == sorted((f, g) for f, a, b in files for g, c, d in files if (a <= d and c <= b if closed else a < d and c < b))


def test_key_range_reaches_the_scan(spark):
    log = reads.get(events_log(spark, "/root/testdata/sf0.001", "user:000007", "user:000007"), "user:000007")
    assert "GreaterThanOrEqual(user_id,7)" in log._jdf.queryExecution().toString()
    odd = spark.createDataFrame([(-5,), (3,), (999_999,), (1_234_567,)], "u long")
    keys = {r["u"]: r["k"] for r in odd.select("u", user_key(odd["u"]).alias("k")).collect()}
    assert keys == {-5: "user:0000-5", 3: "user:000003", 999_999: "user:999999", 1_234_567: "user:123456"}  # so ids of other widths are always read


def test_wal_after_a_crash(spark, tmp_path):
    opt = Options(wal_buffer_bytes=200, wal_segment_bytes=600)
    log = make(spark, [(i, f"k{i % 40}", f"värde{i}") for i in range(1, 301)]).withColumn("shard", F.col("seq") % 2)
    path = str(tmp_path / "w")
    wal = Wal(spark, path, opt)
    wal.append(log.where("seq <= 150"))
    wal.append(log.where("seq > 150"))
    key = lambda df: sorted((r["seq"], r["k"], r["v"]) for r in df.collect())
    again = Wal(spark, path, opt)  # not closed
    assert not again.clean and again.meta == wal.meta and key(again.replay()) == key(log)
    again.close()
    wal.files.write(f"{path}/metadata.json", '{"appends": "x"')
    third = Wal(spark, path, opt)
    assert not third.clean and third.meta == wal.meta
    assert third.truncate(150) == 1 and key(third.replay()) == key(log.where("seq > 150"))
    empty = Wal(spark, str(tmp_path / "none"), opt)
    assert empty.replay().count() == 0 and empty.truncate(9) == 0


def test_persistent_100(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options())
    store.flush(make(spark, [(i + 1, f"mkey{i}", f"mvalue{i}") for i in range(100)]))
    store.close()
    with pytest.raises(StoreError):
        store.flush(make(spark, [(101, "a", "b")]))
    again = Store(spark, str(tmp_path / "s"), Options())
    asked = spark.createDataFrame([(f"mkey{i}",) for i in range(120)], "k string")
    assert {r["k"]: r["v"] for r in again.multi_get(asked).collect()} == {f"mkey{i}": f"mvalue{i}" if i < 100 else None for i in range(120)}
    assert again.read_length("mkey7").first()["length"] == 7


def test_filters_prune_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), Options(level0_files=1))
    store.flush(make(spark, [(i + 1, f"a{i:04d}", "x") for i in range(0, 400, 2)]))
    store.flush(make(spark, [(i + 1000, f"a{i:04d}", "y") for i in range(1, 400, 2)]))
    asked = spark.createDataFrame([(f"a{i:04d}",) for i in range(0, 400, 40)], "k string")
    pairs = store.may_hold(asked)
    assert pairs.select("k").distinct().count() == 10 and pairs.count() < 14  # ranges alone would give 20
    assert store.locate(asked).select("k").distinct().count() == 10
    store.compact()
    assert store.may_hold(asked).count() == 10 and store.multi_get(asked).where("v = 'x'").count() == 10
    assert store.vacuum(store.versions()[-1]) > 0 and store.multi_get(asked).where("v = 'x'").count() == 10


def test_runs_of_equal_and_missing_seq(spark):
    rows = [(i // 3, f"k{i:03d}", "v" * 20) for i in range(90)] + [(None, "none", "v"), (None, "also", "v"), (4, "k012", "v" * 20)]
    log = runs.sharded(make(spark, rows), 1)
    got = runs.memtable_runs(log, Options(memtable_bytes=300)).collect()
    assert sorted((r["seq"], r["k"]) for r in got if r["seq"] is not None) == sorted((a, k) for a, k, _ in rows if a is not None) and len(got) == len(rows)
    run_of, held = {}, {}
    for r in got:
        assert run_of.setdefault(r["seq"], r["run_id"]) == r["run_id"]
        held[r["run_id"]] = held.get(r["run_id"], 0) + r["z"]
    assert max(held.values()) < 300 and sorted(held) == list(range(len(held)))
    order = [run_of[s] for s in sorted(x for x in run_of if x is not None)]
    assert order == sorted(order) and run_of[None] == 0


def test_separated_values(spark, tmp_path):
    at = str(tmp_path / "s")
    store = Store(spark, at, Options(separate_from=100, level0_files=1))
    long = lambda c: c * 150
    odd = f"{POINTER}x:9:9"
    store.flush(make(spark, [(1, "a", long("a")), (2, "b", "short"), (3, "c", long("c")), (4, "d", odd), (5, "e", "-"), (6, "a", long("A"))]))
    first = store.pin(store.versions()[-1])
    raw = {r["k"]: r["v"] for r in store._read(store.load()["files"]).collect()}
    assert raw["b"] == "short" and raw["e"] == "-" and all(raw[k].startswith(POINTER) and len(raw[k]) < 50 for k in "acd")
    store.flush(make(spark, [(7, "c", "-"), (8, "a", "now short"), (9, "f", long("f"))]))
    store.compact()
    want = {"a": "now short", "b": "short", "d": odd, "f": long("f")}
    again = Store(spark, at, store.options)
    assert [(r["k"], r["v"]) for r in again.scan().collect()] == sorted(want.items())
    assert {r["k"]: r["v"] for r in store.scan(version=first).collect()} == {"a": long("A"), "b": "short", "c": long("c"), "d": odd}
    asked = spark.createDataFrame([(k,) for k in "abcdfz"], "k string")
    assert {r["k"]: r["v"] for r in store.multi_get(asked).collect()} == {**want, "c": None, "z": None}
    assert store.get("f").first()["v"] == long("f") and store.read_length("f").first()["length"] == 150 and store.get("c").count() == 0
    folders = lambda: store.files.names(f"{at}/blobs")
    assert len(folders()) == 2
    store.unpin(first)
    store.flush(make(spark, [(10, "d", "no longer odd")]))
    store.flush(make(spark, [(11, "g", "so that level 0 is due")]))
    store.compact()
    want |= {"d": "no longer odd", "g": "so that level 0 is due"}
    assert len(folders()) == 2 and all(f["level"] for f in store.load()["files"])
    store.vacuum(store.versions()[-1])
    assert len(folders()) == 1 and {r["k"]: r["v"] for r in store.scan().collect()} == want
    store.files.delete(f"{at}/blobs/{folders()[0]}")
    with pytest.raises(Exception):
        store.get("f").collect()


def test_sharded_store(spark, tmp_path):
    store = ShardedStore(spark, str(tmp_path / "s"), 3, Options(level0_files=1))
    rows = [(i + 1, f"k{i % 50}", f"v{i}") for i in range(120)]
    store.flush(make(spark, rows[:80]))
    store.flush(make(spark, rows[80:]))
    store.compact()
    want = {k: v for _, k, v in rows}
    assert {r["k"]: r["v"] for r in store.scan().collect()} == want
    assert store.get("k7").first()["v"] == want["k7"] and store.multi_get(spark.createDataFrame([("k1",), ("no",)], "k string")).where("found").count() == 1
    store.close()


def test_logs_of_any_format(spark, tmp_path):
    log = make(spark, [(1, "a", "1"), (2, "b", "-")])
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.write_log(log, str(tmp_path / fmt), fmt)
        assert sorted((r["seq"], r["k"], r["op"]) for r in tables.read_log(spark, str(tmp_path / fmt), fmt).collect()) == [(1, "a", "P"), (2, "b", "D")]


def test_codec_and_dictionary(spark):
    from tidelog import codec, compression

    held = b"\x02\x00" + b"\x01\x00a\x02\x00bc" + b"\x03\x00def\x00\x00"
    assert codec.read_block(held) == ([[b"a", b"bc"], [b"def", b""]], len(held))
    assert codec.read_block(held[:-1]) == ([[b"a", b"bc"]], 9) and codec.read_block(b"\x01") == ([], 0)
    rows = runs.with_size(make(spark, [(i, f"http://example.org/page/{i:05d}", f"the same words over and over, and {i}") for i in range(3000)])).withColumn("f", F.lit(1))
    raw = runs.payloads(runs.with_blocks(rows, ["f"], Options(block_bytes=500)), ["f"]).cache()
    dictionary = compression.train(raw, "payload", ["block_id"])
    size = lambda df: df.agg(F.sum(F.octet_length("payload"))).first()[0]
    packed = compression.compressed(raw, "payload", dictionary)
    assert dictionary and size(packed) < 0.7 * size(compression.compressed(raw, "payload")) < size(raw)
    assert sorted(compression.decompressed(packed, "payload", dictionary).collect()) == sorted(raw.collect())
    assert runs.with_size(make(spark, [(1, "k" * 70000, "v")])).select(codec.record(F.col("k"), F.col("v"))).first()[0] is None
