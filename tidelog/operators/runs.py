"""From the log to sorted files: runs, blocks, their metadata, and the look-ups that prune by it."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codec import block, record
from ..functions.fences import slots
from ..functions.folds import Rule, fold
from ..functions.hashing import routed
from ..model import Options, RejectedRecord, StoreError, record_bytes
from .reads import newest

#: Ends of key ranges that one look-up sends to tasks.
MAX_FENCES = 2_000_000
#: Pairs of files that a task of a look-up makes, unless the tasks would be more than MAX_TASKS.
PAIRS_A_TASK, MAX_TASKS = 1_000_000, 2000


def sharded(log: DataFrame, n: int) -> DataFrame:
    """Each shard is a log of its own: by the key's FNV-1a, so one key stays in one shard."""
    return log.withColumn("shard", routed(F.col("k"), n))


def with_size(log: DataFrame) -> DataFrame:
    return log.withColumn("z", record_bytes(F.col("k"), F.col("v")).cast("long"))


def oversized(log: DataFrame, opt: Options) -> DataFrame:
    """Records that no memtable can hold, with the reason."""
    return with_size(log).where(F.col("z") >= opt.memtable_bytes).withColumn("reason", F.lit("too large"))


def in_write_order(rows: DataFrame, sizes: dict[str, Column], *folds: tuple[str, Rule, str]) -> DataFrame:
    """rows (with shard) and, for each fold (size, rule, out), its number. A shard is folded in the order of seq,
    so all of it that is dealt by shard and goes through Python is (shard, seq, sizes); rows, with their values,
    meet the numbers by a join that any number of tasks share. Rows of one seq are one write and stay together."""
    order = rows.select("shard", "seq", *(size.alias(name) for name, size in sizes.items())).repartition("shard")
    order = order.groupBy("shard", "seq").agg(*(F.sum(name).alias(name) for name in sizes))
    for size, rule, out in folds:
        order = fold(order, ["shard"], ["seq"], size, rule, out, dealt=True)
    at = order.select(F.col("shard").alias("__shard"), F.col("seq").alias("__seq"), *(out for _, _, out in folds))
    met = rows.join(at, rows["shard"].eqNullSafe(at["__shard"]) & rows["seq"].eqNullSafe(at["__seq"]))
    return met.drop("__shard", "__seq")


def memtable_runs(log: DataFrame, opt: Options, rejects: str = "error") -> DataFrame:
    """log (with shard) and run_id: a run ends before the record that would fill the memtable. A record that
    no memtable can hold is an error, raised when it is met; with rejects="skip" the caller has taken
    oversized() and such records are left out."""
    rows = with_size(log)
    if rejects == "skip":
        rows = rows.where(F.col("z") < opt.memtable_bytes)
    else:
        told = F.concat(F.lit(f"{RejectedRecord.__name__}: too large for a memtable: "), F.col("k"))
        rows = rows.withColumn("z", F.when(F.col("z") < opt.memtable_bytes, F.col("z")).otherwise(F.raise_error(told).cast("long")))
    return in_write_order(rows, {"z": F.col("z")}, ("z", Rule(opt.memtable_bytes), "run_id"))


def flushed(runs: DataFrame) -> DataFrame:
    """One version of each key per run, the newest."""
    best = runs.groupBy("shard", "run_id", "k").agg(F.max(F.struct("seq", "v", "ts", "z")).alias("n"))
    return best.select("shard", "run_id", "k", "n.seq", "n.v", "n.ts", "n.z")


def file_meta(files: DataFrame, by: list[str]) -> DataFrame:
    return files.groupBy(*by).agg(F.min("k").alias("mn"), F.max("k").alias("mx"), F.count("*").alias("n"), F.sum("z").alias("bytes"), F.max("seq").alias("newest"))


def with_blocks(files: DataFrame, by: list[str], opt: Options) -> DataFrame:
    """Blocks of a file at flush: a record opens a new one if the block would exceed its size."""
    return fold(files, by, ["k"], "z", Rule(opt.block_bytes, start=2, strict=True), "block_id")


def block_index(blocks: DataFrame, by: list[str]) -> DataFrame:
    return blocks.groupBy(*by, "block_id").agg(F.min("k").alias("min_key"), F.count("*").alias("num_keys"), (F.sum("z") + 2).alias("len"))


def payloads(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, block_id, payload): each block's records as bytes, in key order."""
    recs = blocks.groupBy(*by, "block_id").agg(F.array_sort(F.collect_list(F.struct("k", record(F.col("k"), F.col("v")).alias("r")))).alias("r"))  # a block's
    return recs.select(*by, "block_id", block(F.transform("r", lambda x: x["r"])).alias("payload"))


def paged(index: DataFrame, by: list[str], page: int) -> DataFrame:
    """Blocks laid end to end in pages: the page that each starts in (its header), those it fills, the one it
    ends in."""
    before = F.coalesce(F.sum("len").over(Window.partitionBy(*by).orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = index.withColumn("start", before).withColumns({"header": F.floor(F.col("start") / page), "end": F.floor((F.col("start") + F.col("len") - 1) / page)})
    return at.select(*by, "block_id", "header", "end", F.greatest(F.lit(0).cast("long"), F.col("end") - F.col("header") - 1).alias("middle"))


def block_checksums(blocks: DataFrame, by: list[str]) -> DataFrame:
    """CRC-32 of each block's records in key order."""
    rows = blocks.groupBy(*by, "block_id").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: F.concat(x["k"], F.lit("="), x["v"])), "\n")
    return rows.select(*by, "block_id", F.crc32(body.cast("binary")).alias("checksum"), F.size("r").alias("num_keys"))


def failed_blocks(stored: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks whose checksum isn't the stored one."""
    now = block_checksums(blocks, by).withColumnRenamed("checksum", "now")
    return stored.join(now.select(*by, "block_id", "now"), [*by, "block_id"]).where("checksum <> now")


def find_block(index: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """For each key asked of a file (columns `by` and k), the block with the greatest min_key that isn't
    above the key; the first block if there is none. An as-of join as one sort: keys and fences are merged,
    and the last fence seen is carried forward."""
    fences = index.select(*by, F.col("min_key").alias("k"), "block_id", F.lit(0).alias("asked"))
    asks = asked.select(*by, "k", F.lit(None).cast("long").alias("block_id"), F.lit(1).alias("asked"))
    w = Window.partitionBy(*by).orderBy("k", "asked").rowsBetween(Window.unboundedPreceding, 0)
    both = fences.unionByName(asks).withColumn("block_id", F.last("block_id", ignorenulls=True).over(w))
    return both.where("asked = 1").select(*by, "k", F.coalesce("block_id", F.lit(0).cast("long")).alias("block_id"))


def fences_of(*metas: DataFrame) -> list[str]:
    """All ends of key ranges, sorted. Manifests have a row a file and are read by the driver anyway; what is
    sent to tasks is one key an end, MAX_FENCES at most."""
    ends = [m.select(F.explode(F.array("mn", "mx")).alias("k")) for m in metas]
    rows = reduce(DataFrame.union, ends).distinct().limit(MAX_FENCES + 1).collect()
    if len(rows) > MAX_FENCES:
        raise StoreError(f"more than {MAX_FENCES} ends of key ranges")
    return sorted(r["k"] for r in rows if r["k"] is not None)


def _covering(meta: DataFrame, slot) -> DataFrame:
    """meta with a row for each slot between its ends, and `first`, the slot of its least key."""
    ranged = meta.withColumns({"first": slot(F.col("mn")), "last": slot(F.col("mx"))})
    return ranged.withColumn("slot", F.explode(F.sequence("first", "last"))).drop("last")


def find_files(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, file columns) with mn <= k <= mx. The ends of all ranges cut the keys into slots; a file lists its
    slots, which are few where files overlap little, and a key has one, so the join has an equality."""
    slot = slots(fences_of(meta))
    met = keys.withColumn("slot", slot(F.col("k"))).join(_covering(meta, slot).drop("first"), "slot")
    return met.where((F.col("mn") <= F.col("k")) & (F.col("k") <= F.col("mx"))).drop("slot")


def touched(meta: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, touched) of the keys that are in some file's range, and in how many: those that start up to the key less
    those that end before it. No pair is made."""
    ends = rows_of(meta.select("mn", "mx"))
    mn, mx = (sorted(ends[c].to_pylist()) for c in ("mn", "mx"))
    return keys.select("k", (slots(mn)(F.col("k")) - slots(mx, "left")(F.col("k"))).alias("touched")).where("touched > 0")


def rows_of(meta: DataFrame) -> pa.Table:
    """The rows of a manifest, a row a file, on the driver; more than MAX_FENCES ends are an error."""
    rows = meta.limit(MAX_FENCES // 2 + 1).toArrow()
    if 2 * rows.num_rows > MAX_FENCES:
        raise StoreError(f"more than {MAX_FENCES} ends of key ranges")
    return rows


def gathered(meta: DataFrame) -> DataFrame:
    """The manifest computed once, for the plans that read it several times."""
    return meta.sparkSession.createDataFrame(rows_of(meta))


def ranked(*metas: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each manifest the ends of its files' ranges (mn, mx) as their ranks among all ends, in key order."""
    ends = [m[c].to_pylist() for m in metas for c in ("mn", "mx")]
    rank = {k: i for i, k in enumerate(sorted(set().union(*ends)))}
    at = [np.fromiter((rank[k] for k in held), np.int64, len(held)) for held in ends]
    return list(zip(at[::2], at[1::2]))


def _starting(spark, x: tuple, y: tuple, first: str, last: str, names: tuple[str, str]) -> DataFrame:
    """Pairs of the files x and y, each (ids, mn, mx): those of y whose mn is in x's range, found as a stretch of
    y in the order of mn. So there is a row for each pair, and none besides."""
    order = np.argsort(y[1], kind="stable")
    lo, hi = (np.searchsorted(y[1][order], end, side=side) for end, side in ((x[1], first), (x[2], last)))
    some = np.flatnonzero(hi > lo)
    spans = spark.createDataFrame(pa.table({names[0]: pa.array(x[0]).take(pa.array(some)), "x_mn": x[1][some], "lo": lo[some], "hi": hi[some] - 1}))
    at = spark.createDataFrame(pa.table({"at": np.arange(len(order)), names[1]: pa.array(y[0]).take(pa.array(order)), "y_mx": y[2][order]}))
    tasks = min(MAX_TASKS, 1 + int((hi - lo)[some].sum()) // PAIRS_A_TASK)
    return spans.repartition(tasks).withColumn("at", F.explode(F.sequence("lo", "hi"))).join(F.broadcast(at), "at")


def overlaps(a: DataFrame, b: DataFrame, closed: bool) -> DataFrame:
    """Pairs of files (a_id, b_id) whose key ranges overlap; touching ends count only if closed. Of a pair one
    range starts in the other: b's in a's, or else a's in b's after its start. The work is that of the pairs."""
    x = rows_of(a.select("file_id", "mn", "mx"))
    y = x if a is b else rows_of(b.select("file_id", "mn", "mx"))
    (x_ends, y_ends), spark = ranked(x, y), a.sparkSession
    x, y = (x["file_id"].combine_chunks(), *x_ends), (y["file_id"].combine_chunks(), *y_ends)
    within = _starting(spark, x, y, "left", "right" if closed else "left", ("a_id", "b_id"))
    if not closed:
        within = within.where(F.col("x_mn") < F.col("y_mx"))
    after = _starting(spark, y, x, "right", "right" if closed else "left", ("b_id", "a_id"))
    return within.select("a_id", "b_id").union(after.select("a_id", "b_id"))


def index_partitions(index: DataFrame, by: list[str], blocks: int) -> DataFrame:
    """A two-level index: (by, part_id, min_fence, blocks), of so many neighbouring blocks of a file each."""
    part = index.withColumn("part_id", F.floor(F.col("block_id") / blocks))
    held = F.array_sort(F.collect_list(F.struct("min_key", "block_id", "num_keys", "len")))  # `blocks` of them
    return part.groupBy(*by, "part_id").agg(F.min("min_key").alias("min_fence"), held.alias("blocks"))


def find_in_partitions(parts: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """(by, k, part_id, block_id): the partition by its fence, then the block in it."""
    fences = parts.select(*by, F.col("min_fence").alias("min_key"), F.col("part_id").alias("block_id"))
    at = find_block(fences, asked, by).withColumnRenamed("block_id", "part_id").join(parts.drop("min_fence"), [*by, "part_id"])
    below = F.filter("blocks", lambda x: x["min_key"] <= F.col("k"))
    found = F.coalesce(F.element_at(F.filter(below, lambda x: x["min_key"] == F.array_max(F.transform(below, lambda y: y["min_key"]))), 1), F.element_at("blocks", 1))
    return at.select(*by, "k", "part_id", found["block_id"].alias("block_id"))


def fetch(blocks: DataFrame, at: DataFrame, by: list[str]) -> DataFrame:
    """For keys located in blocks (by, block_id, k): the block's size, and the key's place in it and value, null
    if the block doesn't have it."""
    place = Window.partitionBy(*by, "block_id").orderBy("k")
    held = blocks.select(*by, "block_id", "k", "v", (F.row_number().over(place) - 1).alias("place"), F.count("*").over(Window.partitionBy(*by, "block_id")).alias("num_keys"))
    sizes = held.select(*by, "block_id", "num_keys").distinct()
    return at.select(*by, "block_id", "k").join(sizes, [*by, "block_id"]).join(held.drop("num_keys"), [*by, "block_id", "k"], "left")


def physically_deleted(log: DataFrame, keys: DataFrame) -> DataFrame:
    """log less the newest version of each of the keys: what was below it is seen again."""
    first = newest(log.join(keys.select("k").distinct(), "k", "left_semi")).select("k", "seq")
    return log.join(first, ["k", "seq"], "left_anti")


def wal(log: DataFrame, opt: Options) -> DataFrame:
    """log with flush_id (buffer writes), segment (in a ring) and segment_no, per shard."""
    rows = with_size(log).withColumn("zw", F.col("z") + 4)
    buffers, segments = Rule(opt.wal_buffer_bytes, strict=True, extra=4), Rule(opt.wal_segment_bytes, strict=True)
    rows = in_write_order(rows, {"z": F.col("z"), "zw": F.col("zw")}, ("z", buffers, "flush_id"), ("zw", segments, "segment_no"))
    return rows.withColumn("segment", F.col("segment_no") % opt.wal_segments)


def tiers(log: DataFrame, opt: Options) -> DataFrame:
    size = F.octet_length("v")
    return log.withColumn("size", size).withColumn("tier", F.when(size < opt.inline_below, "inline").when(size < opt.large_from, "medium").otherwise("large"))


def separated(log: DataFrame, opt: Options) -> tuple[DataFrame, DataFrame]:
    """Key-value separation: (main, blobs). main keeps small values and pointers (blob_id, length) to the
    others, so that scans and merges of keys don't move large values."""
    t = tiers(log, opt)
    big = F.col("tier") != "inline"
    main = t.select("seq", "k", F.when(~big, F.col("v")).alias("v"), F.when(big, F.struct(F.col("seq").alias("blob_id"), F.col("size").alias("length"))).alias("pointer"))
    return main, t.where(big).select(F.col("seq").alias("blob_id"), F.col("v").alias("value"))


def resolved(main: DataFrame, blobs: DataFrame) -> DataFrame:
    joined = main.join(blobs, main["pointer.blob_id"] == blobs["blob_id"], "left")
    return joined.select("seq", "k", F.coalesce("v", "value").alias("v"))
