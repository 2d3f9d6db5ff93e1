"""The registered queries of the engine's own operators, each with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import codec, compression
from ..functions.folds import Rule, fold_sql
from ..functions.hashing import cache_shard, routed
from ..model import Options, as_log, rejected
from ..operators import compaction, pruning, reads, runs, snapshots
from ..sources.tables import conversations_log, customer_keys, events_log, orders_log, table
from ..store import ShardedStore, Store
from ..streaming import upsert
from ..wal import Wal, scratch

#: Small sizes, so that modest inputs have several runs, blocks and files.
OPT = Options(memtable_bytes=32 * 1024, block_bytes=4096, file_bytes=64 * 1024, level0_bytes=100 * 1024, wal_segment_bytes=32 * 1024)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (SELECT event_id AS seq, 'user:' || lpad(user_id::VARCHAR, 6, '0') AS k,
  CASE WHEN event_type = 'error' THEN '-' ELSE props END AS v, ts, user_id % 4 AS shard FROM events
  WHERE user_id IS NOT NULL AND (props IS NOT NULL OR event_type = 'error'))"""
NEWEST = LOG + ", newest AS (SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM log GROUP BY k), live AS (SELECT * FROM newest WHERE v <> '-')"
Z = "(strlen(k) + strlen(v) + 4)::BIGINT"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The events log with the shard that its user is in."""
    return events_log(spark, sf).withColumn("shard", (F.substring("k", 6, 9).cast("long") % OPT.shards))


# reads


@query("kv_put_lww", f"WITH {NEWEST} SELECT k, seq, v FROM newest")
def _(spark, sf):
    return reads.newest(events_log(spark, sf))


@query("kv_delete_live", f"WITH {NEWEST} SELECT k, seq, v FROM live")
def _(spark, sf):
    return reads.live(events_log(spark, sf))


@query("kv_get", f"WITH {NEWEST} SELECT k, seq, v FROM live WHERE k = 'user:000007'")
def _(spark, sf):
    return reads.get(events_log(spark, sf, "user:000007", "user:000007"), "user:000007")


@query("kv_multi_get", f"""WITH {NEWEST}, asked AS (SELECT DISTINCT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_custkey IS NOT NULL)
SELECT a.k, l.v, l.v IS NOT NULL AS found FROM asked a LEFT JOIN live l ON l.k = a.k""")  # fmt: skip
def _(spark, sf):
    return reads.multi_get(events_log(spark, sf), customer_keys(spark, sf))


@query("kv_scan_range", f"WITH {NEWEST} SELECT k, seq, v FROM live WHERE k >= 'user:000010' AND k < 'user:000050'")
def _(spark, sf):
    return reads.scan(events_log(spark, sf, "user:000010", "user:000050"), "user:000010", "user:000050")


@query("kv_scan_prefix", f"WITH {NEWEST} SELECT k, seq, v FROM live WHERE starts_with(k, 'user:00001')")
def _(spark, sf):
    return reads.scan_prefix(events_log(spark, sf), "user:00001")


@query("kv_prefix_as_range", ORACLES["kv_scan_prefix"])
def _(spark, sf):
    return reads.scan_prefix(events_log(spark, sf), "user:00001", as_range=True)


@query("kv_seek_limit", f"WITH {NEWEST} SELECT k, seq, v, (row_number() OVER (ORDER BY k))::INTEGER AS pos FROM live WHERE k >= 'user:000005' ORDER BY k LIMIT 10")
def _(spark, sf):
    return reads.seek(events_log(spark, sf), "user:000005", 10)


@query("kv_full_scan", f"WITH {NEWEST} SELECT k, seq, v, row_number() OVER (ORDER BY k) AS pos FROM live")
def _(spark, sf):
    return reads.ordered(reads.live(events_log(spark, sf)))


@query("kv_composite_scan", """SELECT lpad(conv_id::VARCHAR, 8, '0') || ':' || lpad(turn::VARCHAR, 4, '0') AS k, max(conv_id * 10000 + turn) AS seq, max_by(text, text) AS v
FROM conversations WHERE text IS NOT NULL AND conv_id >= 3 AND conv_id < 9 GROUP BY 1 HAVING max_by(text, text) <> '-'""")  # fmt: skip
def _(spark, sf):
    return reads.scan(conversations_log(spark, sf), "00000003:", "00000009:")


SOURCES = """src AS (SELECT k, v, CASE WHEN seq % 5 = 0 THEN 0 WHEN seq % 5 < 3 THEN 1 ELSE 2 END AS src, seq AS idx FROM log)"""


@query("kv_source_precedence", f"""WITH {LOG}, {SOURCES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY src, idx DESC) AS n FROM src)
SELECT k, v, src, idx FROM r WHERE n = 1""")  # fmt: skip
def _(spark, sf):
    """Memory (0), level 0 (1) and deeper levels (2) as sources."""
    five = F.col("seq") % 5
    log = events_log(spark, sf).select("k", "v", F.when(five == 0, 0).when(five < 3, 1).otherwise(2).alias("src"), F.col("seq").alias("idx"))
    return reads.merge_sources(log)


@query("kv_typed_order", """WITH c AS (SELECT c_nationkey AS n, c_custkey::VARCHAR AS k FROM customer)
SELECT n, k, (row_number() OVER (PARTITION BY n ORDER BY k))::INTEGER AS by_string, (row_number() OVER (PARTITION BY n ORDER BY k::INT))::INTEGER AS by_int,
(row_number() OVER (PARTITION BY n ORDER BY k::FLOAT, k))::INTEGER AS by_float, (row_number() OVER (PARTITION BY n ORDER BY substr(k, 1, 1), k::INT))::INTEGER AS by_prefix,
CASE WHEN k < '5' THEN -1 WHEN k > '5' THEN 1 ELSE 0 END AS as_string, CASE WHEN k::INT < 5 THEN -1 WHEN k::INT > 5 THEN 1 ELSE 0 END AS as_int,
CASE WHEN substr(k, 1, 1) < '5' THEN -1 WHEN substr(k, 1, 1) > '5' THEN 1 ELSE 0 END AS as_prefix FROM c""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_custkey").cast("string").alias("k"))
    k, five = F.col("k"), F.lit("5")
    rank = lambda *o: F.row_number().over(Window.partitionBy("n").orderBy(*o))
    return c.select("n", "k", rank(k).alias("by_string"), rank(k.cast("int")).alias("by_int"), rank(k.cast("float"), k).alias("by_float"), rank(F.substring(k, 1, 1), k.cast("int")).alias("by_prefix"), reads.compare(k, five, "string").alias("as_string"), reads.compare(k, five, "int").alias("as_int"), reads.compare(k, five, "string", 1).alias("as_prefix"))


# runs and files

MEMTABLE = Rule(OPT.memtable_bytes)
RUNS = f"{LOG}, sized AS (SELECT *, {Z} AS z, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM log WHERE {Z} < {OPT.memtable_bytes}), " + fold_sql("SELECT shard AS grp, rn, z FROM sized", MEMTABLE, "run_id") + ", runs AS (SELECT sized.*, f.run_id FROM sized JOIN f ON f.grp = sized.shard AND f.rn = sized.rn)"
FLUSHED = RUNS + ", flushed AS (SELECT shard, run_id, k, max(seq) AS seq, max_by(v, seq) AS v, max_by(ts, seq) AS ts, max_by(z, seq) AS z FROM runs GROUP BY shard, run_id, k)"
BLOCK = Rule(OPT.block_bytes, start=2, strict=True)
BY = ["shard", "run_id"]


def _runs(spark, sf):
    return runs.memtable_runs(events(spark, sf), OPT)


def _flushed(spark, sf):
    return runs.flushed(_runs(spark, sf))


@query("memtable_runs", f"WITH RECURSIVE {RUNS} SELECT shard, run_id, count(*) AS n, sum(z)::BIGINT AS bytes, min(seq) AS first_seq, max(seq) AS last_seq FROM runs GROUP BY shard, run_id")
def _(spark, sf):
    return _runs(spark, sf).groupBy("shard", "run_id").agg(F.count("*").alias("n"), F.sum("z").alias("bytes"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("flush_dedup", f"WITH RECURSIVE {FLUSHED} SELECT shard, run_id, k, seq, v FROM flushed")
def _(spark, sf):
    return _flushed(spark, sf).select("shard", "run_id", "k", "seq", "v")


@query("sst_meta", f"WITH RECURSIVE {FLUSHED} SELECT shard, run_id, min(k) AS mn, max(k) AS mx, count(*) AS n, sum(z)::BIGINT AS bytes, max(seq) AS newest FROM flushed GROUP BY shard, run_id")
def _(spark, sf):
    return runs.file_meta(_flushed(spark, sf), BY)


BIG = """big AS (SELECT (o_orderkey % 4)::BIGINT AS shard, 'order:' || lpad(o_orderkey::VARCHAR, 9, '0') AS k, o_orderstatus || '|' || o_orderpriority AS v FROM orders
  WHERE o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL)"""
SORTED = f"{BIG}, files AS (SELECT *, {Z} AS z, row_number() OVER (PARTITION BY shard ORDER BY k) AS rn FROM big)"
BLOCKS = SORTED + ", " + fold_sql("SELECT shard AS grp, rn, z FROM files", BLOCK, "block_id") + ", blocks AS (SELECT files.*, f.block_id FROM files JOIN f ON f.grp = files.shard AND f.rn = files.rn)"
INDEX = BLOCKS + ", idx AS (SELECT shard, block_id, min(k) AS min_key, count(*) AS num_keys, (sum(z) + 2)::BIGINT AS len FROM blocks GROUP BY shard, block_id)"


def _orders(spark, sf):
    """One sorted file of unique keys per shard."""
    o = table(spark, sf, "orders").where("o_orderkey IS NOT NULL AND o_orderstatus IS NOT NULL AND o_orderpriority IS NOT NULL")
    k = F.concat(F.lit("order:"), F.lpad(o["o_orderkey"].cast("string"), 9, "0"))
    return runs.with_size(o.select((F.col("o_orderkey") % 4).alias("shard"), F.col("o_orderkey").alias("seq"), k.alias("k"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority").alias("v")))


@query("sst_block_index", f"WITH RECURSIVE {INDEX} SELECT shard, block_id, min_key, num_keys, len FROM idx")
def _(spark, sf):
    return runs.block_index(runs.with_blocks(_orders(spark, sf), ["shard"], OPT), ["shard"])


ASKED = "asked AS (SELECT DISTINCT (l_orderkey % 4)::BIGINT AS shard, 'order:' || lpad(l_orderkey::VARCHAR, 9, '0') AS k FROM lineitem WHERE l_orderkey IS NOT NULL)"


def _asked(spark, sf):
    line = table(spark, sf, "lineitem").where("l_orderkey IS NOT NULL")
    return line.select((F.col("l_orderkey") % 4).alias("shard"), F.concat(F.lit("order:"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0")).alias("k")).distinct()


@query("block_lookup_asof", f"WITH RECURSIVE {INDEX}, {ASKED} SELECT a.shard, a.k, coalesce(i.block_id, 0) AS block_id FROM asked a ASOF LEFT JOIN idx i ON a.shard = i.shard AND a.k >= i.min_key")
def _(spark, sf):
    index = runs.block_index(runs.with_blocks(_orders(spark, sf), ["shard"], OPT), ["shard"])
    return runs.find_block(index, _asked(spark, sf), ["shard"])


META = FLUSHED + ", meta AS (SELECT shard::VARCHAR || '/' || run_id::VARCHAR AS file_id, shard, run_id, min(k) AS mn, max(k) AS mx, count(*) AS n, sum(z)::BIGINT AS bytes, max(seq) AS newest FROM flushed GROUP BY shard, run_id)"


def _meta(spark, sf):
    meta = runs.file_meta(_flushed(spark, sf), BY)
    return meta.withColumn("file_id", F.concat_ws("/", F.col("shard").cast("string"), F.col("run_id").cast("string")))


def _kept(spark, sf):
    """The flushed runs, written once and read again by each use."""
    at = scratch(spark, "runs")
    _flushed(spark, sf).select(*BY, "k", "seq", "z").write.parquet(at)
    return spark.read.parquet(at)


@query("sst_lookup", f"""WITH RECURSIVE {META}, asked AS (SELECT DISTINCT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_custkey IS NOT NULL),
hit AS (SELECT a.k, m.file_id, m.shard, m.run_id FROM asked a JOIN meta m ON a.k BETWEEN m.mn AND m.mx)
SELECT h.k, count(*) AS touched, count(f.k) AS hits FROM hit h LEFT JOIN flushed f ON f.shard = h.shard AND f.run_id = h.run_id AND f.k = h.k GROUP BY h.k""")  # fmt: skip
def _(spark, sf):
    """Read amplification: files whose range holds the key, and those that have it."""
    keys, flushed = customer_keys(spark, sf), _kept(spark, sf)
    hits = flushed.join(keys, "k", "left_semi").groupBy("k").agg(F.count("*").alias("hits"))
    return runs.touched(runs.file_meta(flushed, BY), keys).join(hits, "k", "left").select("k", "touched", F.coalesce("hits", F.lit(0).cast("long")).alias("hits"))


LEVELS = META + ", man AS (SELECT file_id, run_id % 3 AS level, mn, mx, n, bytes, newest FROM meta)"


def _manifest(spark, sf):
    """A manifest of the runs, dealt to three levels."""
    return runs.gathered(_meta(spark, sf)).select("file_id", (F.col("run_id") % 3).alias("level"), "mn", "mx", "n", "bytes", "newest")


for _closed, _name in ((False, "overlap_strict"), (True, "overlap_closed")):
    _op = "<=" if _closed else "<"

    @query(_name, f"WITH RECURSIVE {META} SELECT a.file_id AS a_id, b.file_id AS b_id FROM meta a JOIN meta b ON a.mn {_op} b.mx AND b.mn {_op} a.mx")
    def _(spark, sf, closed=_closed):
        meta = _meta(spark, sf)
        return runs.overlaps(meta, meta, closed)


TRIGGER = f", trig AS (SELECT level, count(*) AS files, CASE WHEN level = 0 THEN count(*) > {OPT.level0_files} ELSE count(*) * {OPT.file_bytes} > {OPT.level0_bytes} * level END AS due FROM man GROUP BY level)"


@query("compact_trigger", f"WITH RECURSIVE {LEVELS} {TRIGGER} SELECT level, files, due FROM trig")
def _(spark, sf):
    return compaction.triggers(_manifest(spark, sf), OPT)


PLAN = f"""{TRIGGER}, vic AS (SELECT m.* FROM man m JOIN trig t ON t.level = m.level AND t.due WHERE m.level < {OPT.levels - 1}),
met AS (SELECT v.file_id AS victim, string_agg(m.file_id, ',' ORDER BY m.file_id) AS inputs FROM vic v JOIN man m ON m.file_id <> v.file_id AND v.mn <= m.mx AND m.mn <= v.mx
  AND (m.level = v.level + 1 OR (v.level = 0 AND m.level = 0)) GROUP BY v.file_id),
jobs AS (SELECT v.file_id AS victim, v.level AS start_level, v.level + 1 AS end_level, coalesce(met.inputs, '') AS inputs, met.inputs IS NULL AND v.level > 0 AS trivial FROM vic v LEFT JOIN met ON met.victim = v.file_id)"""


@query("compact_plan", f"WITH RECURSIVE {LEVELS} {PLAN} SELECT victim, start_level, end_level, inputs, trivial FROM jobs")
def _(spark, sf):
    return compaction.plan(_manifest(spark, sf), OPT)


@query("compact_trivial_move", f"WITH RECURSIVE {LEVELS} {PLAN} SELECT m.file_id, coalesce(j.end_level, m.level) AS level, m.mn, m.mx, m.n, m.bytes, m.newest FROM man m LEFT JOIN jobs j ON j.victim = m.file_id AND j.trivial")
def _(spark, sf):
    manifest = _manifest(spark, sf)
    return compaction.move(manifest, compaction.moves(manifest, OPT))


@query("compact_merge", f"""WITH RECURSIVE {FLUSHED}, dated AS (SELECT *, max(seq) OVER (PARTITION BY shard, run_id) AS newest FROM flushed),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY newest DESC, seq DESC) AS n FROM dated) SELECT k, seq, v FROM r WHERE n = 1""")  # fmt: skip
def _(spark, sf):
    flushed = _flushed(spark, sf)
    dated = flushed.join(runs.file_meta(flushed, BY).select(*BY, "newest"), BY)
    return compaction.merge(dated, bottom=False)


@query("compact_merge_bottom", ORACLES["compact_merge"] + " AND v <> '-'")
def _(spark, sf):
    flushed = _flushed(spark, sf)
    dated = flushed.join(runs.file_meta(flushed, BY).select(*BY, "newest"), BY)
    return compaction.merge(dated, bottom=True)


_B, _S = OPT.block_bytes, OPT.file_bytes
SPLIT = f"""{SORTED}, fl AS MATERIALIZED (SELECT shard, rn, k, z FROM files), p AS (
  SELECT shard, rn, (z + 2)::BIGINT AS bb, {_B}::BIGINT AS tr, 0::BIGINT AS file_no, 0::BIGINT AS block_no FROM fl WHERE rn = 1 UNION ALL
  SELECT shard, rn, CASE WHEN roll OR nb THEN 2 + z ELSE bb + z END, CASE WHEN roll THEN {_B} ELSE tr2 END, CASE WHEN roll THEN file_no + 1 ELSE file_no END, CASE WHEN roll THEN 0 WHEN nb THEN block_no + 1 ELSE block_no END
  FROM (SELECT *, tr2 + z >= {_S} AS roll FROM (SELECT fl.shard, fl.rn, fl.z, p.bb, p.file_no, p.block_no, p.bb + fl.z >= {_B} AS nb, p.tr + CASE WHEN p.bb + fl.z >= {_B} THEN {_B} ELSE 0 END AS tr2 FROM p JOIN fl ON fl.shard = p.shard AND fl.rn = p.rn + 1)))"""


@query("compact_split", f"WITH RECURSIVE {SPLIT} SELECT p.shard, file_no, block_no, min(k) AS min_key, count(*) AS num_keys, sum(z)::BIGINT AS bytes FROM p JOIN fl ON fl.shard = p.shard AND fl.rn = p.rn GROUP BY p.shard, file_no, block_no")
def _(spark, sf):
    cut = compaction.split(_orders(spark, sf), ["shard"], OPT)
    return cut.groupBy("shard", "file_no", "block_no").agg(F.min("k").alias("min_key"), F.count("*").alias("num_keys"), F.sum("z").alias("bytes"))


@query("amplification", f"""WITH RECURSIVE {FLUSHED}, l AS (SELECT k FROM log GROUP BY k HAVING max_by(v, seq) <> '-')
SELECT (SELECT count(*) FROM flushed) AS stored, (SELECT sum(z)::BIGINT FROM flushed) AS file_bytes, (SELECT count(*) FROM l) AS live, (SELECT sum({Z})::BIGINT FROM log) AS log_bytes""")  # fmt: skip
def _(spark, sf):
    return compaction.amplification(_flushed(spark, sf), events(spark, sf))


def _bytes(text: str, kind: str = "BIGINT") -> str:
    """A list of the bytes of an ASCII text."""
    return f"list_transform(string_split({text}, ''), lambda x: ord(x)::{kind})"


CRC = f"""tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
body AS (SELECT shard, block_id, string_agg(k || '=' || v, chr(10) ORDER BY k) AS body, count(*)::INTEGER AS num_keys FROM blocks GROUP BY shard, block_id),
sums AS (SELECT shard, block_id, num_keys, xor(list_reduce(list_concat([4294967295::BIGINT], {_bytes("body")}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) AS checksum FROM body, tab)"""


def _blocks(spark, sf):
    return runs.with_blocks(_orders(spark, sf), ["shard"], OPT)


@query("block_checksum", f"WITH RECURSIVE {BLOCKS}, {CRC} SELECT shard, block_id, checksum, num_keys FROM sums")
def _(spark, sf):
    return runs.block_checksums(_blocks(spark, sf), ["shard"])


@query("block_verify", f"WITH RECURSIVE {BLOCKS} SELECT DISTINCT shard, block_id FROM blocks WHERE (block_id + shard) % 3 = 1")
def _(spark, sf):
    """Blocks in which a value was changed after the checksums were taken."""
    blocks = _blocks(spark, sf)
    changed = blocks.withColumn("v", F.when((F.col("block_id") + F.col("shard")) % 3 == 1, F.concat("v", F.lit("!"))).otherwise(F.col("v")))
    return runs.failed_blocks(runs.block_checksums(blocks, ["shard"]), changed, ["shard"]).select("shard", "block_id")


HEX = "printf('%02X%02X', strlen({0}) % 256, strlen({0}) // 256) || hex({0}::BLOB)"
PAYLOADS = f"""payloads AS (SELECT shard, block_id, printf('%02X%02X', count(*) % 256, count(*) // 256) || string_agg({HEX.format("k")} || {HEX.format("v")}, '' ORDER BY k) AS x FROM blocks GROUP BY shard, block_id)"""


@query("record_encode", f"WITH RECURSIVE {BLOCKS}, {PAYLOADS} SELECT shard, block_id, (length(x) // 2)::INTEGER AS bytes, md5(x) AS digest FROM payloads")
def _(spark, sf):
    return runs.payloads(_blocks(spark, sf), ["shard"]).select("shard", "block_id", F.octet_length("payload").alias("bytes"), F.md5(F.hex("payload").cast("binary")).alias("digest"))


@query("record_decode", f"WITH RECURSIVE {BLOCKS} SELECT shard, block_id, (row_number() OVER (PARTITION BY shard, block_id ORDER BY k) - 1)::INTEGER AS pos, k, v FROM blocks")
def _(spark, sf):
    return codec.decoded(runs.payloads(_blocks(spark, sf), ["shard"]), "payload", ["k", "v"])


@query("block_arrays", f"WITH RECURSIVE {BLOCKS} SELECT shard, block_id, string_agg(k, ',' ORDER BY k) AS keys, string_agg(v, ',' ORDER BY k) AS vals FROM blocks GROUP BY shard, block_id")
def _(spark, sf):
    """Blocks as parallel arrays of keys and values."""
    rows = codec.decoded(runs.payloads(_blocks(spark, sf), ["shard"]), "payload", ["k", "v"])
    held = rows.groupBy("shard", "block_id").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "v"))).alias("r"))  # a block's
    return held.select("shard", "block_id", F.array_join(F.col("r.k"), ",").alias("keys"), F.array_join(F.col("r.v"), ",").alias("vals"))


@query("block_compress", f"WITH RECURSIVE {BLOCKS}, {PAYLOADS} SELECT shard, block_id, (length(x) // 2)::INTEGER AS bytes, md5(x) AS digest, true AS smaller FROM payloads")
def _(spark, sf):
    """Blocks compressed with a trained dictionary and read back."""
    raw = runs.payloads(_blocks(spark, sf), ["shard"])
    dictionary = compression.train(raw, "payload", ["shard", "block_id"])
    packed = compression.compressed(raw, "payload", dictionary)
    back = compression.decompressed(packed.withColumn("packed", F.octet_length("payload")), "payload", dictionary)
    return back.select("shard", "block_id", F.octet_length("payload").alias("bytes"), F.md5(F.hex("payload").cast("binary")).alias("digest"), (F.col("packed") < F.octet_length("payload")).alias("smaller"))


@query("page_packing", f"""WITH RECURSIVE {INDEX}, laid AS (SELECT shard, block_id, len, coalesce(sum(len) OVER (PARTITION BY shard ORDER BY block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM idx),
p AS (SELECT shard, block_id, start // 4096 AS header, (start + len - 1) // 4096 AS "end" FROM laid) SELECT shard, block_id, header, "end", greatest(0, "end" - header - 1) AS middle FROM p""")  # fmt: skip
def _(spark, sf):
    return runs.paged(runs.block_index(_blocks(spark, sf), ["shard"]), ["shard"], 4096)


PARTS = f"{INDEX}, parts AS (SELECT shard, block_id // 8 AS part_id, min(min_key) AS min_fence, count(*) AS blocks, sum(num_keys)::BIGINT AS num_keys FROM idx GROUP BY shard, block_id // 8)"


@query("index_partitions", f"WITH RECURSIVE {PARTS} SELECT shard, part_id, min_fence, blocks, num_keys FROM parts")
def _(spark, sf):
    """The two-level index as it is stored and read again."""
    parts = runs.index_partitions(runs.block_index(_blocks(spark, sf), ["shard"]), ["shard"], 8)
    at = scratch(spark, "index")
    parts.write.parquet(at)
    back = spark.read.parquet(at)
    return back.select("shard", "part_id", "min_fence", F.size("blocks").cast("long").alias("blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda n, x: n + x["num_keys"]).alias("num_keys"))


@query("partition_lookup", f"""WITH RECURSIVE {PARTS}, {ASKED}, p AS (SELECT a.shard, a.k, coalesce(i.part_id, 0) AS part_id FROM asked a ASOF LEFT JOIN parts i ON a.shard = i.shard AND a.k >= i.min_fence)
SELECT p.shard, p.k, p.part_id, coalesce(i.block_id, 0) AS block_id FROM p ASOF LEFT JOIN idx i ON p.shard = i.shard AND p.k >= i.min_key""")  # fmt: skip
def _(spark, sf):
    parts = runs.index_partitions(runs.block_index(_blocks(spark, sf), ["shard"]), ["shard"], 8)
    return runs.find_in_partitions(parts, _asked(spark, sf), ["shard"])


@query("block_fetch", f"""WITH RECURSIVE {INDEX}, {ASKED}, loc AS (SELECT a.shard, a.k, coalesce(i.block_id, 0) AS block_id FROM asked a ASOF LEFT JOIN idx i ON a.shard = i.shard AND a.k >= i.min_key),
placed AS (SELECT shard, block_id, k, v, (row_number() OVER (PARTITION BY shard, block_id ORDER BY k) - 1)::INTEGER AS place FROM blocks)
SELECT loc.shard, loc.block_id, loc.k, i.num_keys, p.place, p.v FROM loc JOIN idx i ON i.shard = loc.shard AND i.block_id = loc.block_id LEFT JOIN placed p ON p.shard = loc.shard AND p.block_id = loc.block_id AND p.k = loc.k""")  # fmt: skip
def _(spark, sf):
    """The block of each key asked, by number, and the key's place in it."""
    blocks = _blocks(spark, sf)
    at = runs.find_block(runs.block_index(blocks, ["shard"]), _asked(spark, sf), ["shard"])
    return runs.fetch(blocks, at, ["shard"]).select("shard", "block_id", "k", "num_keys", "place", "v")


M = "4294967296::HUGEINT"


def murmur_sql(source: str, seeds: int) -> str:
    """CTEs; murmur (k, seed, h) has MurmurHash3 of the ASCII keys of a query of k."""
    word = " + ".join(f"coalesce(b[4 * i + {j + 1}], 0) * {256**j}" for j in range(4))
    mixed = lambda x: f"list_transform(list_transform(list_transform({x}, lambda w: (w * 3432918353) % {M}), lambda a: (a * 32768) % {M} + a // 131072), lambda c: (c * 461845907) % {M})"
    down = lambda x, n: f"xor({x}, {x} // {2**n})"
    return f"""mk AS (SELECT k, {_bytes("k", "HUGEINT")} AS b FROM ({source})), mw AS (SELECT k, len(b) AS n, {mixed(f"list_transform(range(0, len(b) // 4), lambda i: {word})")} AS w, {mixed(f"[(SELECT sum(coalesce(b[4 * (len(b) // 4) + j + 1], 0) * (256 ** j)::HUGEINT) FROM range(4) t(j))::HUGEINT]")}[1] AS tail FROM mk),
mh AS (SELECT k, n, seed, xor(list_reduce(list_concat([seed::HUGEINT], w), lambda h, x: (((xor(h, x) * 8192) % {M} + xor(h, x) // 524288) * 5 + 3864292196) % {M}), tail) AS h FROM mw, range({pruning.SEED}, {pruning.SEED + seeds}) s(seed)),
m1 AS (SELECT k, seed, {down("xor(h, n::HUGEINT)", 16)} AS h FROM mh), m2 AS (SELECT k, seed, (h * 2246822507) % {M} AS h FROM m1), m3 AS (SELECT k, seed, ({down("h", 13)} * 3266489909) % {M} AS h FROM m2), murmur AS (SELECT k, seed, ({down("h", 16)})::BIGINT AS h FROM m3)"""


@query("murmur3", f"WITH {murmur_sql('SELECT c_name AS k FROM customer WHERE c_name IS NOT NULL', 3)} SELECT k, list(h ORDER BY seed) AS h FROM murmur GROUP BY k")
def _(spark, sf):
    c = table(spark, sf, "customer").where("c_name IS NOT NULL").select(F.col("c_name").alias("k")).distinct()
    return c.select("k", pruning.hashes(F.col("k"), 3).alias("h"))


HIT = """asked AS (SELECT DISTINCT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_custkey IS NOT NULL),
hit AS (SELECT a.k, m.shard, m.run_id FROM asked a JOIN meta m ON a.k BETWEEN m.mn AND m.mx), every AS (SELECT k FROM asked UNION SELECT k FROM flushed)"""
BLOOM = f"""{META}, {HIT}, {murmur_sql("SELECT k FROM every", pruning.HASHES)}, sized AS (SELECT shard, run_id, ((n * {pruning.BITS_PER_KEY} + 63) // 64) * 64 AS bits FROM meta),
bits AS (SELECT DISTINCT f.shard, f.run_id, m.h % s.bits AS at FROM flushed f JOIN sized s ON s.shard = f.shard AND s.run_id = f.run_id JOIN murmur m ON m.k = f.k)"""


@query("bloom_build", f"WITH RECURSIVE {BLOOM.replace('sized AS (SELECT shard, run_id', 'bsize AS (SELECT shard, run_id').replace('JOIN sized s ON', 'JOIN bsize s ON')} SELECT s.shard, s.run_id, s.bits, count(b.at) AS n_set FROM bsize s JOIN bits b ON b.shard = s.shard AND b.run_id = s.run_id GROUP BY s.shard, s.run_id, s.bits")
def _(spark, sf):
    """Filters as they are stored and read again: their size and how many bits are set."""
    at = scratch(spark, "filter")
    pruning.run_blooms(_flushed(spark, sf), BY).write.parquet(at)
    back = spark.read.parquet(at)
    return back.groupBy(*BY, "bits").agg(F.sum(F.bitmap_count("map")).alias("n_set"))


HAS = "SELECT x.shard, x.run_id, x.k, x.maybe, f.k IS NOT NULL AS has FROM maybe x LEFT JOIN flushed f ON f.shard = x.shard AND f.run_id = x.run_id AND f.k = x.k"


@query("bloom_prune", f"""WITH RECURSIVE {BLOOM.replace('sized AS (SELECT shard, run_id', 'bsize AS (SELECT shard, run_id').replace('JOIN sized s ON', 'JOIN bsize s ON')},
maybe AS (SELECT h.shard, h.run_id, h.k, bool_and(b.at IS NOT NULL) AS maybe FROM hit h JOIN bsize s ON s.shard = h.shard AND s.run_id = h.run_id JOIN murmur m ON m.k = h.k LEFT JOIN bits b ON b.shard = h.shard AND b.run_id = h.run_id AND b.at = m.h % s.bits GROUP BY h.shard, h.run_id, h.k) {HAS}""")  # fmt: skip
def _(spark, sf):
    """Per key asked and run whose range holds it: whether the filter lets it pass, and whether the run has it."""
    return pruning.probed(_kept(spark, sf), customer_keys(spark, sf), BY)


FNV_KEY = f"list_reduce(list_concat([14695981039346656037::HUGEINT], {_bytes('k', 'HUGEINT')}), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query("blocked_bloom", f"""WITH RECURSIVE {META}, {HIT}, fnv AS (SELECT k, {FNV_KEY} AS h FROM every), bsize AS (SELECT shard, run_id, ((n * {pruning.BITS_PER_KEY} + 511) // 512) AS buckets FROM meta),
probes AS (SELECT k, h, (h // (128::HUGEINT ** i)::HUGEINT) % 512 AS bit FROM fnv, range({pruning.PROBES}) t(i)),
bits AS (SELECT DISTINCT f.shard, f.run_id, p.h % s.buckets AS bucket, p.bit FROM flushed f JOIN bsize s ON s.shard = f.shard AND s.run_id = f.run_id JOIN probes p ON p.k = f.k),
maybe AS (SELECT h.shard, h.run_id, h.k, bool_and(b.bit IS NOT NULL) AS maybe FROM hit h JOIN bsize s ON s.shard = h.shard AND s.run_id = h.run_id JOIN probes p ON p.k = h.k
  LEFT JOIN bits b ON b.shard = h.shard AND b.run_id = h.run_id AND b.bucket = p.h % s.buckets AND b.bit = p.bit GROUP BY h.shard, h.run_id, h.k) {HAS}""")  # fmt: skip
def _(spark, sf):
    return pruning.probed(_kept(spark, sf), customer_keys(spark, sf), BY, blocked=True)


# snapshots


@query("snapshot_as_of", f"WITH {LOG}, n AS (SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM log WHERE seq <= 500 GROUP BY k) SELECT k, seq, v FROM n WHERE v <> '-'")
def _(spark, sf):
    return snapshots.as_of(events_log(spark, sf), 500)


@query("snapshot_diff", f"""WITH {LOG}, a AS (SELECT k, max_by(v, seq) AS v FROM log WHERE seq <= 500 GROUP BY k HAVING max_by(v, seq) <> '-'),
b AS (SELECT k, max_by(v, seq) AS v FROM log WHERE seq <= 900 GROUP BY k HAVING max_by(v, seq) <> '-')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'add' WHEN b.k IS NULL THEN 'del' ELSE 'upd' END AS change, a.v AS old_v, b.v AS new_v
FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")  # fmt: skip
def _(spark, sf):
    return snapshots.diff(events_log(spark, sf), 500, 900)


@query("orders_as_of", """WITH o AS (SELECT 'cust:' || lpad(o_custkey::VARCHAR, 8, '0') AS k, o_orderkey AS seq, CASE WHEN o_orderstatus = 'P' THEN '-' ELSE concat_ws('|', o_orderstatus, o_orderpriority) END AS v FROM orders
WHERE o_custkey IS NOT NULL AND o_orderdate < TIMESTAMP '1996-01-01'), n AS (SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM o GROUP BY k) SELECT k, seq, v FROM n WHERE v <> '-'""")  # fmt: skip
def _(spark, sf):
    """State before a date: the filter on ts reaches the scan."""
    return reads.live(orders_log(spark, sf).where(F.col("ts") < F.lit("1996-01-01").cast("timestamp")))


# write-ahead log

WAL_RULE, SEG_RULE = Rule(OPT.wal_buffer_bytes, strict=True, extra=4), Rule(OPT.wal_segment_bytes, strict=True)
NUMBERED = f"{LOG}, sized AS (SELECT *, {Z} AS z, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM log), "


@query("wal_flushes", f"WITH RECURSIVE {NUMBERED} {fold_sql('SELECT shard AS grp, rn, z FROM sized', WAL_RULE, 'flush_id')} SELECT grp AS shard, f.flush_id, count(*) AS n, sum(sized.z)::BIGINT AS bytes FROM f JOIN sized ON sized.shard = f.grp AND sized.rn = f.rn GROUP BY grp, f.flush_id")
def _(spark, sf):
    return runs.wal(events(spark, sf), OPT).groupBy("shard", "flush_id").agg(F.count("*").alias("n"), F.sum("z").alias("bytes"))


@query("wal_segments", f"WITH RECURSIVE {NUMBERED} {fold_sql('SELECT shard AS grp, rn, z + 4 AS z FROM sized', SEG_RULE, 'segment_no')} SELECT grp AS shard, f.segment_no, f.segment_no % {OPT.wal_segments} AS segment, count(*) AS n, min(sized.seq) AS first_seq FROM f JOIN sized ON sized.shard = f.grp AND sized.rn = f.rn GROUP BY grp, f.segment_no")
def _(spark, sf):
    return runs.wal(events(spark, sf), OPT).groupBy("shard", "segment_no", "segment").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def _wal(spark, sf) -> Wal:
    """The events appended in two parts, closed and opened again."""
    at, log = scratch(spark, "wal"), events(spark, sf)
    wal = Wal(spark, at, OPT)
    for part in (F.col("seq") <= 400, F.col("seq") > 400):
        wal.append(log.where(part))
    wal.close()
    return Wal(spark, at, OPT)


@query("wal_replay", ORACLES["kv_put_lww"])
def _(spark, sf):
    """State after a crash: from the bytes of the log's segments."""
    return reads.newest(_wal(spark, sf).replay())


@query("wal_reopen", f"WITH {LOG} SELECT count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq, 2::BIGINT AS appends, true AS clean FROM log")
def _(spark, sf):
    wal = _wal(spark, sf)
    return wal.replay().agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).withColumns({"appends": F.lit(wal.meta["appends"]).cast("long"), "clean": F.lit(wal.clean)})


@query("wal_torn", f"WITH RECURSIVE {NUMBERED} {fold_sql('SELECT shard AS grp, rn, z FROM sized', WAL_RULE, 'flush_id')}, last AS (SELECT grp, max(flush_id) AS flush_id FROM f GROUP BY grp) SELECT sized.shard, sized.seq, k, v FROM sized JOIN f ON sized.shard = f.grp AND sized.rn = f.rn JOIN last ON last.grp = f.grp AND f.flush_id < last.flush_id")
def _(spark, sf):
    """The last buffer of each shard was not written whole: replay ends before it."""
    wal = Wal(spark, scratch(spark, "wal"), OPT)
    wal.append(events(spark, sf))
    held = wal.rows()
    last = F.col("flush_id") == F.max("flush_id").over(Window.partitionBy("shard"))
    torn = held.withColumn("payload", F.when(last, F.substring("payload", 1, 100)).otherwise(F.col("payload")))
    after = Wal(spark, scratch(spark, "wal"), OPT)
    torn.write.partitionBy("append").parquet(f"{after.path}/segments")
    return after.replay().select("shard", "seq", "k", "v")


# the store


def _store(spark, sf, path: str | None = None, parts: int = 3) -> Store:
    """The events flushed in parts, by a store that is closed then; opened anew."""
    log, path = events_log(spark, sf), path or scratch(spark, "store")
    store = Store(spark, path, OPT)
    last = log.agg(F.max("seq")).first()[0] or 0
    for i in range(parts):
        store.flush(log.where((F.col("seq") > last * i // parts) & (F.col("seq") <= last * (i + 1) // parts)))
    store.close()
    return Store(spark, path, OPT)


@query("store_reopen", ORACLES["kv_delete_live"])
def _(spark, sf):
    return _store(spark, sf).scan()


@query("store_compact", ORACLES["kv_delete_live"])
def _(spark, sf):
    store = _store(spark, sf)
    store.compact()
    return store.scan()


@query("store_manifest", "SELECT 0 AS level, 0 AS due")
def _(spark, sf):
    """After compaction no level is due and none below level 0 has files that overlap."""
    store = _store(spark, sf)
    store.compact()
    manifest = store.manifest()
    met = runs.overlaps(manifest, manifest, closed=True).where("a_id <> b_id").join(manifest.where("level > 0").withColumnRenamed("file_id", "a_id"), "a_id")
    both = met.join(manifest.select(F.col("file_id").alias("b_id"), F.col("level").alias("b_level")), "b_id").where("level = b_level").agg(F.count("*").cast("int").alias("level"))
    return both.crossJoin(compaction.triggers(manifest, OPT).agg(F.coalesce(F.sum(F.col("due").cast("int")), F.lit(0)).cast("int").alias("due")))  # one row each


@query("store_snapshot", f"WITH {LOG}, n AS (SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM log WHERE seq <= (SELECT max(event_id) // 3 FROM events) GROUP BY k) SELECT k, seq, v FROM n WHERE v <> '-'")
def _(spark, sf):
    """A pinned version, read after later flushes and a compaction."""
    store = _store(spark, sf)
    first = store.pin(store.versions()[0])
    store.compact()
    return store.scan(version=first)


@query("store_multi_get", ORACLES["kv_multi_get"])
def _(spark, sf):
    return _store(spark, sf).multi_get(customer_keys(spark, sf))


@query("store_seek", ORACLES["kv_scan_prefix"])
def _(spark, sf):
    return _store(spark, sf).seek("user:00001")


@query("store_read_length", f"WITH {NEWEST} SELECT k, seq, v, strlen(v)::INTEGER AS length FROM live WHERE k = 'user:000007'")
def _(spark, sf):
    return _store(spark, sf).read_length("user:000007")


@query("store_locate", f"""WITH {NEWEST} SELECT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS k, true AS located FROM customer WHERE 'user:' || lpad(c_custkey::VARCHAR, 6, '0') IN (SELECT k FROM newest)""")
def _(spark, sf):
    """Keys of the store among those asked, found by the ranges, filters and block indexes stored beside its files."""
    store, asked = _store(spark, sf), customer_keys(spark, sf)
    at = store.locate(asked).groupBy("k").agg(F.min("block_id").alias("b"))
    return reads.newest(store._read(store.load()["files"])).join(asked, "k", "left_semi").select("k").join(at, "k", "left").select("k", F.col("b").isNotNull().alias("located"))


@query("store_shards", f"WITH {NEWEST}, s AS (SELECT *, ({FNV_KEY} % 3)::BIGINT AS shard FROM live) SELECT k, seq, v, shard FROM s")
def _(spark, sf):
    """Three shards: each has its own keys."""
    store = ShardedStore(spark, scratch(spark, "shards"), 3, OPT)
    store.flush(events_log(spark, sf))
    parts = [s.scan().withColumn("shard", F.lit(i).cast("long")) for i, s in enumerate(store.shards)]
    return parts[0].union(parts[1]).union(parts[2])


@query("stream_into_store", ORACLES["kv_delete_live"])
def _(spark, sf):
    """The events arrive in order, in several files; each batch is a commit."""
    at = scratch(spark, "stream")
    log = events_log(spark, sf)
    half = (log.agg(F.max("seq")).first()[0] or 0) // 2
    for part in (F.col("seq") <= half, F.col("seq") > half):
        log.where(part).coalesce(1).write.mode("append").parquet(f"{at}/in")
    store = Store(spark, f"{at}/store", OPT)
    upsert.into_store(upsert.stream_log(spark, f"{at}/in"), store, f"{at}/checkpoint").awaitTermination()
    return store.scan()


@query("put_rejects", f"""SELECT doc_id AS seq, CASE WHEN text IS NULL THEN 'no value' ELSE 'too large' END AS reason FROM documents
WHERE doc_id IS NOT NULL AND (text IS NULL OR strlen(text) + strlen(doc_id::VARCHAR) + 4 >= {OPT.memtable_bytes // 4})""")  # fmt: skip
def _(spark, sf):
    """Documents that can't be put: without a text, or too large for a memtable of 8 KB."""
    d, small = table(spark, sf, "documents").where("doc_id IS NOT NULL"), Options(memtable_bytes=OPT.memtable_bytes // 4)
    key = d["doc_id"].cast("string")
    log = d.where("text IS NOT NULL").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("k"), F.col("text").alias("v"))
    return rejected(d, d["doc_id"], key, d["text"]).select("seq", "reason").union(runs.oversized(log, small).select("seq", "reason"))


@query("kv_physical_delete", f"""WITH {LOG}, asked AS (SELECT DISTINCT 'user:' || lpad(c_custkey::VARCHAR, 6, '0') AS k FROM customer WHERE c_custkey IS NOT NULL),
r AS (SELECT log.*, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS n FROM log), kept AS (SELECT * FROM r WHERE NOT (n = 1 AND k IN (SELECT k FROM asked)))
SELECT k, max(seq) AS seq, max_by(v, seq) AS v FROM kept GROUP BY k""")  # fmt: skip
def _(spark, sf):
    """The newest version of each key asked is unlinked, and the one below it is seen."""
    return reads.newest(runs.physically_deleted(events_log(spark, sf), customer_keys(spark, sf)))


JOBS = f"""{PLAN}, q AS (SELECT *, row_number() OVER (ORDER BY start_level, victim) AS rn, list_concat([victim], CASE WHEN inputs = '' THEN [] ELSE string_split(inputs, ',') END) AS files FROM jobs),
g AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS taken, false AS zero, false AS ok UNION ALL
  SELECT q.rn, CASE WHEN list_has_any(q.files, g.taken) OR (g.zero AND q.start_level = 0) THEN g.taken ELSE list_concat(g.taken, q.files) END,
    g.zero OR (q.start_level = 0 AND NOT list_has_any(q.files, g.taken)), NOT (list_has_any(q.files, g.taken) OR (g.zero AND q.start_level = 0)) FROM g JOIN q ON q.rn = g.rn + 1)"""


@query("compact_jobs", f"WITH RECURSIVE {LEVELS} {JOBS} SELECT row_number() OVER (ORDER BY q.rn) - 1 AS place, victim, start_level, end_level, inputs, trivial FROM q JOIN g ON g.rn = q.rn AND g.ok")
def _(spark, sf):
    """The jobs of a plan that can run together."""
    return compaction.jobs(_manifest(spark, sf), OPT)


@query("stream_upsert", ORACLES["kv_delete_live"])
def _(spark, sf):
    """The events arrive out of order, in several files; the state at the end is the batch result."""
    at = scratch(spark, "stream")
    events_log(spark, sf).repartition(4, F.xxhash64("seq")).write.parquet(f"{at}/in")
    upsert.append(upsert.stream_log(spark, f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return upsert.state(spark, f"{at}/out")


# value log

TIER = f"CASE WHEN strlen(text) < {OPT.inline_below} THEN 'inline' WHEN strlen(text) < {OPT.large_from} THEN 'medium' ELSE 'large' END"


def _documents(spark, sf):
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    return d.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("k"), F.col("text").alias("v"))


@query("vlog_tier", f"SELECT {TIER} AS tier, count(*) AS n, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1")
def _(spark, sf):
    return runs.tiers(_documents(spark, sf), OPT).groupBy("tier").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("bytes"))


@query("vlog_resolve", "SELECT doc_id AS seq, doc_id::VARCHAR AS k, text AS v FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def _(spark, sf):
    return runs.resolved(*runs.separated(_documents(spark, sf), OPT))


@query("store_separated", "SELECT doc_id + 1 AS seq, doc_id::VARCHAR AS k, text AS v FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def _(spark, sf):
    """A store whose values of 512 bytes or more are blobs, after two flushes and a compaction. Sequence numbers start at 1."""
    store = Store(spark, scratch(spark, "store"), replace(OPT, separate_from=OPT.inline_below))
    d = table(spark, sf, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL")
    log = as_log(d, d["doc_id"] + 1, d["doc_id"].cast("string"), d["text"])
    last = log.agg(F.max("seq")).first()[0] or 0
    for a, b in ((0, last // 2), (last // 2, last)):
        store.flush(log.where((F.col("seq") > a) & (F.col("seq") <= b)))
    store.compact()
    return store.scan()


# routing and caches

FNV = "list_reduce(list_concat([14695981039346656037::HUGEINT], list_transform(string_split(c_name, ''), lambda x: ord(x)::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query("shard_route", f"WITH h AS (SELECT c_name AS k, ({FNV} % 8)::BIGINT AS shard FROM customer WHERE c_name IS NOT NULL) SELECT k, shard, CASE WHEN shard = 3 THEN 4 ELSE shard END AS from_3 FROM h")
def _(spark, sf):
    c = table(spark, sf, "customer").where("c_name IS NOT NULL").select(F.col("c_name").alias("k"))
    return c.select("k", routed(F.col("k"), 8).alias("shard"), routed(F.col("k"), 8, 3).alias("from_3"))


DJB2 = f"list_reduce(list_concat([5381::HUGEINT], {_bytes('k', 'HUGEINT')}), lambda h, b: (h * 33 + b) % 18446744073709551616::HUGEINT)"


@query("cache_shard_route", f"""WITH RECURSIVE c AS (SELECT c_name AS k, {DJB2.replace('k,', 'c_name,')} AS h FROM customer WHERE c_name IS NOT NULL),
j AS (SELECT k, h, -1::BIGINT AS b, 0::BIGINT AS nxt FROM c UNION ALL
  SELECT k, h2, nxt, floor((nxt + 1) * (2147483648::DOUBLE / ((h2 // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT FROM (SELECT k, nxt, (h * 2862933555777941757::HUGEINT % 18446744073709551616::HUGEINT + 1) % 18446744073709551616::HUGEINT AS h2 FROM j WHERE nxt < 8))
SELECT k, max(b) AS bucket FROM j WHERE nxt >= 8 GROUP BY k""")  # fmt: skip
def _(spark, sf):
    c = table(spark, sf, "customer").where("c_name IS NOT NULL")
    return c.select(F.col("c_name").alias("k"), cache_shard(F.col("c_name"), 8).alias("bucket"))


FALSE = "list_transform({}, lambda x: false)"


@query("clock_cache_sim", f"""WITH RECURSIVE {LOG}, t AS MATERIALIZED (SELECT shard, substr(k, 6)::BIGINT // 10 AS page, row_number() OVER (PARTITION BY shard ORDER BY seq) AS rn FROM log),
c AS (SELECT shard, rn, [page] AS q, [true] AS u, 0::BIGINT AS hits FROM t WHERE rn = 1 UNION ALL
  SELECT shard, rn, CASE WHEN p > 0 THEN q WHEN len(q) < 8 THEN list_append(q, page) WHEN f > 0 THEN list_concat(list_concat(q[f + 1:], q[:f - 1]), [page]) ELSE list_append(q[2:], page) END,
    CASE WHEN p > 0 THEN list_concat(list_append(u[:p - 1], true), u[p + 1:]) WHEN len(q) < 8 THEN list_append(u, true) WHEN f > 0 THEN list_append(list_concat(u[f + 1:], {FALSE.format("u[:f - 1]")}), true) ELSE list_append({FALSE.format("u[2:]")}, true) END,
    hits + (p > 0)::BIGINT
  FROM (SELECT t.shard, t.rn, t.page, c.q, c.u, c.hits, coalesce(list_position(c.q, t.page), 0) AS p, coalesce(list_position(c.u, false), 0) AS f FROM c JOIN t ON t.shard = c.shard AND t.rn = c.rn + 1))
SELECT shard, max(rn) AS accesses, max(hits) AS hits FROM c GROUP BY shard""")  # fmt: skip
def _(spark, sf):
    """Block accesses of the events by shard: hits of a cache of 8 frames."""
    trace = events(spark, sf).withColumn("page", F.floor(F.substring("k", 6, 9).cast("long") / 10))
    return pruning.clock_cache(trace, ["shard"], ["seq"], "page", 8)
