"""Bloom filters per run, and a simulation of the clock page cache."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a_64, murmur3_32
from .runs import rows_of

#: Bits a key and hashes of a filter at flush, hashes and 64-bit words of one at compaction, the
#: first seed; bits and probes of a bucket of the blocked kind.
BITS_PER_KEY, HASHES, SEED = 10, 2, 51
COMPACTED_HASHES, COMPACTED_WORDS = 10, 2000
BUCKET_BITS, PROBES = 512, 8
#: Bits that a row of a filter holds.
WORD = 32768


def hashes(key: Column, n: int = HASHES) -> Column:
    """MurmurHash3 of the key under n seeds from SEED on."""

    @F.pandas_udf("array<long>")
    def run(keys: pd.Series) -> pd.Series:
        held = [k.encode() for k in keys]
        grid = np.stack([murmur3_32(held, SEED + i).astype(np.int64) for i in range(n)], axis=1) if held else np.empty((0, n), np.int64)
        return pd.Series(list(grid))

    return run(key)


def bits_for(n: Column) -> Column:
    """Bits of a filter of n keys, whole 64-bit words."""
    return F.ceil(n * BITS_PER_KEY / 64).cast("long") * 64


def _places(df: DataFrame, n: int) -> DataFrame:
    """df (k, bits) with a row for each bit of the key: word and bit in the word."""
    at = df.withColumn("h", hashes(F.col("k"), n)).withColumn("at", F.explode(F.transform("h", lambda h: F.pmod(h, F.col("bits")))))
    return at.withColumns({"word": F.floor(F.col("at") / WORD), "bit": F.col("at") % WORD}).drop("h", "at")


def run_blooms(files: DataFrame, by: list[str], n: int = HASHES) -> DataFrame:
    """Per run a bitmap, in words of 4 KB: (by, bits, word, map). Empty keys are in no filter."""
    sizes = files.groupBy(*by).agg(bits_for(F.count("*")).alias("bits"))
    hits = _places(files.where("k <> ''").select(*by, "k").join(sizes, by), n)
    return hits.groupBy(*by, "bits", "word").agg(F.bitmap_construct_agg("bit").alias("map"))


def compacted_blooms(files: DataFrame, by: list[str]) -> DataFrame:
    """The same of files that compaction writes: a fixed size, more hashes."""
    hits = _places(files.where("k <> ''").select(*by, "k").withColumn("bits", F.lit(64 * COMPACTED_WORDS).cast("long")), COMPACTED_HASHES)
    return hits.groupBy(*by, "bits", "word").agg(F.bitmap_construct_agg("bit").alias("map"))


def is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(bitmap.isNull(), 0).otherwise(F.getbit(byte, (bit % 8).cast("int")))


def may_contain(blooms: DataFrame, asked: DataFrame, by: list[str], n: int = HASHES) -> DataFrame:
    """asked (by, k) and `maybe`: false means that the run surely lacks the key. An empty key is in no run."""
    sizes = blooms.select(*by, "bits").distinct()
    places = _places(asked.where("k <> ''").select(*by, "k").join(sizes, by), n)
    met = places.join(blooms.drop("bits"), [*by, "word"], "left")
    return met.groupBy(*by, "k").agg((F.min(is_set(F.col("map"), F.col("bit"))) == 1).alias("maybe"))


def blocked_places(key: Column, buckets: Column) -> Column:
    """(bucket, probes) of a blocked filter: one bucket of BUCKET_BITS a key, so that a look-up reads one cache
    line, and PROBES bits in it from further bits of the key's FNV-1a."""

    @F.pandas_udf("struct<bucket:long,probes:array<long>>")
    def run(keys: pd.Series, n: pd.Series) -> pd.DataFrame:
        h = fnv1a_64([k.encode() for k in keys])
        probes = np.stack([(h >> np.uint64(7 * i)).astype(np.uint64) % np.uint64(BUCKET_BITS) for i in range(PROBES)], axis=1).astype(np.int64)
        return pd.DataFrame({"bucket": (h % n.to_numpy(np.uint64)).astype(np.int64), "probes": list(probes)})

    return run(key, buckets)


def blocked_blooms(files: DataFrame, by: list[str], bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """(by, buckets, bucket, map): a bitmap a bucket that has a key."""
    sizes = files.groupBy(*by).agg(F.ceil(F.count("*") * bits_per_key / BUCKET_BITS).alias("buckets"))
    at = files.where("k <> ''").select(*by, "k").join(sizes, by).withColumn("p", blocked_places(F.col("k"), F.col("buckets")))
    hits = at.select(*by, "buckets", F.col("p.bucket").alias("bucket"), F.explode("p.probes").alias("bit"))
    return hits.groupBy(*by, "buckets", "bucket").agg(F.bitmap_construct_agg("bit").alias("map"))


def blocked_may_contain(blooms: DataFrame, asked: DataFrame, by: list[str]) -> DataFrame:
    """asked (by, k) and `maybe`, from one bucket a key."""
    sizes = blooms.select(*by, "buckets").distinct()
    at = asked.where("k <> ''").select(*by, "k").join(sizes, by).withColumn("p", blocked_places(F.col("k"), F.col("buckets")))
    met = at.withColumn("bucket", F.col("p.bucket")).join(blooms.drop("buckets"), [*by, "bucket"], "left")
    return met.select(*by, "k", F.forall("p.probes", lambda b: is_set(F.col("map"), b) == 1).alias("maybe"))


def classic_filters(files: DataFrame, by: list[str]) -> DataFrame:
    """(by, size, at, part): of each run the bits of its filter, and pieces of that from byte `at` on."""
    left = F.least(F.lit(WORD).cast("long"), F.col("bits") - F.col("word") * WORD)
    return run_blooms(files, by).select(*by, F.col("bits").alias("size"), (F.col("word") * (WORD // 8)).alias("at"), F.substring("map", F.lit(1), F.ceil(left / 8).cast("int")).alias("part"))


def blocked_filters(files: DataFrame, by: list[str]) -> DataFrame:
    """The same of blocked filters; size is their buckets."""
    return blocked_blooms(files, by).select(*by, F.col("buckets").alias("size"), (F.col("bucket") * (BUCKET_BITS // 8)).alias("at"), F.substring("map", 1, BUCKET_BITS // 8).alias("part"))


def classic_bits(keys: list[bytes]):
    """Of the i-th key and runs of so many bits, the places to look at (a row a hash)."""
    h = np.stack([murmur3_32(keys, SEED + i).astype(np.int64) for i in range(HASHES)])
    return lambda i, size: h[:, i : i + 1] % size


def blocked_bits(keys: list[bytes]):
    h = fnv1a_64(keys)
    probes = np.stack([(h >> np.uint64(7 * i)) % np.uint64(BUCKET_BITS) for i in range(PROBES)]).astype(np.int64)
    return lambda i, size: (h[i] % size.astype(np.uint64)).astype(np.int64) * BUCKET_BITS + probes[:, i : i + 1]


#: A cell of probes: so many runs and about so many keys; rows that it sends at a time.
RUNS_A_CELL, KEYS_A_CELL, ROWS_A_BATCH = 4096, 50_000, 200_000


def probed(files: DataFrame, asked: DataFrame, by: list[str], blocked: bool = False) -> DataFrame:
    """(by, k, maybe, has) for each key asked and run (of files: by, k) whose range holds it: whether the run's
    filter lets it pass and whether the run has it. Runs and keys meet in cells of a grid, in which a key is tried
    on all runs at once; what crosses an exchange are filters and keys, once for each cell, and no pair. A cell
    holds its filters and one key's runs."""
    spark, filters, bits = files.sparkSession, *((blocked_filters, blocked_bits) if blocked else (classic_filters, classic_bits))
    unit, kinds = BUCKET_BITS if blocked else 1, dict(files.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", k string, maybe boolean, has boolean"
    asked, files = asked.select("k").where("k <> ''").distinct(), files.select(*by, "k").where("k <> ''")
    met = rows_of(files.groupBy(*by).agg(F.min("k").alias("mn"), F.max("k").alias("mx")))
    if not met.num_rows:
        return spark.createDataFrame([], schema)
    met = met.take(pa.array(sorted(range(met.num_rows), key=met["mn"].to_pylist().__getitem__)))
    met = met.append_column("run", pa.array(np.arange(met.num_rows)))
    down, across = -(-met.num_rows // RUNS_A_CELL), 1 + asked.count() // KEYS_A_CELL
    numbered = F.broadcast(spark.createDataFrame(met))
    row = F.floor(F.col("run") / RUNS_A_CELL)
    pieces = filters(files, by).groupBy(*by, "size").agg(F.collect_list(F.struct("at", "part")).alias("parts"))  # a run's
    none = lambda kind: F.lit(None).cast(kind)
    run_rows = pieces.join(numbered, by).select(row.alias("row"), "run", *by, "mn", "mx", "size", "parts", none("string").alias("k"), none("array<bigint>").alias("own"))
    run_rows = run_rows.withColumn("cell", F.explode(F.sequence(F.col("row") * across, F.col("row") * across + across - 1)))
    own = files.join(asked, "k", "left_semi").join(numbered.select(*by, "run"), by).groupBy("k", row.alias("row")).agg(F.collect_list("run").alias("own"))  # at most RUNS_A_CELL
    key_rows = asked.withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long")))).join(own, ["k", "row"], "left")
    key_rows = key_rows.withColumn("cell", F.pmod(F.xxhash64("k"), F.lit(across)) + F.col("row") * across)
    held = run_rows.unionByName(key_rows, allowMissingColumns=True).drop("row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, grid, waiting = [], None, []

        def out() -> pa.RecordBatch:
            keys, at, maybe, has = zip(*waiting)
            runs_at = pa.array(np.concatenate(at))
            k = pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in at])))
            waiting.clear()
            return pa.RecordBatch.from_arrays([*(grid.by[c].take(runs_at) for c in by), k, pa.array(np.concatenate(maybe)), pa.array(np.concatenate(has))], names=[*by, "k", "maybe", "has"])

        size = 0
        for b in batches:
            of_runs = b.column("k").null_count
            if of_runs:
                runs += b.slice(0, of_runs).to_pylist()
            b = b.slice(of_runs)
            if not b.num_rows or not runs and grid is None:
                continue
            if grid is None:
                grid, runs = Grid(runs, by, b.schema, unit), []
            keys = b.column("k").to_pylist()
            places = bits([k.encode() for k in keys])
            for i, (k, lists) in enumerate(zip(keys, b.column("own"))):
                at = grid.holding(k)
                if len(at):
                    maybe, has = grid.passing(places(i, grid.size[at]), at), grid.has(at, lists.values)
                    waiting.append((k, at, maybe, has))
                    size += len(at)
                if size >= ROWS_A_BATCH:
                    yield out()
                    size = 0
        if waiting:
            yield out()

    dealt = held.repartitionById(down * across, F.col("cell").cast("int")).sortWithinPartitions(F.col("k").isNotNull(), "run")
    return dealt.drop("cell").mapInArrow(run, schema)


class Grid:
    """The runs of a cell, in the order of mn: their ranges, their filters laid end to end, their columns. A
    filter has size times unit bits."""

    def __init__(self, runs: list[dict], by: list[str], schema: pa.Schema, unit: int):
        mx = np.array([r["mx"] for r in runs], dtype=object)
        self.mn, self.ends = np.array([r["mn"] for r in runs], dtype=object), np.sort(mx)
        self.mx = np.searchsorted(self.ends, mx, side="left")
        self.number = np.array([r["run"] for r in runs], np.int64)
        self.size = np.array([r["size"] for r in runs], np.int64)
        self.by = {c: pa.array([r[c] for r in runs], schema.field(c).type) for c in by}
        reach = [-(-r["size"] * unit // 8) for r in runs]
        self.start = np.concatenate([[0], np.cumsum(reach)[:-1]]).astype(np.int64)
        self.bytes = np.zeros(sum(reach), np.uint8)
        for at, r in zip(self.start.tolist(), runs):
            for x in r["parts"]:
                self.bytes[at + x["at"] : at + x["at"] + len(x["part"])] = np.frombuffer(x["part"], np.uint8)

    def holding(self, k: str) -> np.ndarray:
        """The runs with mn <= k <= mx."""
        first = np.searchsorted(self.mn, k, side="right")
        return np.flatnonzero(self.mx[:first] >= np.searchsorted(self.ends, k, side="left"))

    def passing(self, places: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((self.bytes[self.start[at] + (places >> 3)] >> (places & 7).astype(np.uint8)) & 1).all(axis=0)

    def has(self, at: np.ndarray, own: pa.Array | None) -> np.ndarray:
        return np.isin(self.number[at], own.to_numpy(zero_copy_only=False)) if own is not None else np.zeros(len(at), bool)


def clock_cache(trace: DataFrame, group: list[str], order: list[str], page: str, frames: int) -> DataFrame:
    """(group, accesses, hits): second-chance eviction over each group's trace, in order. State is `frames`
    pages, whatever the trace's length."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trace.schema.fields if f.name in group)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pages, used, hand, where, seen, hits = None, [], [], 0, {}, 0, 0

        def out() -> pd.DataFrame:
            return pd.DataFrame([[*last, seen, hits]], columns=[*group, "accesses", "hits"])

        for rows in batches:
            for key, p in zip(map(tuple, rows[group].itertuples(index=False)), rows[page]):
                if key != last:
                    if last is not None:
                        yield out()
                    last, pages, used, hand, where, seen, hits = key, [], [], 0, {}, 0, 0
                seen += 1
                if p in where:
                    hits += 1
                    used[where[p]] = True
                elif len(pages) < frames:
                    where[p] = len(pages)
                    pages.append(p)
                    used.append(True)
                else:
                    while used[hand]:
                        used[hand] = False
                        hand = (hand + 1) % frames
                    del where[pages[hand]]
                    pages[hand], used[hand], where[p] = p, True, hand
                    hand = (hand + 1) % frames
        if last is not None:
            yield out()

    dealt = trace.select(*group, *order, page).repartition(*group).sortWithinPartitions(*group, *order)
    return dealt.mapInPandas(run, f"{fields}, accesses long, hits long")
