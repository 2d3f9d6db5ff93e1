"""A copy-on-write store: Parquet runs, the block index and filter of each, and a manifest per version.

A commit writes new files, then publishes manifest/v<N>.json by an atomic rename; readers resolve a
version once. All paths go through Hadoop's file systems, so any store that Spark reads will do. One
writer at a time, as for one shard; ShardedStore has several, each with its own keys.

Values of Options.separate_from bytes or more are written once, by the flush that brings them, to a
folder of blobs in key order; the runs have pointers to them, which is all that compaction moves. A
folder of blobs goes when no version that is kept points into it.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from .functions.hashing import fnv1a_64
from .model import LARGE, LOG, TOMBSTONE, Options, ProtectedResource, StoreError, checked
from .operators import compaction, pruning, reads, runs
from .paths import Paths

#: Up to this size files that compaction writes have the small fixed filter.
SMALL_FILE = 1 << 20
#: Files that a task of a flush or compaction writes at most, about.
FILES_A_TASK = 16
#: Starts a pointer, "<POINTER><folder>:<seq>:<length>"; a value that starts so itself is always separated.
POINTER = "\x01>"
ROW = "file_id string, level int, mn string, mx string, n long, bytes long, newest long"


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or LARGE
        self.files, self.closed = Paths(spark, self.path), False
        self.pins: dict[int, int] = {}

    # manifest versions

    def versions(self) -> list[int]:
        return sorted(int(x[1:-5]) for x in self.files.names(f"{self.path}/manifest") if x.startswith("v") and x.endswith(".json"))

    def load(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if not version and not known:
            return {"version": 0, "seq": 0, "files": []}
        if version not in known:
            raise StoreError(f"no version {version}")
        return json.loads(self.files.read(f"{self.path}/manifest/v{version}.json"))

    def publish(self, files: list[dict], seq: int, base: int) -> int:
        body = json.dumps({"version": base + 1, "seq": seq, "files": files})
        if self.closed:
            raise StoreError("the store is closed")
        if not self.files.publish(f"{self.path}/manifest/v{base + 1}.json", body):
            raise StoreError(f"version {base + 1} was published by another writer")
        return base + 1

    def close(self) -> None:
        """No more commits by this one; all that it committed is there already."""
        self.closed = True

    # writes

    def _sorted(self, rows: DataFrame, folder: str, n: int, records: int, by: tuple[str, ...] = (), filtered: bool = True) -> None:
        """rows (records at most) as about n sorted files with disjoint ranges in a new folder. A task writes up to
        FILES_A_TASK of them one after the other, so that tasks and blocks of the exchange grow slower than files."""
        tasks = -(-n // FILES_A_TASK)
        cut = rows.repartitionByRange(tasks, "k").sortWithinPartitions(*by, "k")
        # the folder is unknown to readers before a manifest has it, so tasks may commit into it by themselves
        out = cut.write.partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").option("compression", "zstd")
        each = max(1, -(-records // n))
        if filtered:  # sized for a file's keys; without their number it takes 1 MB
            out = out.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.expected.ndv#k", each)
        out.option("maxRecordsPerFile", each if n > 1 else 0).parquet(folder)

    def _write(self, rows: DataFrame, level: int, n: int, records: int, by: tuple[str, ...] = ()) -> list[dict]:
        """Sorted files with disjoint ranges in a new folder, none with rows of two values of `by`; one
        manifest row each, read back from the files: once, without the values, for index, filter and manifest."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        self._sorted(rows.select("k", "seq", "v", "ts", *by), folder, n, records, by)
        back = runs.with_size(self.spark.read.schema("k string, seq long, v string, ts timestamp").parquet(folder))
        blob = F.when(F.startswith(F.col("v"), F.lit(POINTER)), F.split_part("v", F.lit(":"), F.lit(1)).substr(len(POINTER) + 1, 32))
        back = back.select(F.input_file_name().alias("file_id"), "k", "seq", "z", blob.alias("blob")).persist(StorageLevel.DISK_ONLY)
        try:
            self._write_index(back.select("file_id", "k", "z"), folder, level)
            meta = back.groupBy("file_id").agg(F.min("k").alias("mn"), F.max("k").alias("mx"), F.count("*").alias("n"), F.sum("z").alias("bytes"), F.max("seq").alias("newest"), F.array_sort(F.collect_set("blob")).alias("blobs"))
            return [r.asDict() | {"level": level} for r in meta.collect()]  # one row a file
        finally:
            back.unpersist()

    def _write_index(self, rows: DataFrame, folder: str, level: int) -> None:
        """Beside a folder of files, for each its block index and its filter, which reads look at first."""
        blocks = runs.with_blocks(rows, ["file_id"], self.options)
        runs.block_index(blocks, ["file_id"]).write.parquet(f"{folder}-index")
        filters = pruning.compacted_blooms if level and self.options.file_bytes <= SMALL_FILE else pruning.run_blooms
        filters(rows, ["file_id"]).write.parquet(f"{folder}-filter")

    def _is_large(self) -> Column:
        large = F.startswith(F.col("v"), F.lit(POINTER))
        if self.options.separate_from:
            large |= F.octet_length("v") >= self.options.separate_from
        return large & (F.col("v") != TOMBSTONE)

    def _separated(self, rows: DataFrame, n: int, records: int) -> DataFrame:
        """rows with pointers for their large values, which go to n files of a new folder of blobs."""
        name = uuid.uuid4().hex
        self._sorted(rows.where(self._is_large()).select("k", "seq", "v"), f"{self.path}/blobs/{name}", n, records, filtered=False)
        pointer = F.concat_ws(":", F.lit(POINTER + name), F.col("seq").cast("string"), F.octet_length("v").cast("string"))
        return rows.withColumn("v", F.when(self._is_large(), pointer).otherwise(F.col("v")))

    def flush(self, log: DataFrame) -> int:
        """Commits a batch of writes as one level-0 run: the newest version of each key, deletions kept. A
        batch whose writes are all in the store already changes nothing, so a retried batch is safe. A record
        without key or value fails the batch before anything of it is seen."""
        now = self.load()
        log = checked(log.select(*LOG.fieldNames())).where(F.col("seq") > now["seq"])
        large = F.when(self._is_large(), F.octet_length("v"))
        last = log.agg(F.max("seq"), F.sum(F.octet_length("k") + F.octet_length("v")), F.sum(large), F.count("*"), F.count(large)).first()
        if last[0] is None:
            return now["version"]
        best = log.groupBy("k").agg(F.max(F.struct("seq", "v", "ts")).alias("n")).select("k", "n.*")
        if last[2]:
            best = self._separated(best, -(-last[2] // self.options.file_bytes), last[4])
        files = self._write(best, 0, max(1, -(-(last[1] - (last[2] or 0)) // self.options.memtable_bytes)), last[3])
        return self.publish(now["files"] + files, last[0], now["version"])

    def compact(self) -> int:
        """Moves due levels down until none is due; each round is one version. Only files of the next level
        that a due file overlaps are merged with it. A file below level 0 that overlaps none is moved in
        the manifest; files that no due file touches stay as they are."""
        while True:
            now = self.load()
            manifest = self.manifest(now)
            due = [r["level"] for r in compaction.triggers(manifest, self.options).where("due").collect() if r["level"] < self.options.levels - 1]
            if not due:
                return now["version"]
            level = min(due)
            rest = [f for f in now["files"] if f["level"] not in (level, level + 1)]
            deeper = any(f["level"] > level + 1 for f in rest)
            inputs, groups = [], []
            for number, files in enumerate(compaction.touching([f for f in now["files"] if f["level"] in (level, level + 1)])):
                if all(f["level"] > level for f in files) or (level and len(files) == 1):
                    rest += [f | {"level": level + 1} for f in files]
                else:
                    inputs += files
                    groups += [(f["file_id"], number) for f in files]
            written = []
            if inputs:
                of = self.spark.createDataFrame(groups, "file string, part int")
                rows = self._read(inputs).withColumn("file", F.input_file_name()).join(of, "file")
                out = rows.groupBy("k").agg(F.max(F.struct("seq", "v", "ts")).alias("n"), F.min("part").alias("part")).select("k", "n.*", "part")
                out = out if deeper else out.where(F.col("v") != TOMBSTONE)
                n = max(1, -(-sum(f["bytes"] for f in inputs) // self.options.file_bytes))
                written = self._write(out, level + 1, n, sum(f["n"] for f in inputs), ("part",))
            self.publish(rest + written, now["seq"], now["version"])

    # reads

    def manifest(self, at: dict | None = None) -> DataFrame:
        files = (at or self.load())["files"]
        return self.spark.createDataFrame([[f[c] for c in ("file_id", "level", "mn", "mx", "n", "bytes", "newest")] for f in files], ROW)

    def _read(self, files: list[dict]) -> DataFrame:
        schema = "k string, seq long, v string, ts timestamp"
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f["file_id"] for f in files])

    def _between(self, version: int | None, start: str | None, end: str | None) -> list[dict]:
        """The files that can hold a key in [start, end]."""
        return [f for f in self.load(version)["files"] if (end is None or f["mn"] <= end) and (start is None or f["mx"] >= start)]

    def _values(self, found: DataFrame, files: list[dict], start: str | None = None, end: str | None = None, keys: DataFrame | None = None) -> DataFrame:
        """found, read from the files, with the values that pointers stand for. Of the blobs that the files
        point into only those in [start, end] or of the keys are joined."""
        folders = sorted({x for f in files for x in f.get("blobs", ())})
        if not folders:
            return found
        blobs = self.spark.read.schema("k string, seq long, v string").parquet(*[f"{self.path}/blobs/{x}" for x in folders])
        if start is not None:
            blobs = blobs.where(F.col("k") >= start)
        if end is not None:
            blobs = blobs.where(F.col("k") <= end)
        if keys is not None:
            blobs = blobs.join(keys.select("k"), "k", "left_semi")
        blobs = blobs.select(F.col("k").alias("__k"), F.col("seq").alias("__seq"), F.col("v").alias("__v"))
        at = F.when(F.startswith(F.col("v"), F.lit(POINTER)), F.split_part("v", F.lit(":"), F.lit(2)).try_cast("long"))
        rows = found.withColumn("__at", at)
        rows = rows.join(blobs, (rows["k"] == blobs["__k"]) & (rows["__at"] == blobs["__seq"]), "left")
        lost = F.raise_error(F.concat(F.lit("no blob of the key "), F.col("k"))).cast("string")
        return rows.withColumn("v", F.when(F.col("__at").isNull(), F.col("v")).otherwise(F.coalesce("__v", lost))).select(*found.columns)

    def _beside(self, files: list[dict], what: str, schema: str) -> DataFrame:
        """What is stored beside the files, of these alone."""
        folders = sorted({self._folder(f) for f in files})
        held = self.spark.read.schema(schema).parquet(*[f"{x}-{what}" for x in folders])
        return held.join(self.spark.createDataFrame([(f["file_id"], f["level"]) for f in files], "file_id string, level int"), "file_id")

    def _folder(self, file: dict) -> str:
        """The folder that a file was written in, below which partitions may be."""
        root = f"/{self.path.rsplit('/', 1)[-1]}/data/"
        at = file["file_id"].index(root) + len(root)
        return f"{self.path}/data/{file['file_id'][at:].split('/', 1)[0]}"

    def may_hold(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(k, file_id) of the files that may have a key, by their ranges and then their filters."""
        files = self.load(version)["files"]
        if not files:
            return keys.select("k").where("false").withColumn("file_id", F.lit(""))
        met = runs.find_files(self.manifest({"files": files}), keys.select("k").distinct()).select("k", "file_id", "level")
        blooms = self._beside(files, "filter", "file_id string, bits long, word long, map binary")
        small = self.options.file_bytes <= SMALL_FILE
        parts = [("level = 0", pruning.HASHES), ("level > 0", pruning.COMPACTED_HASHES)] if small else [("true", pruning.HASHES)]
        found = [pruning.may_contain(blooms.where(of).drop("level"), met.where(of), ["file_id"], n) for of, n in parts]
        return reduce(DataFrame.union, found).where("maybe").select("k", "file_id")

    def locate(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(file_id, k, block_id): the block of each file that may have the key, by the stored index."""
        files = self.load(version)["files"]
        index = self._beside(files, "index", "file_id string, block_id long, min_key string, num_keys long, len long").drop("level")
        return runs.find_block(index, self.may_hold(keys, version), ["file_id"])

    def get(self, key: str, version: int | None = None) -> DataFrame:
        files = self._between(version, key, key)
        return self._values(reads.get(self._read(files), key), files, key, key)

    def read_length(self, key: str, version: int | None = None) -> DataFrame:
        """get, with the value's length in bytes."""
        return self.get(key, version).withColumn("length", F.octet_length("v"))

    def multi_get(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """Reads only files whose filter lets one of the keys pass; Parquet's own filters prune within them."""
        files = self.load(version)["files"]
        due = {r["file_id"] for r in self.may_hold(keys, version).select("file_id").distinct().collect()}  # files, not rows
        files = [f for f in files if f["file_id"] in due]
        return self._values(reads.multi_get(self._read(files), keys), files, keys=keys)

    def scan(self, start: str | None = None, end: str | None = None, version: int | None = None) -> DataFrame:
        files = self._between(version, start, end)
        return self._values(reads.scan(self._read(files), start, end), files, start, end).orderBy("k")

    def seek(self, prefix: str, version: int | None = None) -> DataFrame:
        return self.scan(prefix, reads.after_prefix(prefix), version)

    # lifecycle

    def pin(self, version: int) -> int:
        self.load(version)
        self.pins[version] = self.pins.get(version, 0) + 1
        return version

    def unpin(self, version: int) -> None:
        self.pins[version] = max(0, self.pins.get(version, 0) - 1)

    def vacuum(self, keep: int) -> int:
        """Drops versions below keep and the files that only they use; returns how many files went."""
        known = self.versions()
        if held := [v for v in known if v < keep and self.pins.get(v)]:
            raise ProtectedResource(f"versions {held} are pinned")
        used = {f["file_id"] for v in known if v >= keep for f in self.load(v)["files"]}
        old = {f["file_id"] for v in known if v < keep for f in self.load(v)["files"]}
        for f in old - used:
            self.files.delete(f)
        live = {self._folder({"file_id": f}) for f in used}
        for folder in {self._folder({"file_id": f}) for f in old - used} - live:
            for what in ("index", "filter"):
                self.files.delete(f"{folder}-{what}")
        pointed = lambda versions: {x for v in versions for f in self.load(v)["files"] for x in f.get("blobs", ())}
        for x in pointed(v for v in known if v < keep) - pointed(v for v in known if v >= keep):
            self.files.delete(f"{self.path}/blobs/{x}")
        for v in known:
            if v < keep:
                self.files.delete(f"{self.path}/manifest/v{v}.json")
        return len(old - used)


class ShardedStore:
    """n stores below one path; a key is in the one that its FNV-1a says."""

    def __init__(self, spark: SparkSession, path: str, n: int, options: Options | None = None):
        self.n, self.shards = n, [Store(spark, f"{path.rstrip('/')}/shard{i}", options) for i in range(n)]

    def of(self, key: str) -> Store:
        return self.shards[int(fnv1a_64([key.encode()])[0] % self.n)]

    def flush(self, log: DataFrame) -> list[int]:
        dealt = runs.sharded(log, self.n)
        return [s.flush(dealt.where(F.col("shard") == i).select(*LOG.fieldNames())) for i, s in enumerate(self.shards)]

    def compact(self) -> list[int]:
        return [s.compact() for s in self.shards]

    def get(self, key: str) -> DataFrame:
        return self.of(key).get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        dealt = runs.sharded(keys.select("k").distinct(), self.n)
        return reduce(DataFrame.union, [s.multi_get(dealt.where(F.col("shard") == i).select("k")) for i, s in enumerate(self.shards)])

    def scan(self, start: str | None = None, end: str | None = None) -> DataFrame:
        return reduce(DataFrame.union, [s.scan(start, end) for s in self.shards]).orderBy("k")

    def close(self) -> None:
        for s in self.shards:
            s.close()
