"""A write-ahead log of segments. Each buffer that is flushed is one row: its records as bytes and their
checksum. Appends are Parquet files in a folder per append, so a failed one leaves nothing half read;
metadata says how far the log goes and whether it was closed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import codec
from .model import TOMBSTONE, Options, StoreError
from .operators import runs
from .paths import Paths

ROWS = "shard long, append long, segment_no long, segment long, flush_id long, first_seq long, last_seq long, n long, payload binary, checksum long"


class Wal:
    """Log rows need `shard`; order within a shard is that of seq, and appends come in order."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self.files = Paths(spark, self.path)
        self.open()

    def open(self) -> None:
        """Reads the metadata; where it is missing or not valid, it is made anew from the segments."""
        try:
            self.meta = json.loads(self.files.read(f"{self.path}/metadata.json"))
            self.clean = bool(self.meta.pop("closed"))
            if sorted(self.meta) != ["appends", "total_len"] or min(self.meta.values()) < 0:
                raise ValueError(self.meta)
        except (FileNotFoundError, ValueError, KeyError):
            held = self.rows()
            got = held.agg(F.max("append"), F.sum(F.octet_length("payload"))).first() if held is not None else (None, None)
            self.meta, self.clean = {"appends": -1 if got[0] is None else got[0], "total_len": got[1] or 0}, False
            self.meta["appends"] += 1
        self._write_meta(False)

    def _write_meta(self, closed: bool) -> None:
        self.files.write(f"{self.path}/metadata.json", json.dumps(self.meta | {"closed": closed}))

    def close(self) -> None:
        self._write_meta(True)

    def append(self, log: DataFrame) -> None:
        cut = runs.wal(log, self.options)
        cut = cut.withColumn("record", codec.record(F.col("k"), F.col("v"), F.col("seq").cast("string")))
        cell = ["shard", "segment_no", "segment", "flush_id"]
        rows = cut.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("seq", "record"))).alias("r"))  # a buffer's records
        rows = rows.select(*cell, F.lit(self.meta["appends"]).cast("long").alias("append"), F.element_at("r", 1)["seq"].alias("first_seq"), F.element_at("r", -1)["seq"].alias("last_seq"), F.size("r").cast("long").alias("n"), codec.block(F.transform("r", lambda x: x["record"])).alias("payload"))
        rows = rows.withColumn("checksum", F.crc32("payload"))
        at = f"{self.path}/segments/append={self.meta['appends']}"
        rows.drop("append").write.mode("overwrite").parquet(at)
        wrote = self.spark.read.parquet(at).agg(F.sum(F.octet_length("payload"))).first()[0] or 0
        self.meta = {"appends": self.meta["appends"] + 1, "total_len": self.meta["total_len"] + wrote}
        self._write_meta(False)

    def rows(self) -> DataFrame | None:
        at = f"{self.path}/segments"
        return self.spark.read.schema(ROWS).option("basePath", at).parquet(at) if self.files.exists(at) else None

    def whole(self) -> DataFrame:
        """The buffers before the first one of each shard whose bytes aren't those that were written.
        The ends come first, a row a shard; payloads stay where they are read."""
        held = self.rows()
        if held is None:
            return self.spark.createDataFrame([], ROWS)
        at = F.struct("append", "segment_no", "flush_id")
        torn = held.where((F.crc32("payload") != F.col("checksum")) | F.col("payload").isNull())
        ends = F.broadcast(torn.groupBy(F.col("shard").alias("__shard")).agg(F.min(at).alias("__end")))  # a row a shard
        met = held.join(ends, held["shard"].eqNullSafe(ends["__shard"]), "left")
        return met.where(F.col("__end").isNull() | (at < F.col("__end"))).drop("__shard", "__end")

    def replay(self) -> DataFrame:
        """The log as it was written, up to a torn end: (seq, k, v, op, ts), and shard."""
        got = codec.decoded(self.whole().select("shard", "payload"), "payload", ["k", "v", "s"])
        return got.select(F.col("s").cast("long").alias("seq"), "k", "v", F.when(F.col("v") == TOMBSTONE, "D").otherwise("P").alias("op"), F.lit(None).cast("timestamp").alias("ts"), "shard")

    def truncate(self, seq: int) -> int:
        """Drops appends whose records are all in a store up to seq; returns how many."""
        held = self.rows()
        if held is None:
            return 0
        done = [r["append"] for r in held.groupBy("append").agg(F.max("last_seq").alias("last")).where(F.col("last") <= seq).collect()]  # one row an append
        for k in done:
            self.files.delete(f"{self.path}/segments/append={k}")
        if done and len(done) > self.meta["appends"]:
            raise StoreError("more appends than the metadata has")
        return len(done)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one of spark.checkpoint.dir; elsewhere only where all tasks run here."""
    import re
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise StoreError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.gettempdir()
    return f"{base}/{name}-{uuid.uuid4().hex}"
