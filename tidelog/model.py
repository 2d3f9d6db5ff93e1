"""The data model: a versioned write log of puts and deletes, and the options that cut it up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOMBSTONE = "-"

LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("k", T.StringType()), T.StructField("v", T.StringType()), T.StructField("op", T.StringType()), T.StructField("ts", T.TimestampType())])


@dataclass(frozen=True)
class Options:
    """Sizes in bytes. The defaults are small enough to show several runs, blocks and files."""

    memtable_bytes: int = 512 * 1024
    block_bytes: int = 4096
    file_bytes: int = 256 * 1024
    level0_bytes: int = 400 * 1024
    level0_files: int = 2
    wal_buffer_bytes: int = 4096
    wal_segment_bytes: int = 512 * 1024
    wal_segments: int = 3
    inline_below: int = 512
    large_from: int = 64 * 1024
    #: Values of so many bytes or more stay out of a store's sorted files; 0: none.
    separate_from: int = 0
    shards: int = 4
    levels: int = 7


#: For stores of many terabytes: files of 256 MB, so that a manifest has thousands of rows a terabyte.
LARGE = Options(memtable_bytes=512 << 20, block_bytes=64 << 10, file_bytes=256 << 20, level0_bytes=2 << 30, level0_files=4, wal_buffer_bytes=4 << 20, wal_segment_bytes=256 << 20)


class StoreError(Exception):
    """Base of all errors of the store."""


class RejectedRecord(StoreError):
    """A record that no run can hold."""


class ProtectedResource(StoreError):
    """A version is pinned and may not be vacuumed."""


def reason() -> Column:
    """Why a record (k, v) can't be put; null if it can."""
    return F.when(F.col("k").isNull(), "no key").when(F.col("k") == "", "empty key").when(F.col("v").isNull(), "no value")


def record_bytes(k: Column, v: Column) -> Column:
    """Encoded length: two bytes of length before the key and before the value."""
    return F.octet_length(k) + F.octet_length(v) + 4


def as_log(df: DataFrame, seq: Column, k: Column, v: Column, deleted: Column | None = None, ts: Column | None = None) -> DataFrame:
    """Projects typed rows into the log. A null key or value, or an empty key, can't be put: rejected() has
    those rows, with the reason. A deletion is marked by op and, for readers of values alone, by the
    tombstone value."""
    out = _projected(df, seq, k, v, deleted, ts).where(reason().isNull())
    return out.select("seq", "k", "v", F.when(F.col("v") == TOMBSTONE, "D").otherwise("P").alias("op"), "ts")


def rejected(df: DataFrame, seq: Column, k: Column, v: Column, deleted: Column | None = None, ts: Column | None = None) -> DataFrame:
    """(seq, k, v, reason) of the rows that as_log leaves out."""
    return _projected(df, seq, k, v, deleted, ts).withColumn("reason", reason()).where("reason IS NOT NULL").select("seq", "k", "v", "reason")


def checked(log: DataFrame) -> DataFrame:
    """log, which must have none of the rows that can't be put: the first one met raises an error."""
    told = F.concat(F.lit(f"{RejectedRecord.__name__}: "), reason(), F.lit(" at seq "), F.coalesce(F.col("seq").cast("string"), F.lit("?")))
    return log.withColumn("k", F.when(reason().isNull(), F.col("k")).otherwise(F.raise_error(told)))


def _projected(df: DataFrame, seq: Column, k: Column, v: Column, deleted: Column | None, ts: Column | None) -> DataFrame:
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    return df.select(seq.cast("long").alias("seq"), k.alias("k"), F.when(gone, TOMBSTONE).otherwise(v).alias("v"), (ts if ts is not None else F.lit(None).cast("timestamp")).alias("ts"))
