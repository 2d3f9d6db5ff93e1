"""Reads over a write log: newest version wins, deletions are hidden after that, never before.

A read resolves with max(struct(seq, v)): one partial aggregate before the shuffle, so a key with any
number of versions sends one row per task. Filters on keys go below it, filters on values may not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fences import slots
from ..model import TOMBSTONE


def newest(log: DataFrame) -> DataFrame:
    """(k, seq, v): the newest version of each key, deletions too."""
    return log.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("n")).select("k", "n.seq", "n.v")


def live(log: DataFrame) -> DataFrame:
    return newest(log).where(F.col("v") != TOMBSTONE)


def get(log: DataFrame, key: str) -> DataFrame:
    return live(log.where(F.col("k") == key))


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, v, found) for every key asked. Only versions of asked keys are resolved; the choice between
    broadcasting the key list and shuffling is Spark's, by its size."""
    asked = keys.select("k").distinct()
    hit = live(log.join(asked, "k", "left_semi"))
    return asked.join(hit, "k", "left").select("k", "v", F.col("v").isNotNull().alias("found"))


def scan(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Live versions with start <= k < end, in key order."""
    if start is not None:
        log = log.where(F.col("k") >= start)
    if end is not None:
        log = log.where(F.col("k") < end)
    return live(log).orderBy("k")


def after_prefix(prefix: str) -> str | None:
    """The least key above all keys with the prefix; None if there is none."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            return prefix[:i] + chr(0xE000 if c + 1 == 0xD800 else c + 1)
    return None


def scan_prefix(log: DataFrame, prefix: str, as_range: bool = False) -> DataFrame:
    """Live versions whose key has the prefix. As a range it prunes files by their least and greatest key."""
    if as_range:
        return scan(log, prefix, after_prefix(prefix))
    return live(log.where(F.startswith(F.col("k"), F.lit(prefix)))).orderBy("k")


def seek(log: DataFrame, key: str, n: int) -> DataFrame:
    """The first n live versions from a key on (a top-k per task, then one merge)."""
    first = live(log.where(F.col("k") >= key)).orderBy("k").limit(n)
    return first.withColumn("pos", F.row_number().over(Window.orderBy("k")))


#: Keys that are read for each slot of an ordered scan, to place its fences.
PER_SLOT = 32


def ordered(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows (of unique keys) with `pos`, their place in key order. Fences cut the keys into about `parts`
    slots; places come from counts per slot and ranks within it, so no task sees all rows. The fences come
    from PER_SLOT keys a slot, those of the least hash; any fences give the same places."""
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    drawn = sorted(r["k"] for r in rows.select("k").orderBy(F.xxhash64("k"), "k").limit(parts * PER_SLOT).collect())
    rows = rows.withColumn("__p", slots(drawn[PER_SLOT // 2 :: PER_SLOT])(F.col("k")))
    counts = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")  # a row a slot
    own = rows.withColumn("__own", F.row_number().over(Window.partitionBy("__p").orderBy("k")))
    return own.join(F.broadcast(before), "__p").withColumn("pos", F.col("__own") + F.col("__before")).drop("__p", "__own", "__before")


def merge_sources(sources: DataFrame) -> DataFrame:
    """(k, v, src, idx) over rows (k, v, src, idx): the smaller src is newer; within one the greater idx is."""
    rank = F.struct(-F.col("src"), F.col("idx"), F.col("v"))
    won = sources.groupBy("k").agg(F.max(rank).alias("n"))
    return won.select("k", "n.v", (-F.col("n.col1")).alias("src"), "n.idx")


def three_way(a: Column, b: Column) -> Column:
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def compare(a: Column, b: Column, kind: str, prefix: int = 0) -> Column:
    """-1, 0 or 1 by kind: int, float, string (of the first `prefix` characters if that is positive) or
    bytes; null if an operand is."""
    if kind in ("int", "float"):
        a, b = a.cast(kind), b.cast(kind)
    elif kind == "string" and prefix > 0:
        a, b = F.substring(a, 1, prefix), F.substring(b, 1, prefix)
    elif kind == "bytes":
        a, b = a.cast("binary"), b.cast("binary")
    return F.when(a.isNull() | b.isNull(), None).otherwise(three_way(a, b))
