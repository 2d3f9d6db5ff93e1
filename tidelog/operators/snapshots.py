"""Reads of the past: a version is a position in the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TOMBSTONE
from .reads import live


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """Live state after the write seq; the filter on seq reaches the scan."""
    return live(log.where(F.col("seq") <= seq))


def diff(log: DataFrame, old: int, new: int) -> DataFrame:
    """(k, change, old_v, new_v) between two versions. Both states come from one aggregation."""
    upto = lambda s: F.max(F.when(F.col("seq") <= s, F.struct("seq", "v")))
    both = log.where(F.col("seq") <= max(old, new)).groupBy("k").agg(upto(old).alias("o"), upto(new).alias("n"))
    seen = lambda c: F.when(F.col(f"{c}.v") != TOMBSTONE, F.col(f"{c}.v"))
    both = both.select("k", seen("o").alias("old_v"), seen("n").alias("new_v"))
    change = F.when(F.col("old_v").isNull() & F.col("new_v").isNotNull(), "add").when(F.col("old_v").isNotNull() & F.col("new_v").isNull(), "del").when(F.col("old_v") != F.col("new_v"), "upd")
    return both.withColumn("change", change).where("change IS NOT NULL").select("k", "change", "old_v", "new_v")
