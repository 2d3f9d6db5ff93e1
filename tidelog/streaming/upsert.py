"""Streams into state: micro-batches are appended and resolved by newest version at read, which needs no
per-key streaming state; or, where live state is wanted, flushed into a store batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import LOG
from ..operators.reads import live
from ..store import Store


def stream_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def append(stream: DataFrame, out: str, checkpoint: str):
    """Each batch writes its own folder, so a batch that is tried again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.groupBy("k").agg(F.max(F.struct("seq", "v")).alias("n")).select("k", "n.seq", "n.v")
        best.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, out: str) -> DataFrame:
    return live(spark.read.schema("k string, seq long, v string").option("basePath", out).parquet(out))


def into_store(stream: DataFrame, store: Store, checkpoint: str):
    """In-order streams into a store: Store.flush leaves out what it already has."""
    return stream.writeStream.foreachBatch(lambda batch, _: store.flush(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
