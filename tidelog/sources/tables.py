"""Typed tables as write logs. Readers keep the projection declarative, so that only the columns a query
needs are read. Keys are computed, which no scan can filter by; a range of keys given to the reader becomes
one of the column that keys are made of, and that reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import as_log


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(user_id: Column) -> Column:
    return F.concat(F.lit("user:"), F.lpad(user_id.cast("string"), 6, "0"))


def _user_of(key: str, default: int) -> int:
    digits = key.removeprefix("user:")
    return int(digits) if key.startswith("user:") and len(digits) == 6 and digits.isascii() and digits.isdigit() else default


def events_log(spark: SparkSession, sf_dir: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """The events as a log. With start or end, at least the rows with start <= k <= end: six digits are a
    number, and ids that don't fit them are read in any case. The caller still filters by the key."""
    e = table(spark, sf_dir, "events")
    if start is not None or end is not None:
        low, high = _user_of(start or "", 0), _user_of(end or "", 999_999)
        e = e.where(e["user_id"].between(low, high) | (e["user_id"] < 0) | (e["user_id"] > 999_999))
    return as_log(e, e["event_id"], user_key(e["user_id"]), e["props"], e["event_type"] == "error", e["ts"])


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.concat(F.lit("cust:"), F.lpad(o["o_custkey"].cast("string"), 8, "0"))
    return as_log(o, o["o_orderkey"], k, F.concat_ws("|", o["o_orderstatus"], o["o_orderpriority"]), o["o_orderstatus"] == "P", o["o_orderdate"])


def conversations_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite ordered keys: conversation, then turn."""
    c = table(spark, sf_dir, "conversations")
    k = F.concat(F.lpad(c["conv_id"].cast("string"), 8, "0"), F.lit(":"), F.lpad(c["turn"].cast("string"), 4, "0"))
    return as_log(c, c["conv_id"] * 10000 + c["turn"], k, c["text"])


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of keys to look up, some of which the events log has."""
    c = table(spark, sf_dir, "customer").where("c_custkey IS NOT NULL")
    return c.select(user_key(c["c_custkey"]).alias("k")).distinct()


def read_log(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options: str) -> DataFrame:
    """A write log from any reader of Spark; it must have the log's columns."""
    from ..model import LOG

    return spark.read.format(fmt).options(**options).schema(schema or LOG).load(path).select(*LOG.fieldNames())


def write_log(log: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", **options: str) -> None:
    log.write.format(fmt).options(**options).mode(mode).save(path)
