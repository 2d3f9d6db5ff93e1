"""What the corpus operators share: tables, the cluster's shared folder, code shipping."""

from __future__ import annotations

import atexit
import gc
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch; texts may be long.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives the executors this package (once per application), wherever they run, and bounds what a
    Python worker holds of their rows at a time, unless the session has a lower bound."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH.items():
        if not 0 < as_bytes(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, f"{PACKAGE.name}/{p.relative_to(PACKAGE)}")
    out = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{PACKAGE.name}_code.zip")
    Path(out).write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(out)
    _shipped.add(app)


def release() -> None:
    """Gives back what a Python worker has freed; workers live on for other stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


def collect(spark: SparkSession) -> None:
    """Has the driver collect its garbage. Broadcasts and shuffle files of queries that ended go no sooner,
    and between many short queries the driver's heap would grow to its limit with them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where that is unset and all tasks run in the driver's own
    machine is a temporary one set; on a cluster executors wouldn't see each other's files there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_scopes: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends, and lost executors cost
    nothing before it. The files go when the scratch() around ends, or else the driver's Python."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Stored tables made in it go at its end, but for those given to what it yields, which the one around
    has then. What they are made of must be stored by then."""
    held: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        held.remove(df.stored_path)
        if len(_scopes) > 1:
            _scopes[-2].append(df.stored_path)
        return df

    _scopes.append(held)
    try:
        yield keep
    finally:
        _scopes.pop()
        for path in held:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the JVM may have ended before
        pass


#: A key with more than 1/HOT_SHARE of the rows is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def join_split(rows: DataFrame, of: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to of (stored; one row a key, `count` says how many of rows have it): hot keys, of which
    there are fewer than HOT_SHARE, by broadcast, so that their rows stay where they are; others by shuffle."""
    total = of.agg(F.sum(count)).first()[0] or 0
    hot = of.where(F.col(count) > max(1, total // HOT_SHARE))
    if hot.isEmpty():
        return rows.join(of, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(of.where(F.col(count) <= max(1, total // HOT_SHARE)), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, col: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(docs[col], F.lit(""))
