"""Files of any of Hadoop's file systems, by the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Paths:
    def __init__(self, spark: SparkSession, root: str):
        self.path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.lines = spark.read

    def exists(self, at: str) -> bool:
        return self.fs.exists(self.path(at))

    def names(self, at: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(at))] if self.exists(at) else []

    def read(self, at: str) -> str:
        if not self.exists(at):
            raise FileNotFoundError(at)
        return self.lines.text(at, wholetext=True).first()[0]

    def _put(self, at: str, text: str):
        out = self.fs.create(self.path(at))
        out.write(bytearray(text.encode()))
        out.close()

    def write(self, at: str, text: str) -> None:
        """Replaces the file in one step, or nearly: readers see the old text, the new one or none."""
        tmp = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        self._put(tmp, text)
        self.fs.delete(self.path(at), False)
        self.fs.rename(self.path(tmp), self.path(at))

    def publish(self, at: str, text: str) -> bool:
        """Makes a file that must not be there yet; False if it is."""
        tmp = f"{at.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        self._put(tmp, text)
        return not self.exists(at) and self.fs.rename(self.path(tmp), self.path(at))

    def delete(self, at: str) -> None:
        self.fs.delete(self.path(at), True)
