"""Tables that cut lineage, written to the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset
and the master is local (tests, a laptop) does a temporary folder of this process
stand in for it; elsewhere its absence is an error. What an operator does not drop
itself, as its result still reads it, goes when the session's JVM ends.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _LOCAL[0]


class Scratch:
    """Named Parquet tables of one operator call; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        path, files = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(f"{self.root}/{name}")
            files.delete(path, True)

    def release(self) -> None:
        """Asks the driver's JVM to collect, upon which Spark removes the shuffle files of tables that are written and no longer planned."""
        gc.collect()
        self.spark._jvm.System.gc()
