"""Tables that cut lineage, written to the folder that the cluster shares.

The folder is ``spark.checkpoint.dir`` of the session. Only where that is unset and the master is local (tests, a
laptop) does a temporary folder of this process stand in for it; elsewhere its absence is an error. What an operator
does not drop itself, as its result still reads it, goes when the session's JVM ends.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

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


class Rounds:
    """Written tables of one operator call: ``put`` gives the written form, ``drop`` frees one that is no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.count = spark, 0
        self.root = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(path)
        self.files.deleteOnExit(path)
        self.paths: dict[int, str] = {}

    def put(self, frame: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        written = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def drop(self, *written: DataFrame | None) -> None:
        for frame in written:
            path = self.paths.pop(id(frame), None) if frame is not None else None
            if path:
                self.files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def counted(self, frame: DataFrame, marked: Column) -> tuple[DataFrame, int]:
        """``put``, and how many of the rows are marked, counted as they are written."""
        seen = Observation()
        written = self.put(frame.observe(seen, F.sum(marked.cast("long")).alias("n")))
        return written, seen.get["n"] or 0

    def settle(self, frame: DataFrame, step, changed: Column, most: int = 200) -> DataFrame:
        """``step`` applied until no row is ``changed``; every round is written, the one before dropped. ``frame`` reads written tables only."""
        now = frame
        for _ in range(most):
            new, moved = self.counted(step(now), changed)
            self.drop(now)
            now = new
            if not moved:
                return now
        raise RuntimeError(f"not settled after {most} rounds")


def zero(column: str | Column) -> Column:
    return F.coalesce(column, F.lit(0))
