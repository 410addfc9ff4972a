"""The folder that the driver and all executors share, named by spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master (tests) gets a folder of
    its own; any other master is refused, since executors could not read it."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, _own, True)
    return f"file://{_own}"


class Pinned:
    """Tables of one snapshot, as Parquet in the shared folder: what is read again is what was written,
    whatever becomes of the source or of executors. They go when they are dropped, or the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._at(lambda files, at: (files.mkdirs(at), files.deleteOnExit(at)))

    def keep(self, rows: DataFrame, name: str) -> DataFrame:
        rows.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def drop(self) -> None:
        self._at(lambda files, at: files.delete(at, True))

    def _at(self, do) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(self.path)
        do(at.getFileSystem(context._jsc.hadoopConfiguration()), at)
