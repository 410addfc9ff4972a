"""Tables in the folder that all executors share, and a few helpers for them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is common if it holds more than one in so many rows, so there are fewer common keys than that.
COMMON = 1000

_local_dir: str | None = None
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application, so that their Python
    workers can import it wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        folder = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, folder, True)
        with zipfile.ZipFile(f"{folder}/cairn-modules.zip", "w", zipfile.ZIP_DEFLATED) as out:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        out.write(f"{at}/{name}", os.path.relpath(f"{at}/{name}", os.path.dirname(root)))
        context.addPyFile(f"{folder}/cairn-modules.zip")
    _shipped.add(context.applicationId)


def shipped(query: Callable) -> Callable:
    """query(spark, ..) with the modules sent first."""

    @wraps(query)
    def run(spark, *args):
        ship(spark)
        return query(spark, *args)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a local master (tests) gets a
    temporary folder of its own; any other master is refused, since executors could not read it."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master.startswith("local[") or master == "local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="cairn-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


class Scratch:
    """Tables of one run, written as Parquet to the shared folder. They cut lineage: what is read
    again is not computed again, and it survives the loss of executors. They go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files, at = self._at(self.path)
        files.mkdirs(at)
        files.deleteOnExit(at)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        files, at = self._at(f"{self.path}/{name}")
        files.delete(at, True)

    def _at(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at


def tasks_for(spark: SparkSession, df: DataFrame, bytes_each: int) -> int:
    """Partitions of about bytes_each of the tables that df reads, and no fewer than the session's
    shuffle partitions. Tables of unknown size (RDDs) don't count."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length())]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, sum(x for x in sizes if x < 1 << 60) // bytes_each))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores added where a table of these columns has them already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_counted(rows: DataFrame, counts: DataFrame, on: list[str], many: str, total: float) -> DataFrame:
    """rows joined with counts, which has one row for each key and says how many of `total` rows have it
    (or their weight). Common keys (COMMON of them at most) are broadcast, so that no task gets all rows
    of one; the others meet in a shuffle. counts should be cheap to read again, such as a kept table."""
    limit = max(1.0, float(total or 0) / COMMON)
    common = F.broadcast(counts.where(F.col(many) > limit))
    rest = rows.join(common.select(*on), on, "left_anti").join(counts.where(F.col(many) <= limit), on)
    return rows.join(common, on).unionByName(rest)


def join_texts(pairs: DataFrame, texts: DataFrame, key: str, name: str, counts: DataFrame, total: int) -> DataFrame:
    """pairs with the text (as `name`) of the id in column `key`. texts: rep and text; counts: rep and many,
    how many of `total` pairs have it. The text of a common id is copied once for each COMMONth of the pairs
    that it holds, 2 * COMMON copies at most over all ids, so its pairs are spread over as many tasks."""
    share = max(1.0, float(total or 0) / COMMON)
    salts = F.broadcast(counts.where(F.col("many") > share).select("rep", F.ceil(F.col("many") / share).cast("int").alias("_salts")))
    spread = lambda df, rep: df.join(salts.withColumnRenamed("rep", "_common"), F.col(rep) == F.col("_common"), "left").withColumn("_salts", F.coalesce("_salts", F.lit(1))).drop("_common")
    left = spread(pairs, key).withColumn("_salt", F.pmod(F.xxhash64(*pairs.columns), F.col("_salts")).cast("int")).drop("_salts")
    right = spread(texts.select(F.col("rep").alias(key), F.col("text").alias(name)), key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    # the same join at every size: ids and texts grow with the input, so that neither side is broadcast
    return left.hint("merge").join(right, [key, "_salt"]).drop("_salt")
