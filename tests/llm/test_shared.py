import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch, shared_dir, tasks_for

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_workers_import_the_modules_from_anywhere(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert __spark_entry__.queries()["op8_media_columns"](spark, "/root/testdata/sf0.001").count() == 200
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_tables_cut_lineage(spark):
    scratch = Scratch(spark, "test")
    kept = scratch.keep(spark.range(5).withColumn("r", F.rand()), "t")
    assert kept.collect() == kept.collect() and kept.schema["id"].dataType.simpleString() == "bigint"
    scratch.drop("t")
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.path}/t").count()


def test_shared_folder(spark):
    class Other:
        master = "spark://host:7077"

    class Session:
        sparkContext = Other()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "hdfs://x/y/")
    assert shared_dir(Session()) == "hdfs://x/y"
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file:///")


def test_tasks_follow_the_tables_read(spark):
    documents = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    size = os.path.getsize("/root/testdata/sf0.1/documents.parquet")
    assert tasks_for(spark, documents, 1000) == size // 1000
    assert tasks_for(spark, documents.join(documents, "doc_id"), 1000) == 2 * size // 1000
    assert tasks_for(spark, documents, 1 << 40) == 4 == tasks_for(spark, spark.createDataFrame([(1,)], "a int"), 1)
