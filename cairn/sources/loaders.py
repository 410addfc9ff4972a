"""Loaders for catalogs: callables that take a session and return all rows, lazily."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Loader = Callable[[SparkSession], DataFrame]


def _files(kind: str, path, schema=None, **options) -> Loader:
    def load(spark: SparkSession) -> DataFrame:
        reader = spark.read.format(kind).options(**options)
        return (reader.schema(schema) if schema else reader).load(path)

    return load


def parquet(path, schema=None, **options) -> Loader:
    return _files("parquet", path, schema, **options)


def orc(path, schema=None, **options) -> Loader:
    return _files("orc", path, schema, **options)


def json(path, schema, **options) -> Loader:
    """The schema is asked for, as finding it would read everything twice."""
    return _files("json", path, schema, **options)


def csv(path, schema, **options) -> Loader:
    return _files("csv", path, schema, **options)


def table(name: str) -> Loader:
    return lambda spark: spark.read.table(name)


def jdbc(url: str, query: str, partition: tuple[str, int, int, int] | None = None, **options) -> Loader:
    """partition: column, lower and upper bound, and number of parallel reads; without it, one reads all."""

    def load(spark: SparkSession) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).options(**options)
        if partition:
            names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
            return reader.option("dbtable", f"({query}) q").options(**dict(zip(names, partition))).load()
        return reader.option("query", query).load()

    return load
