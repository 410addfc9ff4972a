"""Snapshots on any file system that Spark reads (a local folder, HDFS, an object store by its url).

    <root>/<catalog>/v-<id>/           the rows, as Parquet
    <root>/<catalog>/manifest-<id>.json  hash, version, time, schema and order; the largest id counts

The manifest is written last, under another name, and renamed: a reader sees all of a snapshot or
none of it. Credentials are those of the file system's own configuration.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import SnapshotCorrupt
from cairn.functions import row_text
from cairn.operators.snapshot import Snapshot, content_hash


@dataclass(frozen=True)
class StoredSnapshot:
    catalog: str
    hash: str
    version: int
    created_at: datetime
    data: DataFrame


class ParquetRows:
    """How a snapshot's rows are stored. Another form has these two methods, and must give back the rows
    that it got."""

    def write(self, rows: DataFrame, path: str) -> None:
        rows.write.parquet(path)

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(path)


class JsonRows:
    """Rows as lines of canonical JSON."""

    def write(self, rows: DataFrame, path: str) -> None:
        to_json_rows(rows).write.option("compression", "gzip").format("text").save(f"{path}/lines.json")

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        return from_json_rows(spark.read.text(f"{path}/lines.json"), schema)


class SnapshotStore:
    def __init__(self, root: str, keep: int = 2, codec=None):
        self.root, self.keep, self.codec = root.rstrip("/"), keep, codec or ParquetRows()

    def folder(self, catalog: str) -> str:
        """Names can't lead out of the root."""
        if not re.fullmatch(r"[A-Za-z0-9._-]+", catalog) or catalog in (".", ".."):
            raise ValueError(f"{catalog!r} can't name a folder")
        return f"{self.root}/{catalog}"

    def save(self, spark: SparkSession, snapshot: Snapshot) -> str:
        """Writes the rows and then the manifest; returns the content hash."""
        folder, fs = self.folder(snapshot.catalog), _Files(spark)
        hashed = snapshot.hash or content_hash(snapshot.data, snapshot.order_by)
        name = f"{max([0, *map(_number, self._manifests(fs, folder))]) + 1:012d}-{time.time_ns():x}"
        self.codec.write(snapshot.data, f"{folder}/v-{name}")
        manifest = {
            "catalog": snapshot.catalog, "hash": hashed, "version": snapshot.version, "created_at": snapshot.created_at.isoformat(),
            "schema": snapshot.data.schema.jsonValue(), "order_by": list(snapshot.order_by), "rows": f"v-{name}",
        }
        fs.write(f"{folder}/.new-{name}", json.dumps(manifest, sort_keys=True))
        fs.rename(f"{folder}/.new-{name}", f"{folder}/manifest-{name}.json")
        for old in sorted(self._manifests(fs, folder))[: -self.keep]:
            fs.delete(f"{folder}/{old}")
            fs.delete(f"{folder}/v-{old[len('manifest-') : -len('.json')]}")
        return hashed

    def load(self, spark: SparkSession, catalog: str) -> StoredSnapshot | None:
        """The newest snapshot, checked against its hash; None if there is none or it doesn't fit."""
        folder, fs = self.folder(catalog), _Files(spark)
        names = sorted(self._manifests(fs, folder))
        if not names:
            return None
        try:
            found = json.loads(fs.read(f"{folder}/{names[-1]}"))
            schema = T.StructType.fromJson(found["schema"])
            version, created = int(found["version"]), datetime.fromisoformat(found["created_at"])
            rows, order, hashed = f"{folder}/{found['rows']}", tuple(found["order_by"]), found["hash"]
        except (ValueError, KeyError, TypeError) as e:
            raise SnapshotCorrupt(f"manifest {names[-1]} of {catalog} can't be read") from e
        if not fs.exists(rows):
            return None
        data = self.codec.read(spark, rows, schema)
        return StoredSnapshot(catalog, hashed, version, created, data) if content_hash(data, order) == hashed else None

    @staticmethod
    def _manifests(fs: _Files, folder: str) -> list[str]:
        return [n for n in fs.names(folder) if re.fullmatch(r"manifest-.*\.json", n)]


def _number(manifest: str) -> int:
    return int(manifest.split("-")[1])


class _Files:
    """Small files by Hadoop's file systems, so that any url works that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def write(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def rename(self, old: str, new: str) -> None:
        fs, at = self._at(old)
        if not fs.rename(at, self._at(new)[1]):
            raise OSError(f"{old} can't be renamed to {new}")

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)


def to_json_rows(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Each row as canonical JSON: fields in order of name and map keys in order, at any depth; times in
    ISO form."""
    ordered = rows.select(*(_in_order(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields))
    return ordered.select(row_text(list(columns or rows.columns)).alias("value"))


def _in_order(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], kind.valueType).alias("value")))
        return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _in_order(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = (_in_order(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def from_json_rows(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of JSON texts in a column `value`; a text that isn't an object of the schema is an error."""
    options = {"mode": "FAILFAST", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    checked = F.when(F.col("value").isNull() | (F.trim("value") == "null"), F.raise_error(F.lit("null instead of a row")).cast("string")).otherwise(F.col("value"))
    return lines.select(F.from_json(checked, schema, options).alias("r")).select("r.*")
