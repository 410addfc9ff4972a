"""An immutable state of a catalog."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import fresh, key_bytes, next_power_of_two, row_text
from cairn.operators.indices import EqualityIndex, GraphIndex, View, column

#: Rows whose digests are hashed together.
CHUNK = 10_000
#: Columns of built postings beside those of the rows: the key, and a number of the row.
POSTING, ROW = "__key", "__row"


@dataclass(frozen=True)
class Snapshot:
    """Rows of a catalog with what it declares about them. Queries hold the snapshot they began with."""

    catalog: str
    data: DataFrame
    indices: Mapping[str, EqualityIndex | GraphIndex]
    views: Mapping[str, View]
    version: int
    hash: str
    created_at: datetime | None
    order_by: tuple[str, ...] = ()
    #: Postings of multi and graph indices as tables sorted by key, where they were built.
    built: Mapping[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def of(cls, catalog: str, data: DataFrame, indices: Sequence[EqualityIndex | GraphIndex], views: Sequence[View] = (), order_by: Sequence[str] = (), version: int = 1, hashed: bool = False) -> Snapshot:
        """A snapshot over rows as they are, with indices of its own, outside any catalog."""
        order = tuple(order_by)
        return cls(catalog, data, {i.name: i for i in indices}, {v.name: v for v in views}, version, content_hash(data, order) if hashed else "", datetime.now(timezone.utc), order)

    def has_index(self, name: str) -> bool:
        return name in self.indices

    def has_sorted_index(self, name: str) -> bool:
        return name in self.indices and self.indices[name].kind == "sorted"

    def project(self, rows: DataFrame, view: str | None) -> DataFrame:
        if view is None:
            return rows
        if view not in self.views:
            raise ValueError(f"catalog {self.catalog} has no view {view}")
        return rows.select(*self.views[view].select())

    def key_type(self, name: str) -> T.DataType:
        return self.data.select(self.indices[name].keys().alias("k")).schema["k"].dataType

    def field_type(self, index: GraphIndex, name: str) -> T.DataType:
        """The type of a traversal's values."""
        return self.data.select(index.traversal(name).values.alias("k")).schema["k"].dataType.elementType

    def postings(self, name: str, key: str = "key") -> DataFrame:
        """The rows once for each key of an index, with the key as the last column, called `key`, or with
        underscores added if the rows have a column of this name."""
        index, key = self.indices[name], fresh(self.data.columns, key)
        if index.kind in ("equality", "sorted"):
            keyed = self.data.withColumn(key, index.keys())
            return keyed if index.kind == "sorted" else keyed.where(F.col(key).isNotNull())
        return self.data.withColumn(key, F.explode(index.keys()))

    def grouped(self, name: str) -> DataFrame:
        """An index as it is: each key with all its rows. For small catalogs only, as a key's rows become one
        value; `postings` says the same in rows of their own, at any size."""
        rows = self.postings(name)
        key = rows.columns[-1]
        return rows.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct(*rows.columns[:-1])).alias("rows"))

    def index_info(self) -> DataFrame:
        """name, unique_keys, total_entries and estimated_size_bytes of each index. Sorted indices
        count null keys, which they hold but no query reaches."""
        parts = []
        for name in self.indices:
            kind = self.key_type(name)
            inner = kind.elementType if self.indices[name].kind in ("multi", "graph") else kind
            rows = self.postings(name)
            by_key = rows.groupBy(F.col(rows.columns[-1]).alias("key")).agg(F.count("*").alias("n"))
            sized = by_key.agg(F.count("*").alias("u"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(key_bytes(F.col("key"), inner)), F.lit(0)).alias("keys"))
            buckets = next_power_of_two(F.greatest(F.lit(16), F.floor(F.col("u") / 0.75) + 1))
            size = F.lit(48) + 8 * buckets + 72 * F.col("u") + F.col("keys") + 8 * F.col("n")
            parts.append(sized.select(F.lit(name).alias("name"), F.col("u").cast("long").alias("unique_keys"), F.col("n").cast("long").alias("total_entries"), size.cast("long").alias("estimated_size_bytes")))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def search_many(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows whose key is among many, given as a column `key`: one semi join instead of many lookups.
        Each row comes once, also where several of its keys are wanted, and equal rows stay several."""
        index, columns = self.indices[name], self.data.columns
        key, row, wanted = (fresh(columns, n) for n in ("_key", "_row", "_wanted"))
        asked = keys.select(F.col("key").alias(wanted)).distinct()
        if index.kind not in ("multi", "graph"):
            return self.data.withColumn(key, index.keys()).join(asked, F.col(key) == F.col(wanted), "left_semi").drop(key)
        keyed = self.data.withColumn(row, F.monotonically_increasing_id()).withColumn(key, F.explode(F.array_distinct(index.keys())))
        return keyed.join(asked, F.col(key) == F.col(wanted), "left_semi").dropDuplicates([row]).select(*columns)


def build_postings(data: DataFrame, index: EqualityIndex | GraphIndex) -> DataFrame:
    """The rows once for each key of a multi or graph index, sorted by key, so that a scan reads a key's
    rows only. To be written. Keys of a graph index are texts, with the fields that they are of."""
    rows = data.withColumn(ROW, F.monotonically_increasing_id())
    if isinstance(index, GraphIndex):
        paths = sorted({tuple(h[:n]) for h in index.hotpaths for n in range(1, len(h) + 1)})
        keyed = reduce(DataFrame.union, (_along(rows, index, fields) for fields in paths))
    else:
        keyed = rows.withColumn(POSTING, F.explode(index.keys()))
    return keyed.repartitionByRange(POSTING).sortWithinPartitions(POSTING)


def _along(rows: DataFrame, index: GraphIndex, fields: Sequence[str]) -> DataFrame:
    """The rows once for each choice of values of the fields, whose values are distinct."""
    names = [f"{POSTING}{n}" for n in range(len(fields))]
    keyed = rows
    for name, field_ in zip(names, fields):
        keyed = keyed.withColumn(name, F.explode(index.traversal(field_).values))
    parts = F.array(*(F.col(name).cast("string") for name in names))
    return keyed.withColumn(POSTING, graph_posting(fields, parts)).drop(*names)


def graph_posting(fields: Sequence[str], parts: Column) -> Column:
    """A composite key (an array of texts) with its fields as one text, different for different ones."""
    return F.to_json(F.concat(F.array(F.lit("\x1f".join(fields))), parts))


def content_hash(rows: DataFrame, order_by: tuple[str, ...]) -> str:
    """SHA-256 of the rows in the order of order_by (ties by text), the same in every partitioning, session
    zone and run: of each row's text a digest; of each CHUNK of digests one of them joined by line feeds, and
    so on until CHUNK or fewer are left, which are hashed in the same way.

    Only keys and digests are shuffled. Rows get their place from the sizes of the ranges before theirs;
    a task holds CHUNK digests, and the driver as many, and one number for each range."""
    text = row_text(rows.columns)
    keys = [column(c) for c in order_by]
    names = [f"k{i}" for i in range(len(keys))]
    lines = rows.select(*(k.alias(n) for n, k in zip(names, keys)), F.sha2(text, 256).alias("line"))
    ranged = lines.repartitionByRange(*names, "line").sortWithinPartitions(*names, "line").select("line", F.spark_partition_id().alias("part")).persist()
    try:
        # ids count up within a partition, in its order
        within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        sizes = ranged.groupBy("part").agg(F.count("*").alias("many")).collect()
        if not sizes:
            return _sha("")
        start, starts = 0, []
        for r in sorted(sizes, key=lambda r: r.part):
            starts.append((r.part, start))
            start += r.many
        offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "part int, start bigint"))
        lines = ranged.withColumn("place", within).join(offsets, "part").select((F.col("place") + F.col("start")).alias("place"), "line")
        while True:
            joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\n")
            lines = lines.groupBy(F.floor(F.col("place") / CHUNK).alias("place")).agg(F.sha2(joined, 256).alias("line"))
            start = -(-start // CHUNK)
            if start <= CHUNK:
                return _sha("\n".join(r.line for r in lines.orderBy("place").collect()))
    finally:
        ranged.unpersist()


def _sha(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()
