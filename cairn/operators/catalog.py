"""A catalog: where its rows come from and what is declared about them."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import IndexKeyLimitExceeded
from cairn.operators.indices import EqualityIndex, GraphIndex, Hook, View
from cairn.operators.query import Compound, GraphQuery, Query, condition
from cairn.operators.snapshot import Snapshot, build_postings, content_hash
from cairn.shared_folder import Pinned


class Catalog:
    """Rows of one kind, loaded as a whole by `load` (or given once as `data`), and served as a
    snapshot that is replaced as a whole. Index names are unique over all kinds.

    order_by: columns that stand for the load order; they matter to ordered results and the hash.
    materialize: how a new snapshot's rows are pinned before they are served, so that later changes of the
    source don't show; by default they are written to the shared folder and read from there, and the
    postings of multi and graph indices with them, sorted by key (unless build is False). The last `keep`
    snapshots stay readable."""

    def __init__(
        self, name: str, load: Callable[[SparkSession], DataFrame] | None = None, data: DataFrame | None = None, indices: Sequence[EqualityIndex | GraphIndex] = (),
        views: Sequence[View] = (), hooks: Sequence[Hook | Callable] = (), order_by: Sequence[str] = (), refresh_every: timedelta | None = None,
        materialize: Callable[[DataFrame], DataFrame] | None = None, hashed: bool = True,
        build: bool = True, keep: int = 3,
    ):
        if not name or not name.strip():
            raise ValueError("a catalog needs a name")
        if (load is None) == (data is None):
            raise ValueError("a catalog needs either load or data")
        if not indices:
            raise RuntimeError(f"catalog {name} needs an index")
        if refresh_every is not None and refresh_every <= timedelta(0):
            raise ValueError("refresh_every must be positive")
        for what, names in (("index", [i.name for i in indices]), ("view", [v.name for v in views])):
            if twice := {n for n in names if names.count(n) > 1}:
                raise ValueError(f"catalog {name} has more than one {what} {sorted(twice)[0]}")
        self.name, self._load, self._data, self.refresh_every = name, load, data, refresh_every
        self.indices, self.views, self.order_by = {i.name: i for i in indices}, {v.name: v for v in views}, tuple(order_by)
        self.hooks = sorted((h if isinstance(h, Hook) else Hook(h) for h in hooks), key=lambda h: h.priority)
        self._materialize, self._hashed, self._lock, self._version = materialize, hashed, threading.RLock(), 0
        self._current: Snapshot | None = None
        self._build, self._keep = build, keep
        self._held: list[Pinned] = []

    @property
    def static(self) -> bool:
        return self._load is None

    @property
    def snapshot(self) -> Snapshot | None:
        """What is served now; None before the first load."""
        return self._current

    def current(self, spark: SparkSession | None = None) -> Snapshot:
        if self._current is None:
            if spark is None:
                raise RuntimeError(f"catalog {self.name} isn't loaded")
            return self.bootstrap(spark)
        return self._current

    def bootstrap(self, spark: SparkSession) -> Snapshot:
        with self._lock:
            return self._swap(self._data if self.static else self._load(spark))

    def refresh(self, spark: SparkSession, data: DataFrame | None = None, known_hash: str = "") -> Snapshot:
        """Loads again, or takes data as the new rows; known_hash: their content hash, if it was checked."""
        with self._lock:
            if data is None and self.static:
                raise RuntimeError(f"catalog {self.name} is static")
            return self._swap(data if data is not None else self._load(spark), known_hash if data is not None else "")

    def lazy(self, data: DataFrame) -> Snapshot:
        """A snapshot over rows that are neither pinned nor hashed: for one query over stored data,
        whose filter then reaches the scan."""
        return Snapshot(self.name, data, self.indices, self.views, 0, "", None, self.order_by)

    def _swap(self, data: DataFrame, known_hash: str = "") -> Snapshot:
        if data is None:
            raise ValueError(f"catalog {self.name} loaded nothing")
        pinned = Pinned(data.sparkSession, "catalog")
        try:
            rows = self._materialize(data) if self._materialize else pinned.keep(data, "rows")
            for index in self.indices.values():
                if isinstance(index, GraphIndex):
                    self._check_keys(rows, index)
            passed = rows
            for hook in self.hooks:
                passed = hook.run(passed) or passed
            hashed = (known_hash or content_hash(rows, self.order_by)) if self._hashed else ""
            built = {}
            for index in self.indices.values():
                if self._build and index.kind in ("multi", "graph"):
                    built[index.name] = pinned.keep(build_postings(rows, index), f"postings-{len(built)}")
        except BaseException:
            pinned.drop()
            raise
        self._version += 1
        self._current = Snapshot(self.name, rows, self.indices, self.views, self._version, hashed, datetime.now(timezone.utc), self.order_by, built)
        # queries that began on earlier snapshots may still run
        self._held.append(pinned)
        while len(self._held) > self._keep:
            self._held.pop(0).drop()
        return self._current

    @staticmethod
    def _check_keys(rows: DataFrame, index: GraphIndex) -> None:
        over = rows.select(F.size(index.keys()).alias("n")).where(F.col("n") > index.max_keys_per_row).limit(1).collect()
        if over:
            raise IndexKeyLimitExceeded(f"a row has {over[0].n} keys in {index.name}, which allows {index.max_keys_per_row}")

    def search(self, name: str, key, view: str | None = None) -> DataFrame:
        return search(self.current(), name, key, view)

    def query(self, name: str) -> Query:
        return Query(self.current(), name)

    def compound(self) -> Compound:
        return Compound(self.current())

    def graph_query(self) -> GraphQuery:
        return GraphQuery(self.current())

    def info(self) -> dict:
        snapshot = self.current()
        indices = [r.asDict() for r in snapshot.index_info().collect()]
        size = sum(i["estimated_size_bytes"] for i in indices)
        return {
            "catalog": self.name, "item_count": snapshot.data.count(), "estimated_size_bytes": size, "estimated_size_mb": size / (1024 * 1024),
            "view_count": len(self.views), "views": sorted(self.views), "indices": indices,
        }


def search(snapshot: Snapshot, name: str, key, view: str | None = None) -> DataFrame:
    """Rows under a key; none if there is no such index."""
    if key is None:
        raise ValueError("a key is needed")
    if name not in snapshot.indices:
        return snapshot.project(snapshot.data.where(F.lit(False)), view)
    return Query(snapshot, name).equal_to(key, view=view)


__all__ = ["Catalog", "condition", "search"]
