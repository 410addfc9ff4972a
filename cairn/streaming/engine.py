"""Catalogs under one roof: loading, refresh, and agreement with other nodes."""

from __future__ import annotations

import logging
import math
import os
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from cairn.errors import CatalogNotAvailable
from cairn.operators.catalog import Catalog, search
from cairn.operators.query import Compound, GraphQuery, Query
from cairn.operators.snapshot import Snapshot
from cairn.sources.store import SnapshotStore
from cairn.streaming.events import EVENT, REQUEST, RefreshEvent
from cairn.streaming.leader import SingleNode
from cairn.streaming.metrics import Metrics, Quiet

log = logging.getLogger(__name__)
STATUS = "catalog string, available boolean, version bigint, hash string, item_count bigint, created_at timestamp, failed boolean"


@dataclass(frozen=True)
class RetryPolicy:
    retries: int = 3
    wait: timedelta = timedelta(seconds=2)

    def __post_init__(self):
        if self.retries < 1 or self.wait < timedelta(0):
            raise ValueError("at least one try, and no negative wait")


class Engine:
    """Serves catalogs. Nodes agree through `sync`; the leader loads and publishes, the others take
    the leader's snapshots from `store`. Without these, the engine is a node of its own."""

    def __init__(
        self, spark: SparkSession, store: SnapshotStore | None = None, sync=None, leader=None, retry: RetryPolicy = RetryPolicy(),
        metrics: Metrics | None = None, node_id: str | None = None, sleep: Callable[[float], None] = time.sleep,
        gauges_every: timedelta | None = None,
    ):
        self.spark, self.store, self.sync, self.leader, self.retry = spark, store, sync, leader or SingleNode(), retry
        self.metrics, self._sleep = Quiet(metrics or Metrics()), sleep
        self.node_id = node_id or os.environ.get("HOSTNAME") or uuid.uuid4().hex
        self.catalogs: dict[str, Catalog] = {}
        self.failed: set[str] = set()
        self._running = self._started = False
        self._dispatcher = Dispatcher(self._on_dispatch)
        self._timers: list[threading.Timer] = []
        self._lock = threading.RLock()
        self.gauges_every, self._ended = gauges_every, threading.Event()

    def register(self, catalog: Catalog) -> Engine:
        if self._started:
            raise RuntimeError("catalogs are registered before start()")
        if catalog.name in self.catalogs:
            raise ValueError(f"catalog {catalog.name} is registered already")
        self.catalogs[catalog.name] = catalog
        return self

    def start(self) -> Engine:
        """Loads every catalog, and only then listens to others. A catalog that can't be loaded is
        unavailable until a refresh succeeds; the others are served."""
        if self._started:
            raise RuntimeError("the engine was started before")
        self._started = self._running = True
        self.leader.start()
        for catalog in self.catalogs.values():
            self._bootstrap(catalog)
        if self.sync is not None:
            self.sync.subscribe(self.receive, lambda n: [self.metrics.count("sync_receive_failed") for _ in range(n)])
        for catalog in self.catalogs.values():
            if catalog.refresh_every is not None:
                self._schedule(catalog)
        if self.gauges_every is not None:
            threading.Thread(target=self._gauges, name="gauges", daemon=True).start()
        return self

    def _gauges(self) -> None:
        """Reports what every catalog serves, as long as the engine runs; one that can't be read doesn't
        keep the others from being reported."""
        while not self._ended.wait(self.gauges_every.total_seconds()):
            for name, catalog in self.catalogs.items():
                snapshot = catalog.snapshot
                self.metrics.gauge("available", int(snapshot is not None and name not in self.failed), catalog=name)
                if snapshot is not None:
                    try:
                        self.metrics.gauge("version", snapshot.version, catalog=name)
                        self.metrics.gauge("item_count", snapshot.data.count(), catalog=name)
                    except Exception:
                        log.warning("catalog %s wasn't measured", name, exc_info=True)

    def stop(self) -> None:
        """Ends refreshes; queries go on over the last snapshots. May be called again."""
        if not self._running:
            return
        self._running = False
        self._ended.set()
        for timer in self._timers:
            timer.cancel()
        if self.sync is not None:
            self.sync.stop()
        self._dispatcher.stop()
        self.leader.stop()

    def search(self, catalog: str, index: str, key, view: str | None = None) -> DataFrame:
        return search(self._serving(catalog), index, key, view)

    def query(self, catalog: str, index: str) -> Query:
        return Query(self._serving(catalog), index)

    def compound(self, catalog: str) -> Compound:
        return Compound(self._serving(catalog))

    def graph_query(self, catalog: str) -> GraphQuery:
        return GraphQuery(self._serving(catalog))

    def refresh(self, name: str) -> Snapshot:
        """Loads again here only."""
        self._need_running()
        return self._loaded(self._catalog(name), lambda c: c.refresh(self.spark))

    def refresh_and_sync(self, name: str) -> Snapshot | None:
        """On the leader: loads, saves and publishes. Elsewhere: asks the leader to."""
        self._need_running()
        catalog = self._catalog(name)
        if not self.leader.is_leader():
            self._publish(RefreshEvent(name, self.node_id, 0, "", datetime.now(timezone.utc), REQUEST))
            return None
        snapshot = self._loaded(catalog, lambda c: c.refresh(self.spark))
        self._save(snapshot)
        self._publish(RefreshEvent(name, self.node_id, snapshot.version, snapshot.hash, datetime.now(timezone.utc), EVENT))
        return snapshot

    def receive(self, event: RefreshEvent) -> bool:
        """Whether an event leads to a refresh: not one of an unknown catalog or of this node, not a
        request unless this node leads, and not news of the hash that is served already."""
        self.metrics.count("sync_received", catalog=event.catalog_name)
        catalog = self.catalogs.get(event.catalog_name)
        if catalog is None or not self._running:
            return False
        if event.kind == REQUEST:
            if not self.leader.is_leader():
                return False
        elif event.source_node_id == self.node_id or (catalog.snapshot is not None and catalog.snapshot.hash == event.hash):
            return False
        self._dispatcher.dispatch(event.catalog_name, event)
        return True

    def drain(self) -> None:
        """Waits for the refreshes that are under way."""
        self._dispatcher.drain()

    def status(self) -> DataFrame:
        rows = []
        for name, c in sorted(self.catalogs.items()):
            s = c.snapshot
            rows.append((name, s is not None and name not in self.failed, s.version if s else 0, s.hash if s else "", s.data.count() if s else 0, s.created_at if s else None, name in self.failed))
        return self.spark.createDataFrame(rows, STATUS)

    def info(self, name: str) -> dict:
        self._serving(name)
        return self._catalog(name).info()

    def _catalog(self, name: str) -> Catalog:
        if name not in self.catalogs:
            raise ValueError(f"there is no catalog {name}")
        return self.catalogs[name]

    def _serving(self, name: str) -> Snapshot:
        catalog = self._catalog(name)
        if name in self.failed or catalog.snapshot is None:
            raise CatalogNotAvailable(f"catalog {name} isn't available")
        return catalog.snapshot

    def _need_running(self) -> None:
        if not self._running:
            raise RuntimeError("the engine isn't running")

    def _loaded(self, catalog: Catalog, load: Callable[[Catalog], Snapshot]) -> Snapshot:
        began = time.monotonic()
        try:
            snapshot = load(catalog)
        except Exception:
            self.metrics.count("refresh_failed", catalog=catalog.name)
            raise
        self.failed.discard(catalog.name)
        self.metrics.count("refreshed", catalog=catalog.name)
        self.metrics.gauge("refresh_seconds", time.monotonic() - began, catalog=catalog.name)
        return snapshot

    def _restore(self, catalog: Catalog) -> bool:
        """Takes the stored snapshot's rows; its version is this process's own."""
        if self.store is None or catalog.static:
            return False
        try:
            found = self.store.load(self.spark, catalog.name)
            if found is None:
                return False
            self._loaded(catalog, lambda c: c.refresh(self.spark, found.data, found.hash))
            return True
        except Exception:
            log.warning("the stored snapshot of %s wasn't taken", catalog.name, exc_info=True)
            return False

    def _bootstrap(self, catalog: Catalog) -> None:
        if self._restore(catalog):
            return
        tries = self.retry.retries
        if not catalog.static and not self.leader.is_leader() and self.store is not None:
            for _ in range(10 * tries):
                self._sleep(self.retry.wait.total_seconds())
                if self._restore(catalog):
                    return
                if self.leader.is_leader():
                    break
        for n in range(tries):
            try:
                snapshot = self._loaded(catalog, lambda c: c.bootstrap(self.spark))
            except Exception:
                log.warning("catalog %s wasn't loaded, try %d of %d", catalog.name, n + 1, tries, exc_info=True)
                if n + 1 < tries:
                    self._sleep(self.retry.wait.total_seconds())
                continue
            if self.leader.is_leader():
                self._save(snapshot)
            return
        self.failed.add(catalog.name)
        self.metrics.count("catalog_failed", catalog=catalog.name)

    def _save(self, snapshot: Snapshot) -> None:
        if self.store is not None and not self.catalogs[snapshot.catalog].static:
            try:
                self.store.save(self.spark, snapshot)
            except Exception:
                self.metrics.count("save_failed", catalog=snapshot.catalog)
                log.warning("the snapshot of %s wasn't saved", snapshot.catalog, exc_info=True)

    def _publish(self, event: RefreshEvent) -> None:
        if self.sync is None:
            return
        try:
            self.sync.publish(event)
            self.metrics.count("sync_published", catalog=event.catalog_name)
        except Exception:
            self.metrics.count("sync_publish_failed", catalog=event.catalog_name)
            log.warning("an event of %s wasn't published", event.catalog_name, exc_info=True)

    def _on_dispatch(self, name: str, event: RefreshEvent) -> None:
        try:
            if event.kind == REQUEST:
                self.refresh_and_sync(name)
            elif not self._restore(self.catalogs[name]):
                self.refresh(name)
        except Exception:
            self.metrics.count("event_failed", catalog=name)
            log.warning("an event of %s led to no refresh", name, exc_info=True)

    def _schedule(self, catalog: Catalog, due: float | None = None) -> None:
        """Refreshes at a fixed rate: a late one doesn't put off those after it, and those that would have
        begun meanwhile are left out."""
        every, now = catalog.refresh_every.total_seconds(), time.monotonic()
        due = now + every if due is None else due + every * max(1, math.ceil((now - due) / every))

        def go() -> None:
            if not self._running:
                return
            try:
                if self.leader.is_leader():
                    self.refresh_and_sync(catalog.name)
            except Exception:
                log.warning("the scheduled refresh of %s failed", catalog.name, exc_info=True)
            self._schedule(catalog, due)

        timer = threading.Timer(max(0.0, due - now), go)
        timer.daemon = True
        self._timers = [t for t in self._timers if t.is_alive()] + [timer]
        timer.start()


class Dispatcher:
    """One refresh of a catalog at a time. Events that come meanwhile come down to one more, the last."""

    def __init__(self, run: Callable[[str, RefreshEvent], None]):
        self.run, self.lock, self.busy, self.waiting = run, threading.Condition(), set(), {}
        self.pool = ThreadPoolExecutor(4, thread_name_prefix="refresh")

    def dispatch(self, name: str, event: RefreshEvent) -> None:
        with self.lock:
            if name in self.busy:
                self.waiting[name] = event
                return
            self.busy.add(name)
        self.pool.submit(self._go, name, event)

    def _go(self, name: str, event: RefreshEvent) -> None:
        while event is not None:
            try:
                self.run(name, event)
            except Exception:
                log.warning("a refresh of %s failed", name, exc_info=True)
            with self.lock:
                # taken before it runs, so that an event during the run waits anew
                event = self.waiting.pop(name, None)
                if event is None:
                    self.busy.discard(name)
                    self.lock.notify_all()

    def drain(self) -> None:
        with self.lock:
            self.lock.wait_for(lambda: not self.busy)

    def stop(self) -> None:
        self.pool.shutdown(wait=True)
