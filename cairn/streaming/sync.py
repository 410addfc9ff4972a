"""Transports of refresh events. Each publishes an event, and passes those of all nodes to a listener."""

from __future__ import annotations

import json
import logging
import os
import re
import threading
import urllib.request
import uuid
from collections.abc import Callable, Sequence
from datetime import timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.errors import CatalogError
from cairn.streaming.events import EVENT, RefreshEvent, latest_per_catalog, parse_events

log = logging.getLogger(__name__)
Listener = Callable[[RefreshEvent], None]
Malformed = Callable[[int], None]


def _events(rows: DataFrame) -> list[RefreshEvent]:
    """One row a catalog and kind at most."""
    return [RefreshEvent(r.catalog_name, r.source_node_id, r.version, r.hash, r.timestamp, r.kind) for r in rows.select("catalog_name", "source_node_id", "version", "hash", "timestamp", "kind").collect()]


class _Streamed:
    """A streaming source of event texts, which comes down to the last of each catalog in each batch."""

    def __init__(self, spark: SparkSession, checkpoint: str, every: str):
        self.spark, self.checkpoint, self.every, self.stream = spark, checkpoint, every, None

    @property
    def running(self) -> bool:
        return self.stream is not None

    def lines(self) -> DataFrame:
        raise NotImplementedError

    def subscribe(self, listener: Listener, malformed: Malformed | None = None) -> None:
        def handle(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                good = parse_events(batch)
                if malformed and (bad := batch.count() - good.count()):
                    malformed(bad)
                for event in _events(latest_per_catalog(good)):
                    listener(event)
            finally:
                batch.unpersist()

        self.stream = self.lines().writeStream.foreachBatch(handle).option("checkpointLocation", self.checkpoint).trigger(processingTime=self.every).start()

    def drain(self) -> None:
        """Waits until all events published so far were passed on."""
        self.stream.processAllAvailable()

    def stop(self) -> None:
        if self.stream is not None:
            self.stream.stop()
            self.stream = None

    def _need_running(self) -> None:
        if not self.running:
            raise RuntimeError("this transport isn't running")


class FileSync(_Streamed):
    """Events as files in a folder that all nodes share."""

    def __init__(self, spark: SparkSession, folder: str, checkpoint: str, every: str = "1 second"):
        super().__init__(spark, checkpoint, every)
        self.folder = folder
        os.makedirs(folder, exist_ok=True)

    def lines(self) -> DataFrame:
        return self.spark.readStream.schema("value string").option("latestFirst", "false").text(self.folder)

    def publish(self, event: RefreshEvent) -> None:
        self._need_running()
        name = f"{uuid.uuid4().hex}.json"
        with open(f"{self.folder}/.{name}", "w") as file:
            file.write(event.to_json() + "\n")
        os.rename(f"{self.folder}/.{name}", f"{self.folder}/{name}")


class KafkaSync(_Streamed):
    """Events as records of a topic, keyed by catalog. Every node reads all from the latest on. Needs
    Spark's Kafka connector on the class path."""

    def __init__(self, spark: SparkSession, servers: str, topic: str, checkpoint: str, every: str = "1 second", **options: str):
        super().__init__(spark, checkpoint, every)
        self.options = {"kafka.bootstrap.servers": servers, **options}
        self.topic = topic

    def read_options(self) -> dict[str, str]:
        return self.options | {"subscribe": self.topic, "startingOffsets": "latest", "failOnDataLoss": "false"}

    def lines(self) -> DataFrame:
        return self.spark.readStream.format("kafka").options(**self.read_options()).load().select(F.col("value").cast("string").alias("value"))

    def record(self, event: RefreshEvent) -> DataFrame:
        return self.spark.createDataFrame([(event.catalog_name, event.to_json())], "key string, value string")

    def publish(self, event: RefreshEvent) -> None:
        self._need_running()
        self.record(event).write.format("kafka").options(**self.options).option("topic", self.topic).save()


class TableSync:
    """The last event of each catalog as a row of a table that is polled; a change of the hash is an
    event. Requests aren't kept. read returns the table; write takes one row and replaces its
    catalog's. While there is a listener the table is polled every so many seconds, the first time after
    as many; an error of one poll doesn't end them."""

    def __init__(self, spark: SparkSession, read: Callable[[], DataFrame], write: Callable[[RefreshEvent], None], every: float = 15):
        if every <= 0:
            raise ValueError("a table is polled every so many seconds")
        self.spark, self.read, self.write, self.every, self.seen, self.listener = spark, read, write, every, {}, None
        self._ended, self._lock = threading.Event(), threading.Lock()

    @classmethod
    def folder(cls, spark: SparkSession, path: str, every: float = 15) -> TableSync:
        """A table of one file a catalog, replaced as a whole."""
        os.makedirs(path, exist_ok=True)

        def write(event: RefreshEvent) -> None:
            with open(f"{path}/.{event.catalog_name}.new", "w") as file:
                json.dump({"value": event.to_json()}, file)
            os.replace(f"{path}/.{event.catalog_name}.new", f"{path}/{event.catalog_name}.json")

        return cls(spark, lambda: parse_events(spark.read.schema("value string").json(path)), write, every)

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, table: str = "catalog_sync", every: float = 15, **properties: str) -> TableSync:
        """A table of a database, made if it isn't there. A row is updated, else inserted, else, when
        another node inserted it meanwhile, updated."""
        if not re.fullmatch(r"\w+(\.\w+)?", table):
            raise ValueError(f"{table!r} can't name a table")
        jvm = spark.sparkContext._jvm

        def run(statement: str, *values) -> int:
            found = jvm.java.util.Properties()
            for name, value in properties.items():
                found.setProperty(name, value)
            connection = jvm.java.sql.DriverManager.getConnection(url, found)
            try:
                prepared = connection.prepareStatement(statement)
                for i, value in enumerate(values, 1):
                    prepared.setObject(i, value)
                prepared.execute()
                return prepared.getUpdateCount()
            finally:
                connection.close()

        def write(event: RefreshEvent) -> None:
            when = event.timestamp.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")
            change = (event.source_node_id, event.version, event.hash, jvm.java.sql.Timestamp.valueOf(when), event.catalog_name)
            update = f"UPDATE {table} SET source_node_id = ?, version = ?, hash = ?, updated_at = ? WHERE catalog_name = ?"
            if run(update, *change):
                return
            try:
                run(f"INSERT INTO {table} (source_node_id, version, hash, updated_at, catalog_name) VALUES (?, ?, ?, ?, ?)", *change)
            except Exception:
                if not run(update, *change):
                    raise

        def read() -> DataFrame:
            rows = spark.read.format("jdbc").options(url=url, dbtable=table, **properties).load()
            rows = rows.toDF(*(c.lower() for c in rows.columns))
            return rows.select("catalog_name", "source_node_id", "version", "hash", F.col("updated_at").alias("timestamp"), F.lit(EVENT).alias("kind"))

        if "driver" in properties:
            jvm.java.lang.Class.forName(properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        try:
            run(f"SELECT catalog_name FROM {table} WHERE 1 = 0")
        except Exception:
            run(f"CREATE TABLE {table} (catalog_name VARCHAR(255) NOT NULL PRIMARY KEY, source_node_id VARCHAR(255), version BIGINT, hash VARCHAR(255), updated_at TIMESTAMP)")
        return cls(spark, read, write, every)

    def publish(self, event: RefreshEvent) -> None:
        if event.kind != EVENT:
            return
        try:
            self.write(event)
        except Exception as e:
            raise CatalogError("the event wasn't written") from e

    def subscribe(self, listener: Listener, malformed: Malformed | None = None) -> None:
        self.stop()
        self.listener, self._ended = listener, threading.Event()
        threading.Thread(target=self._polls, args=(self._ended,), name="poll", daemon=True).start()

    def _polls(self, ended: threading.Event) -> None:
        while not ended.wait(self.every):
            try:
                self.poll()
            except Exception:
                if not ended.is_set():
                    log.warning("the table wasn't polled", exc_info=True)

    def poll(self) -> int:
        """Passes on what changed since the last call; a row a catalog, however many events there were."""
        with self._lock:
            changed = changes(self.read(), self.seen)
            for event in changed:
                self.seen[event.catalog_name] = event.hash
                if listener := self.listener:
                    listener(event)
            return len(changed)

    drain = poll

    def stop(self) -> None:
        self._ended.set()
        self.listener = None


def changes(rows: DataFrame, seen: dict[str, str]) -> list[RefreshEvent]:
    """Events whose hash isn't the last one known of their catalog."""
    return [e for e in _events(latest_per_catalog(rows)) if e.kind == EVENT and seen.get(e.catalog_name) != e.hash]


class HttpSync:
    """Events posted as JSON to the other nodes, which pass them on as they arrive. A node that can't
    be reached misses the event. Texts over 64 KiB are refused."""

    MOST = 64 * 1024

    def __init__(self, peers: Sequence[str], port: int = 0, path: str = "/refresh", timeout: float = 5):
        self.peers, self.port, self.path, self.timeout, self.server = list(peers), port, path, timeout, None
        self.lost = 0

    @property
    def running(self) -> bool:
        return self.server is not None

    def subscribe(self, listener: Listener, malformed: Malformed | None = None) -> None:
        most = self.MOST

        class Handler(BaseHTTPRequestHandler):
            def do_POST(self):
                try:
                    body = self.body()
                    if body is None:
                        self.close_connection = True
                        return self.answer(413)
                    event = RefreshEvent.from_json(body.decode())
                except ValueError:
                    if malformed:
                        malformed(1)
                    return self.answer(500)
                try:
                    listener(event)
                except Exception:
                    # the event arrived, whatever became of it here
                    log.warning("an event wasn't taken", exc_info=True)
                return self.answer(200)

            def body(self) -> bytes | None:
                """The body, whole or in chunks; None if it is too long."""
                if "chunked" not in self.headers.get("Transfer-Encoding", "").lower():
                    size = int(self.headers.get("Content-Length") or 0)
                    return self.rfile.read(size) if size <= most else None
                found = b""
                while size := int(self.rfile.readline(1024).split(b";")[0], 16):
                    if len(found) + size > most:
                        return None
                    found += self.rfile.read(size)
                    self.rfile.readline(1024)
                while self.rfile.readline(1024).strip():
                    pass
                return found

            def do_GET(self):
                self.answer(405)

            do_PUT = do_DELETE = do_HEAD = do_PATCH = do_GET

            def answer(self, code: int) -> None:
                self.send_response(code)
                self.send_header("Content-Length", "0")
                self.end_headers()

            def log_message(self, *_):
                """No line for each request."""

        self.server = ThreadingHTTPServer(("", self.port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def publish(self, event: RefreshEvent) -> None:
        """Posts to all peers without waiting for them."""
        if not self.running:
            raise RuntimeError("this transport isn't running")
        for peer in self.peers:
            threading.Thread(target=self._post, args=(peer, event.to_json().encode()), daemon=True).start()

    def _post(self, peer: str, body: bytes) -> None:
        try:
            request = urllib.request.Request(peer.rstrip("/") + self.path, body, {"Content-Type": "application/json"}, method="POST")
            urllib.request.urlopen(request, timeout=self.timeout).close()
        except OSError:
            self.lost += 1
            log.warning("%s wasn't reached", peer, exc_info=True)

    def stop(self) -> None:
        if self.server is not None:
            self.server.shutdown()
            self.server.server_close()
            self.server = None
