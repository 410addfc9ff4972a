import datetime as dt
import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import CatalogError, CatalogNotAvailable, SnapshotCorrupt
from cairn.operators import Catalog, EqualityIndex
from cairn.sources import JsonRows, SnapshotStore, from_json_rows, loaders, to_json_rows
from cairn.streaming import EVENT, REQUEST, Counters, Engine, FileLease, FileSync, HttpSync, KafkaSync, RefreshEvent, RetryPolicy, TableSync, latest_per_catalog, parse_events
from cairn.streaming.engine import Dispatcher
from cairn.streaming.metrics import Statsd

NOW = dt.datetime(2026, 1, 2, 3, 4, 5, 678901, tzinfo=dt.timezone.utc)
INDEX = [EqualityIndex("by-name", "name")]
FAST = RetryPolicy(2, dt.timedelta(0))


def event(catalog="c", node="other", version=1, hashed="h", kind=EVENT, when=NOW):
    return RefreshEvent(catalog, node, version, hashed, when, kind)


class Source:
    """Rows that a test can change."""

    def __init__(self, *names):
        self.names, self.loads, self.fail = list(names), 0, 0

    def __call__(self, spark):
        self.loads += 1
        if self.fail:
            self.fail -= 1
            raise ConnectionError("down")
        return spark.createDataFrame(list(enumerate(self.names)), "id int, name string")


def catalog(source, name="c", **more):
    return Catalog(name, load=source, indices=INDEX, order_by=["id"], **more)


def names(engine, name="c"):
    return sorted(r.name for r in engine._serving(name).data.collect())


def test_store_round_trip(spark, tmp_path):
    store, source = SnapshotStore(f"file://{tmp_path}", keep=2), Source("a", "b")
    assert store.load(spark, "c") is None
    c = catalog(source)
    first = c.bootstrap(spark)
    assert store.save(spark, first) == first.hash
    found = store.load(spark, "c")
    assert (found.hash, found.version, found.created_at) == (first.hash, 1, first.created_at)
    assert sorted(map(tuple, found.data.collect())) == [(0, "a"), (1, "b")] and found.data.schema == first.data.schema
    for n in range(3):
        source.names.append(str(n))
        store.save(spark, c.refresh(spark))
    assert store.load(spark, "c").data.count() == 5
    assert len(list(tmp_path.glob("c/manifest-*"))) == 2 == len(list(tmp_path.glob("c/v-*")))


def test_store_doubts(spark, tmp_path):
    store = SnapshotStore(f"file://{tmp_path}")
    store.save(spark, catalog(Source("a")).bootstrap(spark))
    manifest = next(tmp_path.glob("c/manifest-*"))
    whole = json.loads(manifest.read_text())
    (tmp_path / "c" / f".{manifest.name}.crc").unlink(missing_ok=True)
    manifest.write_text(json.dumps(whole | {"hash": "0"}))
    assert store.load(spark, "c") is None
    manifest.write_text(json.dumps(whole | {"rows": "v-gone"}))
    assert store.load(spark, "c") is None
    for bad in ("{", "{}", "[]"):
        manifest.write_text(bad)
        with pytest.raises(SnapshotCorrupt):
            store.load(spark, "c")
    for name in ("..", ".", "a/b", "", "a b"):
        with pytest.raises(ValueError):
            store.folder(name)


def test_json_rows(spark):
    schema = "b int, a string, m map<string,string>, t timestamp"
    rows = spark.createDataFrame([(1, "x", {"z": "1", "k": "2"}, dt.datetime(2026, 1, 1)), (None, None, None, None)], schema)
    lines = to_json_rows(rows)
    assert [r.value for r in lines.collect()] == ['{"a":"x","b":1,"m":{"k":"2","z":"1"},"t":"2026-01-01T00:00:00.000000Z"}', "{}"]
    back = from_json_rows(lines, rows.schema)
    assert [r.asDict() for r in back.collect()] == [r.asDict() for r in rows.collect()]
    for bad in ("null", None, "{"):
        with pytest.raises(Exception):
            from_json_rows(spark.createDataFrame([(bad,)], "value string"), T.StructType([T.StructField("a", T.StringType())])).collect()


def test_loaders(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    for kind in ("parquet", "orc", "json"):
        rows.write.format(kind).save(f"{tmp_path}/{kind}")
        load = getattr(loaders, kind)(f"{tmp_path}/{kind}", rows.schema)
        assert sorted(map(tuple, load(spark).select("id", "name").collect())) == [(1, "a"), (2, "b")]
    rows.write.option("header", True).csv(f"{tmp_path}/csv")
    assert loaders.csv(f"{tmp_path}/csv", rows.schema, header=True)(spark).count() == 2
    rows.createOrReplaceTempView("loaded_rows")
    assert loaders.table("loaded_rows")(spark).count() == 2
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="items", **driver).save()
    assert loaders.jdbc(url, 'select "id", "name" from items', **driver)(spark).count() == 2
    assert loaders.jdbc(url, "select * from items", ("id", 0, 10, 2), **driver)(spark).rdd.getNumPartitions() == 2


def test_event_codec():
    for e in (event(), event(kind=REQUEST, version=0, hashed="")):
        assert RefreshEvent.from_json(e.to_json()) == e
    whole = json.loads(event().to_json())
    for kind in (None, "NEWS"):
        assert RefreshEvent.from_json(json.dumps(whole | {"kind": kind})).kind == EVENT
    for field in ("catalog_name", "source_node_id", "version", "hash", "timestamp"):
        with pytest.raises(ValueError):
            RefreshEvent.from_json(json.dumps({k: v for k, v in whole.items() if k != field}))
    with pytest.raises(ValueError):
        RefreshEvent.from_json("[]")


def test_events_as_rows(spark):
    later = NOW + dt.timedelta(seconds=1)
    texts = [event(version=1).to_json(), event(version=2, when=later).to_json(), event("d", kind="odd").to_json(), event(kind=REQUEST).to_json(), "{", "", '{"catalog_name":"x"}']
    rows = parse_events(spark.createDataFrame([(t,) for t in texts], "value string"))
    assert rows.count() == 4
    assert sorted((r.catalog_name, r.kind, r.version) for r in latest_per_catalog(rows).collect()) == [("c", EVENT, 2), ("c", REQUEST, 1), ("d", EVENT, 1)]


def test_file_sync(spark, tmp_path):
    sync = FileSync(spark, f"{tmp_path}/events", f"{tmp_path}/checkpoint", "0 seconds")
    with pytest.raises(RuntimeError):
        sync.publish(event())
    got, bad = [], []
    sync.subscribe(got.append, bad.append)
    sync.publish(event("a")), sync.publish(event("b", kind=REQUEST))
    (tmp_path / "events" / "odd.json").write_text("nonsense\n")
    sync.drain()
    assert sorted((e.catalog_name, e.kind) for e in got) == [("a", EVENT), ("b", REQUEST)] and sum(bad) == 1
    sync.publish(event("a", version=7))
    sync.drain()
    assert got[-1].version == 7 and len(got) == 3
    sync.stop()
    assert not sync.running


def test_table_sync(spark, tmp_path):
    sync = TableSync.folder(spark, f"{tmp_path}/t")
    got = []
    sync.subscribe(got.append)
    sync.publish(event(kind=REQUEST))
    assert sync.poll() == 0
    sync.publish(event(hashed="1")), sync.publish(event(hashed="2")), sync.publish(event("d", hashed="1"))
    assert sync.poll() == 2 and {(e.catalog_name, e.hash) for e in got} == {("c", "2"), ("d", "1")}
    sync.publish(event(hashed="2", version=9))
    assert sync.poll() == 0
    sync.publish(event(hashed="3"))
    assert sync.poll() == 1 and got[-1].hash == "3"
    with pytest.raises(CatalogError):
        TableSync(spark, lambda: None, lambda e: 1 / 0).publish(event())


def test_jdbc_table(spark, tmp_path):
    url, driver = f"jdbc:derby:{tmp_path}/sync;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    one, two = (TableSync.jdbc(spark, url, driver=driver) for _ in range(2))
    got = []
    two.subscribe(got.append)
    one.publish(event(hashed="1")), one.publish(event(kind=REQUEST)), one.publish(event("d", hashed="1")), one.publish(event(hashed="2", version=5))
    assert two.poll() == 2 and {(e.catalog_name, e.hash, e.version) for e in got} == {("c", "2", 5), ("d", "1", 1)}
    assert two.poll() == 0
    with pytest.raises(ValueError):
        TableSync.jdbc(spark, url, "x; drop table y")


def test_http_sync():
    import http.client
    import time

    got, bad = [], []
    one, two = HttpSync([]), HttpSync([])
    with pytest.raises(RuntimeError):
        one.publish(event())
    one.subscribe(lambda e: None), two.subscribe(lambda e: got.append(e) if e.catalog_name != "odd" else 1 / 0, bad.append)
    one.peers = [f"http://127.0.0.1:{two.port}", "http://127.0.0.1:1"]
    one.publish(event())
    for _ in range(100):
        if got and one.lost:
            break
        time.sleep(0.05)
    assert got == [event()] and one.lost == 1

    def status(method, body):
        connection = http.client.HTTPConnection("127.0.0.1", two.port, timeout=5)
        connection.request(method, "/refresh", body)
        return connection.getresponse().status

    assert [status("GET", None), status("POST", "x"), status("POST", event("odd").to_json())] == [405, 500, 200] and bad == [1]
    connection = http.client.HTTPConnection("127.0.0.1", two.port, timeout=5)
    connection.request("POST", "/refresh", iter([event("chunks").to_json().encode()[:20], event("chunks").to_json().encode()[20:]]), encode_chunked=True, headers={"Transfer-Encoding": "chunked"})
    assert connection.getresponse().status == 200 and got[-1] == event("chunks")
    connection = http.client.HTTPConnection("127.0.0.1", two.port, timeout=5)
    connection.request("POST", "/refresh", iter([b"x" * HttpSync.MOST, b"x"]), encode_chunked=True, headers={"Transfer-Encoding": "chunked"})
    assert connection.getresponse().status == 413
    connection = http.client.HTTPConnection("127.0.0.1", two.port, timeout=5)
    connection.putrequest("POST", "/refresh")
    connection.putheader("Content-Length", str(HttpSync.MOST + 1))
    connection.endheaders()
    assert connection.getresponse().status == 413
    one.stop(), two.stop()
    assert not two.running


def test_kafka_options(spark):
    sync = KafkaSync(spark, "h:9092", "t", "/tmp/none", **{"kafka.security.protocol": "SSL"})
    assert sync.read_options() == {"kafka.bootstrap.servers": "h:9092", "kafka.security.protocol": "SSL", "subscribe": "t", "startingOffsets": "latest", "failOnDataLoss": "false"}
    row = sync.record(event()).first()
    assert row.key == "c" and RefreshEvent.from_json(row.value) == event()


def test_lifecycle(spark):
    engine = Engine(spark, retry=FAST, node_id="n")
    source = Source("a")
    engine.register(catalog(source))
    with pytest.raises(ValueError):
        engine.register(catalog(source))
    with pytest.raises(RuntimeError):
        engine.refresh("c")
    engine.start()
    for again in (engine.start, lambda: engine.register(catalog(source, "d"))):
        with pytest.raises(RuntimeError):
            again()
    source.names.append("b")
    assert engine.refresh("c").version == 2 and engine.search("c", "by-name", "b").count() == 1
    assert engine.query("c", "by-name").equal_to("a").count() == 1 == engine.compound("c").where("by-name").equal_to("a").execute().count()
    with pytest.raises(ValueError):
        engine.search("x", "by-name", "b")
    status = engine.status().first()
    assert (status.catalog, status.available, status.version, status.item_count, status.failed) == ("c", True, 2, 2, False)
    assert engine.info("c")["item_count"] == 2
    engine.stop(), engine.stop()
    assert engine.search("c", "by-name", "b").count() == 1
    with pytest.raises(RuntimeError):
        engine.refresh("c")


def test_retry_and_failure(spark):
    metrics, waits = Counters(), []
    shaky, broken = Source("a"), Source("b")
    shaky.fail, broken.fail = 1, 99
    engine = Engine(spark, retry=RetryPolicy(3, dt.timedelta(seconds=2)), metrics=metrics, sleep=waits.append)
    engine.register(catalog(shaky, "s")).register(catalog(broken, "b")).start()
    assert names(engine, "s") == ["a"] and shaky.loads == 2 and broken.loads == 3 and waits == [2.0] * 3
    with pytest.raises(CatalogNotAvailable):
        engine.search("b", "by-name", "b")
    assert {r.catalog: r.available for r in engine.status().collect()} == {"s": True, "b": False}
    assert metrics.counts["catalog_failed", ("catalog", "b")] == 1
    broken.fail = 0
    engine.refresh("b")
    assert names(engine, "b") == ["b"]
    engine.stop()
    with pytest.raises(ValueError):
        RetryPolicy(0)


class Follower:
    def __init__(self, leads=False):
        self.leads = leads

    def start(self): ...

    def stop(self): ...

    def is_leader(self):
        return self.leads


class Wire:
    """Passes events on at once."""

    def __init__(self):
        self.sent, self.listeners = [], []

    def publish(self, e):
        self.sent.append(e)
        for listener in self.listeners:
            listener(e)

    def subscribe(self, listener, malformed=None):
        self.listeners.append(listener)

    def stop(self): ...


def test_two_nodes(spark, tmp_path):
    """The leader saves and publishes; the follower takes its snapshot, and asks for a new one."""
    wire, source = Wire(), Source("a")
    store = SnapshotStore(f"file://{tmp_path}")
    other = Source("never")
    lead = Engine(spark, store, wire, retry=FAST, node_id="lead").register(catalog(source)).start()
    follow = Engine(spark, store, wire, Follower(), FAST, node_id="follow").register(catalog(other)).start()
    assert names(follow) == ["a"] and other.loads == 0
    source.names.append("b")
    lead.refresh_and_sync("c")
    follow.drain()
    assert names(follow) == ["a", "b"] and [e.kind for e in wire.sent] == [EVENT]
    source.names.append("c")
    assert follow.refresh_and_sync("c") is None
    lead.drain(), follow.drain()
    assert names(lead) == names(follow) == ["a", "b", "c"]
    assert [(e.kind, e.source_node_id) for e in wire.sent[1:]] == [(REQUEST, "follow"), (EVENT, "lead")]
    count = len(wire.sent)
    lead.drain(), follow.drain()
    assert len(wire.sent) == count and other.loads == 0
    lead.stop(), follow.stop()


def test_events_that_change_nothing(spark):
    source = Source("a")
    engine = Engine(spark, retry=FAST, node_id="me").register(catalog(source)).start()
    same = engine.catalogs["c"].snapshot.hash
    for e in (event("unknown"), event(node="me"), event(hashed=same)):
        assert not engine.receive(e)
    engine.leader = Follower()
    assert not engine.receive(event(kind=REQUEST))
    assert engine.receive(event(hashed="new"))
    engine.drain()
    assert source.loads == 2
    engine.stop()
    assert not engine.receive(event(hashed="newer"))


def test_a_broken_transport_or_store_loses_no_refresh(spark):
    class Broken:
        def publish(self, e):
            raise OSError

        def subscribe(self, listener, malformed=None): ...

        def stop(self): ...

        def load(self, spark, name):
            raise OSError

        save = load

    metrics = Counters()
    engine = Engine(spark, Broken(), Broken(), retry=FAST, metrics=metrics).register(catalog(Source("a"))).start()
    assert engine.refresh_and_sync("c").version == 2
    assert metrics.counts["sync_publish_failed", ("catalog", "c")] == 1 and metrics.counts["save_failed", ("catalog", "c")] == 2
    engine.stop()


def test_follower_becomes_leader(spark, tmp_path):
    leader, source = Follower(), Source("a")
    engine = Engine(spark, SnapshotStore(f"file://{tmp_path}"), None, leader, FAST, sleep=lambda s: setattr(leader, "leads", True))
    engine.register(catalog(source)).start()
    assert source.loads == 1 and names(engine) == ["a"]
    engine.stop()


def test_scheduled_refresh(spark):
    source, done = Source("a"), threading.Event()
    engine = Engine(spark, retry=FAST).register(catalog(source, refresh_every=dt.timedelta(milliseconds=200), hooks=[lambda rows: done.set() if source.loads > 2 else None])).start()
    assert done.wait(30)
    engine.stop()


def test_dispatcher_coalesces():
    go, ran = threading.Event(), []

    def run(name, e):
        go.wait(10)
        ran.append(e)

    d = Dispatcher(run)
    for n in range(5):
        d.dispatch("a", n)
    go.set()
    d.drain()
    assert ran == [0, 4]
    d.dispatch("a", 9)
    d.drain()
    assert ran[-1] == 9
    d.stop()


def test_file_lease(tmp_path):
    clock = [0.0]
    one, two = (FileLease(f"{tmp_path}/lease", n, 15, lambda: clock[0]) for n in ("one", "two"))
    told = []
    two.on_change(told.append)
    one.start(), two.start()
    assert one.is_leader() and not two.is_leader()
    clock[0] = 10.5
    assert not one.is_leader() and not two.renew()
    clock[0] = 16
    assert two.renew() and not one.renew() and told == [True]
    two.stop()
    assert one.renew() and told == [True, False]


def test_statsd_lines():
    sent = []
    s = Statsd(sent.append)
    s.count("refreshed", catalog="c", a="b"), s.gauge("seconds", 1.5)
    assert sent == [b"cairn.refreshed:1|c|#a:b,catalog:c", b"cairn.seconds:1.5|g"]


def test_streaming_events_reach_an_engine(spark, tmp_path):
    source = Source("a")
    sync = FileSync(spark, f"{tmp_path}/e", f"{tmp_path}/k", "0 seconds")
    engine = Engine(spark, None, sync, retry=FAST, node_id="n").register(catalog(source)).start()
    source.names.append("b")
    sync.publish(event(hashed="x")), sync.publish(event(hashed="y"))
    sync.drain(), engine.drain()
    assert names(engine) == ["a", "b"]
    assert spark.range(1).select(F.lit(1)).count() == 1
    engine.stop()


def test_a_polled_table_reaches_an_engine(spark, tmp_path):
    """Nothing calls poll(): the transport does by itself, also after a poll that failed."""
    source, sync = Source("a"), TableSync.folder(spark, f"{tmp_path}/t", every=0.3)
    read, fails = sync.read, [1]
    sync.read = lambda: read() if not fails or fails.pop() > 1 else 1 / 0
    engine = Engine(spark, None, sync, retry=FAST, node_id="n").register(catalog(source)).start()
    source.names.append("b")
    sync.publish(event(hashed="x"))
    deadline = time.monotonic() + 60
    while names(engine) != ["a", "b"] and time.monotonic() < deadline:
        time.sleep(0.1)
    assert names(engine) == ["a", "b"] and not fails
    engine.stop()
    assert sync.listener is None
    with pytest.raises(ValueError):
        TableSync.folder(spark, f"{tmp_path}/t", every=0)


def test_a_leader_goes_on_leading(tmp_path):
    one, two = (FileLease(f"{tmp_path}/lease", n, 0.6) for n in ("one", "two"))
    one.start(), two.start()
    deadline = time.monotonic() + 1.8
    led = []
    while time.monotonic() < deadline:
        led.append((one.is_leader(), two.is_leader()))
        time.sleep(0.05)
    assert not any(b for _, b in led) and sum(a for a, _ in led) > 0.8 * len(led)
    one.stop()
    deadline = time.monotonic() + 5
    while not two.is_leader() and time.monotonic() < deadline:
        time.sleep(0.05)
    assert two.is_leader() and not one.is_leader()
    two.stop()


def test_refreshes_keep_their_rate(spark, monkeypatch):
    """A refresh that takes most of the period doesn't put off the next one."""
    began = []

    def slow(s):
        began.append(time.monotonic())
        time.sleep(0.35 if len(began) > 1 else 0)
        return s.createDataFrame([(0, "a")], "id int, name string")

    monkeypatch.setattr(Engine, "refresh_and_sync", lambda self, name: slow(self.spark))
    engine = Engine(spark, retry=FAST).register(catalog(slow, refresh_every=dt.timedelta(milliseconds=500))).start()
    time.sleep(3.3)
    engine.stop()
    steps = [b - a for a, b in zip(began[1:], began[2:])]
    assert len(steps) >= 3 and sum(steps) / len(steps) < 0.65


def test_restored_rows_are_hashed_once(spark, tmp_path, monkeypatch):
    store = SnapshotStore(f"file://{tmp_path}")
    first = catalog(Source("a", "b")).bootstrap(spark)
    store.save(spark, first)
    found = store.load(spark, "c")
    monkeypatch.setattr("cairn.operators.catalog.content_hash", lambda *a: 1 / 0)
    again = catalog(Source("never"))
    assert again.refresh(spark, found.data, found.hash).hash == first.hash and again.snapshot.data.count() == 2


def test_snapshots_as_json(spark, tmp_path):
    """Another form of a snapshot's files; the store itself doesn't know what it is."""
    store = SnapshotStore(f"file://{tmp_path}", codec=JsonRows())
    rows = spark.createDataFrame([(0, "a"), (1, None)], "id int, name string")
    plain = Catalog("d", data=rows, indices=INDEX, order_by=["id"]).bootstrap(spark)
    store.save(spark, plain)
    assert list(tmp_path.glob("d/v-*/*.json*")) and not list(tmp_path.glob("d/v-*/*.parquet"))
    found = store.load(spark, "d")
    assert found.hash == plain.hash and sorted(map(tuple, found.data.collect())) == [(0, "a"), (1, None)]


def test_maps_in_order_at_any_depth(spark):
    schema = "b struct<z:map<string,int>,a:array<map<string,int>>>, m map<string,map<string,int>>"
    rows = spark.createDataFrame([(({"y": 1, "x": 2}, [{"d": 1, "c": 2}, None]), {"k": {"b": 1, "a": 2}, "j": None}), (None, None), ((None, None), {})], schema)
    lines = [r.value for r in to_json_rows(rows).collect()]
    assert lines[0] == '{"b":{"a":[{"c":2,"d":1},null],"z":{"x":2,"y":1}},"m":{"j":null,"k":{"a":2,"b":1}}}' and lines[1:] == ["{}", '{"b":{},"m":{}}']


def test_gauges_are_polled(spark):
    metrics = Counters()
    broken = Source("x")
    broken.fail = 99
    engine = Engine(spark, retry=FAST, metrics=metrics, node_id="n", gauges_every=dt.timedelta(milliseconds=200))
    engine.register(catalog(Source("a", "b"))).register(catalog(broken, "x")).start()
    deadline = time.monotonic() + 60
    while ("item_count", ("catalog", "c")) not in metrics.gauges and time.monotonic() < deadline:
        time.sleep(0.1)
    engine.stop()
    assert metrics.gauges["item_count", ("catalog", "c")] == 2 and metrics.gauges["version", ("catalog", "c")] == 1
    assert metrics.gauges["available", ("catalog", "c")] == 1 and metrics.gauges["available", ("catalog", "x")] == 0
