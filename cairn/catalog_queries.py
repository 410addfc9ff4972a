"""Registered queries over catalogs, with SQL for the same results."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import path_prefixes
from cairn.operators import Catalog, EqualityIndex, GraphIndex, MultiIndex, Snapshot, SortedIndex, View, many, path, simple
from cairn.operators.catalog import search
from cairn.operators.query import Compound, GraphQuery, Query
from cairn.operators.snapshot import content_hash
from cairn.sources import loaders, to_json_rows
from cairn.streaming.events import latest_per_catalog


def _catalog(name: str, sf_dir: str, indices, views=(), load=None, order_by=()) -> Catalog:
    return Catalog(name, load or loaders.parquet(f"{sf_dir}/{name}.parquet"), indices=indices, views=views, order_by=order_by)


def _lazy(catalog: Catalog, spark: SparkSession) -> Snapshot:
    return catalog.lazy(catalog._load(spark))


def orders(spark: SparkSession, sf_dir: str) -> Snapshot:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd")
    indices = [EqualityIndex("by-status", "o_orderstatus"), EqualityIndex("by-priority", "o_orderpriority"), SortedIndex("by-date", "o_orderdate"), SortedIndex("by-day", iso)]
    views = [View("summary", {"id": "o_orderkey", "priority": "o_orderpriority"})]
    return _lazy(_catalog("orders", sf_dir, indices, views, order_by=["o_orderkey"]), spark)


def part(spark: SparkSession, sf_dir: str) -> Snapshot:
    indices = [
        EqualityIndex("by-type", "p_type"), SortedIndex("by-size", "p_size"), SortedIndex("by-name", "p_name"), SortedIndex("by-brand", "p_brand"),
        MultiIndex("by-word", F.split("p_name", " ")),
    ]
    views = [View("label", {"id": "p_partkey", "label": "p_name"}), View("brand", {"id": "p_partkey", "brand": "p_brand"})]
    return _lazy(_catalog("part", sf_dir, indices, views, order_by=["p_partkey"]), spark)


def lineitem(spark: SparkSession, sf_dir: str) -> Snapshot:
    indices = [EqualityIndex("by-flag", "l_returnflag"), EqualityIndex("by-line", "l_linestatus"), SortedIndex("by-quantity", "l_quantity"), SortedIndex("by-ship", "l_shipdate")]
    return _lazy(_catalog("lineitem", sf_dir, indices), spark)


def orders_with_flags(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Orders with the distinct flags of their lines, under (flag, date path)."""

    def load(s: SparkSession) -> DataFrame:
        flags = s.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))
        rows = s.read.parquet(f"{sf_dir}/orders.parquet").join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return rows.withColumn("day_path", F.date_format("o_orderdate", "yyyy/MM/dd"))

    graph = GraphIndex("by-flag-date", [many("flag", "flags"), path("date", "day_path")], [("flag", "date"), ("date",)])
    return _lazy(_catalog("orders", sf_dir, [graph], load=load), spark)


def customers(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Customers with their region, under (region, segment)."""

    def load(s: SparkSession) -> DataFrame:
        read = lambda t: s.read.parquet(f"{sf_dir}/{t}.parquet")
        places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
        return read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))

    graph = GraphIndex("by-region", [simple("region", "r_name"), simple("segment", "c_mktsegment")], [("region", "segment")])
    return _lazy(_catalog("customer", sf_dir, [graph], [View("name", {"id": "c_custkey", "name": "c_name"})], load), spark)


def typed_orders(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Orders under fields of several types."""
    thousands = lambda: F.floor(F.col("o_totalprice") / 1000).cast("decimal(12,2)")
    fields = [simple("urgent", lambda: F.col("o_orderpriority") == "1-URGENT"), simple("year", lambda: F.year("o_orderdate")), simple("day", lambda: F.to_date("o_orderdate")), simple("thousands", thousands)]
    graph = GraphIndex("by-fields", fields, [("urgent", "year"), ("day",), ("thousands", "urgent")])
    return _lazy(_catalog("orders", sf_dir, [graph]), spark)


def _typed(by_keys: bool, **conditions):
    def run(s, d):
        query = GraphQuery(typed_orders(s, d))
        for name, values in conditions.items():
            query = query.where(name).in_(values)
        return query.execute(by_keys=by_keys).select("o_orderkey")

    return run


def _timestamp(text: str):
    from datetime import datetime

    return datetime.fromisoformat(text)


def _sizes(operator: str, *values):
    return lambda s, d: getattr(Query(part(s, d), "by-size"), operator)(*values).select("p_partkey", "p_size")


def _names(operator: str, value: str):
    return lambda s, d: getattr(Query(part(s, d), "by-name"), operator)(value).select("p_partkey", "p_name")


def _graph_keys(s, d):
    """How many orders have each key, of both hotpaths."""
    return orders_with_flags(s, d).postings("by-flag-date").groupBy(F.array_join("key", " > ").alias("key")).agg(F.count("*").alias("n"))


def _flags_in(s, d, by_keys: bool = False):
    query = GraphQuery(orders_with_flags(s, d)).where("flag").in_(["R", "A"]).and_("date").in_(["1997/06", "1998/01"])
    return query.execute(by_keys=by_keys).select("o_orderkey")


def _hash_of_parts(s, d):
    """The content hash of rows, of the same rows in another partitioning, and of the rows without one."""
    rows = part(s, d).data
    hashes = [content_hash(r, ("p_partkey",)) for r in (rows, rows.repartition(7), rows.where("p_partkey <> 1"))]
    return s.createDataFrame([tuple(hashes)], "hash string, again string, less string")


def _info(s, d):
    """What Catalog.info says of a loaded catalog."""
    catalog = _catalog("orders", d, [EqualityIndex("by-status", "o_orderstatus"), EqualityIndex("by-priority", "o_orderpriority")], [View("summary", {"id": "o_orderkey"})], order_by=["o_orderkey"])
    catalog.bootstrap(s)
    info = catalog.info()
    row = (info["catalog"], info["item_count"], info["estimated_size_bytes"], info["view_count"], ",".join(info["views"]), ",".join(sorted(i["name"] for i in info["indices"])))
    return s.createDataFrame([row], "catalog string, item_count bigint, estimated_size_bytes bigint, view_count int, views string, indices string")


def _words_of_big_parts(s, d):
    """Parts that have a word of the largest parts' names, each once, looked up in bulk in a multi index."""
    wanted = s.read.parquet(f"{d}/part.parquet").where("p_size = 50").select(F.explode(F.split("p_name", " ")).alias("key"))
    return part(s, d).search_many("by-word", wanted.where("key <> 'widget'")).select("p_brand")


def _hot_types(s, d):
    """Parts of a list of types, as one semi join."""
    wanted = s.read.parquet(f"{d}/part.parquet").where("p_size > 45").select(F.col("p_type").alias("key"))
    return part(s, d).search_many("by-type", wanted).select("p_partkey")


def _events(s, d):
    """User events read as refresh events: the last of each catalog."""
    e = s.read.parquet(f"{d}/events.parquet")
    rows = e.select(F.col("event_type").alias("catalog_name"), F.col("user_id").cast("string").alias("source_node_id"), F.col("event_id").alias("version"), F.md5(F.col("event_id").cast("string")).alias("hash"), F.col("ts").alias("timestamp"), F.lit("EVENT").alias("kind"))
    return latest_per_catalog(rows, by="version").select("catalog_name", "version", "hash")


QUERIES = {
    "search_eq": lambda s, d: search(orders(s, d), "by-status", "P").select("o_orderkey", "o_custkey", "o_orderstatus"),
    "search_unknown_index": lambda s, d: search(orders(s, d), "by-nothing", "P").select("o_orderkey"),
    "search_view": lambda s, d: search(orders(s, d), "by-status", "P", "summary"),
    "search_many": _hot_types,
    "search_many_multi": _words_of_big_parts,
    "query_equal_to": lambda s, d: Query(part(s, d), "by-size").equal_to(7).select("p_partkey", "p_name"),
    "query_between": lambda s, d: Query(orders(s, d), "by-date").between(_timestamp("1997-01-01"), _timestamp("1997-03-31")).select("o_orderkey", "o_orderdate"),
    "query_greater_than": _sizes("greater_than", 45),
    "query_greater_or_equal": _sizes("greater_or_equal", 45),
    "query_less_than": _sizes("less_than", 5),
    "query_less_or_equal": _sizes("less_or_equal", 5),
    "query_starts_with": _names("starts_with", "cold"),
    "query_ends_with": _names("ends_with", "widget"),
    "query_empty_pattern": _names("contains", ""),
    "query_contains": lambda s, d: Query(part(s, d), "by-brand").contains("#1").select("p_partkey", "p_brand"),
    "query_contains_numeric": _sizes("contains", "1"),
    "query_iso_date_contains": lambda s, d: Query(orders(s, d), "by-day").contains("-15").select("o_orderkey"),
    "query_iso_date_prefix": lambda s, d: Query(orders(s, d), "by-day").starts_with("1997-06").select("o_orderkey"),
    "query_range_view": lambda s, d: Query(part(s, d), "by-size").between(10, 12, view="label"),
    "multi_key_postings": lambda s, d: part(s, d).postings("by-word").select("p_partkey", F.col("key").alias("k")),
    "multi_key_search": lambda s, d: search(part(s, d), "by-word", "widget").select("p_partkey", "p_name"),
    "compound_eq_range": lambda s, d: Compound(lineitem(s, d)).where("by-flag").equal_to("R").and_("by-quantity").between(10, 20).execute().select("l_orderkey", "l_partkey", "l_linenumber"),
    "compound_four_way": lambda s, d: Compound(lineitem(s, d)).where("by-flag").equal_to("A").and_("by-line").equal_to("F").and_("by-quantity").greater_or_equal(40).and_("by-ship").less_than(_timestamp("1998-01-01")).execute().select("l_orderkey", "l_partkey", "l_linenumber"),
    "compound_view": lambda s, d: Compound(part(s, d)).where("by-type").equal_to("PROMO").and_("by-name").ends_with("bolt").execute("brand"),
    "compound_part": lambda s, d: Compound(part(s, d)).where("by-word").equal_to("cold").and_("by-type").equal_to("ECONOMY").execute().select("p_partkey"),
    "path_prefixes": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(path_prefixes(F.col("url"), "/")).alias("prefix")),
    "graph_keys_fan_out_path": _graph_keys,
    "graph_query_prefix": lambda s, d: GraphQuery(orders_with_flags(s, d)).where("flag").eq("R").execute().select("o_orderkey"),
    "graph_query_drilldown": lambda s, d: GraphQuery(orders_with_flags(s, d)).where("flag").eq("R").and_("date").eq("1997/06").execute().select("o_orderkey"),
    "graph_query_in": _flags_in,
    "graph_query_by_keys": lambda s, d: _flags_in(s, d, by_keys=True),
    "graph_query_view": lambda s, d: GraphQuery(customers(s, d)).where("segment").eq("MACHINERY").and_("region").eq("ASIA").execute("name"),
    "graph_query_boolean_int": _typed(False, urgent=[True], year=[1997, 1998.0, 1996.5, "1995"]),
    "graph_query_boolean_int_by_keys": _typed(True, urgent=[True], year=[1997, 1998.0, 1996.5, "1995"]),
    "graph_query_date": _typed(False, day=[date(1997, 6, 1), date(1998, 1, 15), "1996-01-01"]),
    "graph_query_date_by_keys": _typed(True, day=[date(1997, 6, 1), date(1998, 1, 15), "1996-01-01"]),
    "graph_query_decimal": _typed(False, thousands=[Decimal("150"), 151, Decimal("152.001")], urgent=[True, "false"]),
    "graph_query_decimal_by_keys": _typed(True, thousands=[Decimal("150"), 151, Decimal("152.001")], urgent=[True, "false"]),
    "index_info": lambda s, d: orders(s, d).index_info(),
    "index_size_estimate": lambda s, d: part(s, d).index_info().select("name", "estimated_size_bytes"),
    "catalog_info": _info,
    "content_hash": _hash_of_parts,
    "canonical_json": lambda s, d: to_json_rows(s.read.parquet(f"{d}/nation.parquet")),
    "event_dedup_latest": _events,
}

_KEYS = "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE"
_IN = "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y/%m') IN ('1997/06', '1998/01') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag IN ('R', 'A'))"
_URGENT = "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) IN (1997, 1998)"
_DAYS = "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) IN (DATE '1997-06-01', DATE '1998-01-15')"
_THOUSANDS = "SELECT o_orderkey FROM orders WHERE floor(o_totalprice / 1000) IN (150, 151) AND o_orderpriority = '1-URGENT'"
_TEXT_BYTES = "40 + length(k)"
_ORDER_KEYS = [("by-status", "o_orderstatus", _TEXT_BYTES), ("by-priority", "o_orderpriority", _TEXT_BYTES), ("by-date", "o_orderdate", "50"), ("by-day", "strftime(o_orderdate, '%Y-%m-%d')", _TEXT_BYTES)]
_PART_KEYS = [("by-type", "part", "p_type", _TEXT_BYTES), ("by-size", "part", "p_size", "16"), ("by-name", "part", "p_name", _TEXT_BYTES), ("by-brand", "part", "p_brand", _TEXT_BYTES), ("by-word", "part", "unnest(string_split(p_name, ' '))", _TEXT_BYTES)]


def _index(name: str, table: str, key: str, key_bytes: str) -> str:
    """SQL for one index's statistics: a hash table of its keys and lists of its entries."""
    buckets = "CAST(pow(2, ceil(log2(greatest(16, floor(count(*) / 0.75) + 1)))) AS BIGINT)"
    return f"""SELECT '{name}' AS name, CAST(count(*) AS BIGINT) AS unique_keys, CAST(sum(n) AS BIGINT) AS total_entries,
        CAST(48 + 8 * {buckets} + 72 * count(*) + sum({key_bytes}) + 8 * sum(n) AS BIGINT) AS estimated_size_bytes
        FROM (SELECT k, count(*) AS n FROM (SELECT {key} AS k FROM {table}) GROUP BY k)"""


def _hash(where: str) -> str:
    """SQL for the content hash of parts: digests of rows, of chunks of these, and of what is left."""
    fields = ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"]
    text = "'{' || " + " || ',' || ".join(f"'\"{f}\":' || CAST(to_json({f}) AS VARCHAR)" for f in fields) + " || '}'"
    digests = f"SELECT sha256({text}) AS line, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part WHERE {where}"
    chunks = f"SELECT place // 10000 AS chunk, sha256(string_agg(line, chr(10) ORDER BY place)) AS line FROM ({digests}) GROUP BY 1"
    return f"SELECT sha256(string_agg(line, chr(10) ORDER BY chunk)) FROM ({chunks})"


SQL = {
    "search_eq": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'",
    "search_unknown_index": "SELECT o_orderkey FROM orders WHERE false",
    "search_view": "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'P'",
    "search_many": "SELECT p_partkey FROM part WHERE p_type IN (SELECT p_type FROM part WHERE p_size > 45)",
    "query_equal_to": "SELECT p_partkey, p_name FROM part WHERE p_size = 7",
    "query_between": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-03-31'",
    "query_greater_than": "SELECT p_partkey, p_size FROM part WHERE p_size > 45",
    "query_greater_or_equal": "SELECT p_partkey, p_size FROM part WHERE p_size >= 45",
    "query_less_than": "SELECT p_partkey, p_size FROM part WHERE p_size < 5",
    "query_less_or_equal": "SELECT p_partkey, p_size FROM part WHERE p_size <= 5",
    "query_starts_with": "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'cold')",
    "query_ends_with": "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'widget')",
    "query_empty_pattern": "SELECT p_partkey, p_name FROM part WHERE false",
    "query_contains": "SELECT p_partkey, p_brand FROM part WHERE contains(p_brand, '#1')",
    "query_contains_numeric": "SELECT p_partkey, p_size FROM part WHERE contains(CAST(p_size AS VARCHAR), '1')",
    "query_iso_date_contains": "SELECT o_orderkey FROM orders WHERE contains(strftime(o_orderdate, '%Y-%m-%d'), '-15')",
    "query_iso_date_prefix": "SELECT o_orderkey FROM orders WHERE starts_with(strftime(o_orderdate, '%Y-%m-%d'), '1997-06')",
    "query_range_view": "SELECT p_partkey AS id, p_name AS label FROM part WHERE p_size BETWEEN 10 AND 12",
    "multi_key_postings": "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS k FROM part",
    "multi_key_search": "SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, unnest(string_split(p_name, ' ')) AS k FROM part) WHERE k = 'widget'",
    "compound_eq_range": f"{_KEYS} l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 20",
    "compound_four_way": f"{_KEYS} l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity >= 40 AND l_shipdate < TIMESTAMP '1998-01-01'",
    "compound_view": "SELECT p_partkey AS id, p_brand AS brand FROM part WHERE p_type = 'PROMO' AND ends_with(p_name, 'bolt')",
    "compound_part": "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'cold') AND p_type = 'ECONOMY'",
    "path_prefixes": """
        WITH s AS (SELECT page_id, list_filter(string_split(url, '/'), lambda x: x <> '') AS s FROM pages)
        SELECT page_id, array_to_string(s[1:i], '/') AS prefix FROM (SELECT page_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""",
    "graph_keys_fan_out_path": """
        WITH f AS (SELECT DISTINCT l_orderkey, l_returnflag AS flag FROM lineitem),
        p AS (SELECT o_orderkey, unnest([strftime(o_orderdate,'%Y'), strftime(o_orderdate,'%Y/%m'), strftime(o_orderdate,'%Y/%m/%d')]) AS d FROM orders)
        SELECT flag || ' > ' || d AS key, CAST(count(*) AS BIGINT) AS n FROM f JOIN p ON l_orderkey = o_orderkey GROUP BY 1
        UNION ALL SELECT flag, CAST(count(*) AS BIGINT) FROM f JOIN orders ON l_orderkey = o_orderkey GROUP BY flag
        UNION ALL SELECT d, CAST(count(*) AS BIGINT) FROM p GROUP BY d""",
    "graph_query_prefix": "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "graph_query_drilldown": "SELECT o_orderkey FROM orders WHERE starts_with(strftime(o_orderdate, '%Y/%m/%d') || '/', '1997/06/') AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')",
    "graph_query_in": _IN,
    "graph_query_by_keys": _IN,
    "graph_query_view": "SELECT c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_mktsegment = 'MACHINERY'",
    "search_many_multi": """
        WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS k FROM part WHERE p_size = 50)
        SELECT p_brand FROM part WHERE EXISTS (SELECT 1 FROM w WHERE k <> 'widget' AND list_contains(string_split(p_name, ' '), k))""",
    "graph_query_boolean_int": _URGENT,
    "graph_query_boolean_int_by_keys": _URGENT,
    "graph_query_date": _DAYS,
    "graph_query_date_by_keys": _DAYS,
    "graph_query_decimal": _THOUSANDS,
    "graph_query_decimal_by_keys": _THOUSANDS,
    "index_info": " UNION ALL ".join(_index(n, "orders", k, b) for n, k, b in _ORDER_KEYS),
    "index_size_estimate": "SELECT name, estimated_size_bytes FROM (" + " UNION ALL ".join(_index(n, t, k, b) for n, t, k, b in _PART_KEYS) + ")",
    "catalog_info": f"""SELECT 'orders' AS catalog, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS item_count, CAST(sum(estimated_size_bytes) AS BIGINT) AS estimated_size_bytes,
        CAST(1 AS INTEGER) AS view_count, 'summary' AS views, string_agg(name, ',' ORDER BY name) AS indices
        FROM ({" UNION ALL ".join(_index(n, "orders", k, b) for n, k, b in _ORDER_KEYS[:2])})""",
    "content_hash": f"SELECT ({_hash('true')}) AS hash, ({_hash('true')}) AS again, ({_hash('p_partkey <> 1')}) AS less",
    "canonical_json": """SELECT '{"n_name":' || to_json(n_name) || ',"n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}' AS value FROM nation""",
    "event_dedup_latest": "SELECT event_type AS catalog_name, max(event_id) AS version, md5(CAST(max(event_id) AS VARCHAR)) AS hash FROM events GROUP BY event_type",
}
