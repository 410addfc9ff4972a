"""URL filters by dated lists: each capture is judged by the entries active when it was fetched.

A list is a table of events: on a date a key is added to it or removed. Keys are hosts, which stand
for themselves and every host below them, or a host and the first segments of a path. The events of a
key become validity intervals, from an addition up to the next removal. As they don't overlap, the
as-of join of captures is an equality join on the keys that a url falls under, with the interval as
further condition, and finds one interval a key at most. Captures of a host that holds most rows are
split by the join as any skewed key; nothing is collected by key.

Additions of a key that is listed, and removals of one that isn't, change nothing; on one date
removals come first. Intervals hold their first moment and not their last. Of several active entries
the longest key is named, a host before a path. Events without key, kind or date are left out.
Captures without url or time, or without a host in the url, are never blocked. Schemes, user, port,
query and fragment don't count; hosts are compared in lower case without a final dot, paths as they
are, without empty segments. Rows that repeat are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch

_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"\.$", "")


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """kind, key, since and until (null: still listed) of events (kind, key, action, at)."""
    known = events.where("key is not null and key <> '' and at is not null and action in ('add', 'remove') and kind in ('host', 'path')").select("kind", "key", "action", "at").distinct()
    order = Window.partitionBy("kind", "key").orderBy("at", F.desc("action"))
    turns = known.withColumn("_before", F.lag("action").over(order)).where("action <> coalesce(_before, 'remove')")
    ends = turns.withColumn("until", F.lead("at").over(order)).where("action = 'add'")
    return ends.where("until is null or until > at").select("kind", "key", F.col("at").alias("since"), "until")


def keys_of(url: Column, depth: int) -> Column:
    """The keys that a url falls under, paths up to depth segments."""
    host, segments = host_of(url), F.slice(segments_of(url), 1, max(1, depth))
    labels = F.split(host, r"\.")
    count = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), count), lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, count), ".").alias("key")))
    upto = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(upto, lambda i: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")).alias("key")))
    return F.when(host != "", F.concat(hosts, paths) if depth else hosts)


def judged(captures: DataFrame, listed: DataFrame, others: list[str]) -> DataFrame:
    """others, blocked, entry (the key that blocks) and listed_since of captures (url, fetched, others).

    listed: what intervals() returns."""
    spark = captures.sparkSession
    scratch = Scratch(spark, "urls")
    listed = scratch.keep(listed, "intervals")
    # no listed path has more segments, so no key that could be listed is left out
    depth = listed.where("kind = 'path'").agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    rows = captures.select(*others, F.col("url").alias("_url"), F.col("fetched").alias("_fetched"), F.monotonically_increasing_id().alias("_row"))
    rows = scratch.keep(rows, "captures")
    asked = rows.where("_fetched is not null").select("_row", "_fetched", F.explode(keys_of(F.col("_url"), depth)).alias("_k")).select("_row", "_fetched", "_k.*")
    active = asked.join(listed, ["kind", "key"]).where("since <= _fetched and (until is null or _fetched < until)")
    first = active.groupBy("_row").agg(F.max_by(F.struct("key", "since"), F.struct(F.char_length("key"), F.when(F.col("kind") == "host", 1).otherwise(0), "key")).alias("_hit"))
    out = rows.join(first, "_row", "left")
    return out.select(*others, F.col("_hit").isNotNull().alias("blocked"), F.col("_hit.key").alias("entry"), F.col("_hit.since").alias("listed_since"))


def _number(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def events_for(pages: DataFrame) -> DataFrame:
    """A list for the synthetic pages, which have none: by a hash of its name a host is listed for
    good, listed, removed and listed again, listed with its parent domain or for one section, or not."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct().withColumn("n", _number(F.col("host")))
    day = lambda n: F.date_add(F.lit("2020-01-01").cast("date"), n.cast("int"))
    first = F.floor(F.col("n") / 5) % 700
    case, event = F.col("n") % 5, lambda kind, key, action, at: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(action).alias("action"), day(at).alias("at"))
    host, parent = F.col("host"), F.regexp_replace("host", r"^[^.]*\.", "")
    events = (
        F.when(case == 0, F.array(event("host", host, "add", first)))
        .when(case == 1, F.array(event("host", host, "add", first), event("host", host, "remove", first + 100), event("host", host, "add", first + 300)))
        .when(case == 2, F.array(event("path", F.concat(host, F.lit("/en")), "add", first)))
        .when(case == 3, F.array(event("host", parent, "add", first + 600), event("host", parent, "remove", first + 620)))
    )
    return hosts.select(F.explode(events).alias("e")).select("e.*")


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with a day of fetching, which follows from their id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("page_id") * 37 % 1400).cast("int")).alias("fetched"))


def op5(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = captures_of(pages).withColumn("day", F.col("fetched"))
    return judged(rows, intervals(events_for(pages)), ["page_id", "day"])


#: Every page beside every interval; for small tables.
OP5_SQL = r"""
WITH hosts AS (
  SELECT *, CAST('0x' || substr(md5(host), 1, 8) AS BIGINT) AS n
  FROM (SELECT DISTINCT regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host FROM pages) WHERE host <> ''
), dated AS (
  SELECT *, CAST((n // 5) % 700 AS INTEGER) AS first, regexp_replace(host, '^[^.]*\.', '') AS parent FROM hosts
), events AS (
  SELECT 'host' AS kind, host AS key, 'add' AS action, first AS d FROM dated WHERE n % 5 IN (0, 1)
  UNION SELECT 'host', host, 'remove', first + 100 FROM dated WHERE n % 5 = 1
  UNION SELECT 'host', host, 'add', first + 300 FROM dated WHERE n % 5 = 1
  UNION SELECT 'path', host || '/en', 'add', first FROM dated WHERE n % 5 = 2
  UNION SELECT 'host', parent, 'add', first + 600 FROM dated WHERE n % 5 = 3
  UNION SELECT 'host', parent, 'remove', first + 620 FROM dated WHERE n % 5 = 3
), turns AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY kind, key ORDER BY d, action DESC) AS before FROM events) WHERE action <> coalesce(before, 'remove')
), ended AS (
  SELECT kind, key, action, d AS since, lead(d) OVER (PARTITION BY kind, key ORDER BY d, action DESC) AS until FROM turns
), spans AS (
  SELECT kind, key, since, until FROM ended WHERE action = 'add' AND (until IS NULL OR until > since)
), captures AS (
  SELECT page_id, row_number() OVER () AS r, CAST(page_id * 37 % 1400 AS INTEGER) AS d,
         regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/+', '/', 'g') AS path
  FROM pages
), hits AS (
  SELECT r, arg_max({'key': key, 'since': since}, (length(key), kind = 'host', key)) AS hit
  FROM captures JOIN spans ON since <= d AND (until IS NULL OR d < until)
   AND ((kind = 'host' AND (host = key OR ends_with(host, '.' || key))) OR (kind = 'path' AND starts_with(host || path || '/', key || '/')))
  WHERE host <> '' GROUP BY r
)
SELECT page_id, DATE '2020-01-01' + d AS day, hit IS NOT NULL AS blocked, hit.key AS entry, DATE '2020-01-01' + hit.since AS listed_since
FROM captures LEFT JOIN hits USING (r)
"""
