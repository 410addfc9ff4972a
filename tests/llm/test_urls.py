import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import urls

DAY = lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)


@pytest.mark.parametrize(
    "url,depth,keys",
    [
        (None, 2, None),
        ("", 2, None),
        ("no host", 2, None),
        ("http:///x", 2, None),
        ("https://u:p@A.b.C:80/x//y/z?q#f", 2, ["a.b.c", "b.c", "c", "a.b.c/x", "a.b.c/x/y"]),
        ("//h./", 2, ["h"]),
        ("http://h/x", 0, ["h"]),
        ("http://h?x=//y/z", 3, ["h"]),
        ("http://" + "a." * 300 + "org/" + "s/" * 20_000, 1, None),
    ],
)
def test_keys(spark, url, depth, keys):
    found = spark.createDataFrame([(url,)], "url string").select(urls.keys_of(F.col("url"), depth).alias("k")).first().k
    if url and len(url) > 1000:
        assert len(found) == 302
    else:
        assert (found and [k.key for k in found]) == keys


def plain_intervals(events):
    out, state = [], {}
    for key in {(k, n) for k, n, _, _ in events if k and n}:
        since = None
        for at, action in sorted(((a, x) for k, n, x, a in events if (k, n) == key and a), key=lambda e: (e[0], e[1] == "add")):
            if action == "add" and since is None:
                since = at
            elif action == "remove" and since is not None:
                if at > since:
                    out.append((*key, since, at))
                since = None
        if since is not None:
            out.append((*key, since, None))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_loops(spark, seed):
    rnd = random.Random(seed)
    hosts = ["a.org", "www.a.org", "b.net", "x.b.net", "org"]
    events = [(rnd.choice(["host", "path"]), rnd.choice(hosts), rnd.choice(["add", "remove"]), DAY(rnd.randrange(12))) for _ in range(40)]
    events = [(k, h + rnd.choice(["/x", "/x/y"]) if k == "path" else h, a, t) for k, h, a, t in events]
    events += [("host", None, "add", DAY(0)), ("host", "b.net", "add", None), (None, "b.net", "add", DAY(0)), ("host", "", "add", DAY(0)), events[0]]
    captures = [(i, f"http://{rnd.choice(hosts)}/{rnd.choice(['', 'x', 'x/y/z', 'xx'])}", DAY(rnd.randrange(-1, 14))) for i in range(200)]
    captures += [(900, None, DAY(3)), (901, "http://a.org/", None), (None, "http://b.net/x", DAY(5)), captures[0]]
    listed = urls.intervals(spark.createDataFrame(events, "kind string, key string, action string, at date"))
    spans = plain_intervals(events)
    assert sorted(map(str, map(tuple, listed.collect()))) == sorted(map(str, spans))
    want = []
    for i, url, t in captures:
        best = None
        if url and t:
            host, path = url[7:].split("/", 1)
            for kind, key, since, until in spans:
                under = host == key or host.endswith("." + key) if kind == "host" else f"{host}/{path}/".startswith(key + "/")
                if under and since <= t and (until is None or t < until):
                    best = max(best or (0,), (len(key), kind == "host", key, since))
        want.append((i, best is not None, best and best[2], best and best[3]))
    frame = spark.createDataFrame(captures, "page_id bigint, url string, fetched date")
    found = urls.judged(frame, listed, ["page_id"])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert urls.judged(frame.limit(0), listed, ["page_id"]).count() == 0
    assert urls.judged(frame, listed.limit(0), ["page_id"]).where("blocked").count() == 0
