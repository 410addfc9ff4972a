import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairn.llm import mixing


def rows_of(seed):
    rnd = random.Random(seed)
    rows = [(None, None, None), (None, "b", "x y"), (5, "a", ""), (5, "a", "")]
    for i in range(rnd.choice([3, 40, 400])):
        source = rnd.choice([None, "é", "a", "b", "B", "c" * rnd.randrange(1, 5)])
        rows.append((rnd.randrange(300), source, " \t".join(["w"] * rnd.choice([0, 1, 3, 50, 900]))))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_against_sql(spark, tmp_path, seed):
    frame = spark.createDataFrame([(*r, 1.5) for r in rows_of(seed)], "doc_id bigint, source string, text string, target double")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = mixing.op7(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, map(tuple, found))) == sorted(map(key, con.sql(mixing.OP7_SQL).fetchall()))
    sources = {}
    total = 0
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        total += r.size
    taken = sum(r.taken for r in found)
    assert abs(taken - 1.5 * total) <= len({r.target for r in found}) + 1


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id bigint, source string, size bigint")
    assert mixing.mix_sources(rows).count() == 0


def plain_targets(sizes):
    """Shares the excess again and again until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, [5, 2, 1] * len(names)))
    target, left, free = {}, 1.5 * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in free}
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_targets(spark):
    rnd = random.Random(3)
    for _ in range(4):
        sizes = {s: rnd.choice([0, 1, 10, 500, 10_000]) for s in ["a", "b", "Z", "é", "\U0001f600", None][: rnd.randrange(2, 7)]}
        rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size bigint")).collect()
        want = plain_targets(sizes)
        assert {r.source: pytest.approx(r.target) for r in rows} == want


def test_rows_that_are_equal(spark, tmp_path):
    """Most rows are equal in all columns, so that they share a key, which is dealt into slots."""
    rows = [(None, "a", "x y z")] * 3000 + [(7, None, "x")] * 500 + rows_of(4)
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = mixing.sized(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    keyed = sizes.withColumn("k", mixing.random_key(F.col("doc_id"), F.col("source"), F.col("size"))).withColumn("r", F.floor(F.col("k") / (1 << 58)))
    assert mixing.common_keys(keyed, "k", "r", 4)
    found = [tuple(r) for r in mixing.op7(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, found)) == sorted(map(key, con.sql(mixing.OP7_SQL).fetchall()))


def test_clashing_names(spark):
    names = ["_key", "_range", "_slot", "_s", "_t", "_start", "_inside", "_size", "source_size", "target", "taken"]
    rows = [(i, "ab"[i % 2], 3 + i, *range(len(names))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint, " + ", ".join(f"{n} int" for n in names))
    found = mixing.mix_sources(frame)
    assert sorted(found.columns) == sorted(frame.columns)
    plain = mixing.mix_sources(frame.select("doc_id", "source", "size"))
    assert {(r.doc_id, r.source_size, r.target) for r in found.collect()} == {(r.doc_id, r.source_size, r.target) for r in plain.collect()}
    assert all([r[n] for n in names[:8]] == list(range(8)) and 0 <= r.taken <= 2 * r.size for r in found.collect())
