import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import composite_keys, distinct_values, fan_out, key_bytes, next_power_of_two, path_prefixes, row_text


def value(spark, expression, data=((None,),), schema="a int"):
    return spark.createDataFrame(list(data), schema).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text,separator,want",
    [
        ("/deportes//futbol/", "/", ["deportes", "deportes/futbol"]),
        (None, "/", []),
        ("", "/", []),
        ("///", "/", []),
        ("a.b", ".", ["a", "a.b"]),
        ("a||b|c", "||", ["a", "a||b|c"]),
        ("a\\Eb", "\\E", ["a", "a\\Eb"]),
        ("é/😀", "/", ["é", "é/😀"]),
    ],
)
def test_path_prefixes(spark, text, separator, want):
    assert value(spark, path_prefixes(F.col("a"), separator), [(text,)], "a string") == want


def test_collections(spark):
    assert value(spark, distinct_values(F.col("a")), [([1, None, 1, 2],)], "a array<int>") == [1, 2]
    assert value(spark, distinct_values(F.col("a")), [(None,)], "a array<int>") == []
    picked = fan_out(F.col("a"), lambda e: e["c"])
    assert value(spark, picked, [([("x",), None, ("x",), (None,), ("y",)],)], "a array<struct<c:string>>") == ["x", "y"]
    assert value(spark, picked, [(None,)], "a array<struct<c:string>>") == []


def test_composite_keys(spark):
    keys = lambda *fields: value(spark, composite_keys([F.array(*map(F.lit, f)).cast("array<string>") for f in fields]))
    assert keys(["AR"], ["d", "d/f"]) == [["AR"], ["AR", "d"], ["AR", "d/f"]]
    assert keys(["AR", "BR"], ["x"], ["1", "2"]) == [["AR"], ["BR"], ["AR", "x"], ["BR", "x"], ["AR", "x", "1"], ["AR", "x", "2"], ["BR", "x", "1"], ["BR", "x", "2"]]
    assert keys(["AR"], [], ["1"]) == [["AR"]] and keys([], ["1"]) == []


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 2**29, 2**29 + 1, 2**31])
def test_next_power_of_two(spark, n):
    want = 1
    while want < n:
        want *= 2
    assert value(spark, next_power_of_two(F.lit(n).cast("long"))) == want


def test_key_bytes(spark):
    size = lambda v, kind: value(spark, key_bytes(F.col("a"), kind), [(v,)], T.StructType([T.StructField("a", kind)]))
    assert size("abc", T.StringType()) == 43 and size("a😀", T.StringType()) == 43 and size(None, T.StringType()) == 50
    assert size(7, T.LongType()) == 16 and size(dt.date(2020, 1, 1), T.DateType()) == 50
    assert size(["a", "bc"], T.ArrayType(T.StringType())) == 40 + 41 + 42


def test_row_text(spark):
    assert value(spark, row_text(["b", "a"]), [(2, "x")], "b int, a string") == '{"a":"x","b":2}'
