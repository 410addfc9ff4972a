"""Expressions for keys: paths, fan-outs, composite keys and their sizes. All run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings() -> Column:
    return F.array().cast("array<string>")


def path_prefixes(path: Column, separator: str = "/") -> Column:
    """Every leading path of whole segments: 'a//b/' -> ['a', 'a/b']. Empty segments don't count;
    null and empty paths have none. The separator is taken literally."""
    if not separator:
        raise ValueError("a path needs a separator")
    segments = F.filter(F.split(path, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, 1, i), separator))
    return F.when(path.isNotNull() & (F.size(segments) > 0), prefixes).otherwise(_strings())


def distinct_values(values: Column) -> Column:
    """The distinct values of an array that aren't null; none for a null array."""
    return F.coalesce(F.array_distinct(F.filter(values, lambda x: x.isNotNull())), F.array())


def fan_out(collection: Column, pick: Callable[[Column], Column]) -> Column:
    """The distinct values that pick takes from a collection's elements, without nulls."""
    return distinct_values(F.transform(collection, pick))


def composite_keys(fields: Sequence[Column]) -> Column:
    """All keys of all leading fields, each an array of text: for fields (a, b) the keys (a) and
    (a, b) for every pair of their values. A field without values ends the keys that go through it."""
    text = [F.transform(f, lambda x: x.cast("string")) for f in fields]
    levels = [F.transform(text[0], lambda x: F.array(x))]
    for values in text[1:]:
        levels.append(_longer(levels[-1], values))
    return F.array_distinct(F.concat(*levels))


def _longer(keys: Column, values: Column) -> Column:
    return F.flatten(F.transform(keys, lambda key: F.transform(values, lambda x: F.concat(key, F.array(x)))))


def text_of(value: Column) -> Column:
    return value.cast("string")


def next_power_of_two(value: Column) -> Column:
    """The least power of two that is at least value (1 or more); by bit length, since logarithms round."""
    return F.when(value <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin((value - 1).cast("long")))))


def key_bytes(key: Column, kind: T.DataType) -> Column:
    """Estimated heap size of a key: text 40 and its UTF-16 units, numbers 16, composite keys 40 and
    their parts, anything else 50."""
    if isinstance(kind, T.StringType):
        # two units for each character beyond U+FFFF, whose UTF-8 form has four bytes
        wide = F.length(key) - F.length(F.regexp_replace(key, r"[\x{10000}-\x{10FFFF}]", ""))
        return F.coalesce(F.lit(40) + F.length(key) + wide, F.lit(50))
    if isinstance(kind, T.NumericType):
        return F.when(key.isNull(), 50).otherwise(16)
    if isinstance(kind, T.ArrayType):
        return F.lit(40) + F.aggregate(key, F.lit(0), lambda total, x: total + key_bytes(x, kind.elementType))
    return F.lit(50)


def row_text(columns: Sequence[str]) -> Column:
    """A row as JSON with its fields in order of name; null fields are left out of it. Times are in UTC,
    whatever the session's zone."""
    return F.to_json(F.struct(*sorted(columns)), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timeZone": "UTC"})


def fresh(columns: Sequence[str], name: str) -> str:
    """The name, with underscores added where a table of these columns has it already."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates)
