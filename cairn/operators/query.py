"""Queries of one snapshot. Each returns a lazy DataFrame whose filter is a plain column expression,
so that it reaches the scan."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.errors import IndexNotFound, UncoveredConditions, UnsupportedIndexOperation
from cairn.functions.keys import all_of, fresh
from cairn.operators.indices import GraphIndex
from cairn.operators.snapshot import POSTING, ROW, Snapshot, graph_posting
from cairn.plans.planner import plan

_LITERALS = (
    (T.BooleanType, bool),
    (T.NumericType, (int, float, Decimal)),
    (T.StringType, str),
    (T.DateType, date),
    (T.TimestampType, datetime),
    (T.TimestampNTZType, datetime),
)
_TEXT = ("starts_with", "ends_with", "contains")
_RANGE = ("between", "greater_than", "greater_or_equal", "less_than", "less_or_equal")


def _typed(value, kind: T.DataType):
    """Whether a literal may be compared to keys of a type: kinds aren't mixed."""
    if value is None:
        raise ValueError("a key is needed")
    for spark_type, python in _LITERALS:
        if isinstance(kind, spark_type):
            mixed = isinstance(value, bool) and not isinstance(kind, T.BooleanType) or isinstance(kind, T.DateType) and isinstance(value, datetime)
            if mixed or not isinstance(value, python):
                return False
    return True


def _literal(value, kind: T.DataType) -> Column:
    """A literal as a key of a type; null if there is no such key, as of 1.5 among integers."""
    if isinstance(value, int) and value.bit_length() > 63:
        value = Decimal(value) if abs(value) < 10**38 else None  # beyond any number type but double
    given = F.lit(value)
    same = given.try_cast(kind)
    return F.when(same == given, same)


def _graph_key(snapshot: Snapshot, index: GraphIndex, parts: Sequence) -> Column:
    """Rows that have a composite key along one of the hotpaths. Parts are compared as the types that the
    fields have, and a part of another kind finds nothing."""
    found = F.lit(False)
    for fields in {tuple(h[: len(parts)]) for h in index.hotpaths if len(h) >= len(parts)} if parts else ():
        kinds = [snapshot.field_type(index, f) for f in fields]
        if all(map(_typed, parts, kinds)):
            key = F.array(*(_literal(v, k).cast("string") for v, k in zip(parts, kinds)))
            found |= F.array_contains(index.keys(fields), key)
    return found


def condition(snapshot: Snapshot, name: str, operator: str, *values) -> Column:
    """The filter of one predicate. The checks come before any work: an empty text pattern finds
    nothing even before the index is looked at; then the index must exist and support the operator."""
    if any(v is None for v in values):
        raise ValueError("a key is needed")
    if operator in _TEXT and values[0] == "":
        return F.lit(False)
    index = snapshot.indices.get(name)
    if operator == "equal_to":
        if index is None:
            raise IndexNotFound(f"catalog {snapshot.catalog} has no index {name}")
        if index.kind == "graph":
            return _graph_key(snapshot, index, values[0])
        kind = snapshot.key_type(name)
        if index.kind == "multi":
            return F.array_contains(index.keys(), F.lit(values[0])) if _typed(values[0], kind.elementType) else F.lit(False)
        return index.keys() == F.lit(values[0]) if _typed(values[0], kind) else F.lit(False)
    if index is None or index.kind != "sorted":
        raise UnsupportedIndexOperation(f"{operator} needs a sorted index, and {name} of catalog {snapshot.catalog} is none")
    key, kind = index.keys(), snapshot.key_type(name)
    if operator in ("starts_with", "ends_with") and not isinstance(kind, T.StringType):
        raise UnsupportedIndexOperation(f"{operator} needs text keys, and those of {name} are {kind.simpleString()}")
    if operator in _RANGE and not all(_typed(v, kind) for v in values):
        raise ValueError(f"keys of {name} are {kind.simpleString()}")
    if operator == "between":
        low, high = values
        if low > high:
            raise ValueError(f"a range from {low!r} to {high!r} is upside down")
        return key.between(low, high)
    text = key if isinstance(kind, T.StringType) else key.cast("string")
    return {
        "greater_than": lambda v: key > F.lit(v),
        "greater_or_equal": lambda v: key >= F.lit(v),
        "less_than": lambda v: key < F.lit(v),
        "less_or_equal": lambda v: key <= F.lit(v),
        "starts_with": key.startswith if isinstance(kind, T.StringType) else None,
        "ends_with": key.endswith if isinstance(kind, T.StringType) else None,
        "contains": text.contains,
    }[operator](values[0])


def _once(postings: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of built postings, each once."""
    return postings.dropDuplicates([ROW]).select(*columns)


class _Operators:
    """The predicates, for queries of one and of several indices."""

    def equal_to(self, key, **more):
        return self._apply("equal_to", (key,), **more)

    def between(self, low, high, **more):
        """Both ends belong to it."""
        return self._apply("between", (low, high), **more)

    def greater_than(self, key, **more):
        return self._apply("greater_than", (key,), **more)

    def greater_or_equal(self, key, **more):
        return self._apply("greater_or_equal", (key,), **more)

    def less_than(self, key, **more):
        return self._apply("less_than", (key,), **more)

    def less_or_equal(self, key, **more):
        return self._apply("less_or_equal", (key,), **more)

    def starts_with(self, text, **more):
        return self._apply("starts_with", (text,), **more)

    def ends_with(self, text, **more):
        return self._apply("ends_with", (text,), **more)

    def contains(self, text, **more):
        """Of the key's text form, so numbers and dates have it too."""
        return self._apply("contains", (text,), **more)


class Query(_Operators):
    """snapshot.query(index).between(a, b, view='v', ordered=True)"""

    def __init__(self, snapshot: Snapshot, name: str):
        if not name:
            raise ValueError("an index name is needed")
        self.snapshot, self.name = snapshot, name

    def _apply(self, operator, values, view: str | None = None, ordered: bool = False) -> DataFrame:
        index = self.snapshot.indices.get(self.name)
        where = condition(self.snapshot, self.name, operator, *values)
        built = self.snapshot.built.get(self.name) if operator == "equal_to" else None
        columns = self.snapshot.data.columns
        if built is not None and index.kind == "multi":
            kind = built.schema[POSTING].dataType
            rows = built.where(F.col(POSTING) == F.lit(values[0]) if _typed(values[0], kind) else F.lit(False)).select(*columns)
        elif operator == "equal_to" and index.kind == "multi":
            # as many rows as the key has postings
            hits = F.filter(index.keys(), lambda x: x == F.lit(values[0]))
            hit = fresh(columns, "_hit")
            rows = self.snapshot.data.where(where).withColumn(hit, F.explode(hits)).drop(hit)
        else:
            rows = self.snapshot.data.where(where)
        if ordered:
            key = () if operator == "equal_to" else (F.reverse(index.keys()) if operator == "ends_with" else index.keys(),)
            rows = rows.orderBy(*key, *self.snapshot.order_by)
        return self.snapshot.project(rows, view)


class Compound(_Operators):
    """snapshot.compound().where(a).equal_to(x).and_(b).between(y, z).execute(view='v')"""

    def __init__(self, snapshot: Snapshot):
        self.snapshot, self.conditions, self._name, self._begun = snapshot, [], None, False

    def where(self, name: str) -> Compound:
        if self._begun:
            raise RuntimeError("where() was called before; go on with and_()")
        self._begun = True
        return self.and_(name)

    def and_(self, name: str) -> Compound:
        if not name:
            raise ValueError("an index name is needed")
        self._name = name
        return self

    def _apply(self, operator, values) -> Compound:
        if self._name is None:
            raise RuntimeError("name an index with where() first")
        self.conditions.append((self._name, operator, values))
        self._name = None
        return self

    def execute(self, view: str | None = None) -> DataFrame:
        if not self.conditions:
            raise RuntimeError("a compound query needs a condition")
        for name, _, _ in self.conditions:
            if name not in self.snapshot.indices:
                raise IndexNotFound(f"catalog {self.snapshot.catalog} has no index {name}")
        parts = [condition(self.snapshot, n, o, *v) for n, o, v in self.conditions]
        return self.snapshot.project(self.snapshot.data.where(all_of(parts)), view)


class GraphQuery:
    """snapshot.graph_query().where('country').eq('AR').and_('category').in_(['a/b']).execute()"""

    def __init__(self, snapshot: Snapshot):
        self.snapshot, self.conditions, self._field = snapshot, {}, None

    def where(self, field: str) -> GraphQuery:
        if not field:
            raise ValueError("a field is needed")
        self._field = field
        return self

    and_ = where

    def eq(self, value) -> GraphQuery:
        return self.in_([value])

    def in_(self, values) -> GraphQuery:
        values = list(values)
        if not values or any(v is None for v in values):
            raise ValueError("values are needed, and none may be null")
        if self._field is None:
            raise RuntimeError("name a field with where() first")
        self.conditions[self._field] = values
        return self

    def plan(self):
        graphs = [i for i in self.snapshot.indices.values() if isinstance(i, GraphIndex)]
        return plan({f: v for f, v in self.conditions.items()}, graphs)

    def execute(self, view: str | None = None, by_keys: bool = False) -> DataFrame:
        """Rows that have one of the planned keys, each once. by_keys probes the composite keys; else
        each field is tested by itself, which says the same of a row, and plain fields reach the scan."""
        found = self.plan() if self.conditions else None
        if found is None:
            return self.snapshot.project(self.snapshot.data.where(F.lit(False)), view)
        if found.uncovered:
            raise UncoveredConditions(f"no hotpath covers {', '.join(found.uncovered)}")
        kinds = {f: self.snapshot.field_type(found.index, f) for f in found.fields}
        if not by_keys:
            where = all_of([self._test(found.index.traversal(f), kinds[f], self.conditions[f]) for f in found.fields])
            return self.snapshot.project(self.snapshot.data.where(where), view)
        wanted = [[(v, kinds[f]) for f, v in zip(found.fields, key)] for key in found.keys]
        wanted = [F.array(*(_literal(v, k).cast("string") for v, k in key)) for key in wanted if all(_typed(v, k) for v, k in key)]
        if not wanted:
            return self.snapshot.project(self.snapshot.data.where(F.lit(False)), view)
        built = self.snapshot.built.get(found.index.name)
        if built is not None:
            return self.snapshot.project(_once(built.where(F.col(POSTING).isin(*(graph_posting(found.fields, key) for key in wanted))), self.snapshot.data.columns), view)
        where = F.arrays_overlap(found.index.keys(found.fields), F.array(*wanted))
        return self.snapshot.project(self.snapshot.data.where(where), view)

    @staticmethod
    def _test(traversal, kind: T.DataType, values) -> Column:
        wanted = [_literal(v, kind) for v in values if _typed(v, kind)]
        if not wanted:
            return F.lit(False)
        if traversal.plain is not None:
            return traversal.plain.isin(*wanted)
        return F.exists(traversal.values, lambda x: x.isin(*wanted))
