"""What a catalog declares: indices, traversals, views and hooks.

Keys are names of columns, expressions, or functions that return an expression; the last can be
declared before there is a session."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import composite_keys, distinct_values, fan_out, path_prefixes


Key = str | Column | Callable[[], Column]


def column(key: Key) -> Column:
    if isinstance(key, str):
        return F.col(key)
    return key if isinstance(key, Column) else key()


def _named(name: str) -> None:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a name is needed")


@dataclass(frozen=True)
class EqualityIndex:
    """Equality on a key. Rows with a null key are not in it; a null struct on the way gives null."""

    name: str
    key: Key
    kind = "equality"

    def __post_init__(self):
        _named(self.name)

    def keys(self) -> Column:
        return column(self.key)


@dataclass(frozen=True)
class SortedIndex(EqualityIndex):
    """Equality, ranges, and text predicates on a key."""

    kind = "sorted"


@dataclass(frozen=True)
class MultiIndex(EqualityIndex):
    """A posting for each element of an array key, nulls left out; repeated elements post again."""

    kind = "multi"

    def keys(self) -> Column:
        return F.filter(column(self.key), lambda x: x.isNotNull())


@dataclass(frozen=True)
class Traversal:
    """A field of composite keys: an array of the row's distinct values for it."""

    name: str
    expression: Callable[[], Column]
    #: For a plain field, the column itself, which scans can be filtered by.
    plain_key: Key | None = None

    def __post_init__(self):
        _named(self.name)

    @property
    def values(self) -> Column:
        return self.expression()

    @property
    def plain(self) -> Column | None:
        return None if self.plain_key is None else column(self.plain_key)


def simple(name: str, value: Key) -> Traversal:
    """One value, or none if null."""
    return Traversal(name, lambda: F.filter(F.array(column(value)), lambda x: x.isNotNull()), value)


def many(name: str, collection: Key, pick: Callable[[Column], Column] | None = None) -> Traversal:
    """Distinct values over a collection; null collections, elements and values are left out."""
    return Traversal(name, lambda: fan_out(column(collection), pick) if pick else distinct_values(column(collection)))


def path(name: str, value: Key, separator: str = "/") -> Traversal:
    """Every leading path, so that a shorter one finds all below it."""
    return Traversal(name, lambda: path_prefixes(column(value), separator))


@dataclass(frozen=True)
class GraphIndex:
    """Composite keys along hotpaths, each an ordered choice of traversals."""

    name: str
    traversals: Sequence[Traversal]
    hotpaths: Sequence[Sequence[str]]
    max_keys_per_row: int = 100
    kind = "graph"

    def __post_init__(self):
        _named(self.name)
        names = [t.name for t in self.traversals]
        if not names or not self.hotpaths:
            raise RuntimeError(f"graph index {self.name} needs traversals and hotpaths")
        if len(set(names)) < len(names):
            raise ValueError(f"graph index {self.name} has two traversals of one name")
        if self.max_keys_per_row < 1:
            raise ValueError("max_keys_per_row must be positive")
        for fields in self.hotpaths:
            if not fields or isinstance(fields, str) or len(set(fields)) < len(fields):
                raise ValueError("a hotpath is a list of different traversals")
            if unknown := set(fields) - set(names):
                raise ValueError(f"unknown traversals {sorted(unknown)}")

    def traversal(self, name: str) -> Traversal:
        return next(t for t in self.traversals if t.name == name)

    def keys(self, fields: Sequence[str] | None = None) -> Column:
        """Distinct composite keys over all hotpaths, or along some fields, each an array of text."""
        paths = [fields] if fields else self.hotpaths
        return F.array_distinct(F.concat(*(composite_keys([self.traversal(f).values for f in path]) for path in paths)))


@dataclass(frozen=True)
class View:
    """A projection under a name."""

    name: str
    columns: Mapping[str, Key]

    def __post_init__(self):
        _named(self.name)

    def select(self) -> list[Column]:
        return [column(c).alias(n) for n, c in self.columns.items()]


@dataclass(frozen=True)
class Hook:
    """A step of the build, run in order of priority, then of declaration. It gets the rows as the
    hook before returned them; what the last returns is not served. An error aborts the build."""

    run: Callable[[DataFrame], DataFrame | None]
    priority: int = 100
    order: int = field(default=0, compare=False)
