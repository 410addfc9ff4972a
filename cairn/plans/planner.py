"""Chooses the hotpath whose leading fields a query covers furthest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from itertools import product
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from cairn.operators.indices import GraphIndex


@dataclass(frozen=True)
class Plan:
    index: GraphIndex
    fields: tuple[str, ...]
    keys: tuple[tuple, ...]
    uncovered: tuple[str, ...]


def covered(conditions: Mapping[str, Sequence], hotpath: Sequence[str]) -> int:
    """How many leading fields of a hotpath have a condition."""
    for n, field in enumerate(hotpath):
        if field not in conditions:
            return n
    return len(hotpath)


def plan(conditions: Mapping[str, Sequence], graphs: Sequence[GraphIndex]) -> Plan | None:
    """The furthest covered hotpath, the first declared of equals, with its keys: every choice of the
    values of the covered fields. None if no hotpath begins with a field of the query."""
    choices = [(index, hotpath) for index in graphs for hotpath in index.hotpaths]
    best = max(choices, key=lambda c: covered(conditions, c[1]), default=None)
    if best is None or not (n := covered(conditions, best[1])):
        return None
    fields = tuple(best[1][:n])
    return Plan(best[0], fields, tuple(product(*(conditions[f] for f in fields))), tuple(f for f in conditions if f not in fields))
