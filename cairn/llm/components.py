"""Connected components of links between integer ids, as a DataFrame loop.

Rounds of large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
Beyond") bring every id to the smallest of its component. A step takes the minimum of an id's
neighbours with partial aggregation and joins it back, so no neighbourhood is ever held in a task. Where
there are many links, those of ids with a large part of them are joined by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch, join_counted

#: Up to so many links the ids' smallest neighbours, two numbers each, are broadcast.
FEW = 200_000


def _down(pairs: DataFrame) -> DataFrame:
    """Distinct links from the larger id to the smaller."""
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_lowest(links: DataFrame, total: int, few: int) -> DataFrame:
    """Each link with the smallest neighbour of its end a; total: how many links there are at most."""
    low = links.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("many"))
    return links.join(F.broadcast(low), "a") if total <= few else join_counted(links, low, ["a"], "many", total)


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, scratch: Scratch, name: str, few: int = FEW) -> DataFrame:
    """(a, b): each linked id that isn't the smallest of its component, and that smallest id.

    links: integer columns a and b; null ends, loops and repeats don't matter. few: links up to which the
    smallest neighbours are broadcast, to the same result."""
    current, step = scratch.keep(_down(links.select("a", "b")), f"{name}-0"), 0
    state = _state(current)
    while state[0]:
        both = current.union(current.select("b", "a"))
        large = _with_lowest(both, 2 * state[0], few).where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b"))
        small = _with_lowest(large.where("a <> b").distinct(), state[0], few)
        small = small.select("b", "low").union(small.select("a", "low")).toDF("a", "b").where("a <> b").distinct()
        step += 1
        after = scratch.keep(small, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        before, state, current = state, _state(after), after
        if state == before:
            break
    return current
