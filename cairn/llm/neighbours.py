"""Approximate nearest neighbours by inner product, over learned partitions.

Fitting takes SAMPLE vectors at most, those with the smallest hashes of their ids: the graph of
their nearest neighbours is cut into balanced parts with few edges between them, and a small
classifier (one hidden layer, trained by stochastic gradient descent) learns to tell a vector's part
(Dong et al., "Learning Space Partitions for Nearest Neighbor Search"). How many parts a query tries
is the least number that finds RECALL of the sample's own neighbours. Vectors of unequal length are
told apart by one more component that brings all to the same length; for a query it is 0.

Every vector is indexed under its most probable part. A part is split into blocks of about BLOCK
vectors, so that no task holds more, however many equal vectors there are. A query goes to all
blocks of its parts, and every vector there is scored exactly: products of the components in double
precision, added in order. Equal scores go to the smaller id. A query that finds fewer than it could, as
its parts hold too few, is asked again of all parts.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do null ids. Equal rows count once. Of an id with different vectors all are candidates, and
the nearest is its score; as a query it has the least of them in the order of arrays. An id is never
its own neighbour.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch

SAMPLE, NEAR, MOST_PARTS, BLOCK, QUERIES = 6000, 16, 256, 2048, 1024
RECALL, SEED, HIDDEN, EPOCHS = 0.93, 5, 64, 30


def usable(vector: Column) -> Column:
    value = vector.cast("array<double>")
    bad = F.exists(value, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(F.exists(value, lambda x: x != 0), F.lit(False))


def balanced_parts(near: np.ndarray, parts: int, seed: int = SEED, sweeps: int = 12) -> np.ndarray:
    """The part of each node of a graph; near: each node's neighbours. Parts are grown one by one
    from the node most tied to what is left, then nodes move where most of their edges lead, as far
    as parts stay within a fifth of equal size."""
    n, rnd = len(near), np.random.default_rng(seed)
    edges: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(near.tolist()):
        for j in row:
            edges[i].append(j), edges[j].append(i)
    part = np.full(n, -1)
    for p in range(parts):
        size, free = n // parts + (p < n % parts), set(np.flatnonzero(part < 0).tolist())
        ties: dict[int, int] = {}
        for _ in range(size):
            at = max(ties, key=ties.get) if ties else next(iter(free))
            ties.pop(at, None), free.discard(at)
            part[at] = p
            for j in edges[at]:
                if part[j] < 0:
                    ties[j] = ties.get(j, 0) + 1
    sizes = np.bincount(part, minlength=parts)
    most, least = math.ceil(n / parts * 1.2), math.floor(n / parts * 0.8)
    for _ in range(sweeps):
        moved = 0
        for i in rnd.permutation(n).tolist():
            votes = np.bincount(part[edges[i]], minlength=parts)
            own = votes[part[i]]
            votes[sizes >= most] = -1
            best = int(votes.argmax())
            if votes[best] > own and sizes[part[i]] > least:
                sizes[part[i]] -= 1
                sizes[best] += 1
                part[i] = best
                moved += 1
        if not moved:
            break
    return part


def closest(rows: np.ndarray, k: int) -> np.ndarray:
    """The k other rows of largest inner product with each, in blocks, since all products would not
    fit beside the driver's other work."""
    out = np.empty((len(rows), k), np.int64)
    for i in range(0, len(rows), 256):
        products = -(rows[i : i + 256] @ rows.T)
        products[np.arange(len(products)), i + np.arange(len(products))] = np.inf
        out[i : i + 256] = np.argpartition(products, k - 1, axis=1)[:, :k]
    return out


class Router:
    """The classifier, and how many parts to try."""

    def __init__(self, sample: np.ndarray, parts: int, longest: float, k: int = 20):
        self.longest, self.parts, self.probes = longest, parts, parts
        self.dim = sample.shape[1] if len(sample) else 0
        if parts < 2 or len(sample) <= k:
            self.parts = self.probes = 1
            return
        rows = self._rows(sample)
        label = balanced_parts(closest(rows, NEAR), parts)
        self._learn(rows, label)
        own, tried = self.order(rows, 1)[:, 0], self.order(self._rows(sample, query=True), parts)
        near = closest(sample, k)
        place = np.argsort(tried, axis=1)
        needed = np.take_along_axis(place, own[near], 1)
        share = np.bincount(needed.ravel(), minlength=parts).cumsum() / needed.size
        self.probes = int(np.searchsorted(share, RECALL)) + 1

    def _rows(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        unit = vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) if query else self.longest)
        rest = np.zeros(len(unit)) if query else np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        return np.column_stack((unit, rest))

    def _learn(self, rows: np.ndarray, label: np.ndarray) -> None:
        rnd, n = np.random.default_rng(SEED), len(rows)
        self.a = rnd.normal(0, 1, (rows.shape[1], HIDDEN))
        self.b, self.c, self.d = np.zeros(HIDDEN), rnd.normal(0, 0.1, (HIDDEN, self.parts)), np.zeros(self.parts)
        for epoch in range(EPOCHS):
            rate = 0.5 * (1 - epoch / EPOCHS)
            order = rnd.permutation(n)
            for i in range(0, n, 64):
                at = order[i : i + 64]
                x = rows[at]
                hidden = np.tanh(x @ self.a + self.b)
                error = self._softmax(hidden @ self.c + self.d)
                error[np.arange(len(at)), label[at]] -= 1
                error /= len(at)
                back = error @ self.c.T * (1 - hidden**2)
                self.c -= rate * hidden.T @ error
                self.d -= rate * error.sum(0)
                self.a -= rate * x.T @ back
                self.b -= rate * back.sum(0)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def order(self, rows: np.ndarray, first: int) -> np.ndarray:
        """The most probable parts of rows, most probable first."""
        odds = np.tanh(rows @ self.a + self.b) @ self.c + self.d
        return np.argsort(-odds, axis=1, kind="stable")[:, :first]

    def part(self, vectors: np.ndarray) -> np.ndarray:
        return self.order(self._rows(vectors), 1)[:, 0] if self.parts > 1 else np.zeros(len(vectors), np.int64)

    def tries(self, vectors: np.ndarray) -> np.ndarray:
        if self.parts < 2:
            return np.zeros((len(vectors), 1), np.int64)
        return self.order(self._rows(vectors, query=True), self.probes)


def matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, added component by component, so that equal vectors have equal scores."""
    out = np.zeros((len(queries), len(vectors)))
    for i in range(queries.shape[1]):
        out += queries[:, i, None] * vectors[None, :, i]
    return out


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    at = np.arange(len(ids))
    if len(ids) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def fit(vectors: DataFrame, dim: int, sample: int = SAMPLE, k: int = 20) -> Router:
    """vectors: vec_id and usable vectors of length dim. The sample meets in one task, and the driver gets
    the fitted router only, some MOST_PARTS * HIDDEN numbers."""
    longest = F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))
    count, longest = vectors.agg(F.count("*"), longest).first()
    parts = min(MOST_PARTS, round(math.sqrt(count) / 4))

    def learn(batches):
        held = [(i, v) for batch in batches for i, v in zip(batch.column(0).to_pylist(), matrix(batch.column(1), dim))]
        held.sort(key=lambda r: (r[0], r[1].tolist()))
        router = Router(np.array([v for _, v in held]).reshape(len(held), dim), parts, float(longest or 1), k)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(router)], pa.binary())], ["router"])

    rows = vectors.orderBy(F.xxhash64("vec_id", "vector"), "vec_id").limit(sample).repartition(1)
    found = rows.mapInArrow(learn, "router binary").first()
    return pickle.loads(found.router) if found else Router(np.zeros((0, dim)), 1, 1.0, k)


def _routed(rows: DataFrame, router: Router, every: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(router)  # MOST_PARTS * HIDDEN numbers at most

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                vectors = matrix(batch.column(1), shared.value.dim)
                parts = shared.value.tries(vectors) if every else shared.value.part(vectors)[:, None]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(parts.astype(np.int32)), pa.list_(pa.int32()))], ["vec_id", "vector", "parts"])

    return rows.mapInArrow(run, "vec_id bigint, vector array<double>, parts array<int>")


def _searched(k: int, dim: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if queries.num_rows and vectors.num_rows:
            ids, own = np.array(vectors["vec_id"]), np.array(queries["vec_id"])
            inside, asked = matrix(vectors["vector"], dim), matrix(queries["vector"], dim)
            order = np.argsort(ids, kind="stable")
            ids, inside = ids[order], inside[order]
            first = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))
            names = ids[first]
            for i in range(0, len(own), 128):
                for q, row in zip(own[i : i + 128], exact_scores(asked[i : i + 128], inside)):
                    row = np.maximum.reduceat(row, first)
                    other = names != q
                    at = best(names[other], row[other], k)
                    out[0].append(np.full(len(at), q)), out[1].append(names[other][at]), out[2].append(row[other][at])
        a, b, c = (np.concatenate(x) if x else [] for x in out)
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    return run


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query.

    embeddings: vec_id and embedding; is_query: a condition on vec_id."""
    scratch = Scratch(embeddings.sparkSession, "neighbours")
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).dropDuplicates()
    rows = scratch.keep(rows, "vectors")
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common.dim if common else 0
    rows = rows.where(F.size("vector") == dim)
    router = fit(rows, dim, sample, k)
    router.dim = dim
    indexed = scratch.keep(_routed(rows, router, False).withColumn("part", F.element_at("parts", 1)).drop("parts"), "indexed")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = scratch.keep(_routed(queries, router, True), "asked")
    found = scratch.keep(_ranked(_search(asked.withColumn("part", F.explode("parts")).drop("parts"), indexed, k, dim), k), "found")
    # queries whose parts hold fewer others than there are are asked of the parts they left out
    most = min(k, rows.select("vec_id").distinct().limit(k + 1).count() - 1)
    many = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("many"))
    short = asked.join(many, "vec_id", "left").where(F.coalesce("many", F.lit(0)) < most).drop("many")
    short = scratch.keep(short, "short")
    if short.isEmpty():
        return found.select("query_id", "rank", "vec_id", "score")
    every = short.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(router.parts - 1)))).drop("parts")
    again = _ranked(_search(every, indexed, k, dim), k)
    rest = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
    return rest.unionByName(again).select("query_id", "rank", "vec_id", "score")


def _search(asked: DataFrame, indexed: DataFrame, k: int, dim: int) -> DataFrame:
    """The k best of each query (vec_id, vector, part) in each block of the part."""
    # one row for each of MOST_PARTS parts
    sizes = indexed.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes.join(asked.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("groups")), "part"))
    # equal ids and vectors are spread alike
    pick = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), n).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(sizes, "part").select("part", pick(F.col("groups")).alias("group"), upto("blocks").alias("block"), "vec_id", "vector")
    right = indexed.join(sizes, "part").select("part", upto("groups").alias("group"), pick(F.col("blocks")).alias("block"), "vec_id", "vector")
    key = ["part", "group", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searched(k, dim), "query_id bigint, vec_id bigint, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """Each id once, with its best score; the k first."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k)


def op9(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
