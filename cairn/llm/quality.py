"""Quality classifier: supervised subword embeddings.

A document is the average of the vectors of its words, of the character n-grams inside each word
(between marks for its ends), of its word bigrams and trigrams, and of the patterns of these: which of
their words are equal. A pattern says of an n-gram what it has in common with those of words that are new.
A softmax layer over the average gives the classes. All features are hashed to BUCKETS rows. Vectors and
layer are trained by stochastic gradient descent in numpy, as in Joulin et al., "Bag of Tricks for
Efficient Text Classification".

Training takes SAMPLE labelled rows at most, those with the smallest hashes of their ids, and of these
the first whose texts have SAMPLE_BYTES together; these bounds are the one limit on data here. Scoring
covers every whole text: as the layer is linear before the softmax, each bucket comes down to one number,
a megabyte that every task gets.

Null and empty texts, and those of white space only, have no words and are scored by the layer's
bias. Labels that are null, or without a document, are not learnt from; where none are left, every
score is 0.5. Several labels of an id are several examples; of several texts of an id the first in byte
order is learnt from. A row without an id is scored, is not held out, and is not learnt from.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import U, between, mix, slices, sums, utf8, words

SAMPLE, BUCKETS, DIM, EPOCHS, BATCH, RATE, SEED = 6000, 1 << 17, 8, 6, 16, 1.0, 17
SAMPLE_BYTES = 1 << 26
#: Lengths of the character n-grams, in bytes, and of the word n-grams.
GRAMS, WORD_GRAMS = (3, 4, 5), (2, 3)
#: A score from which a document counts as good.
KEEP = 0.3
_EDGE = 1


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of each word, one word after the other, and their offsets."""
    length = end - start
    wide = length + 2
    ends = np.cumsum(wide)
    begin = ends - wide
    marked = np.full(int(ends[-1]) if len(ends) else 0, _EDGE, np.int64)
    marked[np.arange(length.sum()) + np.repeat(begin + 1 - (np.cumsum(length) - length), length)] = data[np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)]
    prefix = sums(mix(marked.astype(U) + U(1)))
    counts = [np.ones(len(start), np.int64)] + [np.maximum(wide - n + 1, 0) for n in GRAMS]
    offsets = np.concatenate(([0], np.cumsum(sum(counts))))
    out = np.zeros(int(offsets[-1]), np.int64)
    place = offsets[:-1].copy()
    out[place] = _bucket(mix(hashes ^ U(0x9E3779B97F4A7C15)))
    place += 1
    for n, count in zip(GRAMS, counts[1:]):
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(begin, count) + step
        out[np.repeat(place, count) + step] = _bucket(between(prefix, at, at + n))
        place += count
    return out, offsets


def word_grams(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word n-grams of rows and of their patterns, and the row of each; first: the number of
    each row's first word."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    buckets, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in WORD_GRAMS:
        count = max(0, len(hashes) - n + 1)
        inside = np.flatnonzero(row[:count] == row[n - 1 : n - 1 + count])
        gram, pattern, bit = np.full(len(inside), n, U), np.full(len(inside), n, U), 8
        for j in range(n):
            gram = mix(gram * U(0x9E3779B97F4A7C15) + hashes[inside + j])
            for i in range(j):
                pattern += (hashes[inside + i] == hashes[inside + j]).astype(U) * U(bit)
                bit *= 2
        buckets += [_bucket(gram), _bucket(mix(pattern + U(0x5851F42D4C957F2D)))]
        rows += [inside_rows := row[inside], inside_rows]
    return np.concatenate(buckets), np.concatenate(rows)


def _distinct(data: np.ndarray, at: np.ndarray):
    """Distinct words of the rows: their features; each word's number among them, by row; and buckets and
    rows of the word n-grams."""
    start, end, hashes, first = words(data, at)
    _, lead, number = np.unique(hashes, return_index=True, return_inverse=True)
    features, offsets = subwords(data, start[lead], end[lead], hashes[lead])
    return features, offsets, number, first, *word_grams(hashes, first)


@dataclass
class Model:
    """One number for each bucket, their average's offset, and what the classes' odds start from."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        features, offsets, number, first, grams, rows = _distinct(data, at)
        n = len(first) - 1
        if not len(number):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        each = np.add.reduceat(self.weight[features], offsets[:-1])
        many = np.diff(offsets).astype(float)
        full = np.flatnonzero(np.diff(first))
        total, count = np.zeros(n), np.ones(n)
        total[full] = np.add.reduceat(each[number], first[:-1][full])
        count[full] = np.add.reduceat(many[number], first[:-1][full])
        total += np.bincount(rows, self.weight[grams], n)
        count += np.bincount(rows, minlength=n)
        return 1 / (1 + np.exp(-np.clip(total / count + self.bias, -500, 500)))


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its features."""
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        features, offsets, number, _, grams, _ = _distinct(data, np.array([0, len(data)]))
        times = np.repeat(np.bincount(number, minlength=len(offsets) - 1), np.diff(offsets))
        features, times = np.concatenate((features, grams)), np.concatenate((times, np.ones(len(grams), np.int64)))
        bucket, inverse = np.unique(features, return_inverse=True)
        share = np.bincount(inverse, times, minlength=len(bucket)) / max(1, times.sum())
        out.append((bucket.astype(np.int32), share.astype(np.float32)))
    return out


def train(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """The same model for the same examples in the same order."""
    if not texts:
        return Model(np.zeros(BUCKETS), 0.0)
    rnd = np.random.default_rng(seed)
    vectors = rnd.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((2, DIM)), np.zeros(2)
    found, truth = bags(texts), np.array(labels)
    n, done = len(texts), 0
    for _ in range(epochs):
        order = rnd.permutation(n)
        for i in range(0, n, BATCH):
            rows = order[i : i + BATCH]
            hidden = np.stack([found[r][1] @ vectors[found[r][0]] for r in rows])
            logit = hidden @ layer.T + bias
            odds = np.exp(logit - logit.max(1, keepdims=True))
            error = odds / odds.sum(1, keepdims=True)
            error[np.arange(len(rows)), truth[rows]] -= 1
            step = rate * (1 - done / (n * epochs))
            back = error @ layer
            layer -= step * error.T @ hidden
            bias -= 0.1 * step * error.sum(0) / len(rows)
            for r, change in zip(rows, step * back):
                bucket, share = found[r]
                vectors[bucket] -= np.outer(share, change)
            done += len(rows)
    side = layer[1] - layer[0]
    return Model(vectors @ side, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most `sample` labelled rows that are not held out."""
    key = F.col("doc_id").cast("long")
    usable = labels.where(key.isNotNull() & F.col(label).isin(0, 1) & ~held_out(key))
    chosen = usable.select(key.alias("id"), F.col(label).cast("int").alias("truth")).orderBy(F.xxhash64("id"), "id", "truth").limit(sample)
    # every label has a number, so that equal ones are several examples; at most `sample` rows of three numbers
    chosen = chosen.withColumn("nth", F.monotonically_increasing_id())
    rows = documents.select(key.alias("doc"), "text").join(F.broadcast(chosen), F.col("doc") == F.col("id"))
    # copies of an id come down to one text before they meet
    rows = rows.groupBy("id", "truth", "nth").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # at most `sample` texts, which meet in one task and never on the driver, and SAMPLE_BYTES in its memory
    rows = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id", "truth").select("truth", "text")
    learnt = rows.mapInArrow(_learn, "weight binary, bias double").first()
    return Model(np.frombuffer(learnt.weight, np.float64), learnt.bias) if learnt else train([], [])


def _learn(batches):
    texts, truth, size = [], [], 0
    for batch in batches:
        for y, text in zip(*(c.to_pylist() for c in batch.columns)):
            size += len(text.encode())
            if size <= SAMPLE_BYTES or not texts:
                texts.append(text), truth.append(y)
    model = train(texts, truth)
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])


def score(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """documents with a column of scores; one that had this name before is replaced."""
    documents = documents.drop(name)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(names.index("text")))
            scores = [shared.value.scores(data, at[i : j + 1]) for i, j in slices(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, name])

    schema = documents.withColumn(name, F.lit(0.0)).schema
    return documents.mapInArrow(run, schema)


def op2(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(documents, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


def crc_remainder(doc_id: int) -> int:
    """The split as zlib has it, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
