import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairn.llm import quality
from cairn.llm.words import slices, utf8


def examples(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for _ in range(n):
        w = ["".join(rnd.choice(["an", "er", "ti", "on", "the"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(20, 80))]
        kind = rnd.randrange(4)
        if kind == 0:
            w = [x.upper() + "!!" for x in w]
        if kind == 1:
            w = [w[0]] * 30 + w[:5]
        texts.append(" ".join(w)), labels.append(int(kind > 1))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return quality.train(*examples(400, 1), epochs=8)


M = (1 << 64) - 1


def plain_mix(x):
    for _ in range(2):
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & M
    return x ^ (x >> 32)


def plain_sequence(numbers):
    """Hash of a sequence: the sum of numbers times powers of a base, and its length."""
    return plain_mix(sum(x * pow(0x9E3779B97F4A7C55, i, 1 << 64) for i, x in enumerate(numbers)) + len(numbers) & M)


def plain_word(word):
    return plain_mix(sum(plain_mix((b + 1) * 0x9E3779B97F4A7C15 & M) * pow(0x9E3779B97F4A7C55, i, 1 << 64) for i, b in enumerate(word)) & M)


def plain_features(text):
    """Buckets of all features of a text, one by one, from their definitions."""
    words, out = (text or "").encode().split(), []
    bucket = lambda h: h >> 64 - 17
    for w in words:
        out.append(bucket(plain_mix(plain_word(w) ^ 0x9E3779B97F4A7C15)))
        marked = [1, *w, 1]
        out += [bucket(plain_sequence([plain_mix(b + 1) for b in marked[i : i + n]])) for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    for n in (2, 3):
        for i in range(len(words) - n + 1):
            gram, h = words[i : i + n], n
            for w in gram:
                h = plain_mix(h * 0x9E3779B97F4A7C15 + plain_word(w) & M)
            pairs = [(a, b) for b in range(n) for a in range(b)]
            pattern = n + sum(8 << k for k, (a, b) in enumerate(pairs) if gram[a] == gram[b])
            out += [bucket(h), bucket(plain_mix(pattern + 0x5851F42D4C957F2D & M))]
    return out


def plain_score(model, text):
    features = plain_features(text)
    return 1 / (1 + math.exp(-(sum(model.weight[f] for f in features) / max(1, len(features)) + model.bias)))


def plain_train(texts, labels, epochs):
    """The updates written out, one number at a time."""
    rnd = np.random.default_rng(quality.SEED)
    vectors = rnd.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.BUCKETS, quality.DIM)).tolist()
    layer, bias, n, done = [[0.0] * quality.DIM for _ in range(2)], [0.0, 0.0], len(texts), 0
    features = [plain_features(t) for t in texts]
    for _ in range(epochs):
        order = rnd.permutation(n)
        for i in range(0, n, quality.BATCH):
            rows, step = order[i : i + quality.BATCH], quality.RATE * (1 - done / (n * epochs))
            hidden = {r: [sum(vectors[f][d] for f in features[r]) / max(1, len(features[r])) for d in range(quality.DIM)] for r in rows}
            error = {}
            for r in rows:
                odds = [math.exp(sum(map(float.__mul__, layer[c], hidden[r])) + bias[c]) for c in (0, 1)]
                error[r] = [odds[c] / sum(odds) - (labels[r] == c) for c in (0, 1)]
            back = {r: [sum(error[r][c] * layer[c][d] for c in (0, 1)) for d in range(quality.DIM)] for r in rows}
            for c in (0, 1):
                layer[c] = [layer[c][d] - step * sum(error[r][c] * hidden[r][d] for r in rows) for d in range(quality.DIM)]
                bias[c] -= 0.1 * step * sum(error[r][c] for r in rows) / len(rows)
            for r in rows:
                for f in features[r]:
                    for d in range(quality.DIM):
                        vectors[f][d] -= step * back[r][d] / len(features[r])
            done += len(rows)
    side = [layer[1][d] - layer[0][d] for d in range(quality.DIM)]
    return [sum(map(float.__mul__, v, side)) for v in vectors], bias[1] - bias[0]


def test_features_against_their_definition():
    for text in ["", "x", "an an an b an", "É!! é ab", examples(1, 5)[0][0]]:
        bucket, share = quality.bags([text])[0]
        want = Counter(plain_features(text))
        assert dict(zip(bucket.tolist(), share.tolist())) == {f: pytest.approx(k / want.total()) for f, k in want.items()}


def test_training_against_plain_updates():
    texts, labels = examples(40, 6)
    texts = [*texts, "", "x"]
    labels = [*labels, 0, 1]
    model, (weight, bias) = quality.train(texts, labels, epochs=2), plain_train(texts, labels, 2)
    assert np.allclose(model.weight, weight, atol=1e-6) and model.bias == pytest.approx(bias, abs=1e-6)


def test_scores_by_definition_in_any_batch(model):
    texts = [None, "", " \n", "x", "an an an", "É!! é", *examples(20, 2)[0], "tion " * 5000]
    data, at = utf8(pa.array(texts))
    whole = model.scores(data, at)
    assert np.allclose(whole, [plain_score(model, t) for t in texts], atol=1e-9)
    parts = np.concatenate([model.scores(data, at[i : j + 1]) for i, j in slices(at, 300)])
    assert (whole == parts).all()


def test_learns_and_is_the_same_again(model):
    texts, labels = examples(300, 3)
    data, at = utf8(pa.array(texts))
    assert ((model.scores(data, at) >= quality.KEEP) == np.array(labels)).mean() > 0.97
    again = quality.train(*examples(400, 1), epochs=8)
    assert (again.weight == model.weight).all() and again.bias == model.bias


def test_nothing_to_learn_from(spark):
    documents = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(None, 1), (1, None), (77, 1)], "doc_id bigint, quality int")
    model = quality.fit(documents, labels)
    rows = quality.score(documents.withColumn("_score", F.lit(1)), model).collect()
    assert [r.score for r in rows] == [0.5, 0.5] and rows[0]._score == 1
    assert quality.train(["", ""], [1, 0], epochs=1).weight.shape == (quality.BUCKETS,)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.op2(spark, sf).collect()
    assert len(rows) == 1000
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (quality.crc_remainder(r.doc_id) == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.95 * len(judged)


def test_repeated_ids_and_rows_without_one(spark, monkeypatch):
    """One text of an id is learnt from, however many rows it has; a row without an id isn't held out."""

    def count(batches):
        yield pa.RecordBatch.from_pylist([{"weight": b"", "bias": float(sum(b.num_rows for b in batches))}])

    monkeypatch.setattr(quality, "_learn", count)
    documents = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (1, None), (None, "x"), (2, "c")], "doc_id int, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (2, 1), (None, 1)], "doc_id bigint, quality int")
    assert quality.fit(documents, labels).bias == sum(2 for i in (1, 2) if quality.crc_remainder(i))
    assert documents.where("doc_id is null").select(quality.held_out(F.col("doc_id"))).first()[0] is False
