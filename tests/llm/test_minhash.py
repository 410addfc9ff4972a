import random

import numpy as np
import pytest

from cairn.llm import minhash
from cairn.llm.components import components
from cairn.llm.shared import Scratch


def shingle_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, num, den):
    sets, root = {}, {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t, size))
            root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(a and b and den * len(a & b) >= num * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {(i, len(shingle_set(t, size)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows}


def edited(rnd, words, share):
    return [rnd.choice("abcdefgh") * 3 + str(rnd.randrange(999)) if rnd.random() < share else w for w in words]


def rows_of(seed):
    rnd = random.Random(seed)
    rows = []
    for g in range(12):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 8, 40, 150, 400]))]
        for _ in range(rnd.choice([1, 2, 20])):
            rows.append(" ".join(edited(rnd, base, rnd.choice([0, 0.01, 0.03, 0.06]))))
    rows += [None, "", "  \n", "One", "one", "Two words", "two\twords", "É é", "é É"]
    rnd.shuffle(rows)
    return [*enumerate(rows), (None, "one"), (5, rows[5])]


@pytest.mark.parametrize("seed,size,threshold,block", [(1, 3, "0.85", minhash.BLOCK), (2, 5, "0.8", 3000), (3, 3, "0.85", 1000)])
def test_against_brute_force(spark, seed, size, threshold, block):
    rows = rows_of(seed)
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, n int")
    found = {tuple(r) for r in minhash.near_duplicates(frame, size, threshold, block).collect()}
    num, den = (85, 100) if threshold == "0.85" else (80, 100)
    assert found == brute(rows, size, num, den)


def test_empty(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_sketch_estimates():
    rnd = np.random.default_rng(1)
    pool = rnd.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[400:2400])
    bins = minhash.sketch(np.concatenate([a, b, pool[:1]]), np.array([0, 2000, 4000, 4001, 4001]), 250)
    assert (bins[:3] != minhash._FULL).all() and (bins[3] == minhash._FULL).all()
    assert abs((bins[0] == bins[1]).mean() - 1600 / 2400) < 0.1


def test_parities_bound_the_difference():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64)) for n in (1, 50, 5000)]
    sets += [sets[1][5:], sets[2][::2]]
    bits = minhash.parities(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    rnd = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 200) for i in range(30)] + [(rnd.randrange(300, 400), rnd.randrange(300, 400)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in list(root) if find(x) != x}
    for few in (1 << 20, 0):
        found = components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test"), "c", few)
        assert {tuple(r) for r in found.collect()} == want


def test_ids_with_different_texts(spark, monkeypatch):
    """Rows of one id are one node: what one of them is linked with is linked with all. Nodes that share
    a shingle with more than PARTNERS others meet by their signatures."""
    monkeypatch.setattr(minhash, "PARTNERS", 2)
    monkeypatch.setattr(minhash, "SIGNATURES", 5)
    rows = rows_of(4)
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows += [(903, texts[0]), (905, texts[0]), (905, texts[1]), (909, texts[1]), (909, texts[1]), (909, None), (910, ""), (910, texts[2]), (911, texts[2] + " end"), (1, rows[60][1])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, rep int")
    found = {tuple(r) for r in minhash.near_duplicates(frame, 3, "0.7", 1000).collect()}
    assert found == brute(rows, 3, 7, 10)
    assert {c for i, _, c, _ in found if i in (903, 905, 909)} == {903} and {c for i, _, c, _ in found if i in (910, 911)} == {910}


@pytest.mark.parametrize("threshold", ["0.5", "1"])
def test_lowest_and_highest_threshold(spark, threshold):
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 30))) for i in range(0, 40, 5)] + [(50, "one"), (51, "ONE"), (52, "two")]
    num, den = (1, 2) if threshold == "0.5" else (1, 1)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, threshold).collect()
    assert {tuple(r) for r in found} == brute(rows, 3, num, den)


def test_other_thresholds_are_refused(spark):
    for threshold in ("0.49", "0", "1.1"):
        with pytest.raises(ValueError, match="threshold"):
            minhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string"), 3, threshold)


def test_a_loose_cluster(spark):
    """Texts that have most words in common but are no near-duplicates, and a few that are."""
    rnd = random.Random(6)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join(common + [f"x{rnd.randrange(10**6)}" for _ in range(60)])) for i in range(150)]
    rows += [(200 + i, rows[i][1] + " more") for i in range(0, 150, 10)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in minhash.near_duplicates(frame, 3, "0.85", 1000).collect()} == brute(rows, 3, 85, 100)
