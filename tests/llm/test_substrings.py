import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import substrings
from cairn.llm.words import utf8, words


def brute(rows, window):
    seen, found = {}, {}
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            v = tuple(w[s : s + window])
            if seen.setdefault(v, (i, s)) < (i, s):
                gone[s : s + window] = [True] * window
        found[i] = gone
    out = set()
    for i, text in rows:
        w = (text or "").encode().split()
        gone = found.get(i, [False] * len(w))
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.add((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(seed, window):
    rnd = random.Random(seed)
    few, many = [f"w{i}" for i in range(3)], [f"v{i}" for i in range(3000)]
    passages = [[rnd.choice(many) for _ in range(rnd.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(6)]
    rows = [None, "", " \n ", "x", " ".join(["a"] * 100), " ".join(["a"] * 100), " ".join(["a", "b"] * 60)]
    for _ in range(60):
        w = []
        for _ in range(rnd.randrange(6)):
            w += rnd.choice([rnd.choice(passages), [rnd.choice(many) for _ in range(30)], [rnd.choice(few) for _ in range(15)], [rnd.choice(passages)[0]] * 5])
        rows.append(rnd.choice([" ", "\n", "\x0b ", "  "]).join(w) + rnd.choice(["", " ", " end\t"]))
    rnd.shuffle(rows)
    ids = rnd.sample(range(10_000), len(rows))
    return [*zip(ids, rows), (None, rows[10]), (ids[5], rows[5])]


@pytest.mark.parametrize("seed,window,gram", [(1, 20, 8), (2, 5, 2), (3, 20, None)])
def test_against_brute_force(spark, tmp_path, monkeypatch, seed, window, gram):
    rows = rows_of(seed, window)
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, start string").repartition(3)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(substrings, "WINDOW", window)
    monkeypatch.setattr(substrings, "GRAM", gram or 8)
    want = brute(rows, window)
    assert {tuple(r) for r in substrings.op3(spark, str(tmp_path)).collect()} == want
    cut = substrings.remove_repeats(frame, window, gram)
    assert cut.columns == frame.columns
    got = {(r.doc_id, hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest()) for r in cut.collect()}
    assert got == {(i, sha) for i, _, _, sha in want}
    same = {(i, t) for i, t in rows} & {(r.doc_id, r.text) for r in cut.collect()}
    assert {i for i, _ in same} >= {i for i, _, gone, _ in want if not gone}


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert substrings.op3(spark, str(tmp_path)).count() == 0


def test_long_documents_in_chunks(monkeypatch):
    rnd = random.Random(1)
    text = " ".join(rnd.choice(["a", "b", "cc"]) for _ in range(3000)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    _, _, hashes, first = words(data, at)
    whole = substrings.runs(hashes, first, 20, 8)
    monkeypatch.setattr(substrings, "CHUNK", 500)
    parts = list(substrings._all_runs(hashes, first, 20, 8))
    covered = lambda found: sorted(s + o for f in found for s, n in zip(f["start"], f["len"]) for o in range(n - 19))
    assert len(parts) == 6 and covered(parts) == covered([whole]) == list(range(len(hashes) - 19))


def test_words_in_pieces(monkeypatch):
    from cairn.llm import words as module

    text = ("aé b\tccc\n" * 500 + "x" * 9000 + " end").encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    want = words(data, at)
    monkeypatch.setattr(module, "SLICE", 100)
    for a, b in zip(want, words(data, at)):
        assert (a == b).all()
    assert [text[a:b] for a, b in zip(want[0], want[1])] == text.split()


def spread_of(rows, parts, split):
    """The most occurrences in a part after the packer, rows in packs of 100. Part -1 is spread by itself."""
    held = {}
    for i in range(0, len(rows), 100):
        texts = [" ".join(w) for w in rows[i : i + 100]]
        data, at = utf8(substrings.pa.array(texts))
        _, _, hashes, first = words(data, at)
        packer = substrings._Packer(parts, split)
        found = substrings.runs(hashes, first, 20, 8)
        packer.add(found | {"doc": found["row"] + i})
        for batch in packer.flush():
            for r in (r for r in batch.to_pylist() if r["part"] >= 0):
                held[r["part"]] = held.get(r["part"], 0) + len(r["doc"]) // 8
    return max(held.values()), sum(held.values())


def test_one_passage_between_different_words(spark, tmp_path):
    """Every run around the passage differs, so that all are known by the anchors of one passage."""
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(30)]
    rows = [[f"x{rnd.randrange(10**9)}" for _ in range(40)] + passage + [f"y{rnd.randrange(10**9)}" for _ in range(40)] for _ in range(2000)]
    most, everything = spread_of(rows, 100, True)
    assert most < 2 * everything / 100 and spread_of(rows, 100, False)[0] > 5 * everything / 100
    table = [(i, " ".join(w)) for i, w in enumerate(rows)]
    spark.createDataFrame(table, "doc_id bigint, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in substrings.op3(spark, str(tmp_path)).collect()} == brute(table, 20)


def test_clashing_names(spark):
    rows = [(1, "a b c d e f g", 1, 2, 3, 4), (2, "x a b c d e f g", 5, 6, 7, 8), (None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, _id int, runs int, start int, RUNS_ int")
    found = substrings.remove_repeats(frame, 5, 2)
    assert found.columns == frame.columns
    assert {tuple(r) for r in found.collect()} == {rows[0], (2, "x ", 5, 6, 7, 8), rows[2]}
