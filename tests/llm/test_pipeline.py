"""The stages against plain versions of what they decide."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from cairn.llm import quality  # noqa: E402
from cairn.llm.shared import Scratch  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    rnd = random.Random(9)
    words = ["an", "er", "ti", "on", "the", "re", "st"]
    prose = lambda n: ["".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))) for _ in range(n)]
    passage, rows, labels = prose(70), [], []
    for i in range(160):
        w = prose(rnd.randrange(30, 150))
        if i % 8 == 0:
            w = [x.upper() + "!!" for x in w]
        if i % 8 == 1 and i > 8:
            w = rows[i - 8][1].split()
            w[rnd.randrange(len(w))] = "changed"
        if i % 8 in (2, 3):
            w[10:10] = passage
        rows.append((i, " ".join(w), "en", rnd.choice(["a", "b", None]), 1, 7))
        labels.append((i, int(i % 8 != 0), 0))
    rows += [(500, None, None, None, None, None), (501, "", "en", "a", 0, 1), (None, " ".join(prose(50)), "en", "a", 1, 1), rows[20], (502, "x", "en", "b", 1, 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    """The input and what each stage returned, read again."""
    path, docs = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], sf).write.parquet(f"{path}/{k}")
        out.append(spark.read.parquet(f"{path}/{k}"))
    return out


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_columns(steps):
    for docs in steps[1:-1]:
        assert docs.dtypes == steps[0].dtypes
    assert steps[-1].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_quality(spark, sf, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    scored = quality.score(steps[0], model, "s").collect()
    assert rows(steps[1]) == sorted((tuple(r)[:-1] for r in scored if r.s >= 0.3), key=str)
    kept = {r.doc_id for r in steps[1].collect()}
    assert all((i in kept) == (i % 8 != 0) for i in range(160))


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_near_duplicates(steps):
    docs = [r for r in steps[1].collect()]
    sets = {r.doc_id: shingles(r.text) for r in docs if r.doc_id is not None}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {tuple(r) for r in docs if r.doc_id is None or find(r.doc_id) == r.doc_id}
    assert rows(steps[2]) == sorted(want, key=str) and len(want) < len(docs) - 10


def test_passages(steps):
    seen, want = {}, {}
    for r in sorted((r for r in steps[2].collect() if r.doc_id is not None), key=lambda r: r.doc_id):
        w = (r.text or "").split()
        gone = set()
        for s in range(len(w) - pipeline.PASSAGE + 1):
            if seen.setdefault(tuple(w[s : s + pipeline.PASSAGE]), (r.doc_id, s)) < (r.doc_id, s):
                gone |= set(range(s, s + pipeline.PASSAGE))
        want[r.doc_id] = " ".join(x for i, x in enumerate(w) if i not in gone)
    found = {r.doc_id: r for r in steps[3].collect()}
    assert {i: " ".join((r.text or "").split()) for i, r in found.items() if i is not None} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found.values())
    before = {r.doc_id: r.text for r in steps[2].collect()}
    cut = {i for i in found if found[i].text != before[i]}
    assert {i % 8 for i in cut} == {2, 3} and len(cut) == 39 and found[None].text == before[None]


def test_mix(steps):
    before = {}
    for r in steps[3].collect():
        before[r.doc_id] = r
    size = lambda t: len((t or "").split())
    sizes, taken = {}, {}
    for r in before.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    copies = {}
    for r in steps[4].collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        copies.setdefault(r.doc_id, []).append(size(r.text))
        whole = before[r.doc_id]
        assert r.text == whole.text or whole.text.split()[: size(r.text)] == r.text.split()
        assert r.n_chars == len(r.text) and (r.lang, r.source, r.score) == (whole.lang, whole.source, whole.score)
    assert all(len(c) <= 2 and sum(c) <= 2 * size(before[i].text) for i, c in copies.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) <= 3 and all(taken[s] <= 2 * sizes[s] for s in taken)


def test_encoding(spark, sf, steps):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for r in steps[4].collect():
        ids = oracle.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha(r.text.encode())))
    assert rows(steps[5]) == sorted(want, key=str)
    assert rows(pipeline.run(spark, sf)) == rows(steps[5])


def test_empty_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_one_row_of_each_id(spark):
    """Of an id with different texts one row stays, as the docstring says."""
    texts = {"one": " ".join(f"a{i}" for i in range(40)), "two": " ".join(f"b{i}" for i in range(40))}
    rows = [(1, texts["one"], "en", "a", 1, 1), (1, texts["two"], "en", "a", 1, 1), (2, "else " * 20, "en", "a", 1, 1)]
    kept = pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2] and {r.text for r in kept if r.doc_id == 1} < set(texts.values())
    hashes = spark.createDataFrame([(t,) for t in texts.values()], "text string").selectExpr("text", "xxhash64(text) as h").orderBy("h").collect()
    assert next(r.text for r in kept if r.doc_id == 1) == hashes[0].text


def test_clashing_names(spark, sf):
    """Columns named as the stages' own come through as they were."""
    names = ["_quality", "score_", "_id", "_text", "_row", "runs", "_key", "_range", "_slot", "_size", "size", "taken", "target", "source_size", "row", "nth", "_part", "_turn"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.select("*", *((F.xxhash64("doc_id") + i).alias(n) for i, n in enumerate(names)))
    for _, stage in pipeline.STAGES[:-1]:
        more = Scratch(spark, "clash").keep(stage(spark, more, sf), "t")
        assert more.columns == [*docs.columns, *names]
    wrong = [F.col(n) != F.xxhash64("doc_id") + i for i, n in enumerate(names)]
    assert more.count() > 50 and all(more.where(w).count() == 0 for w in wrong)
