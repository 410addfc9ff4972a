import base64

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, P.PATTERN)


def check(texts):
    ids, at = ENCODER.encode(texts)
    want = [ORACLE.encode_ordinary(t or "") for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    assert ENCODER.decode(ids, at) == [(t or "").encode() for t in texts]
    assert ENCODER.written(ids, at) == [" ".join(map(str, w)).encode() for w in want]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text("abc the'sn \n\t!1é", max_size=300)), max_size=6))
def test_as_tiktoken(texts):
    check(texts)


def test_edges():
    check([None, "", " ", "  \n ", "a" * 5000, "!?" * 700, "<|endoftext|>", "日本語 текст 😀" * 50, "x " * 3000, "ab" * 127, "q" * 255, "q" * 256, "q" * 257])


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    for _ in range(3):
        check(["one two three four five", "six one"])


def test_frame(spark):
    rows = spark.createDataFrame([(1, "Hello there", "x"), (2, None, "y"), (2, "", "z"), (None, "again again", "w")], "doc_id bigint, text string, ids string")
    found = bpe.encode(rows, PATH, P.PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in found.collect()} == {(1, tuple(ORACLE.encode("Hello there"))), (2, ()), (None, tuple(ORACLE.encode("again again")))}
    assert sorted(bytes(r.bytes) for r in bpe.decode(found, PATH, P.PATTERN).collect()) == [b"", b"", b"Hello there", b"again again"]
    assert bpe.digests(rows.limit(0), PATH, P.PATTERN).count() == 0


def test_both_ways_of_merging_agree():
    """Pieces of 200 to 1,000 bytes, by rounds over matrices and by a heap."""
    import random

    rnd = random.Random(2)
    common = [t for t in list(RANKS)[300:5000] if t.isalpha()]
    pieces = []
    for n in range(200, 1001, 50):
        pieces += [b"a" * n, bytes(rnd.randrange(256) for _ in range(n)), b"".join(rnd.choices(common, k=n))[:n], (b"ab" * n)[:n]]
    for piece in pieces:
        tokens = ENCODER.byte[np.frombuffer(piece, np.uint8)][None, :]
        [(_, found)] = ENCODER._merged(tokens)
        assert [t for t in found[0].tolist() if t >= 0] == ENCODER._long(piece).tolist()
