"""Byte-level BPE encoding and decoding with numpy.

Pieces of a text (matches of a pattern) are bytes, and each row of a matrix holds the tokens of one
piece. Pieces of similar lengths share a matrix, padded on the right. In each round every row merges
its leftmost pair of minimum rank; ranks of pairs come from a hash table of the pairs, and rows
without a pair to merge leave the matrix. Pieces beyond LONG bytes, where rounds would cost the
square of the length, are merged with a heap over a linked list instead, to the same tokens.

Null and empty texts have no tokens. A piece is encoded once for each cache of a worker; the cache
is bounded by CACHE pieces and begins anew beyond that.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LONG, CACHE, SLICE = 256, 400_000, 1 << 20
_NONE = np.int32(1 << 30)
_C = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing from a pair of tokens to the rank of what they merge to."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, _NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        ranks = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], ranks[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, ranks, slot = keys[left], ranks[left], (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _C) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE where there is no such merge; negative tokens are padding."""
        out = np.full(left.shape, _NONE, np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        keys = left.ravel()[at].astype(np.int64) << 32 | right.ravel()[at].astype(np.int64)
        slot, flat = self._slot(keys), out.ravel()
        while len(at):
            there = self.keys[slot]
            hit = there == keys
            flat[at[hit]] = self.ranks[slot[hit]]
            on = ~hit & (there >= 0)
            at, keys, slot = at[on], keys[on], (slot[on] + 1) & (len(self.keys) - 1)
        return flat.reshape(left.shape)


def _spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(lengths)
    return np.concatenate(([0], ends)), ends - lengths


def gather(flat: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of flat[offsets[i]:offsets[i+1]] for i in index, and its offsets."""
    lengths = offsets[index + 1] - offsets[index]
    out, starts = _spread(lengths)
    return flat[np.arange(out[-1]) - np.repeat(starts - offsets[index], lengths)], out


class Encoder:
    """Encodes as the ranks say. ranks: bytes of a token -> its rank, which is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                if (a := ranks.get(token[:cut])) is not None and (b := ranks.get(token[cut:])) is not None:
                    pairs[a, b] = rank
        self.pairs, self.table = pairs, PairTable(pairs)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_at = _spread(np.array([len(t) for t in tokens]))[0]
        digits = [b"%d " % i for i in range(size)]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_at = _spread(np.array([len(t) for t in digits]))[0]
        self._clear()

    def _clear(self) -> None:
        self.flat, self.at, self.known = np.zeros(0, np.int32), np.zeros(1, np.int64), _Numbers()

    def pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the pieces, one after the other, and their offsets."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list = [None] * len(pieces)
        width = np.where(lengths <= 16, (lengths + 1) // 2 * 2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if w > LONG:
                for i in rows:
                    out[i] = self._long(pieces[i])
                continue
            for part in np.array_split(rows, -(-len(rows) * int(w) // (1 << 20))) if w else []:
                raw = np.frombuffer(b"".join(pieces[i].ljust(w, b"\0") for i in part), np.uint8).reshape(len(part), w)
                tokens = np.where(np.arange(w) < lengths[part, None], self.byte[raw], np.int32(-1))
                for rows_done, found in self._merged(tokens):
                    counts = (found >= 0).sum(1)
                    values, ends = found[found >= 0], np.cumsum(counts)
                    for r, piece in zip(part[rows_done], np.split(values, ends[:-1])):
                        out[r] = piece
        empty = np.zeros(0, np.int32)
        out = [empty if x is None else x for x in out]
        return (np.concatenate(out) if out else empty), _spread(np.fromiter(map(len, out), np.int64, len(out)))[0]

    def _merged(self, tokens: np.ndarray):
        """Yields (rows, their tokens) as rows are done."""
        rows = np.arange(len(tokens))
        ranks = self.table(tokens[:, :-1], tokens[:, 1:])
        while tokens.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == _NONE
            if done.any():
                yield rows[done], tokens[done]
                tokens, ranks, rows, at, best = tokens[~done], ranks[~done], rows[~done], at[~done], best[~done]
            if not len(rows):
                return
            n, w = np.arange(len(rows)), tokens.shape[1]
            tokens[n, at] = best
            cols = np.arange(w - 1)
            tokens = np.take_along_axis(tokens, cols + (cols > at[:, None]), 1)
            if w == 2:
                break
            cols = np.arange(w - 2)
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.table(tokens[left, at[left] - 1], tokens[left, at[left]])
            right = np.flatnonzero(at < w - 2)
            ranks[right, at[right]] = self.table(tokens[right, at[right]], tokens[right, at[right] + 1])
        yield rows, tokens

    def _long(self, piece: bytes) -> np.ndarray:
        tokens = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(tokens)
        after, before, get = [*range(1, n), -1], [-1, *range(n - 1)], self.pairs.get
        heap = [(r, i, tokens[i], tokens[i + 1]) for i in range(n - 1) if (r := get((tokens[i], tokens[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else -1
            if j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := get((rank, tokens[after[j]]))) is not None:
                    heapq.heappush(heap, (r, i, rank, tokens[after[j]]))
            if (k := before[i]) >= 0 and (r := get((tokens[k], rank))) is not None:
                heapq.heappush(heap, (r, k, tokens[k], rank))
        return np.array([t for t in tokens if t >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the texts, one after the other, and their offsets."""
        if len(self.known) > CACHE:
            self._clear()
        lookup, index, counts = self.known.__getitem__, [], []
        for text in texts:
            found = self.split(text) if text else []
            index.append(np.fromiter(map(lookup, found), np.int64, len(found)))
            counts.append(len(found))
        if new := self.known.new:
            flat, at = self.pieces([p.encode() for p in new])
            self.at = np.concatenate((self.at, at[1:] + len(self.flat)))
            self.flat = np.concatenate((self.flat, flat))
            new.clear()
        ids, at = gather(self.flat, self.at, np.concatenate(index) if index else np.zeros(0, np.int64))
        return ids, at[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Bytes of the texts whose ids lie between the offsets."""
        data, ends = gather(self.token_bytes, self.token_at, ids)
        data, ends = data.tobytes(), ends[at].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def written(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The ids of each text as decimal numbers joined by one space."""
        data, ends = gather(self.digits, self.digits_at, ids)
        data, ends = data.tobytes(), ends[at].tolist()
        return [data[a : max(a, b - 1)] for a, b in zip(ends, ends[1:])]


class _Numbers(dict):
    """Numbers pieces in the order in which they come; `new` holds those not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_encoders: dict = {}


def encoder_for(data: bytes, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    key = hashlib.sha256(data + pattern.encode()).digest()
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(data), pattern)
    return _encoders[key]


def _parts(batch: pa.RecordBatch):
    """The rows of a batch, so many together as hold SLICE characters or one row."""
    texts, start, size = batch.column(1).to_pylist(), 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i + 1 == len(texts):
            yield batch.column(0).slice(start, i + 1 - start), texts[start : i + 1]
            start, size = i + 1, 0


def _run(documents: DataFrame, path: str, pattern: str, key: str, text: str, columns: str, make) -> DataFrame:
    rows = documents.select(key, text)
    # under 2 MB whatever the input, as it is a vocabulary
    data = documents.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        encoder = encoder_for(data.value, pattern)
        for batch in batches:
            for keys, texts in _parts(batch):
                yield pa.RecordBatch.from_arrays([keys, *make(encoder, texts)[0]], [key, *make.names])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, {columns}")


def _ids(encoder, texts):
    ids, at = encoder.encode(texts)
    return [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ids


_ids.names = ["ids"]


def _digest(encoder, texts):
    ids, at = encoder.encode(texts)
    sha = lambda parts: pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())
    return [pa.array(np.diff(at)), sha(encoder.written(ids, at)), sha(encoder.decode(ids, at))], ids


_digest.names = ["n_tokens", "ids_sha256", "decoded_sha256"]


def encode(documents: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ids (array<int>) of each row. Null and empty texts have no ids."""
    return _run(documents, path, pattern, key, text, "ids array<int>", _ids)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and the bytes that the ids stand for. Null ids have no bytes."""
    rows = encoded.select(key, ids)
    data = encoded.sparkSession.sparkContext.broadcast(open(path, "rb").read())

    def run(batches):
        encoder = encoder_for(data.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                lists = [x or [] for x in part.column(1).to_pylist()]
                flat = np.array([t for x in lists for t in x], np.int64)
                found = encoder.decode(flat, np.concatenate(([0], np.cumsum([len(x) for x in lists], dtype=np.int64))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], [key, "bytes"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, bytes binary")


def digests(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the written ids and of the bytes decoded from them."""
    return _run(documents, path, pattern, "doc_id", "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
