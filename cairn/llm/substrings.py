"""Repeated passages: seed and extend over winnowed anchors.

A window is so many consecutive words of one document. A word is removed if a window that covers it
also starts earlier, in a document of smaller id or earlier in its own.

Seeds: of the word grams inside a window, the one of smallest hash (the leftmost of equals) is its
anchor, so equal windows have equal anchors at equal places, and about 2 in (window - gram + 2)
grams are anchors. Consecutive windows with one anchor are a run; the run's words reach from the
anchor as far both ways as its windows do.

Extension: occurrences of an anchor meet in one partition. Where their runs are equal word for word
(128 bits of hash), all but the earliest are repeats as a whole. Only where an anchor has different
runs, the earliest occurrence of each goes on, window by window, and meets the others under the
windows' own hashes. Repeats that overlap unite to maximal ones when words are removed. Words are
compared by these hashes only: two different passages of equal hashes (128 bits for runs and windows)
would be taken for one.

So no two occurrences are ever paired. Occurrences are packed into arrays before a shuffle, those of
equal runs within some megabytes of text (a pack) only once, so that a passage held by a third of all
documents weighs little more than any other. Where an anchor has different runs within a pack, as one in
a passage between words that differ, these are known to go on: they are spread by their own hashes, and
the anchor's partition gets one of them as a mark. So a partition gets at most one occurrence of an
anchor from each pack, whatever surrounds it.

An id is a key: null ids are left as they are and are no one's earlier occurrence; positions found for an
id apply to each row that repeats it. Null and empty texts have no words and lose none.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import Scratch, fresh, tasks_for
from cairn.llm.words import U, between, mix, slices, sums, utf8, words

WINDOW, GRAM = 20, 8
#: Words of one document whose windows are looked at together; bytes of text packed together.
CHUNK, PACK = 1 << 20, 1 << 24
#: Parquet bytes for each part of the anchors, and parts for each task.
PART_BYTES, PARTS_EACH = 1 << 20, 8
#: len is negative in a mark.
_FIELDS = (("key", U), ("key2", U), ("doc", np.int64), ("start", np.int32), ("len", np.int32))
_PACKED = "part int, " + ", ".join(f"{name} binary" for name, _ in _FIELDS)


def _leftmost_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of width values, the smallest and where it is first."""
    n = len(values) - width + 1
    low, at, span = values, np.arange(len(values)), 1

    def join(first, second, count):
        right = low[second : second + count] < low[first : first + count]
        return np.where(right, low[second : second + count], low[first : first + count]), np.where(right, at[second : second + count], at[first : first + count])

    while span * 2 <= width:
        low, at = join(0, span, len(low) - span)
        span *= 2
    return join(0, width - span, n)


def runs(hashes: np.ndarray, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Of rows whose words' numbers begin at `first`: each run's row, its first word in the row, its
    length in words, its anchor's hash and its own."""
    n = len(hashes)
    empty = {"row": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "len": np.zeros(0, np.int64), "key": np.zeros(0, U), "key2": np.zeros(0, U)}
    if n < window:
        return empty
    prefix = sums(hashes)
    at = np.arange(n - gram + 1)
    grams = between(prefix, at, at + gram)
    _, anchor = _leftmost_min(grams, window - gram + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts = np.flatnonzero(row[: n - window + 1] == row[window - 1 :])
    if not len(starts):
        return empty
    anchor = anchor[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]
    anchor = anchor[new]
    own = mix(between(prefix, begin, last + window) + (anchor - begin).astype(U) * U(0x9E3779B97F4A7C15))
    return {"row": row[begin], "start": begin - first[row[begin]], "len": last + window - begin, "key": grams[anchor], "key2": own}


def _all_runs(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """runs(), a long document in chunks; windows belong to the chunk in which they start."""
    if len(first) > 2 or len(hashes) <= 2 * CHUNK:
        yield runs(hashes, first, window, gram)
        return
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK + window - 1]
        found = runs(part, np.array([0, len(part)]), window, gram)
        found["start"] += i
        yield found


class _Packer:
    """Collects occurrences, drops those that repeat an earlier one here, and packs the rest by part: of
    an anchor, or, if anchors are split and it has several runs here, of the run."""

    def __init__(self, parts: int, split: bool):
        self.parts, self.split, self.held = parts, split, []

    def add(self, found: dict[str, np.ndarray]) -> None:
        if len(found["doc"]):
            self.held.append([found[name].astype(kind) for name, kind in _FIELDS])

    def flush(self) -> list[pa.RecordBatch]:
        if not self.held:
            return []
        columns = _sorted([np.concatenate(x) for x in zip(*self.held)])
        self.held = []
        lead, later = _earliest(columns)
        out = [_packed(-1, columns, later)] if later.any() else []
        columns = [c[lead] for c in columns]
        names = mix(columns[0])  # an anchor is the smallest of some hashes, so its own isn't spread evenly
        if self.split:
            group = _groups(columns[0])
            several = np.bincount(group)[group] > 1
            mark = several & (np.diff(group, prepend=-1) > 0)
            names = np.concatenate((np.where(several, mix(names ^ columns[1]), names), names[mark]))
            columns = [np.concatenate((c, c[mark])) for c in columns]
            columns[4][len(several) :] *= -1
        part = _part_of(names, self.parts)
        order = np.argsort(part, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            out.append(_packed(int(part[group[0]]), columns, group))
        return [pa.RecordBatch.from_pylist(out, schema=_SCHEMA)]


_SCHEMA = pa.schema([("part", pa.int32())] + [(name, pa.binary()) for name, _ in _FIELDS])


def _part_of(names: np.ndarray, parts: int) -> np.ndarray:
    return ((names >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _packed(part: int, columns: list[np.ndarray], which: np.ndarray) -> dict:
    return {"part": part} | {name: c[which].tobytes() for (name, _), c in zip(_FIELDS, columns)}


def _unpacked(batch_rows) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(r[name], kind) for r in batch_rows]) for name, kind in _FIELDS]


def _sorted(columns: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
    return [c[order] for c in columns]


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the group of equal keys of each row, in sorted rows."""
    new = np.zeros(len(keys[0]), np.int64)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _earliest(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """In sorted rows: the first of each group, and those that start later than it. Rows at the very
    same place (repeats of one id) are neither."""
    key, key2, doc, start, _ = columns
    group = _groups(key, key2)
    lead = np.ones(len(key), bool)
    lead[1:] = group[1:] != group[:-1]
    first = np.flatnonzero(lead)[group]
    return lead, (doc != doc[first]) | (start != start[first])


def _anchored(window: int, gram: int, parts: int):
    def run(batches):
        packer, size = _Packer(parts, True), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                _, _, hashes, first = words(data, at[i : j + 1])
                for found in _all_runs(hashes, first, window, gram):
                    packer.add(found | {"doc": ids[i:j][found["row"]]})
                size += int(at[j] - at[i])
                if size >= PACK:
                    yield from packer.flush()
                    size = 0
        yield from packer.flush()

    return run


def _windows(window: int, parts: int):
    """Hashes of the windows of the runs listed with each row."""

    def run(batches):
        packer, size = _Packer(parts, False), 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, at = utf8(batch.column(1))
            owner, start, length = _listed(batch.column(2))
            ends = np.searchsorted(owner, np.arange(len(ids) + 1))
            for i, j in slices(at):
                _, _, hashes, first = words(data, at[i : j + 1])
                prefix, other = sums(hashes), sums(mix(hashes ^ U(0x5851F42D4C957F2D)))
                these = slice(ends[i], ends[j])
                row, begin, count = owner[these] - i, start[these], length[these] - window + 1
                fits = (begin + length[these]) <= np.diff(first)[row]
                row, begin, count = row[fits], begin[fits], count[fits]
                total = np.cumsum(count)
                step = np.arange(total[-1] if len(total) else 0) - np.repeat(total - count, count)
                row, begin = np.repeat(row, count), np.repeat(begin, count) + step
                place = first[row] + begin
                packer.add({"key": between(prefix, place, place + window), "key2": between(other, place, place + window), "doc": ids[i:j][row], "start": begin, "len": np.full(len(row), window)})
                size += int(at[j] - at[i]) + 40 * len(row)
                if size >= PACK:
                    yield from packer.flush()
                    size = 0
        yield from packer.flush()

    return run


def _listed(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, start and length of each entry of a column of lists of (start, len); null is empty."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return owner, *(flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("len", pa.int32()), ("whole", pa.bool_())])


def _met(parts: int):
    """Repeats among the occurrences of each part: whole runs that start later than an equal one, and,
    not whole, the first of each run of an anchor that has several, here or by a mark. For windows, whose
    two keys are equal together, there are only the former."""

    def settle(part, rows):
        if not rows:
            return
        columns = _unpacked(rows)
        if part < 0:
            yield _found(columns, np.ones(len(columns[0]), bool), True)
            return
        marked = columns[0][columns[4] < 0]
        columns = _sorted([c[columns[4] >= 0] for c in columns])
        lead, later = _earliest(columns)
        yield _found(columns, later, True)
        # runs that were spread by their own hashes are here without their anchor's others
        spread = _part_of(mix(columns[0]), parts) != part
        group = _groups(columns[0])
        yield _found(columns, lead & ((np.bincount(group, lead)[group] > 1) | spread | np.isin(columns[0], marked)), False)

    def run(batches):
        last, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] != last or r["part"] < 0:
                    yield from settle(last, rows)
                    last, rows = r["part"], []
                rows.append(r)
        yield from settle(last, rows)

    return run


def _found(columns, which, whole: bool) -> pa.RecordBatch:
    doc, start, length = (c[which] for c in columns[2:])
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(length), pa.array(np.full(len(doc), whole))], schema=_FOUND)


def _meet(packed: DataFrame, parts: int) -> DataFrame:
    # later occurrences known before the shuffle (part -1) pass through, spread over all tasks
    tasks = max(1, -(-parts // PARTS_EACH))
    spread = F.when(F.col("part") < 0, F.xxhash64("doc")).otherwise(F.col("part").cast("bigint"))
    return packed.repartition(tasks, spread).sortWithinPartitions("part").mapInArrow(_met(parts), "doc_id bigint, start int, len int, whole boolean")


def _lists(found: DataFrame, whole: bool) -> DataFrame:
    return found.where(F.col("whole") == whole).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("start", "len")).alias("runs"))


def repeats(documents: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """doc_id and runs (array of start and len, in words, unordered and perhaps overlapping) of each
    document that holds windows which start earlier elsewhere."""
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession, "substrings")
    gram = gram or max(1, min(GRAM, window // 2))
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = tasks_for(spark, documents, PART_BYTES)
    packed = rows.mapInArrow(_anchored(window, gram, parts), _PACKED)
    runs_found = scratch.keep(_meet(packed, parts), "runs")
    open_runs = _lists(runs_found, False)
    packed = rows.join(open_runs, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "runs").mapInArrow(_windows(window, parts), _PACKED)
    windows_found = scratch.keep(_meet(packed, parts).where("whole"), "windows")
    return _lists(runs_found.union(windows_found), True).withColumnRenamed("_id", "doc_id")


def _masks(batch, text: int, listed: int):
    """Each row's number, the starts of its words in the data, and which of them are removed."""
    data, at = utf8(batch.column(text))
    owner, start, length = _listed(batch.column(listed))
    ends = np.searchsorted(owner, np.arange(batch.num_rows + 1))
    for i, j in slices(at):
        begin, _, _, first = words(data, at[i : j + 1])
        change = np.zeros(len(begin) + 1, np.int64)
        these = slice(ends[i], ends[j])
        row = owner[these] - i
        limit = first[row + 1]
        np.add.at(change, np.minimum(first[row] + start[these], limit), 1)
        np.add.at(change, np.minimum(first[row] + start[these] + length[these], limit), -1)
        gone = np.cumsum(change[:-1]) > 0
        for r in range(i, j):
            words_of = slice(first[r - i], first[r - i + 1])
            yield r, data, at[r : r + 2], begin[words_of], gone[words_of]


def _digests(batches):
    for batch in batches:
        out = []
        for r, data, (a, b), _, gone in _masks(batch, 1, 2):
            kept = data[a:b].tobytes().split()
            if gone.any():
                kept = compress(kept, (~gone).tolist())
            out.append((len(gone), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        n, removed, sha = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches):
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for r, data, (a, b), begin, gone in _masks(batch, 0, 1):
            if gone.any():
                # a removed word goes with the white space up to the next
                edges = np.append(begin, b)
                change = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                pieces, last = [], a
                for x, y in zip(change[::2], change[1::2]):
                    pieces.append(data[last : edges[x]].tobytes())
                    last = edges[y]
                texts[r] = (b"".join(pieces) + data[last:b].tobytes()).decode()
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[2:]], ["text", *batch.schema.names[2:]])


def _with_runs(documents: DataFrame, window: int, gram: int | None) -> tuple[DataFrame, str]:
    """documents with the runs found for their ids, and that column's name."""
    key, listed = fresh(documents.columns, "_id", "runs")
    found = repeats(documents, window, gram).toDF(key, listed)
    return documents.join(found, F.col("doc_id").cast("long") == F.col(key), "left"), listed


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int | None = None) -> DataFrame:
    """documents, with the words of repeated windows removed from text; all other columns as they are."""
    others = [c for c in documents.columns if c != "text"]
    rows, listed = _with_runs(documents, window, gram)
    rows = rows.select("text", listed, *others)
    out = rows.mapInArrow(_cut, rows.drop(listed).schema)
    return out.select(*documents.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, listed = _with_runs(documents, WINDOW, GRAM)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", listed)
    return rows.mapInArrow(_digests, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


#: Every window of every document side by side; for small tables.
OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS v
  FROM split, unnest(range(1, len(w) - 18)) AS u(s)
), repeated AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY v ORDER BY doc_id, s) AS place FROM windows) WHERE place > 1
), gone AS (
  SELECT DISTINCT doc_id, s + o AS p FROM repeated, unnest(range(0, 20)) AS u(o)
), words AS (
  SELECT doc_id, p, w[p] AS word FROM split, unnest(range(1, len(w) + 1)) AS u(p)
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)
"""
