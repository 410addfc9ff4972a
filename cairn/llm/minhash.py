"""Near-duplicate documents by fast similarity sketching.

A document's set is its distinct word shingles as 64-bit hashes. The sketch (Dahlgaard, Knudsen and
Thorup, "Fast Similarity Sketching") places every shingle in one hashed bin a round, a bin keeping
the smallest (round, hash); rounds go on until every bin is filled, and rounds beyond the number of
bins fill one given bin each, so that they end. Bins are banded, and documents that share a band are
candidates. Which candidates are linked is decided on their full sets:

1. Documents with equal sets are one node, by a 128-bit sum over the set.
2. Each band value links its documents to the smallest of them (the pivot), not to one another.
   The components of these candidate links are clusters; only documents in clusters go on.
3. Each node is compared to the pivot with which it shares most bands. Components of the links found
   settle most clusters, however large.
4. In clusters still of several components, nodes of different components that can be linked are
   compared. A cluster of bounded weight is compared in one task. In a larger one, a node's shingles are
   sorted by how many nodes of the cluster have them, rarest first: of two sets that are linked, the
   first n - ceil(threshold * n) + 1 shingles share one. Nodes that share such a shingle with at most
   PARTNERS others meet them in a join. The others, which share what many have, meet in blocks of
   fixed-size signatures (no texts): parities of hashed counts, a bound on the sets' difference; the
   nodes of the largest component are not met with one another. What passes is compared on full sets,
   one pair of each node and component first, the rest only where that one isn't linked.

So every two documents in a cluster are either in one component or can't be linked. A pair is
missed only if no chain of shared bands connects it; a pair at the threshold shares no band with
probability MISS at most.

Pivots, clusters and shingles that hold more than one in COMMON of the rows are broadcast or salted where
they are joined with texts or with what is as large, so that no task gets all of them. In the other joins a
row is a few numbers, one side has a row for each key, and adaptive execution splits what is skewed.

Null and empty texts have empty sets and no links. Texts of fewer words than a shingle have the
whole sequence as their one shingle. Rows that repeat an id are one node, also where their texts differ:
whatever any of them is linked with is linked with all. Rows with a null id take no part and are kept.
Thresholds below LEAST are refused, since bands for them would be too many.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.components import components
from cairn.llm.shared import Scratch, join_counted, join_texts, tasks_for
from cairn.llm.words import U, mix, slices, utf8, words

ROWS, MISS, LEAST = 5, 1e-5, 0.5
#: Weight of a cluster that one task compares in step 4: words of its texts, about, and 500 for each node.
BLOCK = 1_000_000
#: Nodes that meet by a shingle in a join, and nodes of a block of signatures.
PARTNERS, SIGNATURES = 64, 2048
#: Bins of sketches that are filled together.
BINS = 1 << 22
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    if not LEAST <= threshold <= 1:
        raise ValueError(f"a threshold from {LEAST} to 1 is needed, not {threshold}")
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows)) if threshold < 1 else 1


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted within the row, and the rows' offsets in them."""
    _, _, hashed, first = words(data, at, fold=True)
    count = np.diff(first)
    n = len(hashed)
    mixed = np.zeros(n, U)
    if n >= size:
        for j in range(size):
            mixed[: n - size + 1] += hashed[j : n - size + 1 + j] * U(2 * j * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)
    mixed = mix(mixed)
    keep = np.ones(n, bool)
    for i in np.flatnonzero(count >= size):
        keep[first[i + 1] - size + 1 : first[i + 1]] = False
    for i in np.flatnonzero((count > 0) & (count < size)):
        whole = U(int(count[i]))
        for h in hashed[first[i] : first[i + 1]]:
            whole = mix(np.array([whole * U(0x9E3779B97F4A7C15) + h]))[0]
        mixed[first[i]] = whole
        keep[first[i] + 1 : first[i + 1]] = False
    sizes = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    mixed, ends = mixed[keep], np.concatenate(([0], np.cumsum(sizes)))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a > 1:
            mixed[a:b].sort()
    new = np.ones(len(mixed), bool)
    new[1:] = mixed[1:] != mixed[:-1]
    new[ends[:-1][sizes > 0]] = True
    total = np.concatenate(([0], np.cumsum(new)))
    return mixed[new], total[ends]


def sketch(sets: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Filled bins of each row's set; rows without any stay unfilled. A bin's highest bits are its round,
    as many as the number of rounds needs, and the others those of the hash."""
    n, sizes = len(at) - 1, np.diff(at)
    low = 64 - (2 * bins).bit_length()
    mask = U((1 << low) - 1)
    out = np.full(n * bins, _FULL)
    row = np.repeat(np.arange(n), sizes)
    for turn in range(2 * bins):
        if not len(sets):
            break
        hashed = mix(sets ^ mix(np.array([turn + 1], U)))
        place = ((hashed >> U(32)) * U(bins) >> U(32)).astype(np.int64) if turn < bins else turn - bins
        np.minimum.at(out, row * bins + place, (hashed & mask) | U(turn << low))
        open_rows = (out.reshape(n, bins) == _FULL).any(1)
        if not open_rows[row[0]] or not open_rows.all():
            left = open_rows[row]
            sets, row = sets[left], row[left]
    return out.reshape(n, bins)


def banded(bins: np.ndarray, rows: int) -> np.ndarray:
    """One hash of each band of bins."""
    bands = bins.shape[1] // rows
    out = np.zeros((len(bins), bands), U)
    for j in range(rows):
        out = mix(out * U(0x9E3779B97F4A7C15) + bins[:, j::rows][:, :bands])
    return mix(out + np.arange(1, bands + 1, dtype=U))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, U), np.cumsum(values, dtype=U)))
    return (total[at[1:]] - total[at[:-1]]).view(np.int64)


def sketches(documents: DataFrame, size: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n, two sums that stand for the set, and the bands of each row."""

    def run(batches):
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                sets, ends = shingles(data, at[i : j + 1], size)
                step = max(1, BINS // (bands * rows))
                parts = [(ends[k], ends[k : k + step + 1]) for k in range(0, j - i, step)]
                found = np.concatenate([banded(sketch(sets[e[0] : e[-1]], e - base, bands * rows), rows) for base, e in parts]).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(ends)), pa.array(_sums(mix(sets ^ U(0x5851F42D4C957F2D)), ends)), pa.array(_sums(mix(sets ^ U(0x14057B7EF767814F)), ends)), lists],
                    ["doc_id", "n", "f1", "f2", "bands"],
                )

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>")


def _sets(column, size: int) -> list[np.ndarray]:
    data, at = utf8(column)
    out = []
    for i, j in slices(at):
        sets, ends = shingles(data, at[i : j + 1], size)
        out += [sets[a:b].copy() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = _common(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def _compare_pairs(size: int, num: int, den: int):
    """The rows of pairs with own and text whose sets are linked, without these two columns; own is that of
    the id which changes less often."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            names = [n for n in batch.schema.names if n not in ("own", "text")]
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                pivots, own = part.column("b").to_pylist(), _sets(part.column("own"), size)
                texts = part.column("text").to_pylist()
                new = [k for k in range(len(pivots)) if (pivots[k], texts[k]) != ((pivots[k - 1], texts[k - 1]) if k else last)]
                sets = _sets(part.column("text").take(pa.array(new, pa.int64())), size)
                hits = []
                for k in range(len(pivots)):
                    if new and new[0] == k:
                        new.pop(0)
                        kept = sets.pop(0)
                    hits.append(_linked(own[k], kept, num, den))
                last = (pivots[-1], texts[-1])
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names], names).filter(pa.array(hits, pa.bool_()))

    return run


def _linked_pairs(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Those of pairs (a, b and any others, a kept table) whose texts' sets are linked."""
    total = pairs.count()
    both = pairs
    for end, name in (("a", "own"), ("b", "text")):
        counts = pairs.groupBy(F.col(end).alias("rep")).agg(F.count("*").alias("many"))
        both = join_texts(both, texts, end, name, counts, total)
    schema = ", ".join(f"{n} bigint" for n in pairs.columns)
    return both.select(*pairs.columns, "own", "text").mapInArrow(_compare_pairs(size, num, den), schema)


def parities(sets: list[np.ndarray], words64: int = 64) -> np.ndarray:
    """Of each set, the parity of how many of its hashes fall on each bit. Two sets differ in no
    fewer elements than their parities do in bits."""
    out = np.zeros((len(sets), words64 * 64), bool)
    for i, s in enumerate(sets):
        out[i] = np.bincount((s >> U(40)).astype(np.int64) % out.shape[1], minlength=out.shape[1]) & 1
    return np.packbits(out, axis=1).view(U)


def _resolve(size: int, num: int, den: int):
    """All pairs of different components in one task's rows of each cluster: the links that join them."""

    def run(table: pa.Table) -> pa.Table:
        ids, cluster = np.array(table["rep"].to_pylist()), np.array(table["cluster"].to_pylist())
        comp = np.array(table["comp"].to_pylist())
        sets = _sets(table["text"], size)
        found = []
        for c in np.unique(cluster):
            rows = np.flatnonzero(cluster == c)
            if len(np.unique(comp[rows])) > 1:
                found += [(ids[a], ids[b]) for a, b in _joins(rows, sets, comp, num, den)]
        return pa.table({"a": pa.array([int(a) for a, _ in found], pa.int64()), "b": pa.array([int(b) for _, b in found], pa.int64())})

    return run


def _joins(rows, sets, comp, num, den):
    root = {int(c): int(c) for c in comp[rows]}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    counts = np.array([len(sets[r]) for r in rows])
    bits = parities([sets[r] for r in rows])
    own = comp[rows]
    for i in range(1, len(rows)):
        total = counts[i] + counts[:i]
        # linked: common >= num * total / (num + den), so the sets differ in total - 2 * common at most
        most = total - 2 * (-(-num * total // (num + den)))
        try_ = np.flatnonzero((own[:i] != own[i]) & (np.abs(counts[:i] - counts[i]) <= most))
        if len(try_):
            try_ = try_[np.bitwise_count(bits[try_] ^ bits[i]).sum(1, dtype=np.int64) <= most[try_]]
        for j in try_:
            a, b = find(int(own[i])), find(int(own[j]))
            if a != b and _linked(sets[rows[i]], sets[rows[j]], num, den):
                root[max(a, b)] = min(a, b)
                yield rows[i], rows[j]


def near_duplicates(documents: DataFrame, size: int = 5, threshold: str = "0.8", block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of documents (doc_id, text, any others).

    threshold: least intersection over union, as an exact decimal."""
    spark = documents.sparkSession
    limit = Fraction(threshold)
    num, den = limit.numerator, limit.denominator
    bands = bands_for(float(limit))
    scratch = Scratch(spark, "minhash")
    drawn = scratch.keep(sketches(documents, size, bands), "sketches")
    whole = drawn.where("n > 0 and doc_id is not null")
    same_set = ["f1", "f2", "n"]
    # equal sets have equal bands
    nodes = scratch.keep(whole.groupBy(*same_set).agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")), "nodes")
    banded_ = nodes.select("rep", F.explode("bands").alias("band"))
    pivots = banded_.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("many")).where("many > 1")
    stars = banded_.join(pivots, "band").where("rep <> pivot").groupBy(F.col("rep").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("shared"))
    stars = scratch.keep(stars, "stars")
    clusters = components(stars, scratch, "clusters")
    clustered = clusters.union(clusters.select("b", "b").distinct()).toDF("rep", "cluster")
    # the same join at every size: ids grow with the input, so that none is broadcast
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(clustered.hint("merge"), F.col("doc_id") == F.col("rep"))
    texts = scratch.keep(texts.select("rep", "cluster", "text"), "texts")
    best = scratch.keep(stars.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")), "best")
    first = scratch.keep(_linked_pairs(best, texts, size, num, den), "links-1")
    settled = components(first, scratch, "settled")
    labelled = texts.join(settled.select(F.col("a").alias("rep"), F.col("b").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    second = scratch.keep(_rest(labelled, texts, scratch, size, num, den, block), "links-2")
    # ids whose rows have different sets tie these together
    sets_of = drawn.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*same_set)).alias("low"), F.max(F.struct(*same_set)).alias("high"))
    several = scratch.keep(sets_of.where("low <> high").select(F.col("doc_id").alias("id")), "several")
    ties = whole.join(several, F.col("doc_id") == F.col("id"), "left_semi").select("doc_id", *same_set).distinct()
    ties = scratch.keep(ties.join(nodes.select(*same_set, "rep"), same_set).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")), "ties")
    final = components(first.union(second).union(ties), scratch, "final").toDF("rep", "component")
    known = nodes.join(final, "rep", "left").select(*same_set, F.coalesce("component", "rep").alias("component"))
    out = drawn.select("doc_id", *same_set).join(known, same_set, "left")
    # an id with other sets has the component of them all, in its empty rows too
    tied = ties.join(final, F.col("b") == F.col("rep"), "left").groupBy(F.col("a").alias("id")).agg(F.min(F.coalesce("component", "b")).alias("tied"))
    out = out.join(tied, F.col("doc_id") == F.col("id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("tied", "component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rest(labelled: DataFrame, texts: DataFrame, scratch: Scratch, size: int, num: int, den: int, block: int) -> DataFrame:
    """Links (a, b) between the components of each cluster that has several. labelled: rep, cluster, comp, text."""
    weight = F.floor(F.octet_length("text") / 6) + 500
    parts = labelled.groupBy("cluster", "comp").agg(F.sum(weight).alias("w"))
    of_cluster = parts.groupBy("cluster").agg(F.count("*").alias("parts"), F.sum("w").alias("total"), F.max_by("comp", F.struct("w", "comp")).alias("main"))
    of_cluster = scratch.keep(of_cluster, "of-cluster")
    everything = of_cluster.agg(F.sum("total")).first()[0] or 0
    rows = scratch.keep(join_counted(labelled, of_cluster.where("parts > 1"), ["cluster"], "total", everything), "mixed")
    few = 4 * tasks_for(labelled.sparkSession, labelled, 1 << 22)
    small = rows.where(F.col("total") <= block).select(F.pmod(F.xxhash64("cluster"), F.lit(few)).alias("task"), "rep", "cluster", "comp", "text")
    found = small.groupBy("task").applyInArrow(_resolve(size, num, den), "a bigint, b bigint")
    large = rows.where(F.col("total") > block)
    return found.union(_between(large, texts, scratch, size, num, den)) if not large.isEmpty() else found


_SETS = "rep bigint, node bigint, cluster bigint, comp bigint, main boolean, n int, first int, bits binary, shingles array<bigint>"


def _described(size: int, num: int, den: int):
    """Of each text its set's size, how many of its rarest shingles a linked set shares one of, signature and set."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = _sets(part.column("text"), size)
                n = np.array([len(x) for x in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, U)
                at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))
                first = n + (-num * n) // den + 1
                bits = pa.array([b.tobytes() for b in parities(sets)], pa.binary())
                main = pa.compute.equal(part.column("comp"), part.column("main"))
                node = pa.array(_sums(mix(flat ^ U(0x5851F42D4C957F2D)), at))
                columns = [part.column("rep"), node, part.column("cluster"), part.column("comp"), main, pa.array(n.astype(np.int32)), pa.array(first.astype(np.int32)), bits, lists]
                yield pa.RecordBatch.from_arrays(columns, ["rep", "node", "cluster", "comp", "main", "n", "first", "bits", "shingles"])

    return run


def _between(large: DataFrame, texts: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links between the components of large clusters."""
    described = large.select("rep", "cluster", "comp", "main", "text").mapInArrow(_described(size, num, den), _SETS)
    described = scratch.keep(described, "described")
    here = ["cluster", "shingle"]
    elements = described.select("cluster", "rep", "node", "comp", "main", "n", "first", F.explode("shingles").alias("shingle"))
    counts = scratch.keep(elements.groupBy(*here).agg(F.count("*").alias("many")), "counts")
    ranked = join_counted(elements, counts, here, "many", counts.agg(F.sum("many")).first()[0])
    place = F.row_number().over(Window.partitionBy("cluster", "rep", "node").orderBy("many", "shingle"))
    prefixes = scratch.keep(ranked.withColumn("place", place).where("place <= first").drop("place", "first", "many"), "prefixes")
    held = scratch.keep(prefixes.groupBy(*here).agg(F.count("*").alias("held"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").drop("low", "high"), "held")
    met = join_counted(prefixes, held, here, "held", prefixes.count())
    near = met.where(F.col("held") <= PARTNERS).select(*here, "rep", "comp", "n")
    other = near.toDF(*here, "rep2", "comp2", "n2")
    fits = (F.col("rep") < F.col("rep2")) & (F.col("comp") != F.col("comp2")) & (den * F.least("n", "n2") >= num * F.greatest("n", "n2"))
    by_join = near.join(other, here).where(fits).select(F.col("rep").alias("a"), F.col("rep2").alias("b"), F.col("comp").alias("ca"), F.col("comp2").alias("cb"))
    common = met.where(F.col("held") > PARTNERS).select("rep", "node").distinct()
    signed = scratch.keep(described.drop("shingles", "first").join(common, ["rep", "node"], "left_semi"), "signed")
    pairs = scratch.keep(by_join.union(_by_signature(signed, scratch, num, den)).distinct(), "pairs")
    # one pair of each node and component; the rest of them only if this one isn't linked
    lead = scratch.keep(pairs.groupBy("a", "ca", "cb").agg(F.min("b").alias("b")), "lead-pairs")
    linked = scratch.keep(_linked_pairs(lead, texts, size, num, den), "lead-links")
    known = linked.select("ca", "cb").distinct()
    left = scratch.keep(pairs.join(known, ["ca", "cb"], "left_anti").join(lead, ["a", "b", "ca", "cb"], "left_anti"), "left-pairs")
    return linked.select("a", "b").union(_linked_pairs(left, texts, size, num, den).select("a", "b"))


def _by_signature(signed: DataFrame, scratch: Scratch, num: int, den: int) -> DataFrame:
    """Pairs of different components in each cluster whose signatures allow a link."""
    sizes = signed.groupBy("cluster").agg(F.count("*").alias("many"), F.sum(F.col("main").cast("int")).alias("m"))
    sizes = scratch.keep(sizes.select("cluster", "many", F.ceil(F.col("m") / SIGNATURES).cast("int").alias("main_blocks"), F.ceil((F.col("many") - F.col("m")) / SIGNATURES).cast("int").alias("blocks")), "signed-sizes")
    rows = join_counted(signed, sizes, ["cluster"], "many", sizes.agg(F.sum("many")).first()[0])
    pick, none = lambda n: F.pmod(F.xxhash64("rep", "node"), n).cast("int"), F.array().cast("array<string>")
    name = lambda kind, i, j: F.concat_ws(":", F.col("cluster"), F.lit(kind), i, j)
    upto = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)).otherwise(none)
    own = pick(F.col("blocks"))
    with_rest = upto("blocks", lambda i: name("m", i, pick(F.col("main_blocks"))))
    with_others = F.concat(upto("main_blocks", lambda j: name("m", own, j)), upto("blocks", lambda j: name("r", F.least(own, j), F.greatest(own, j))))
    tasks = rows.select("rep", "comp", "main", "n", "bits", F.explode(F.when(F.col("main"), with_rest).otherwise(with_others)).alias("task"))
    return tasks.groupBy("task").applyInArrow(_close(num, den), "a bigint, b bigint, ca bigint, cb bigint")


def _close(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        ids, comp, n = (np.array(table[c]) for c in ("rep", "comp", "n"))
        main = np.array(table["main"])
        n = n.astype(np.int64)
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), U).reshape(len(ids), -1)
        out = [[], [], [], []]
        for i in range(1, len(ids)):
            total = n[i] + n[:i]
            # linked: common >= num * total / (num + den), so the sets differ in total - 2 * common at most
            most = total - 2 * (-(-num * total // (num + den)))
            try_ = np.flatnonzero((comp[:i] != comp[i]) & ~(main[:i] & main[i]) & (np.abs(n[:i] - n[i]) <= most))
            try_ = try_[np.bitwise_count(bits[try_] ^ bits[i]).sum(1, dtype=np.int64) <= most[try_]]
            for j in try_:
                a, b = (i, j) if ids[i] < ids[j] else (j, i)
                for values, x in zip(out, (ids[a], ids[b], comp[a], comp[b])):
                    values.append(int(x))
        return pa.table([pa.array(x, pa.int64()) for x in out], ["a", "b", "ca", "cb"])

    return run


def op10(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, "0.85")
