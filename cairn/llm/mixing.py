"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within each source the rows are sorted by ranges of that key, a
running count of words inside a range is added to the total of the ranges before it, and the source
is cut where the running count meets its budget. A budget beyond the source's size repeats it.

The key hashes the whole row, so only rows that are equal in every column share one. A key that holds
more than one in COMMON of the rows is taken out of its range and dealt into slots of its own: equal rows
can be counted in any order, so the mix is the same whichever slot a row falls into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.shared import COMMON, Scratch, fresh, tasks_for

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by a source's place among the sources in code point order, null last; they repeat.
WEIGHTS = (5, 2, 1)
#: All targets together, and the most of any source, in parts of the sizes.
SHARE, MOST = 1.5, 2
SEED = "mix"


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(*columns: Column, seed: str = SEED) -> Column:
    """60 bits of the md5 of columns, the same in every run."""
    text = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *text, F.lit(seed))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target of each source in sizes (source, size).

    The targets are level * weight, or most * source_size where that is less. The level follows in
    closed form: sorted by the level at which they reach their bound, the sources before some place
    are at it, and the rest share what is left. The windows run over one row a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight.cast("double")).withColumn("bound", (most * F.col("source_size")).cast("double"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everywhere = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    none = F.lit(0.0)
    left = F.sum(F.col("source_size").cast("double")).over(everywhere) * share - F.coalesce(F.sum("bound").over(before), none)
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), none)
    levels = ranked.withColumn("place", F.row_number().over(by_level)).withColumn("level", left / open_weight)
    below = F.when(F.col("level") < F.col("bound") / F.col("weight"), F.struct("place", "level"))
    levels = levels.withColumn("open", F.min(below).over(everywhere))
    target = F.when(F.col("place") >= F.col("open.place"), F.col("weight") * F.col("open.level")).otherwise(F.col("bound"))
    return levels.select("source", "source_size", target.alias("target"))


def common_keys(keyed: DataFrame, key: str, bucket: str, ranges: int) -> list[int]:
    """Keys that hold more than one in COMMON of the rows, fewer than COMMON of them. They are looked for
    in ranges that hold more than twice their share; the driver sees one number for each of the ranges,
    200,000 at most."""
    counts = keyed.groupBy(bucket).agg(F.count("*").alias("many")).agg(F.sum("many").alias("rows"), F.collect_list(F.struct(bucket, "many")).alias("ranges")).first()
    least = (counts.rows or 0) / COMMON
    full = [r[0] for r in counts.ranges if r.many > least and r.many > 2 * counts.rows / ranges]
    if not full:
        return []
    found = keyed.where(F.col(bucket).isin(full)).groupBy(key).agg(F.count("*").alias("many")).where(F.col("many") > max(1, least))
    return sorted(r[0] for r in found.select(key).collect())


def mix_sources(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED, ranges: int | None = None) -> DataFrame:
    """What the mix takes of each row.

    rows: doc_id, source, size and any others, a table that is cheap to read again. Adds source_size, target
    and taken, in place of columns of these names. Of a source's budget (the target, rounded) whole repeats
    take every row; the rest is cut off the source in key order, the last row in part. Rows that repeat an
    id, or have none, are rows of their own.
    Empty rows and sources take 0; a null source is a source of its own.
    The key is uniform, so equal ranges of it split even a source that holds most rows evenly."""
    spark = rows.sparkSession
    n = ranges or tasks_for(spark, rows, 1 << 20)
    rows = rows.drop("source_size", "target", "taken")
    key, bucket, slot, start, inside_, place_of, s_, t_ = fresh([*rows.columns, "source_size", "target", "taken"], "_key", "_range", "_slot", "_start", "_inside", "_place", "_s", "_t")
    hashed = [F.xxhash64(*others)] if (others := [c for c in rows.columns if c not in ("doc_id", "source", "size")]) else []
    keyed = rows.withColumn(key, random_key(F.col("doc_id"), F.col("source"), F.col("size"), *hashed, seed=seed)).withColumn(bucket, F.floor(F.col(key) / ((1 << 60) // n + 1)))
    common = common_keys(keyed, key, bucket, n)
    # before, at and between common keys; equal rows are dealt into COMMON slots
    known = F.array(*map(F.lit, common)).cast("array<bigint>")
    below, at = F.size(F.filter(known, lambda x: x < F.col(key))), F.array_contains(known, F.col(key))
    dealt = F.when(at, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(COMMON))).otherwise(F.lit(0))
    keyed = keyed.withColumn(slot, F.struct(F.col(bucket).alias("range"), (2 * below + at.cast("int")).alias("part"), dealt.alias("nth")) if common else F.struct(F.col(bucket).alias("range")))
    if common:
        keyed = Scratch(spark, "mixing").keep(keyed, "dealt")  # a row must have one slot wherever it is read
    size = fresh(keyed.columns, "_size")[0]
    totals = keyed.groupBy("source", slot).agg(F.sum("size").alias(size))
    # one row for each source and slot
    earlier = Window.partitionBy("source").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias(s_), F.col(slot).alias(place_of), F.coalesce(F.sum(size).over(earlier), F.lit(0)).alias(start))
    targets = source_targets(totals.select("source", F.col(size).alias("size")), weights, share, most).withColumnRenamed("source", t_)
    starts = starts.join(targets, F.col(s_).eqNullSafe(F.col(t_))).drop(t_)
    inside = Window.partitionBy("source", slot).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn(inside_, F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col(s_)) & (F.col(slot) == F.col(place_of)), "left")
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - whole * F.col("source_size") - F.col(start) - F.col(inside_)
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.withColumn("taken", taken.cast("long")).drop(key, bucket, slot, inside_, s_, place_of, start)


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source and size (words) of documents."""
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def op7(spark, sf_dir: str) -> DataFrame:
    sizes = Scratch(spark, "mixing").keep(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    return mix_sources(sizes).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(source, 'null') || '/' || size || '/mix'), 1, 15) AS BIGINT) AS key
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sizes GROUP BY source
), bounded AS (
  SELECT *, CAST(2 * source_size AS DOUBLE) AS bound, CAST(2 * source_size AS DOUBLE) / weight AS bound_level FROM per_source
), levels AS (
  SELECT *, row_number() OVER (ORDER BY bound_level, source NULLS LAST) AS place, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 - coalesce(sum(bound) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM bounded
  WINDOW before AS (ORDER BY bound_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), found AS (
  SELECT min(place) AS first, arg_min(level, place) AS open_level FROM levels WHERE level < bound_level
), targets AS (
  SELECT source, source_size, CASE WHEN place >= first THEN weight * open_level ELSE bound END AS target FROM levels, found
), placed AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN (budget // source_size) * size ELSE 0 END
            + greatest(0, least(size, budget - (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END) * source_size - start)) AS BIGINT) AS taken
FROM placed
"""
