"""Documents to token ids: quality, near-duplicates, repeated passages, a mix of sources, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Stages may be run one by one, with what each returns written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm import bpe, minhash, mixing, quality, substrings
from cairn.llm.shared import Scratch, fresh, shipped

#: Passages of this many words that appear earlier go.
PASSAGE = 50


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose score is below quality.KEEP. The classifier learns from labelled documents of docs."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh(docs.columns, "_quality")[0]
    return quality.score(docs, model, score).where(F.col(score) >= quality.KEEP).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates, once; null ids stay.

    Rows that repeat an id are one document. If their texts differ, the row whose text has the smallest
    hash stays and the others go, even one that is like no other document."""
    key, text_hash, row_hash = fresh(docs.columns, "_id", "_text", "_row")
    kept = minhash.near_duplicates(docs, 5, "0.8").where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    text, row, id_ = F.xxhash64("text"), F.xxhash64(*docs.columns), F.col("doc_id").cast("long")
    # which row of a repeated id stays, from hashes by partial aggregation: no task holds all rows of one id
    hashes = docs.where("doc_id is not null").select(id_.alias("i"), F.struct(text.alias("h"), row.alias("g")).alias("s"))
    repeated = hashes.groupBy("i").agg(F.count("*").alias("many"), F.min("s").alias("s")).where("many > 1")
    wanted = kept.join(repeated, F.col(key) == F.col("i"), "left").select(key, F.col("s.h").alias(text_hash), F.col("s.g").alias(row_hash))
    wanted = Scratch(spark, "kept").keep(wanted, "ids")
    rows = docs.join(wanted, id_ == F.col(key))
    single = rows.where(F.col(text_hash).isNull()).select(*docs.columns)
    # equal rows of one id come down to one
    one = rows.where((F.col(text_hash) == text) & (F.col(row_hash) == row)).select(*docs.columns).dropDuplicates(["doc_id"])
    return single.union(one).union(docs.where("doc_id is null"))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of PASSAGE words or more that appear earlier; n_chars follows the text."""
    cut = substrings.remove_repeats(docs, PASSAGE)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: one row for each whole repeat, and one of the first
    words of a document that its source's budget cuts. Documents without words go."""
    row = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("row"))
    row = mixing.mix_sources(row).where("taken > 0").withColumn("nth", F.explode(F.expr("sequence(1L, (taken + size - 1) div size)")))
    left = F.least(F.col("size"), F.col("taken") - (F.col("nth") - 1) * F.col("size"))
    text = F.col("row.text")
    first_words = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, left.cast("int")), "")
    new = F.when(left < F.col("size"), first_words).otherwise(text)
    changed = {"text": new, "n_chars": F.char_length(new).cast(docs.schema["n_chars"].dataType)}
    return row.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the hashes of the token ids and of the bytes decoded from them."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", shipped(keep_good)),
    ("MinHash near-dedup", shipped(keep_one_of_each)),
    ("substring dedup", shipped(cut_passages)),
    ("mixing sources", shipped(mix)),
    ("byte-level BPE", shipped(encode)),
]

#: SQL can express neither the classifier nor the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(k))
        if k:
            scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
