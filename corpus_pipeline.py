"""The corpus pipeline: documents through five stages, each written as Parquet and read again.

1. quality: documents that the co-trained classifier rejects go.
2. lines: lines that three documents or more share stay in the one with the largest id alone.
3. near_duplicates: of each group of similar texts the document with the smallest id stays.
4. mixing: sources are brought to their target weights; documents repeat or go by lot.
5. sentencepiece: what is left is encoded, and decoded as a check.

Every stage accepts what the one before it kept: nulls in any column, empty texts, repeated rows and
empty tables pass through as each operator's docstring says.  All but the last return the columns of
their input, in its order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import jaccard_join, line_dedup, mixing, piece_encoding, quality
from lorekeep.llm.common import release, staged, table
from lorekeep.llm.queries import vocabulary_path


#: Bytes of rejected rows (id and hash) sent to every task, instead of shuffling the texts to join with them.
MOST_BROADCAST = 32 << 20


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, unchanged."""
    scored = quality.fit_and_score(docs, table(spark, sf_dir, "labels"), keys=True)
    rejected = scored.where("not quality_keep").select(F.col("doc_id").alias("__id"), F.col("quality_key").alias("__rejected")).distinct()
    if rejected.count() * 48 <= MOST_BROADCAST:
        rejected = F.broadcast(rejected)
    keyed = docs.withColumn("__key", quality.row_key())
    return keyed.join(rejected, keyed["doc_id"].eqNullSafe(rejected["__id"]) & (keyed["__key"] == rejected["__rejected"]), "left_anti").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; a text that loses lines is its other lines, and ``n_chars`` follows it."""
    marked = line_dedup.mark(docs, prefix="__lines_")
    lost = F.col("__lines_keep_runs").isNotNull()
    kept = line_dedup.kept_text(F.col("text"), F.col("__lines_keep_runs"))
    changed = marked.withColumn("text", F.when(lost, kept).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(lost, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts: that of the smallest id (rows without id last, of equal ids
    the one with the smallest hash of its text).  Texts without words are in no group; of rows that
    repeat id and text one stays."""
    groups = jaccard_join.similar_groups(docs, keys=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("first")
    chosen = groups.where("group is not null").groupBy("group").agg(first).select("first.doc_id", "first.text_key")
    keep = chosen.unionByName(groups.where("group is null").select("doc_id", "text_key")).distinct().withColumnsRenamed({"doc_id": "__id", "text_key": "__key"})
    keyed = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = keyed.join(keep, keyed["doc_id"].eqNullSafe(keep["__id"]) & (keyed["__text"] == keep["__key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.emit(mixing.mix(docs, prefix="__mix_"), docs.columns, prefix="__mix_")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row for each copy in the mix."""
    return piece_encoding.encode(docs, vocabulary_path("piece_bpe_32k.model"), digests=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_similar),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]
#: Neither the trained classifier nor the tokenizer can be expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, delete = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        try:
            docs, delete_next = staged(stage(spark, docs, sf_dir))
        finally:  # what a stage read is done with, whether it succeeded or not
            if delete:
                delete()
        delete = delete_next
        release(spark)
    return docs
