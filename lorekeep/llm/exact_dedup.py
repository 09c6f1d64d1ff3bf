"""Exact dedup against a persistent digest index.

The index is a table of one row per distinct normalised text, bucketed and sorted by digest.  New
rows are first reduced to one row per digest, then anti-joined with the index by sort-merge, and
what is left is appended.  A text that a third of all rows share is one row by the time it reaches
the index; only the final lookup sees every copy, and that is a join whose hot key adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm.common import SPACE_CLASS, answered_id, cut, release, type_of


def normalised(text: Column) -> Column:
    """The text without any white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", "")


class DigestIndex:
    """Digests of everything ingested so far, in the catalog table ``name``.

    The table's folder outlives the session; ``attach`` registers it again with the same buckets.
    """

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, id_type: str = "bigint") -> None:
        self.spark, self.name, self.buckets, self.id_type = spark, name, buckets, id_type

    @property
    def columns(self) -> str:
        return f"digest BINARY, keep_id {self.id_type}, group_size BIGINT"

    def create(self) -> DigestIndex:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        return self

    def attach(self, path: str) -> DigestIndex:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({self.columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds ``docs`` and says for each row which row of its text stays.

        Returns ``id_col, keep_id, group_size, kept, text_sha256``, one row per input row.  Ids may be of
        any type that has an order.  Within
        a batch the row with the most code points of original text stays, then the smallest id
        (nulls last), then one of the identical rows.  A text that the index already holds keeps
        its earlier row and size: all new copies are dropped.  Null text is the empty text; other
        columns of ``docs`` are not read; an empty table gives an empty result.
        """
        text = F.col(text_col)
        digests = cut(
            docs.select(
                F.col(id_col).alias("id"),
                F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
                F.char_length(F.coalesce(text, F.lit(""))).alias("points"),
            ).withColumn("row", F.monotonically_increasing_id())
        )
        order = F.struct((-F.col("points")).alias("points"), F.col("id").isNull().alias("without"), "id", "row")
        batch = cut(digests.groupBy("digest").agg(F.min_by(F.struct("id", "row"), order).alias("best"), F.count("*").alias("n")))
        seen = self.rows().select("digest")
        fresh = batch.join(seen.hint("merge"), "digest", "left_anti").select("digest", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))
        fresh = cut(fresh)
        (
            fresh.repartition(self.buckets, "digest")
            .write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(self.name)
        )
        keepers = batch.select("digest", F.col("best.row").alias("best_row")).join(fresh.select("digest", F.lit(True).alias("is_fresh")), "digest", "left")
        known = cut(keepers.join(self.rows(), "digest"))  # written, so that the last join can split a hot digest
        return digests.join(known, "digest").select(
            F.col("id").alias(answered_id(id_col, ["keep_id", "group_size", "kept", "text_sha256"])),
            "keep_id",
            "group_size",
            (F.coalesce("is_fresh", F.lit(False)) & (F.col("row") == F.col("best_row"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def dedupe_once(docs: DataFrame, name: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ingests ``docs`` into a fresh index called ``name``, which goes once the result is written."""
    index = DigestIndex(docs.sparkSession, name, buckets, type_of(docs, id_col)).create()
    try:
        return cut(index.ingest(docs, id_col, text_col))
    finally:
        index.drop()
        release(docs.sparkSession)
