"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import exact_dedup, html_blocks, jaccard_join, line_dedup, lm_scoring, mixing, motion_jpeg, piece_encoding, quality, secret_scan, source_audit, token_alignment, token_counts
from lorekeep.llm.common import table


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_pieces(path: str) -> list[str]:
    """The pieces of a SentencePiece model that can be part of a word: no controls, bytes or bare runs of marks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [p for p in pieces if token_counts.MARK not in p[1:]]


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return exact_dedup.dedupe_once(table(spark, sf_dir, "documents"), f"digest_index_{uuid.uuid4().hex}", buckets)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.piece_counts(table(spark, sf_dir, "documents"), word_pieces(vocabulary_path("piece_bpe_32k.model")))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_encoding.encode(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"), digests=True)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.mark(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = line_dedup.kept_text(F.col("text"), F.col("lines_keep_runs"))
    return marked.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_dropped").alias("n_dropped"), F.sha2(kept, 256).alias("kept_sha256"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken")
    )


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion_jpeg.media_features(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"), digests=True)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda *kinds: F.filter("secrets", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(of(*secret_scan.BASE_KINDS)), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_lm_scoring": op1_lm_scoring,
        "op2_html_extraction": op2_html_extraction,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_token_counts": op4_token_counts,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_line_dedup": op6_line_dedup,
        "op7_mixing": op7_mixing,
        "op8_media": op8_media,
        "op9_quality": op9_quality,
        "op10_jaccard_join": op10_jaccard_join,
        "op11_token_alignment": op11_token_alignment,
        "op12_secret_scan": op12_secret_scan,
        "op13_source_audit": op13_source_audit,
    }
