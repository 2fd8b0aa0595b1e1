"""The registered queries of the text operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, kdshards, langid, lines, matroska, packing, sampling, shingles, suffixes, windows
from .common import documents


def vocabulary() -> str:
    """Path of the default public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the labelled rows that are not held out."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that no 400-byte repeat covers, as digests."""
    kept = suffixes.remove_repeats(documents(spark, sf_dir, "doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as a Matroska track and read back through its packet table."""
    return matroska.media_digests(documents(spark, sf_dir, "doc_id", "text"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that nearly repeat across documents, and documents that are copies."""
    return windows.near_passages(documents(spark, sf_dir, "doc_id", "text"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document under the public word vocabulary, as digests."""
    return bpe.encode_documents(documents(spark, sf_dir, "doc_id", "text"), vocabulary(), with_ids=False)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of near equal bytes."""
    shards = kdshards.kd_shards(documents(spark, sf_dir, "doc_id", "text"), leaves=16)
    return shards.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose five-word shingle sets reach a Jaccard similarity of 0.75."""
    return shingles.similarity_components(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit, with their likeness and the next document's."""
    return sampling.neighbour_fingerprints(documents(spark, sf_dir, "doc_id", "text"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that an earlier one holds too, as digests."""
    left = lines.dedup_lines(documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", "n_chunks", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2("text", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 4096 ids."""
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), vocabulary())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_suffix_dedup, op3_media_columns, op4_compact_windows, op5_bpe, op6_kd_sharding, op7_ngram_jaccard, op8_weighted_sampling, op9_line_dedup, op10_packing)
}

#: Queries that DuckDB can express.
ORACLES: dict[str, str] = {}
