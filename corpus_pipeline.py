"""Corpus pipeline: five stages over documents, each written as Parquet and read by the next.

Rows that a stage empties are dropped with it; n_chars follows the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm import langid, lines, packing, shingles, suffixes
from stratum.llm.common import materialize
from stratum.llm.queries import vocabulary

CARRIED = ("lang", "source")
#: Most passages of over 50 words have this many bytes; the shorter ones go before packing.
PASSAGE = suffixes.SuffixConfig(length=256, window=120, keep_one=True)
SHORT_WORDS = suffixes.SuffixConfig(length=256, words=51, keep_one=True)


def documents_of(rows: DataFrame) -> DataFrame:
    """The columns of documents, without rows that have no text left."""
    rows = rows.where(F.length(F.trim("text")) > 0)
    return rows.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told by the n-gram filters."""
    return langid.keep_identified(docs.select("doc_id", "text", "lang", "source", "n_chars"), langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks of lines that an earlier document holds."""
    return documents_of(lines.dedup_lines(docs, carry=CARRIED))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return shingles.one_of_each(docs.select("doc_id", "text", "lang", "source", "n_chars"))


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that another text, or place, holds already; one copy stays."""
    return without_repeats(docs, PASSAGE)


def without_repeats(docs: DataFrame, config: suffixes.SuffixConfig) -> DataFrame:
    """Texts without the strings that occur more than once, but for one copy of each."""
    left = suffixes.remove_repeats(docs, config, carry=CARRIED)
    # a byte range may begin or end inside a letter; the broken bytes go with it
    return documents_of(left.select("doc_id", F.try_validate_utf8(F.col("kept").cast("string")).alias("whole"), F.col("kept"), *CARRIED)
                        .select("doc_id", F.coalesce("whole", F.regexp_replace(F.make_valid_utf8(F.col("kept").cast("string")), "�", "")).alias("text"), *CARRIED))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 ids, of texts without the repeated passages of over 50 short words
    that are too short for the suffix stage."""
    # written first, so that no task runs two Python workers
    return packing.pack_documents(materialize(spark, without_repeats(docs, SHORT_WORDS)), vocabulary(), packing.PackingConfig(memory=250_000))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", dedup_passages),
    ("packing", pack),
]

#: Trained filters and content-defined chunks have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        rows = materialize(spark, stage(spark, rows, sf_dir))
    return STAGES[-1][1](spark, rows, sf_dir)
