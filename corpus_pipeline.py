"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, decontamination, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of ``documents``; the last adds the ids of the kept texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, lines, ngram_join, pieces
from tidemark.llm.shared import broadcast_if_small, columns_like, cut, release


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language the model, learned from ``docs``, rejects (with no letter, or below its calibrated threshold)."""
    return language.keep_identified(docs, language.train(docs, F.col("lang").isNotNull()))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; a document that loses all its words to that goes."""
    out = lines.dedup_lines(docs, radius=None, removed_col="__removed")
    bare = (F.size("__removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    changed = F.size("__removed") > 0
    out = out.where(~F.coalesce(bare, F.lit(False))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return columns_like(out, docs)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies (five words, similarity 0.8)."""
    groups = ngram_join.jaccard_join(docs, k=5, percent=80)["groups"]
    gone = cut(groups.where("id <> component_id").select(F.col("id").alias("__gone")).distinct(), "gone")
    return docs.join(broadcast_if_small(gone), docs["doc_id"] == F.col("__gone"), "left_anti")


def decontaminate_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every kept text, checked by decoding them."""
    out = pieces.encode(docs, decoded_col="decoded")
    return out.select("doc_id", "lang", "source", "n_chars", F.size("tokens").cast("long").alias("n_tokens"), "tokens", (F.col("decoded") == F.col("text")).alias("round_trip"))


STAGES = [
    ("language_id", identify_languages),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_copies),
    ("decontamination", decontaminate_documents),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written to the shared folder and read again, and deleted when the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, cut(stage(spark, docs, sf_dir), name)
        release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
