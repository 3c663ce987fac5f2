"""One query for each operator, over its whole table, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table
from .decontaminate import leaks
from .embedding_dedup import near_vectors
from .licenses import find_licenses
from .line_dedup import removed_lines
from .minhash_dedup import near_duplicates
from .oracle import ORACLE_SQL
from .packing import pack
from .secrets import find_secrets, joined
from .substring_dedup import remove_repeated_passages
from .toxicity import score, train
from .warc import read_archives, write_archives


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that 13-word passages of earlier documents cover, removed from every document."""
    out = remove_repeated_passages(table(spark, sf_dir, "documents"), n_words=13, texts_out=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return pack(table(spark, sf_dir, "documents"), spec, capacity=2048, end_id=0).drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document that repeat an earlier line, with a similarity of word sets of 0.8 or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines"))
    gone = removed_lines(docs, threshold=0.8)
    out = lines.join(gone, "doc_id", "left")
    n_removed = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), n_removed.alias("n_removed"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed_lines"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of vectors of one label whose cosine is 0.93 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"), similarity=0.93)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notices of every document."""
    return find_licenses(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to WARC archives with revisit records, and read back."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, min_bytes=100)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a document holds a benchmark item."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edit_share=0.1, q=8)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
