"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir).  Its result is written as Parquet and read again as the next one's
``docs``.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from focalgrid.llm.common import materialize, table
from focalgrid.llm.decontaminate import drop_leaks
from focalgrid.llm.line_dedup import dedup_lines
from focalgrid.llm.minhash_dedup import near_duplicates
from focalgrid.llm.packing import pack
from focalgrid.llm.registry import held_out
from focalgrid.llm.toxicity import score, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is under 0.5; the model learns from the labels that op10 learns from."""
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, model, out_col="_score").where("_score < 0.5").drop("_score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier line; one that loses all its lines goes, and n_chars follows the text."""
    out = dedup_lines(docs.withColumn("_before", F.col("text")))
    emptied = (F.char_length("_before") > 0) & (F.char_length("text") == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False))).drop("_before")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of 5-word shingles have a similarity of 0.8 or more: that with the smallest id."""
    gone = near_duplicates(docs.select("doc_id", "text"), k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with a tenth of its bytes edited."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), edit_share=0.1, q=8)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences of at most 2048 tokens and their places in them."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    return pack(docs, spec, capacity=2048, end_id=0).drop("ids")


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
