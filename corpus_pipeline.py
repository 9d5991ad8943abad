"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last return the
columns of ``documents``.

Defined cases: documents with a null or empty text, or without a letter, go in the first stage; a document whose whole
text repeats stays with an empty text; repeated rows are near duplicates of each other; columns beyond those of
``documents`` are carried along under any name; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from msgloom.llm import decontaminate, hilbert_pack, langid_ppm, probminhash, suffix_dedup
from msgloom.llm._io import materialize, passing
from msgloom.llm.queries import tokenizer_path

#: Words of a passage that repeats: more than 50, however long they are.
REPEAT_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or that no language learned from the others' labels fits (junk, codes), go."""
    return langid_ppm.recognised(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one with the smallest doc_id."""
    return probminhash.one_of_each(docs)


def repeat_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that occur more than once are cut from all documents; ``n_chars`` follows the text."""
    cut = suffix_dedup.without_repeats(docs, min_words=REPEAT_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of 1024 along the Hilbert curve: one row per piece."""
    return hilbert_pack.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("repeat_removal", repeat_removal),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Not expressible in SQL (learned statistics, suffix arrays, a space-filling curve); tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next; only the last two stages' tables stay."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with passing() as keep:
        for name, stage in STAGES[:-1]:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
