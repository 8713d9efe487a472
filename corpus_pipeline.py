"""From raw documents to packed training sequences: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes what its predecessor kept and returns a table; all but the last return the
columns of documents. Documents whose text is cut or redacted have their n_chars counted anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldnotes.llm import minhash, packing, pii, quality, suffixes
from fieldnotes.llm._shared import drop, once, table
from fieldnotes.llm.queries import WORD_BPE, tokenizer_path

#: No SQL expresses the stages after the first; they are tested against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules of their text and whose host passes."""
    return quality.passing(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash.deduplicate(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has."""
    return _counted(suffixes.cut(docs))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and disclosing terms generalised to labels."""
    return _counted(pii.redact(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("quality_rules", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        kept = once(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        drop(docs)  # the input table itself is none of ours and stays
        docs = kept
    return docs
