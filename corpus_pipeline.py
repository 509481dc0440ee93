"""The corpus pipeline: documents in, token digests out.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; every result is written as Parquet and read again.

Defined cases: documents with a null or empty text, or with under ten words, go in
the first stage; of repeated rows and of rows that share a null doc_id one of each
text stays, as of near copies; an empty table gives an empty result, an empty
benchmark removes nothing; very long texts pass whole; further columns of documents,
whatever their names, reach the last stage unchanged, but for ``n_chars``, which
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm._common import Scratch, cleared
from maskwright.llm.op3_bagminhash import keep_one
from maskwright.llm.op5_bpe import encode_documents, vocabulary_path
from maskwright.llm.op6_secrets import redact
from maskwright.llm.op8_decontaminate import remove_contaminated
from maskwright.llm.op9_quality import clean


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject."""
    return clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts give way to a mark."""
    return redact(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded and decoded; the result has a row of digests per document."""
    return encode_documents(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", bpe)]
#: Similarity classes and BPE can't be put in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        with cleared(spark):  # what a stage wrote on its way goes
            docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
