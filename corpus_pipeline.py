"""A corpus pipeline of five stages over ``documents``.

Each stage works on all rows that the one before kept; each but the last returns the columns of
documents. Every stage's rows are written as Parquet and read again as the next one's input; a stage's
table is deleted when the next one's has been written.

Defined results: null and empty texts pass the first stage, are one text in the second, and stay empty; of
rows that repeat id and text one stays. Rows without id are kept but for exact copies. Texts may be of any
length. An empty table gives an empty result. Columns besides those of documents are carried to the last
stage, whatever their names and types.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marksmith.llm import exact_dedup, packing, pii, simhash_dedup, toxicity
from marksmith.llm.common import delete_scratch, scratch_path, table
from marksmith.llm.queries import BYTE_BPE


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels table, doesn't call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text, that with the largest id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group tied by five-word similarity of 0.8 or more."""
    return simhash_dedup.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind, and n_chars of the new text."""
    from pyspark.sql import functions as F

    covered = pii.redacted(docs)
    return covered.withColumn("n_chars", F.when(covered["n_chars"].isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else covered


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents, with their ids, and their places in windows of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

#: Classifier, fingerprints and tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path, made = scratch_path(spark, name), stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete_scratch(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
