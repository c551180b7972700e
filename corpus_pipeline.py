"""The corpus pipeline: toxic documents go, one document of each near-duplicate class stays, personal data is replaced, sources are
mixed to target weights, and what is left is encoded. Each stage's result is written as Parquet and read again for the next.

Null texts count as empty and stay null; null ids are rows like others. Of rows with equal text, or near copies, one stays: that of
the smallest id, of rows with that id one. A document that the mixture takes twice comes out twice. Empty tables give no rows. All
columns of documents pass every stage but the last untouched, whatever their names; of them only doc_id, text, lang, source and
n_chars are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ablatrix.llm import bpe, mixing, near_dup, pii, toxicity
from ablatrix.llm.common import importable, scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of op6."""
    importable(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of op2, the document of the smallest id."""
    importable(spark)
    return near_dup.drop_near_duplicates(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of op3 replaced by its kind; n_chars, if there, follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of op10 takes it."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids of op7's encoding, and decoded_sha256, the digest of what the ids decode to."""
    importable(spark)
    return bpe.encode(docs, decoded=True)


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("pii", replace_personal_data), ("mixing", mix_sources), ("bpe", encode)]
#: Trained scores, sampled signatures and BPE have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
