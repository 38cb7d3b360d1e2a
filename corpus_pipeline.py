"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, and others that the table has, whatever their names.

Null texts count as empty: not toxic, of low quality. Rows without a doc_id are judged by their texts alone and never
count as near-duplicates. Of equal or nearly equal documents one stays (that of least id); different texts with one doc_id are
documents of their own.
Texts of any length are worked on whole. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heartwood.llm import neardup, quality, secrets, tokens, toxicity
from heartwood.llm.common import documents, stored, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic."""
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    into = unused("_toxic", docs.columns)
    return toxicity.score(docs, machine, into=into).where(F.col(into) < 0.5).select(*docs.columns)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one of least id (of nearly equal rows with one id that of least text)."""
    return neardup.representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret replaced by a mask."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return tokens.packed_pieces(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("minhash_neardup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, estimation and packing can't be put in SQL; the pipeline is tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
