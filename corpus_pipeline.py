"""From raw documents to packed training sequences, one operator per stage.

Each stage takes (spark, docs, sf_dir) and returns a frame; `run` writes it as Parquet to
the shared folder and reads it again as the next stage's documents. All but the last stage
return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import mixing, near_copies, packing, quality, secret_scan
from wardlake.llm.common import shared_folder, table, word_count


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return quality.keep_sound(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with five-word similarity 0.8: the one with the smallest id."""
    return near_copies.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every secret replaced by a mark."""
    masked = docs.withColumn("text", secret_scan.mask_secrets(F.col("text")))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in a training sequence."""
    return packing.pack(docs.select("doc_id", word_count(F.col("text")).alias("length")))


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

# Robust estimates, fingerprints and random rounding have no SQL form; tests use brute force.
ORACLE_SQL = None


def _storable(df: DataFrame) -> DataFrame:
    """Give columns that hold nothing but nulls a type that Parquet has."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "void"})


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        _storable(stage(spark, docs, sf_dir)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
