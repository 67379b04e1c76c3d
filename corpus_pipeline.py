"""The corpus pipeline: quality rules, exact and near deduplication, source mixing, tokenization.

Every stage works on all documents that the stage before it kept. ``run`` writes each stage's result as Parquet in the
folder that ``spark.checkpoint.dir`` names and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from catalog_audit.llm import exact_dedup, mixing, near_dedup, quality_rules
from catalog_audit.llm.queries import token_digests
from catalog_audit.llm.text import ship, table
from catalog_audit.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs, k=5, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_digests(docs, share=6)  # the workers are those of four stages before


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("source mixing", mix), ("byte bpe", tokenize)]

#: Quantile sketches, hashed draws and merges are not SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
