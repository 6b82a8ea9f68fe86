"""Corpus pipeline: raw documents to packed training sequences.

Each stage is written as Parquet to the shared folder and read again as the next one's
documents, so a lost executor never costs more than the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspar.llm import stages
from larkspar.llm.common import Scratch

STAGES = [
    ("quality rules", stages.quality_rules),
    ("exact dedup", stages.exact_dedup),
    ("minhash near-dedup", stages.near_dedup),
    ("mixing to target weights", stages.mix_sources),
    ("packing", stages.pack),
]

#: Tokenisers cannot be expressed in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            scratch.drop(f"stage{number - 1}")
    return docs
