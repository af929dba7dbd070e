"""Corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import stages
from plumbline.sources.stored import settle

STAGES = [
    ("quality classifier", stages.keep_good),
    ("n-gram Jaccard join", stages.one_of_each_group),
    ("benchmark decontamination", stages.without_benchmark),
    ("secret scans", stages.without_secrets),
    ("packing", stages.packed),
]

# tokens, trained trees and word shingles have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
