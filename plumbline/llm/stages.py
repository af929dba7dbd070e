"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import decontam, jaccard, packing, quality, secrets

# near duplicates of the pipeline: five words a shingle, at least four fifths in common
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at the threshold or above."""
    forest = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality.scored(docs, forest).where(F.col("score") >= quality.THRESHOLD)
    return good.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group; documents without words all stay.

    Rows that share id and text count as one; rows without an id stay where no row of the group has one.
    """
    groups = jaccard.similar_groups(docs, percent=SIMILAR_PERCENT, width=SHINGLE_WORDS)
    kept = (
        groups.where(F.col("component_id").isNull() | (F.col("id") == F.col("component_id")))
        .select("id", "print")
        .distinct()
    )
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("bigint").alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("print"),
    )
    same = marked["id"].eqNullSafe(kept["id"]) & (marked["print"] == kept["print"])
    found = marked.join(kept, same, "left_semi")
    copies = Window.partitionBy("id", "print").orderBy("id", "print")
    once = found.withColumn("copy", F.row_number().over(copies)).where("copy = 1")
    return once.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans of benchmark items; mostly copied documents go."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token stream."""
    return packing.digest(packing.pack(docs))
