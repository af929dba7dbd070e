"""Ranking of large groups and top-k.

A plain `row_number` over one research date would sort the whole universe in one
task. `ranked` sorts all groups together by range over all tasks and writes that order
once; the rows of a group in a task then need only the number of rows of that group in
the tasks before, from counts of a few rows per task. Equal scores, even on a
third of all rows, are spread by md5(key).

`top_k` is the plain `row_number <= k`: Spark pushes a per-task group limit below
the shuffle (WindowGroupLimit), so only k rows per task and group move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.stored import release, settle

def ranked(
    frame: DataFrame,
    by: Sequence[str],
    score: str,
    key: str,
    name: str,
) -> DataFrame:
    """Adds `name` = 1..n by score descending (NULL last), md5(key), key. Runs the jobs that write and sort the rows."""
    by = list(by)
    # the bounds of the ranges are sampled: without this the rows would be computed twice
    frame = settle(frame, "unranked")
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(c) for c in by], F.col(score).desc_nulls_last(), F.col("_md5"), F.col(key)]
    ranged = frame.withColumn("_md5", F.md5(F.col(key))).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # partition number in the upper bits, row number within it in the lower 33
    placed = settle(ranged.withColumn("_place", F.monotonically_increasing_id()).drop("_md5"), "ranked")
    release(frame)
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    # one row per group and task that holds rows of it
    runs = placed.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first") + 1
    starts = runs.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), shift.alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return (
        placed.join(F.broadcast(starts), same)
        .withColumn(name, (F.col("_place") + F.col("_shift")).cast("long"))
        .drop("_place", "_part", "_of", "_shift", *[f"_{c}" for c in by])
    )


def keep_last(frame: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in a stated order, combined map-side."""
    body = [c for c in frame.columns if c not in keys]
    last = frame.groupBy(*keys).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("_last"))
    return last.select(*keys, *[F.col("_last")[c].alias(c) for c in body]).select(*frame.columns)


def top_k(
    frame: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "position"
) -> DataFrame:
    """First k rows of each group in the given order, with their position."""
    window = Window.partitionBy(*by).orderBy(*order)
    return (
        frame.withColumn(name, F.row_number().over(window))
        .filter(F.col(name) <= k)
        .withColumn(name, F.col(name).cast("long"))
    )
