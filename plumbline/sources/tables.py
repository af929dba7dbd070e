"""Table maintenance: insert-if-absent, parent checks, counts, writes (upserts: `keyed`).

All rules are set operations on keys. In-batch duplicates are settled by
`min_by`/`max_by` (combined map-side), so a key repeated on a third of all rows
costs nothing extra after the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order."""
    body = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct(*body), F.struct(*order)).alias("r"))
        .select(*keys, "r.*")
        .select(*rows.columns)
    )


def insert_if_absent(
    existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], within: str | None = None
) -> DataFrame:
    """Rows to append: deduplicated incoming rows whose key is not stored.

    With `within`, a key column (a date), only stored rows in the batch's range are
    read: the bounds reach the scan as pushed filters. Stored rows outside it cannot match.
    """
    fresh = first_per_key(incoming, keys, order)
    if within:
        low, high = incoming.agg(F.min(within), F.max(within)).first()
        existing = existing.filter(F.col(within).between(F.lit(low), F.lit(high)))
    return fresh.join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def with_parent(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return rows.join(parents.select(key), key, "left_semi")


def orphans(rows: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows without a parent, for quarantine."""
    return rows.join(parents.select(key), key, "left_anti")


def refresh_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Rows fetched, stored before, and new keys, per group; each side is read once.

    Both sides are reduced to one row per key and group map-side, then a key's rows meet: a key that is not stored
    counts as new in the group of its first incoming row (smallest by `keys`, then `by`).
    """
    keys, by = list(keys), list(by)
    columns = [*keys, *by]
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = incoming.select(*columns, one.alias("f"), none.alias("s")).unionByName(
        existing.select(*columns, none.alias("f"), one.alias("s"))
    )
    per_group = both.groupBy(*columns).agg(F.sum("f").alias("f"), F.sum("s").alias("s"))
    part = F.struct(F.struct(*by).alias("g"), "f", "s")
    # a key has as many parts as it has groups
    per_key = per_group.groupBy(*keys).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    known = F.exists("parts", lambda p: p["s"] > 0)
    first = F.get(F.filter("parts", lambda p: p["f"] > 0), 0)["g"]
    rows = per_key.select(known.alias("known"), first.alias("first"), F.explode("parts").alias("p"))
    new = (~F.col("known") & (F.col("p.g") == F.col("first"))).cast("long")
    return (
        rows.groupBy(*[F.col("p.g")[c].alias(c) for c in by])
        .agg(F.sum("p.f").alias("fetched"), F.sum("p.s").alias("stored_before"), F.sum(F.coalesce(new, none)).alias("new_rows"))
        .withColumn("stored_after", F.col("stored_before") + F.col("new_rows"))
    )


def append_rows(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """One partition per research date; only the dates at hand are replaced."""
    (
        snapshot.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("as_of_date")
        .parquet(path)
    )


def write_run(tables: dict[str, DataFrame], path: str) -> None:
    """Summary, history and weight tables of a run, one folder each."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}")
