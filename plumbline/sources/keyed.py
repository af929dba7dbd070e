"""Keyed tables kept in hash buckets, changed by copy-on-write and a commit manifest.

A change rewrites only the buckets that hold one of its keys, into a new version folder, and then
commits by creating the next manifest, which names the version of every bucket. Readers
follow the last manifest, so they never see half a change; of two writers that
started from the same manifest the second one fails. A lost executor costs Spark a task, a
lost driver leaves files that no manifest names (`vacuum` removes them).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.sources.stored import _resolved, listing, release, settle

BUCKETS = 64


class KeyedTable:
    """Rows of `path` by key; at most one row a key."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def manifest(self) -> dict:
        """Of the last commit; version 0 and no buckets before the first one."""
        names = [name for name, _, _ in listing(self.spark, f"{self.path}/manifest") if name.endswith(".json")]
        if not names:
            return {"version": 0, "buckets": self.buckets, "files": {}, "schema": None}
        return json.loads(self.spark.read.text(max(names), wholetext=True).first()[0])

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; None where nothing is stored."""
        return self._read(self.manifest(), only)

    def _read(self, now: dict, only=None) -> DataFrame | None:
        if now["schema"] is None:
            return None
        schema = StructType.fromJson(now["schema"])
        chosen = [b for b in now["files"] if only is None or int(b) in set(only)]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/v{now['files'][b]}/bucket={b}" for b in chosen])

    def upsert(self, rows: DataFrame, order: Sequence[str], present: str | None = None) -> dict:
        """Later rows overwrite by key. `present` names a column with the array of fields a row sets.

        A field that is set is taken as it is, also when null; one that is not set keeps its stored
        value. Without `present` all fields count as set. Returns the new manifest with the buckets touched.
        """
        now = self.manifest()
        if now["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {now['buckets']} buckets")
        body = [c for c in rows.columns if c not in self.keys and c != present]
        fields = F.col(present) if present else F.array(*[F.lit(c) for c in body])
        marked = rows.withColumn("_set", fields)
        newest = marked.groupBy(*self.keys).agg(F.max_by(F.struct(*body, "_set"), F.struct(*order)).alias("new"))
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        newest = settle(newest.withColumn("bucket", bucket), "upsert")
        touched = sorted(r.bucket for r in newest.select("bucket").distinct().collect())
        kept = self._read(now, touched)
        if kept is None:
            kept = self.spark.createDataFrame([], rows.select(*self.keys, *body).schema)
        old = kept.select(*self.keys, F.struct(*body).alias("old"))
        joined = old.join(newest.drop("bucket"), self.keys, "full_outer")
        columns = [F.when(F.array_contains("new._set", c), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in body]
        merged = joined.select(*self.keys, *columns)
        version = now["version"] + 1
        out = merged.withColumn("bucket", bucket).repartition(min(len(touched), self.buckets) or 1, "bucket")
        if touched:
            out.write.partitionBy("bucket").parquet(f"{self.path}/data/v{version}")
        release(newest)
        files = now["files"] | {str(b): version for b in touched}
        made = {"version": version, "buckets": self.buckets, "files": files, "schema": merged.schema.jsonValue()}
        self._commit(made)
        return made | {"touched": touched}

    def _commit(self, manifest: dict) -> None:
        file_system, path = _resolved(self.spark, f"{self.path}/manifest/{manifest['version']:08d}.json")
        # fails where another writer has committed this version
        out = file_system.create(path, False)
        try:
            out.write(bytearray(json.dumps(manifest), "utf-8"))
        finally:
            out.close()

    def vacuum(self) -> None:
        """Delete bucket folders that the last manifest does not name."""
        now = self.manifest()
        named = {f"/data/v{v}/bucket={b}/" for b, v in now["files"].items()}
        for name, _, _ in listing(self.spark, f"{self.path}/data"):
            if "/bucket=" in name and not any(part in name for part in named):
                file_system, path = _resolved(self.spark, name)
                file_system.delete(path, False)
