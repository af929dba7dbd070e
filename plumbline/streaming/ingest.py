"""Incremental ingest with Structured Streaming.

State is bounded by the watermark: keys older than the horizon leave it. A file that
lands twice or too late adds nothing; no micro-batch reads the table it adds to.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

NEWS_HORIZON, NEWS_DAYS = "120 days", 120
PRICE_HORIZON, PRICE_DAYS = "7 days", 7
# Keys of a stream are kept by hash bucket: a bucket holds its share of the keys within the horizon.
KEY_BUCKETS = 16_384


def file_stream(spark: SparkSession, folder: str, schema, glob: str | None = None, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(folder)


def day_bars(ticks: DataFrame, key: str, ts: str, price: str, lateness: str = "1 day") -> DataFrame:
    """Ticks -> daily open/high/low/close/volume per key; works batch or stream."""
    order = F.struct(ts, "event_id")
    return (
        ticks.withWatermark(ts, lateness)
        .groupBy(F.window(ts, "1 day").alias("w"), F.col(key).alias("ticker"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count("*").alias("volume"),
        )
        .select("ticker", F.col("w.start").cast("date").alias("date"), "open", "high", "low", "close", "volume")
    )


def first_seen(
    rows: DataFrame, keys: list[str], ts: str, order: list[str], horizon: str, days: int, buckets: int = KEY_BUCKETS
) -> DataFrame:
    """First row per key, by `order` inside a micro-batch and by arrival over batches; keyed state for `days`.

    A key leaves the state once the watermark has passed its time by `days`. Rows behind the
    watermark (`horizon` after the newest row) are dropped, so a replayed or late file adds nothing.
    A call of Python costs about a millisecond, so it takes all keys of one hash bucket; the state of a bucket is
    its keys, as texts, and the times at which they leave.
    """
    import pandas as pd

    keep_ms = days * 86_400_000
    # whole numbers beside a NULL would become floating point in pandas
    whole = [f.name for f in rows.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]
    sent = rows.withColumns({c: F.col(c).cast("string") for c in whole}) if whole else rows
    sent = sent.withColumns(
        {
            "_key": F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])),
            "_bucket": F.pmod(F.xxhash64(*keys), F.lit(buckets)),
        }
    )
    columns = rows.columns

    def number(values):
        return values.map(int, na_action="ignore").astype("Int64") if values.name in whole else values

    def pick(bucket, frames, state):
        now = state.getCurrentWatermarkMs()
        known = dict(zip(*state.get)) if state.exists else {}
        if not state.hasTimedOut:
            part = pd.concat(list(frames)).sort_values(order, kind="stable", key=number)
            first = part[~(part["_key"].duplicated() | part["_key"].isin(known.keys()))]
            for key, at in zip(first["_key"], first[ts]):
                known[key] = max(0 if pd.isna(at) else int(at.timestamp() * 1000), now) + keep_ms
            if len(first):
                yield first[columns]
        known = {key: until for key, until in known.items() if until >= now}
        if known:
            state.update((list(known.keys()), list(known.values())))
            state.setTimeoutTimestamp(min(known.values()))
        else:
            state.remove()

    picked = (
        sent.withWatermark(ts, horizon)
        .groupBy("_bucket")
        .applyInPandasWithState(
            pick, sent.select(*columns).schema, "seen array<string>, until array<long>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
    return picked.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in whole else F.col(f.name) for f in rows.schema])


def run_table(rows: DataFrame, path: str, checkpoint: str) -> list[dict]:
    """Append-mode file sink over everything that has landed; progress reports of the batches."""
    query = (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]


def run_with_quarantine(rows: DataFrame, path: str, quarantine: str, checkpoint: str, ts: str, lateness_days: int) -> None:
    """Rows on time go to `path`, rows more than `lateness_days` behind the newest row seen to `quarantine`.

    Each batch writes folders of its own number, so a batch that is run again replaces
    what it wrote; counts and the newest time are taken while writing (`Observation`) and kept
    beside the table, under `path`_counts.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = None
        if number:
            before = spark.read.parquet(f"{path}_counts").filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        newest = batch.agg(F.max(ts)).first()[0]
        newest = max(t for t in (before, newest) if t is not None) if before or newest else None
        limit = F.lit(newest).cast("timestamp") - F.make_dt_interval(F.lit(lateness_days))
        late = F.coalesce(F.col(ts) < limit, F.lit(False))
        seen = Observation(f"late-{number}")
        counted = batch.withColumn("late", late).observe(seen, F.count("*").alias("rows"), F.sum(F.col("late").cast("long")).alias("late"))
        # one pass: the flag is the folder
        counted.write.mode("overwrite").partitionBy("late").parquet(f"{path}_batches/batch={number}")
        counts = [(number, seen.get["rows"], seen.get["late"] or 0, newest)]
        spark.createDataFrame(counts, "batch long, rows long, late long, newest timestamp").coalesce(1).write.mode("overwrite").parquet(f"{path}_counts/number={number}")
        split = spark.read.schema(counted.schema).option("basePath", f"{path}_batches/batch={number}").parquet(f"{path}_batches/batch={number}")
        for flag, target in ((False, path), (True, quarantine)):
            split.filter(F.col("late") == flag).drop("late").write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
