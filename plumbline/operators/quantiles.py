"""Exact interpolated quantiles without collecting a group in one task.

`percentile` keeps every value of a group in one task. Here an approximate
sketch (bounded rank error, combined map-side) first gives a narrow bracket that
must hold the wanted order statistics; only rows inside the bracket are then
counted per distinct value, so ties collapse, and the exact values are read off
the running count. The bracket is checked: a miss raises instead of returning an
approximate value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 1000
# the sketch is asked for this many evenly spaced probes
GRID = 200


def melt(frame: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys + (metric, value): one row per column, metric is the position."""
    values = F.array(*[F.col(c).cast("double") for c in columns])
    return frame.select(*keys, F.posexplode(values).alias("metric", "value"))


def sketched(value: Column) -> list[Column]:
    """Count, extremes and evenly spaced probes of a column."""
    grid = F.expr(f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})")
    probes = F.percentile_approx(value, grid, ACCURACY)
    return [F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), probes.alias("probes")]


def column_quantiles(frame: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """`exact_quantiles` of every column per group of `keys`: keys, metric (the column's position), n, low, high, q0, ...

    All columns of a group are sketched side by side: one row per `keys` and task instead of one per column,
    for which Spark would sort the melted rows as soon as there are many of them.
    """
    keys = list(keys)
    sides = [F.struct(F.lit(i).alias("metric"), *sketched(F.col(c).cast("double"))).alias(f"_s{i}") for i, c in enumerate(columns)]
    wide = frame.groupBy(*keys).agg(*sides)
    sketch = wide.select(*keys, F.explode(F.array(*[f"_s{i}" for i in range(len(columns))])).alias("s")).select(*keys, "s.*")
    return exact_quantiles(melt(frame, keys, columns), [*keys, "metric"], probabilities, sketch=sketch)


def exact_quantiles(
    long: DataFrame, by: Sequence[str], probabilities: Sequence[float], value: str = "value", sketch: DataFrame | None = None
) -> DataFrame:
    """Per group of `by`: n, low, high (minimum, maximum) and q0, q1, ...

    `by` must name few groups (dates x metrics, folds): their brackets are
    broadcast, one row per group. `long` is read twice; pass a persisted or
    stored panel when it is costly to compute. `sketch`: by, n, low, high, probes, where the caller has them.
    """
    by = list(by)
    if sketch is None:
        sketch = long.groupBy(*by).agg(*sketched(F.col(value)))
    n, slack = F.col("n"), F.lit(2.0 / ACCURACY)

    def bracket(j: int, p: float):
        """Probes around the wanted ranks, the sketch's error and two ranks away; at the ends the extremes."""
        h = (n - 1) * F.lit(float(p))
        first = F.floor(((h - 2) / n - slack) * GRID).cast("int")
        last = F.ceil(((h + 3) / n + slack) * GRID).cast("int")
        return F.struct(
            F.lit(j).alias("q"),
            h.alias("h"),
            F.when(first <= 0, F.col("low")).otherwise(F.get("probes", first)).alias("from"),
            F.when(last >= GRID, F.col("high")).otherwise(F.get("probes", last)).alias("to"),
        )

    spans = F.when(n > 0, F.array(*[bracket(j, p) for j, p in enumerate(probabilities)]))
    brackets = sketch.select(*by, F.explode(spans).alias("span")).select(*by, "span.*")
    # values below a bracket are only counted (v is NULL), map-side
    counted = (
        long.filter(F.col(value).isNotNull())
        .join(F.broadcast(brackets.groupBy(*by).agg(F.collect_list(F.struct("q", "h", "from", "to")).alias("spans"))), by)
        .select(*by, F.col(value).alias("v"), F.explode("spans").alias("s"))
        .filter(F.col("v") <= F.col("s.to"))
        .select(*by, "s.q", "s.h", F.when(F.col("v") >= F.col("s.from"), F.col("v")).alias("v"))
        .groupBy(*by, "q", "h", "v")
        .agg(F.count("*").alias("rows"))
    )
    running = (
        Window.partitionBy(*by, "q")
        .orderBy(F.col("v").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("upto")
    picked = (
        counted.withColumn("upto", F.sum("rows").over(running))
        .groupBy(*by, "q", "h")
        .agg(
            F.min_by("v", F.when(upto > F.floor("h"), upto)).alias("below"),
            F.min_by("v", F.when(upto > F.ceil("h"), upto)).alias("above"),
        )
    )
    exact = F.col("below") + (F.col("above") - F.col("below")) * (F.col("h") - F.floor("h"))
    checked = F.when(
        F.col("below").isNull() | F.col("above").isNull(),
        F.raise_error(F.lit("quantile bracket missed")).cast("double"),
    ).otherwise(exact)
    wide = (
        picked.withColumn("exact", checked)
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when(F.col("q") == j, F.col("exact"))).alias(f"q{j}")
                for j in range(len(probabilities))
            ]
        )
    )
    return sketch.drop("probes").join(F.broadcast(wide), by, "left")
