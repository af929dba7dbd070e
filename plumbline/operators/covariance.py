"""Complete-case returns and covariance estimates of ticker sets.

Every task adds up one matrix per set from the dates it holds, so only one row per
pair, task and set is shuffled, whatever the number of dates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip
from plumbline.operators.prices import TRADING_DAYS


def complete_returns(returns: DataFrame, sets: DataFrame, group: str = "as_of_date") -> DataFrame:
    """(group, date, ticker, ret) of the dates on which every name has a return.

    `sets` is (group, ticker). Only dates at or before the group's date count.
    One grouped count replaces the name-by-name join. Sets are candidate lists: as
    many rows as names chosen per date, so they are broadcast.
    """
    sized = sets.withColumn("names", F.count("*").over(Window.partitionBy(group)))
    rows = (
        returns.filter(F.col("daily_return").isNotNull())
        .join(F.broadcast(sized), "ticker")
        .filter(F.col("date") <= F.col(group))
        .select(group, "date", "ticker", "names", F.col("daily_return").alias("ret"))
    )
    day = rows.groupBy(group, "date", "names").agg(
        F.array_sort(F.collect_list(F.struct("ticker", "ret"))).alias("row")
    )
    return (
        day.filter(F.size("row") == F.col("names"))
        .select(group, "date", F.explode("row").alias("r"))
        .select(group, "date", "r.ticker", "r.ret")
    )


def _pairs(rows: DataFrame, group: str, value: Column, weight: Column) -> DataFrame:
    """sum(weight * x_i * x_j) for i <= j, per group."""
    day = rows.groupBy(group, "date").agg(
        F.array_sort(F.collect_list(F.struct("ticker", value.alias("x"), weight.alias("w")))).alias("row")
    )
    packed = day.select(group, F.col("row.ticker").alias("names"), F.col("row.x").alias("x"), F.col("row.w").alias("w"))

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            for key, names, x, w in batch.itertuples(index=False):
                x = np.asarray(x, dtype=float)
                at = (key, tuple(names))
                part = np.outer(np.asarray(w, dtype=float) * x, x)
                total, n = sums.get(at, (0.0, 0))
                sums[at] = (total + part, n + 1)
        for (key, names), (total, n) in sums.items():
            i, j = np.triu_indices(len(names))
            label = np.array(names, dtype=object)
            yield pd.DataFrame({group: key, "t1": label[i], "t2": label[j], "s": total[i, j], "n": n})

    kind = rows.schema[group].dataType.simpleString()
    cells = packed.mapInPandas(partial, f"{group} {kind}, t1 string, t2 string, s double, n bigint")
    return cells.groupBy(group, "t1", "t2").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _centered(rows: DataFrame, group: str) -> DataFrame:
    mean = F.avg("ret").over(Window.partitionBy(group, "ticker"))
    return rows.withColumn("x", F.col("ret") - mean)


def sample(rows: DataFrame, group: str = "as_of_date") -> DataFrame:
    pairs = _pairs(_centered(rows, group), group, F.col("x"), F.lit(1.0))
    return pairs.filter("n >= 2").select(
        group, "t1", "t2", (F.col("s") / (F.col("n") - 1) * TRADING_DAYS).alias("cov")
    )


def ewma(rows: DataFrame, span: int = 60, group: str = "as_of_date") -> DataFrame:
    """Exponential weights over the complete dates, normalised; population form."""
    timeline = Window.partitionBy(group, "ticker").orderBy("date")
    every = Window.partitionBy(group, "ticker")
    n = F.count("*").over(every)
    start = -n / span if span > 1 else F.lit(-1.0)
    step = (F.row_number().over(timeline) - 1) / (n - 1)
    rows = rows.withColumn("raw_w", F.exp(start * (1 - step))).withColumn("n_dates", n).filter("n_dates >= 2")
    rows = rows.withColumn("w", F.col("raw_w") / F.sum("raw_w").over(every))
    rows = rows.withColumn("x", F.col("ret") - F.sum(F.col("w") * F.col("ret")).over(every))
    return _pairs(rows, group, F.col("x"), F.col("w")).select(
        group, "t1", "t2", (F.col("s") * TRADING_DAYS).alias("cov")
    )


def _population(rows: DataFrame, group: str):
    centered = _centered(rows, group)
    pairs = _pairs(centered, group, F.col("x"), F.lit(1.0)).filter("n >= 2").withColumn(
        "cov", F.col("s") / F.col("n")
    )
    twice = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(2.0)
    facts = pairs.groupBy(group).agg(
        F.sum(F.when(F.col("t1") == F.col("t2"), F.col("cov"))).alias("trace"),
        F.sum(twice * F.col("cov") * F.col("cov")).alias("square"),
        F.sum(F.when(F.col("t1") == F.col("t2"), 1)).alias("p"),
        F.max("n").alias("n_dates"),
    ).withColumn("mu", F.col("trace") / F.col("p"))
    return centered, pairs, facts


def _shrunk(pairs: DataFrame, facts: DataFrame, group: str) -> DataFrame:
    target = F.when(F.col("t1") == F.col("t2"), F.col("mu")).otherwise(0.0)
    shrunk = (1 - F.col("shrinkage")) * F.col("cov") + F.col("shrinkage") * target
    return pairs.join(F.broadcast(facts.select(group, "mu", "shrinkage")), group).select(
        group, "t1", "t2", (shrunk * TRADING_DAYS).alias("cov")
    )


def ledoit_wolf(rows: DataFrame, group: str = "as_of_date") -> DataFrame:
    """Shrinkage to mu * I (Ledoit & Wolf 2004)."""
    centered, pairs, facts = _population(rows, group)
    daily = centered.groupBy(group, "date").agg(F.sum(F.col("x") * F.col("x")).alias("norm"))
    fourth = daily.groupBy(group).agg(F.sum(F.col("norm") * F.col("norm")).alias("fourth"))
    c = F.col
    delta = (c("square") - 2 * c("mu") * c("trace") + c("p") * c("mu") * c("mu")) / c("p")
    beta = (c("fourth") / c("n_dates") - c("square")) / (c("p") * c("n_dates"))
    beta = F.least(beta, delta)
    facts = facts.join(fourth, group).withColumn(
        "shrinkage", F.when((beta == 0) | (delta == 0), 0.0).otherwise(beta / delta)
    )
    return _shrunk(pairs, facts, group)


def oas(rows: DataFrame, group: str = "as_of_date") -> DataFrame:
    """Oracle-approximating shrinkage (Chen et al. 2010)."""
    _, pairs, facts = _population(rows, group)
    c = F.col
    alpha = c("square") / (c("p") * c("p"))
    top = alpha + c("mu") * c("mu")
    bottom = (c("n_dates") + 1) * (alpha - c("mu") * c("mu") / c("p"))
    facts = facts.withColumn(
        "shrinkage", F.when(bottom == 0, 1.0).otherwise(F.least(top / bottom, F.lit(1.0)))
    )
    return _shrunk(pairs, facts, group)


def estimate(rows: DataFrame, method: str = "sample", span: int = 60) -> DataFrame:
    methods = {"sample": sample, "ledoit_wolf": ledoit_wolf, "oas": oas}
    if method == "ewma":
        return ewma(rows, span)
    if method not in methods:
        raise ValueError("covariance_method must be one of: sample, ewma, ledoit_wolf, oas.")
    return methods[method](rows)


def correlation_distance(cov: DataFrame, group: str = "as_of_date") -> DataFrame:
    """sqrt((1 - corr) / 2), corr 0 where a deviation is 0."""
    diagonal = cov.filter("t1 = t2").select(group, F.col("t1").alias("t"), F.sqrt("cov").alias("sd"))
    left = diagonal.withColumnsRenamed({"t": "t1", "sd": "sd1"})
    right = diagonal.withColumnsRenamed({"t": "t2", "sd": "sd2"})
    joined = cov.join(F.broadcast(left), [group, "t1"]).join(F.broadcast(right), [group, "t2"])
    corr = clip(F.coalesce(F.try_divide("cov", F.col("sd1") * F.col("sd2")), F.lit(0.0)), -1.0, 1.0)
    return joined.select(group, "t1", "t2", F.sqrt((1 - corr) / 2).alias("distance"))
