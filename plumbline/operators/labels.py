"""Holding-period returns and labelled panels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.asof import rows_in_windows

MIN_LABEL_ROWS = 55


def holding_returns(returns: DataFrame, windows: Sequence[tuple[date, date]]) -> DataFrame:
    """Compounded return and row count per (ticker, window)."""
    inside = rows_in_windows(returns.filter(F.col("daily_return").isNotNull()), windows)
    return inside.groupBy("ticker", "start_date", "end_date").agg(
        (F.product(1 + F.col("daily_return")) - 1).alias("holding_return"),
        F.count("*").alias("return_rows"),
    )


def forward_returns(
    returns: DataFrame,
    windows: Sequence[tuple[date, date]],
    benchmark: str,
    min_rows: int = MIN_LABEL_ROWS,
) -> DataFrame:
    """forward_return, benchmark_return (0 when missing) and their difference.

    The benchmark side is one row per window and is broadcast.
    """
    held = holding_returns(returns, windows).filter(F.col("return_rows") >= min_rows)
    bench = held.filter(F.col("ticker") == benchmark).select(
        "start_date", "end_date", F.col("holding_return").alias("benchmark_return")
    )
    return (
        held.filter(F.col("ticker") != benchmark)
        .join(F.broadcast(bench), ["start_date", "end_date"], "left")
        .select(
            "ticker",
            F.col("start_date").alias("as_of_date"),
            "end_date",
            "return_rows",
            F.col("holding_return").alias("forward_return"),
            F.coalesce("benchmark_return", F.lit(0.0)).alias("benchmark_return"),
        )
        .withColumn("forward_excess_return", F.col("forward_return") - F.col("benchmark_return"))
    )


def labelled_panel(features: DataFrame, forward: DataFrame) -> DataFrame:
    """Features joined with their label; dates without a label drop out."""
    return features.join(
        forward.select("as_of_date", "ticker", "forward_return", "benchmark_return", "forward_excess_return"),
        ["as_of_date", "ticker"],
    )
