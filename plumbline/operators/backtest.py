"""Backtests: fixed weights, drifting weights per window, metrics.

Windows and methods are rows, so all of them run at once. The only sequential
part, the account value, is a running product over at most a few dozen windows
per method.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import safe_divide
from plumbline.operators.prices import TRADING_DAYS

RUN = ["method"]


def compound(column: str) -> Column:
    """Log growth, to be summed; returns above -1 only."""
    return F.log1p(F.coalesce(F.col(column), F.lit(0.0)))


def portfolio_returns(weights: DataFrame, rows: DataFrame) -> DataFrame:
    """Daily-rebalanced return per (as_of_date, method, date).

    `rows` are complete-case returns; names without a weight count as 0.
    """
    return (
        rows.join(F.broadcast(weights), ["as_of_date", "ticker"])
        .groupBy("as_of_date", "method", "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("portfolio_return"))
    )


def with_equity(daily: DataFrame, by: Sequence[str] = RUN, initial: float = 1.0) -> DataFrame:
    """Equity curve and running drawdown of a daily return series."""
    path = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = daily.withColumn("equity", initial * F.exp(F.sum(compound("portfolio_return")).over(path)))
    return out.withColumn("drawdown", F.col("equity") / F.max("equity").over(path) - 1)


def metrics(daily: DataFrame, by: Sequence[str] = RUN, risk_free_rate: float = 0.0) -> DataFrame:
    """Performance of each series, one grouped pass over the equity curve.

    total_return divides by the equity after the first day; total_return_full
    includes that day.
    """
    curve = with_equity(daily.filter(F.col("portfolio_return").isNotNull()), by)
    r = F.col("portfolio_return")
    stats = curve.groupBy(*by).agg(
        F.min_by("equity", "date").alias("_first"),
        F.max_by("equity", "date").alias("_last"),
        (F.stddev_samp(r) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annualized_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"),
        F.avg(r).alias("average_daily_return"),
        F.max(r).alias("best_day"),
        F.min(r).alias("worst_day"),
        F.count("*").alias("number_of_days"),
    )
    years = F.col("number_of_days") / TRADING_DAYS
    total = safe_divide("_last", "_first") - 1
    annual = F.when(F.col("total_return") > -1, F.pow(1 + F.col("total_return"), 1 / years) - 1)
    return (
        stats.withColumns({"total_return": total, "total_return_full": F.col("_last") - 1})
        .withColumn("annualized_return", annual)
        .withColumn("excess_annualized_return", F.col("annualized_return") - risk_free_rate)
        .withColumn("sharpe_ratio", safe_divide("excess_annualized_return", "annualized_volatility"))
        .drop("_first", "_last")
    )


def method_table(measured: DataFrame) -> DataFrame:
    return measured.orderBy(F.col("sharpe_ratio").desc_nulls_last(), "method")


def window_returns(
    returns: DataFrame, weights: DataFrame, windows: Sequence[tuple[date, date]]
) -> DataFrame:
    """(as_of_date, method, end_date, date, ticker, weight, ret) of complete dates.

    A date counts for a method when all its weighted names have a return.
    """
    spans = F.array(
        *[F.struct(F.lit(a).alias("as_of_date"), F.lit(b).alias("end_date")) for a, b in windows]
    )
    inside = (
        returns.filter(F.col("daily_return").isNotNull())
        .withColumn(
            "_s", F.explode(F.filter(spans, lambda s: F.col("date").between(s["as_of_date"], s["end_date"])))
        )
        .select("ticker", "date", F.col("daily_return").alias("ret"), "_s.as_of_date", "_s.end_date")
    )
    sized = weights.withColumn("_names", F.count("*").over(Window.partitionBy("as_of_date", "method")))
    held = inside.join(F.broadcast(sized), ["as_of_date", "ticker"])
    full = Window.partitionBy("as_of_date", "method", "date")
    return held.withColumn("_have", F.count("*").over(full)).filter("_have = _names").drop("_have", "_names")


def ticker_growth(held: DataFrame) -> DataFrame:
    """Growth of each position since the window began."""
    path = (
        Window.partitionBy("as_of_date", "method", "ticker")
        .orderBy("date")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return held.withColumn("growth", F.exp(F.sum(compound("ret")).over(path)))


def drifted(held: DataFrame) -> DataFrame:
    """Buy and hold inside a window: daily value and return, first day 0."""
    value = (
        ticker_growth(held)
        .groupBy("as_of_date", "end_date", "method", "date")
        .agg(F.sum(F.col("weight") * F.col("growth")).alias("value"))
    )
    order = Window.partitionBy("as_of_date", "method").orderBy("date")
    change = F.coalesce(safe_divide("value", F.lag("value").over(order)) - 1, F.lit(0.0))
    return value.withColumn("portfolio_return", change)


def rebalance_history(
    daily: DataFrame,
    weights: DataFrame,
    windows: Sequence[tuple[date, date]],
    methods: Sequence[str],
    initial: float = 1.0,
) -> DataFrame:
    """One row per (method, window): return, status and account value.

    Windows without selected names, without weights ("cash") or without returns
    keep the value of the window before.
    """
    spark = daily.sparkSession
    calendar = spark.createDataFrame(
        [(m, a, b) for m in methods for a, b in windows],
        "method string, as_of_date date, end_date date",
    )
    held = weights.groupBy("as_of_date", "method").agg(F.count("*").alias("holdings"))
    selected = weights.select("as_of_date").distinct().withColumn("selected", F.lit(True))
    ends = daily.groupBy("as_of_date", "method").agg(
        (F.max_by("value", "date") - 1).alias("period_return"), F.count("*").alias("days")
    )
    # a handful of rows per method and window on every side
    rows = (
        calendar.join(F.broadcast(held), ["as_of_date", "method"], "left")
        .join(F.broadcast(selected), "as_of_date", "left")
        .join(F.broadcast(ends), ["as_of_date", "method"], "left")
    )
    status = (
        F.when(F.col("selected").isNull(), "no selected tickers")
        .when(F.col("holdings").isNull(), "cash")
        .when(F.col("days").isNull(), "no returns")
        .otherwise("invested")
    )
    rows = rows.withColumn("status", status).withColumn(
        "period_return", F.when(F.col("status") == "cash", 0.0).otherwise(F.col("period_return"))
    )
    chain = (
        Window.partitionBy("method").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumn(
        "ending_value", initial * F.exp(F.sum(compound("period_return")).over(chain))
    ).drop("selected")


def cash_days(
    returns: DataFrame, reference: DataFrame, windows: Sequence[tuple[date, date]]
) -> DataFrame:
    """Zero returns on the trading dates of the reference ticker.

    `reference` is (as_of_date, ticker): the first usable selected name. Windows
    in which it never trades fall back to business days.
    """
    spark = returns.sparkSession
    calendar = spark.createDataFrame(list(windows), "as_of_date date, end_date date")
    spans = calendar.join(F.broadcast(reference), "as_of_date")
    traded = (
        returns.filter(F.col("daily_return").isNotNull())
        .join(F.broadcast(spans), "ticker")
        .filter(F.col("date").between(F.col("as_of_date"), F.col("end_date")))
        .select("as_of_date", "date")
    )
    idle = spans.join(traded.select("as_of_date").distinct(), "as_of_date", "left_anti")
    business = idle.select(
        "as_of_date", F.explode(F.sequence("as_of_date", "end_date")).alias("date")
    ).filter(F.weekday("date") < 5)
    return traded.unionByName(business).withColumn("portfolio_return", F.lit(0.0))


def diagnostics(weights_or_selection: DataFrame, predicted: DataFrame, realised: DataFrame) -> DataFrame:
    """Predicted and realised returns of every selected name.

    predicted: (as_of_date, ticker, predicted); realised: (as_of_date, ticker,
    actual_return, benchmark_return).
    """
    return (
        weights_or_selection.select("as_of_date", "ticker")
        .distinct()
        .join(predicted, ["as_of_date", "ticker"], "left")
        .join(realised, ["as_of_date", "ticker"], "left")
        .withColumn("forward_excess_return", F.col("actual_return") - F.col("benchmark_return"))
        .withColumn("prediction_error", F.col("predicted") - F.col("forward_excess_return"))
    )
