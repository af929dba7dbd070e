"""Cross-sectional factor scoring of every research date at once."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.factor_config import (
    FACTOR_METRICS,
    FACTOR_WEIGHTS,
    INTERACTIONS,
    SCORE_COLUMNS,
    SCORED_METRICS,
    UNSCORED_METRICS,
)
from plumbline.functions.scalars import clip, finite, safe_divide
from plumbline.operators import asof, fundamentals, prices
from plumbline.operators.quantiles import column_quantiles
from plumbline.operators.ranking import ranked, top_k
from plumbline.sources.stored import settle

KEY = ["as_of_date", "ticker"]
RAW_COLUMNS = [*SCORED_METRICS, *UNSCORED_METRICS]


def rsi_score(rsi: Column) -> Column:
    return (
        F.when(rsi.isNull(), None)
        .when(rsi.between(50, 70), 100.0)
        .when((rsi >= 40) & (rsi < 50), 70.0)
        .when((rsi > 70) & (rsi <= 80), 60.0)
        .when((rsi >= 30) & (rsi < 40), 40.0)
        .otherwise(10.0)
    )


def technical_ratios() -> dict[str, Column]:
    return {
        "price_vs_sma_50": safe_divide("price", "sma_50") - 1,
        "price_vs_sma_200": safe_divide("price", "sma_200") - 1,
        "sma_50_vs_sma_200": safe_divide("sma_50", "sma_200") - 1,
        "macd_spread": safe_divide(F.col("macd") - F.col("macd_signal"), "price"),
        "rsi_score": rsi_score(F.col("rsi_14")),
    }


def raw_factors(
    bars: DataFrame,
    statements: DataFrame,
    dates: Sequence[date],
    benchmark: str,
    period_mode: str = "quarterly",
) -> DataFrame:
    """One row per (as-of, ticker) with all raw factors.

    The bars are read once: the as-of row of the price panel gives market and
    technical measures and the market cap.
    """
    # measures look back only: no later bar matters; bars without a date stand first
    past = bars.filter(F.col("date").isNull() | (F.col("date") <= F.lit(max(dates))))
    # measured only where a bar answers a date; a ticker's bars are shuffled and sorted once
    dated = asof.with_validity(past.repartition("ticker")).withColumn(prices.WANTED, asof.answers(dates))
    panel = prices.price_panel(dated, benchmark)
    market = (
        asof.answering(panel, dates)
        .filter(F.col("ticker") != benchmark)
        .withColumns({**technical_ratios(), "market_cap": prices.cap_at(bars)})
    )
    # one row per as-of date and ticker, read on both sides of the join
    used = [c for c in RAW_COLUMNS if c in market.columns]
    market = settle(market.select(*KEY, "return_count", "market_cap", *used), "market")
    caps = market.select(*KEY, "market_cap")
    statement_side = fundamentals.summary(statements, caps, dates, period_mode)
    joined = market.drop("market_cap").join(statement_side, KEY, "left")
    return joined.select(
        *KEY, "return_count", "market_cap", *[finite(c).alias(c) for c in RAW_COLUMNS]
    )


def robust_score(value: Column, bounds: Column, lower_is_better: Column) -> Column:
    """0..100 by clipped min-max. `bounds` holds n, low, high, q0 and q1."""
    low, high = bounds["q0"], bounds["q1"]
    scaled = (clip(value, low, high) - low) / (high - low) * 100
    scaled = F.when(lower_is_better, 100 - scaled).otherwise(scaled)
    return (
        F.when(bounds["n"] == 0, F.lit(None).cast("double"))
        .when((bounds["low"] == bounds["high"]) | (low == high), 50.0)
        .otherwise(clip(scaled, 0.0, 100.0))
    )


LOWER_IS_BETTER = [not higher for entries in FACTOR_METRICS.values() for _, _, higher in entries]


def metric_scores(raw: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Adds `metric_scores`, the robust scores in the order of SCORED_METRICS.

    Reads `raw` three times (sketch, bracket, scoring): pass a stored panel. The bounds are one row per group of `by`.
    """
    by = list(by)
    bounds = column_quantiles(raw, by, SCORED_METRICS, [0.05, 0.95])
    packed = bounds.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("metric", "n", "low", "high", "q0", "q1"))).alias("bounds")
    )
    values = F.array(*[F.col(m) for m in SCORED_METRICS])
    inverted = F.array(*[F.lit(lower) for lower in LOWER_IS_BETTER])
    pairs = F.arrays_zip(values.alias("value"), F.col("bounds").alias("bound"), inverted.alias("inverted"))
    scores = F.transform(pairs, lambda x: robust_score(x["value"], x["bound"], x["inverted"]))
    return (
        raw.join(F.broadcast(packed), by).withColumn("metric_scores", scores).drop("bounds")
    )


def factor_score(factor: str) -> Column:
    """Weighted mean of the available metric scores."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for metric, w, _ in FACTOR_METRICS[factor]:
        score = F.col("metric_scores")[SCORED_METRICS.index(metric)]
        total = total + F.coalesce(score * w, F.lit(0.0))
        weight = weight + F.when(score.isNotNull(), w).otherwise(0.0)
    return safe_divide(total, weight)


def overall_score() -> Column:
    """Missing factors count as 0."""
    total = F.lit(0.0)
    for factor, w in FACTOR_WEIGHTS.items():
        total = total + F.coalesce(F.col(factor), F.lit(0.0)) * w
    return total / sum(FACTOR_WEIGHTS.values())


def score(raw: DataFrame, by: Sequence[str] = ("as_of_date",)) -> DataFrame:
    """Raw factors -> raw factors, 8 factor scores and overall_score."""
    scored = metric_scores(raw, by)
    return scored.select(
        *raw.columns, *[factor_score(f).alias(f) for f in SCORE_COLUMNS]
    ).withColumn("overall_score", overall_score())


def rank_universe(scored: DataFrame, name: str = "universe_rank") -> DataFrame:
    return ranked(scored, ["as_of_date"], "overall_score", "ticker", name)


def best(scored: DataFrame, n: int, score_column: str = "overall_score", name: str = "position") -> DataFrame:
    order = [F.col(score_column).desc_nulls_last(), F.md5("ticker"), F.col("ticker")]
    return top_k(scored, ["as_of_date"], order, n, name)


def two_stage(raw: DataFrame, screen_n: int = 100, final_n: int = 10) -> DataFrame:
    """Score the universe, keep a screen, score again inside it, keep the best.

    Universe ranks come from `best`: its positions are the first ranks.
    """
    # read by the second scoring three times; screen_n rows per date
    screen = settle(best(score(raw), screen_n, name="universe_rank"), "screen")
    inner = score(screen.select(*raw.columns))
    final = best(inner, final_n, name="screen_rank")
    ranks = screen.select(
        *KEY, "universe_rank", F.col("overall_score").alias("universe_score")
    )
    return final.join(F.broadcast(ranks), KEY)


def with_interactions(scored: DataFrame) -> DataFrame:
    return scored.withColumns(
        {name: F.col(a) * F.col(b) / 100.0 for name, (a, b) in INTERACTIONS.items()}
    )


def snapshots(
    bars: DataFrame,
    statements: DataFrame,
    dates: Sequence[date],
    benchmark: str,
    period_mode: str = "quarterly",
) -> DataFrame:
    """Scores and interactions of every date in one plan."""
    raw = raw_factors(bars, statements, dates, benchmark, period_mode)
    return with_interactions(score(settle(raw, "raw_factors")))


def peer_profile(raw: DataFrame, ticker: str, peers: Sequence[str]) -> DataFrame:
    """Scores of one ticker against its peers only."""
    wanted = sorted({t.upper().strip() for t in [ticker, *peers]})
    scored = score(raw.filter(F.col("ticker").isin(wanted)))
    return scored.filter(F.col("ticker") == ticker.upper().strip())
