"""One research run: eligible -> ranked -> screened -> selected -> alpha -> weighted."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.factor_config import SCORE_COLUMNS
from plumbline.functions.scalars import finite
from plumbline.operators import calendars, covariance, factors, labels, models, portfolio, prices, rolling
from plumbline.sources.stored import settle


@dataclass(frozen=True)
class ResearchConfig:
    """Settings of a run; the defaults are the reference's."""

    benchmark: str = "SPY"
    period_mode: str = "quarterly"
    minimum_return_rows: int = 252
    top_screen_n: int = 100
    final_portfolio_n: int = 5
    method: str = "score_weighted"
    top_n: int = 5
    covariance_method: str = "sample"
    ewma_span: int = 60
    max_weight: float | None = 1.0
    max_abs_weight: float | None = 0.40
    long_only: bool = True
    exposure_mode: str = "gross"
    target_gross_exposure: float = 1.0
    target_net_exposure: float = 1.0
    risk_aversion: float = 1.0
    risk_free_signal: float = 0.04
    training_lookback_periods: int = 12
    training_period_months: int = 3
    min_train_periods: int = 8
    hrp_linkage_method: str = "single"
    minimum_label_rows: int = labels.MIN_LABEL_ROWS
    base_models: tuple[str, ...] = tuple(models.STATISTICAL)
    hrp_use_signal: bool = True
    hrp_return_risk_metric: str = "volatility"

    def __post_init__(self) -> None:
        if self.final_portfolio_n > self.top_screen_n:
            raise ValueError("final_portfolio_n must not exceed top_screen_n.")
        if self.risk_aversion < 1:
            raise ValueError("risk_aversion must be at least 1.")


NEEDS_ALPHA = {"top_n_equal_weight", "maximum_sharpe", "mean_variance", "hierarchical_risk_parity"}


def eligible_names(
    bars: DataFrame, statements: DataFrame, dates: Sequence[date], config: ResearchConfig
) -> DataFrame:
    """Raw factors of every name with enough returns, at every date."""
    raw = factors.raw_factors(bars, statements, dates, config.benchmark, config.period_mode)
    return settle(raw.filter(F.col("return_count") >= config.minimum_return_rows), "raw_factors")


def training_spans(days: Sequence[date], config: ResearchConfig) -> list[tuple[date, date, date]]:
    """(research date, training date, end of its label) of every research date."""
    periods, months = config.training_lookback_periods, config.training_period_months
    spans = []
    for day in sorted(set(days)):
        bounds = calendars.boundaries(day, periods, months)
        # a label ends the day before the next boundary, so nothing of `day` or later is seen
        spans += [(day, a, b - timedelta(days=1)) for a, b in zip(bounds, bounds[1:])]
    return spans


def training_panels(
    bars: DataFrame,
    statements: DataFrame,
    days: Sequence[date],
    config: ResearchConfig,
    columns: Sequence[str] = SCORE_COLUMNS,
    raw: DataFrame | None = None,
) -> DataFrame:
    """Rows (research_date, as_of_date, ticker, features, target) of the training dates before every research date.

    Research dates share training dates and label windows: factors and labels are
    computed once for all distinct ones. The label of a date is the excess return up to the next boundary.
    `raw`: raw factors of at least the training dates, where the caller has stored them.
    """
    spans = training_spans(days, config)
    starts, windows = sorted({s[1] for s in spans}), sorted({s[1:] for s in spans})
    if raw is None:
        raw = factors.raw_factors(bars, statements, starts, config.benchmark, config.period_mode)
    eligible = raw.filter(F.col("as_of_date").isin(starts) & (F.col("return_count") >= config.minimum_return_rows))
    scores = factors.score(settle(eligible, "training"))
    forward = labels.forward_returns(prices.with_returns(bars), windows, config.benchmark, config.minimum_label_rows)
    # one row per research date and training date
    calendar = bars.sparkSession.createDataFrame(spans, "research_date date, as_of_date date, end_date date")
    dated = forward.select("as_of_date", "end_date", "ticker", models.TARGET).join(F.broadcast(calendar), ["as_of_date", "end_date"])
    return scores.select("as_of_date", "ticker", *columns).join(dated.drop("end_date"), ["as_of_date", "ticker"])


def training_panel(bars: DataFrame, statements: DataFrame, day: date, config: ResearchConfig) -> DataFrame:
    """The training rows of one research date."""
    return training_panels(bars, statements, [day], config).drop("research_date")


def expected_returns(
    bars: DataFrame, statements: DataFrame, eligible: DataFrame, dates: Sequence[date], config: ResearchConfig
) -> DataFrame:
    """(as_of_date, ticker, alpha): every research date with models trained on earlier dates only.

    Linear base models of all dates are fitted together (`rolling`); a list with other base models is
    fitted date by date. A date whose training dates hold too few labelled rows has no alpha.
    """
    scored = settle(factors.score(eligible).select("as_of_date", "ticker", *SCORE_COLUMNS), "scores")
    panel = settle(training_panels(bars, statements, dates, config), "panel")
    names = list(config.base_models)
    if set(names) <= set(models.STATISTICAL):
        current = scored.filter(F.col("as_of_date").isin(list(dates)))
        out = rolling.rolling_alpha(panel, current, SCORE_COLUMNS, names, config.min_train_periods)
        return settle(out.select("as_of_date", "ticker", "alpha"), "alpha")
    out = scored.select("as_of_date", "ticker", F.lit(None).cast("double").alias("alpha")).limit(0)
    for day in dates:
        own = panel.filter(F.col("research_date") == F.lit(day)).drop("research_date")
        if own.isEmpty():
            continue
        current = scored.filter(F.col("as_of_date") == F.lit(day))
        alpha = models.train_predict(own, current, SCORE_COLUMNS, models.Required(names), config.min_train_periods)
        out = out.unionByName(alpha.withColumnRenamed("alpha_expected_excess_return", "alpha").select("as_of_date", "ticker", "alpha"))
    return settle(out, "alpha")


def build_weights(
    bars: DataFrame, chosen: DataFrame, config: ResearchConfig, alpha: DataFrame | None = None
) -> DataFrame:
    """(as_of_date, ticker, method, weight) for the configured method.

    `alpha` (as_of_date, ticker, alpha) is the signal of the methods that need one; names
    without an alpha leave those methods.
    """
    keys = ["as_of_date", "ticker"]
    if alpha is not None:
        chosen = chosen.join(alpha, keys, "left").withColumn("signal", finite("alpha"))
    else:
        chosen = chosen.withColumn("signal", F.lit(None).cast("double"))
    raw_columns = ["as_of_date", "ticker", "return_count", "market_cap", *factors.RAW_COLUMNS]
    method = config.method
    if method == "equal_weight":
        out = portfolio.equal(chosen)
    elif method == "top_n_equal_weight":
        out = portfolio.top_n_equal(chosen, "signal", config.top_n)
    elif method in ("score_weighted", "risk_adjusted_score_weighted"):
        scored = factors.score(settle(chosen.select(*raw_columns), "candidates"))
        rule = portfolio.score_weighted if method == "score_weighted" else portfolio.risk_adjusted
        out = rule(scored)
    elif method in portfolio.SOLVED:
        returns = prices.with_returns(bars)
        rows = covariance.complete_returns(returns, chosen.select("as_of_date", "ticker"))
        cov = covariance.estimate(rows, config.covariance_method, config.ewma_span)
        signals = chosen.select("as_of_date", "ticker", "signal")
        hrp = {"use_signal": config.hrp_use_signal, "metric": config.hrp_return_risk_metric, "linkage": config.hrp_linkage_method}
        raw = portfolio.solved_weights(cov, signals, [method], config.risk_free_signal, **hrp)
        share = 1 / config.risk_aversion if method == "mean_variance" else 1.0
        always_long = method in ("risk_parity", "hierarchical_risk_parity")
        return portfolio.finalized(
            raw, config.long_only or always_long, config.max_weight, config.max_abs_weight,
            config.exposure_mode, config.target_gross_exposure * share if method != "mean_variance" else share,
            config.target_net_exposure * share, ["as_of_date", "method"],
        )
    else:
        raise ValueError(f"unknown portfolio method: {method}")
    return out.select("as_of_date", "ticker", F.lit(method).alias("method"), F.col("weight").cast("double").alias("weight"))


def run(
    bars: DataFrame, statements: DataFrame, dates: Sequence[date], config: ResearchConfig = ResearchConfig()
) -> dict[str, DataFrame]:
    """Selection, expected returns (where the method needs them) and weights of every research date."""
    eligible = eligible_names(bars, statements, dates, config)
    chosen = settle(factors.two_stage(eligible, config.top_screen_n, config.final_portfolio_n), "selection")
    needed = config.method in NEEDS_ALPHA and (
        config.method != "hierarchical_risk_parity" or config.hrp_use_signal
    )
    alpha = expected_returns(bars, statements, eligible, dates, config) if needed else None
    out = {"selection": chosen, "weights": build_weights(bars, chosen, config, alpha)}
    return out | ({"alpha": alpha} if needed else {})
