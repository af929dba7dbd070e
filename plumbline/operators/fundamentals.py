"""Statements: point-in-time view, Q4 inference, ratios and growth."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import cagr, growth, safe_divide
from plumbline.operators.asof import visible_rows

# Metric names of the statement table.
FLOW_METRICS = [
    "revenue", "net_income", "operating_income", "gross_profit", "operating_cash_flow",
    "free_cash_flow", "capital_expenditures", "depreciation_and_amortization",
    "r_and_d_expense", "sga_expense", "interest_expense", "income_tax_expense",
    "dividends_paid",
]
BALANCE_METRICS = [
    "total_assets", "total_liabilities", "cash_and_equivalents", "total_debt",
    "current_assets", "current_liabilities", "inventory", "accounts_receivable",
    "accounts_payable", "weighted_average_shares", "weighted_average_diluted_shares",
]
METRICS = FLOW_METRICS + BALANCE_METRICS
INTERIM = ("Q1", "Q2", "Q3")
KEY = ("as_of_date", "ticker")


def visible(statements: DataFrame, dates: Sequence[date]) -> DataFrame:
    """Statements filed by each research date."""
    return visible_rows(statements, dates, "filed_date")


def annual(seen: DataFrame) -> DataFrame:
    return seen.filter(F.col("fiscal_period") == "FY")


def _per_year(seen: DataFrame) -> DataFrame:
    """One row per (as-of, ticker, year): last Q1..Q3 and FY rows as structs.

    `max_by` combines map-side; stored Q4 rows are ignored on purpose.
    """
    body = F.struct("period_end_date", "filed_date", *METRICS)
    recency = F.struct("period_end_date", "filed_date")

    def last(period: str) -> Column:
        hit = F.col("fiscal_period") == period
        return F.max_by(F.when(hit, body), F.when(hit, recency)).alias(period)

    return (
        seen.filter(F.col("fiscal_period").isin(*INTERIM, "FY") & F.col("fiscal_year").isNotNull())
        .groupBy(*KEY, "fiscal_year")
        .agg(*[last(p) for p in (*INTERIM, "FY")])
    )


def _inferred() -> Column:
    """FY minus three quarters for flows, FY value for balances."""
    flows = [
        (F.col(f"FY.{m}") - (F.col(f"Q1.{m}") + F.col(f"Q2.{m}") + F.col(f"Q3.{m}"))).alias(m)
        for m in FLOW_METRICS
    ]
    balances = [F.col(f"FY.{m}").alias(m) for m in BALANCE_METRICS]
    return F.when(
        F.col("FY").isNotNull(),
        F.struct(
            F.col("FY.period_end_date").alias("period_end_date"),
            F.col("FY.filed_date").alias("filed_date"),
            *flows,
            *balances,
        ),
    )


def _unfold(years: DataFrame, periods: list[tuple[str, Column]]) -> DataFrame:
    items = F.array(
        *[F.struct(F.lit(name).alias("fiscal_period"), body.alias("body")) for name, body in periods]
    )
    return (
        years.select(*KEY, "fiscal_year", F.explode(items).alias("item"))
        .filter(F.col("item.body").isNotNull())
        .select(*KEY, "fiscal_year", "item.fiscal_period", "item.body.*")
    )


def inferred_q4(seen: DataFrame) -> DataFrame:
    return _unfold(_per_year(seen), [("Q4", _inferred())])


def quarterly(seen: DataFrame) -> DataFrame:
    """Q1..Q3 plus inferred Q4 from one aggregation."""
    periods = [(p, F.col(p)) for p in INTERIM] + [("Q4", _inferred())]
    return _unfold(_per_year(seen), periods)


def by_mode(seen: DataFrame, period_mode: str) -> DataFrame:
    if period_mode == "quarterly":
        return quarterly(seen)
    if period_mode == "annual":
        return annual(seen)
    if period_mode == "raw":
        return seen
    raise ValueError("period_mode must be one of: quarterly, annual, raw.")


RATIO_COLUMNS = [
    "market_cap", "enterprise_value", "book_equity", "net_debt", "invested_capital", "ebitda",
    "revenue_growth", "net_income_growth", "free_cash_flow_growth", "gross_margin",
    "operating_margin", "ebitda_margin", "net_margin", "free_cash_flow_margin",
    "return_on_assets", "return_on_equity", "return_on_invested_capital", "debt_to_assets",
    "debt_to_equity", "net_debt_to_equity", "liabilities_to_assets", "cash_to_debt",
    "current_ratio", "quick_ratio", "asset_turnover", "r_and_d_intensity", "sga_intensity",
    "capex_to_revenue", "operating_cash_flow_to_net_income", "free_cash_flow_to_net_income",
    "dividend_payout_ratio", "interest_coverage", "effective_tax_rate", "basic_eps",
    "diluted_eps", "free_cash_flow_per_share", "earnings_yield", "free_cash_flow_yield",
    "sales_yield", "book_to_market", "price_to_book", "ev_to_sales", "ev_to_operating_income",
    "ev_to_ebitda", "ev_to_free_cash_flow",
]


def ratios(periods: DataFrame, market_caps: DataFrame) -> DataFrame:
    """Business-quality and valuation columns of every period row.

    `market_caps` is (as_of_date, ticker, market_cap); the one value at the
    research date serves every period of the ticker.
    """
    return valued(with_growth(periods), market_caps)


def timeline():
    return Window.partitionBy(*KEY).orderBy("period_end_date", "fiscal_period")


def with_growth(periods: DataFrame) -> DataFrame:
    """Growth of each period row over the one before it."""

    def change(metric: str) -> Column:
        return growth(metric, F.lag(metric).over(timeline()))

    return periods.withColumns({f"{m}_growth": change(m) for m in ("revenue", "net_income", "free_cash_flow")})


def valued(periods: DataFrame, market_caps: DataFrame) -> DataFrame:
    """Quotients of every row `with_growth`."""
    c = F.col
    base = periods.join(market_caps.select(*KEY, "market_cap"), list(KEY), "left")
    base = base.withColumns(
        {
            "book_equity": c("total_assets") - c("total_liabilities"),
            "net_debt": c("total_debt") - c("cash_and_equivalents"),
            "ebitda": c("operating_income") + c("depreciation_and_amortization"),
            "enterprise_value": c("market_cap") + c("total_debt") - c("cash_and_equivalents"),
        }
    ).withColumn("invested_capital", c("total_debt") + c("book_equity"))
    quotients = {
        "gross_margin": ("gross_profit", "revenue"),
        "operating_margin": ("operating_income", "revenue"),
        "ebitda_margin": ("ebitda", "revenue"),
        "net_margin": ("net_income", "revenue"),
        "free_cash_flow_margin": ("free_cash_flow", "revenue"),
        "return_on_assets": ("net_income", "total_assets"),
        "return_on_equity": ("net_income", "book_equity"),
        "return_on_invested_capital": ("operating_income", "invested_capital"),
        "debt_to_assets": ("total_debt", "total_assets"),
        "debt_to_equity": ("total_debt", "book_equity"),
        "net_debt_to_equity": ("net_debt", "book_equity"),
        "liabilities_to_assets": ("total_liabilities", "total_assets"),
        "cash_to_debt": ("cash_and_equivalents", "total_debt"),
        "current_ratio": ("current_assets", "current_liabilities"),
        "quick_ratio": (c("current_assets") - c("inventory"), "current_liabilities"),
        "asset_turnover": ("revenue", "total_assets"),
        "r_and_d_intensity": ("r_and_d_expense", "revenue"),
        "sga_intensity": ("sga_expense", "revenue"),
        "capex_to_revenue": (F.abs("capital_expenditures"), "revenue"),
        "operating_cash_flow_to_net_income": ("operating_cash_flow", "net_income"),
        "free_cash_flow_to_net_income": ("free_cash_flow", "net_income"),
        "dividend_payout_ratio": (F.abs("dividends_paid"), "net_income"),
        "interest_coverage": ("operating_income", "interest_expense"),
        "effective_tax_rate": ("income_tax_expense", c("net_income") + c("income_tax_expense")),
        "basic_eps": ("net_income", "weighted_average_shares"),
        "diluted_eps": ("net_income", "weighted_average_diluted_shares"),
        "free_cash_flow_per_share": ("free_cash_flow", "weighted_average_diluted_shares"),
        "earnings_yield": ("net_income", "market_cap"),
        "free_cash_flow_yield": ("free_cash_flow", "market_cap"),
        "sales_yield": ("revenue", "market_cap"),
        "book_to_market": ("book_equity", "market_cap"),
        "price_to_book": ("market_cap", "book_equity"),
        "ev_to_sales": ("enterprise_value", "revenue"),
        "ev_to_operating_income": ("enterprise_value", "operating_income"),
        "ev_to_ebitda": ("enterprise_value", "ebitda"),
        "ev_to_free_cash_flow": ("enterprise_value", "free_cash_flow"),
    }
    return base.withColumns({name: safe_divide(a, b) for name, (a, b) in quotients.items()})


def latest_period(metrics: DataFrame) -> DataFrame:
    """Newest period row of each (as-of, ticker)."""
    body = [c for c in metrics.columns if c not in KEY]
    return (
        metrics.groupBy(*KEY)
        .agg(F.max_by(F.struct(*body), F.struct("period_end_date", "fiscal_period")).alias("last"))
        .select(*KEY, "last.*")
    )


def annual_growth(seen: DataFrame) -> DataFrame:
    """CAGR between first and last annual row, and the number of rows."""
    body = F.struct("revenue", "net_income", "free_cash_flow")
    ends = (
        annual(seen)
        .groupBy(*KEY)
        .agg(
            F.min_by(body, "period_end_date").alias("first"),
            F.max_by(body, "period_end_date").alias("last"),
            F.count("*").alias("periods_used"),
        )
    )
    return ends.select(
        *KEY,
        *[
            cagr(f"first.{m}", f"last.{m}", F.col("periods_used") - 1).alias(f"{m}_cagr")
            for m in ("revenue", "net_income", "free_cash_flow")
        ],
        "periods_used",
    )


def summary(
    statements: DataFrame,
    market_caps: DataFrame,
    dates: Sequence[date],
    period_mode: str = "quarterly",
) -> DataFrame:
    """Latest ratios joined with the annual growth rates.

    Growth needs the period before; caps and quotients are taken for the newest rows alone, found in the same sort.
    """
    seen = visible(statements, dates)
    grown = with_growth(by_mode(seen, period_mode)).withColumn("_later", F.lead(F.lit(1)).over(timeline()))
    latest = valued(grown.filter(F.col("_later").isNull()).drop("_later"), market_caps)
    return latest.join(annual_growth(seen), list(KEY), "left").withColumn(
        "periods_used", F.coalesce("periods_used", F.lit(0))
    )
