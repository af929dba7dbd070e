"""Factor definitions: fixed values that decide the scores."""

from __future__ import annotations

# Weight of each factor in overall_score.
FACTOR_WEIGHTS = {
    "value_score": 0.20,
    "quality_score": 0.20,
    "growth_score": 0.15,
    "momentum_score": 0.15,
    "financial_strength_score": 0.10,
    "risk_score": 0.10,
    "efficiency_score": 0.05,
    "technical_score": 0.05,
}

# Metrics of each factor as (metric, weight, higher is better).
FACTOR_METRICS = {
    "value_score": [
        ("earnings_yield", 0.20, True),
        ("free_cash_flow_yield", 0.25, True),
        ("sales_yield", 0.10, True),
        ("book_to_market", 0.10, True),
        ("ev_to_sales", 0.10, False),
        ("ev_to_operating_income", 0.10, False),
        ("ev_to_ebitda", 0.10, False),
        ("ev_to_free_cash_flow", 0.05, False),
    ],
    "growth_score": [
        ("revenue_growth", 0.20, True),
        ("net_income_growth", 0.20, True),
        ("free_cash_flow_growth", 0.20, True),
        ("revenue_cagr", 0.15, True),
        ("net_income_cagr", 0.15, True),
        ("free_cash_flow_cagr", 0.10, True),
    ],
    "quality_score": [
        ("gross_margin", 0.10, True),
        ("operating_margin", 0.15, True),
        ("ebitda_margin", 0.10, True),
        ("net_margin", 0.10, True),
        ("free_cash_flow_margin", 0.15, True),
        ("return_on_assets", 0.10, True),
        ("return_on_equity", 0.10, True),
        ("return_on_invested_capital", 0.15, True),
        ("operating_cash_flow_to_net_income", 0.05, True),
    ],
    "financial_strength_score": [
        ("debt_to_assets", 0.20, False),
        ("debt_to_equity", 0.15, False),
        ("net_debt_to_equity", 0.20, False),
        ("liabilities_to_assets", 0.15, False),
        ("cash_to_debt", 0.10, True),
        ("current_ratio", 0.10, True),
        ("quick_ratio", 0.05, True),
        ("interest_coverage", 0.05, True),
    ],
    "efficiency_score": [
        ("asset_turnover", 0.40, True),
        ("r_and_d_intensity", 0.25, True),
        ("sga_intensity", 0.20, False),
        ("capex_to_revenue", 0.15, False),
    ],
    "momentum_score": [
        ("one_month_return", 0.15, True),
        ("three_month_return", 0.25, True),
        ("six_month_return", 0.25, True),
        ("one_year_return", 0.20, True),
        ("sharpe_ratio", 0.15, True),
    ],
    "risk_score": [
        ("annualized_volatility", 0.40, False),
        ("max_drawdown", 0.35, True),
        ("beta_vs_spy", 0.25, False),
    ],
    "technical_score": [
        ("price_vs_sma_50", 0.22, True),
        ("price_vs_sma_200", 0.22, True),
        ("sma_50_vs_sma_200", 0.22, True),
        ("macd_spread", 0.14, True),
        ("rsi_score", 0.10, True),
        ("volume_ratio", 0.10, True),
    ],
}

SCORED_METRICS = [metric for entries in FACTOR_METRICS.values() for metric, _, _ in entries]
# raw factors that carry no weight
UNSCORED_METRICS = ["cumulative_return", "free_cash_flow_to_net_income"]
SCORE_COLUMNS = list(FACTOR_METRICS)
# model features: all raw factors but the cumulative return
RAW_FEATURES = [*SCORED_METRICS, "free_cash_flow_to_net_income"]

# Pairs whose product / 100 is an extra feature.
INTERACTIONS = {
    "quality_value_interaction": ("quality_score", "value_score"),
    "growth_quality_interaction": ("growth_score", "quality_score"),
    "momentum_technical_interaction": ("momentum_score", "technical_score"),
    "financial_strength_quality_interaction": ("financial_strength_score", "quality_score"),
    "value_financial_strength_interaction": ("value_score", "financial_strength_score"),
    "growth_momentum_interaction": ("growth_score", "momentum_score"),
    "efficiency_quality_interaction": ("efficiency_score", "quality_score"),
    "risk_momentum_interaction": ("risk_score", "momentum_score"),
}
