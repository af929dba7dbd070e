"""Statements, ratios and factor scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog.prices import AS_OF, base, dates_sql
from plumbline.catalog.twin import SNAPSHOTS, cte, r, register
from plumbline.functions.factor_config import (
    FACTOR_METRICS,
    FACTOR_WEIGHTS,
    INTERACTIONS,
    SCORE_COLUMNS,
    SCORED_METRICS,
)
from plumbline.functions.scalars import rnd
from plumbline.operators import asof, factors, fundamentals, prices
from plumbline.operators.quantiles import exact_quantiles, melt
from plumbline.sources import testbed

FLOWS = fundamentals.FLOW_METRICS
BALANCES = fundamentals.BALANCE_METRICS
METRICS = fundamentals.METRICS
FUND_KEYS = ["as_of_date", "ticker", "fiscal_year", "fiscal_period", "period_end_date"]


def seen(spark, sf, by=testbed.SUPPLIER):
    return fundamentals.visible(testbed.statements(spark, sf, by), AS_OF)


def market_caps(spark, sf, by=testbed.SUPPLIER):
    rows = asof.latest_rows(testbed.bars(spark, sf, by), AS_OF)
    return rows.select("as_of_date", "ticker", prices.cap_at(rows).alias("market_cap"))


# columns of a bar that measures and labels read
MEASURED = ["ticker", "date", "close", "adjusted_close", "volume", "shares_outstanding"]


def stored_bars(spark, sf, by=testbed.SUPPLIER):
    """Bars, stored once: the panel, its benchmark and the labels would each add up the order lines again."""
    return SNAPSHOTS.get(spark, ("bars", sf, by), lambda: testbed.bars(spark, sf, by).select(*MEASURED))


def stored_statements(spark, sf, by=testbed.SUPPLIER):
    return SNAPSHOTS.get(spark, ("statements", sf, by), lambda: testbed.statements(spark, sf, by))


def raw(spark, sf, by=testbed.SUPPLIER, dates=AS_OF):
    """Raw factors, stored once: scoring reads them three times."""

    def build():
        return factors.raw_factors(
            stored_bars(spark, sf, by), stored_statements(spark, sf, by), dates, testbed.BENCHMARK
        )

    return SNAPSHOTS.get(spark, ("raw", sf, by, tuple(dates)), build)


# --- twins ---------------------------------------------------------------

RATIO_SQL = {
    "gross_margin": "gross_profit / NULLIF(revenue, 0)",
    "operating_margin": "operating_income / NULLIF(revenue, 0)",
    "ebitda_margin": "ebitda / NULLIF(revenue, 0)",
    "net_margin": "net_income / NULLIF(revenue, 0)",
    "free_cash_flow_margin": "free_cash_flow / NULLIF(revenue, 0)",
    "return_on_assets": "net_income / NULLIF(total_assets, 0)",
    "return_on_equity": "net_income / NULLIF(book_equity, 0)",
    "return_on_invested_capital": "operating_income / NULLIF(total_debt + book_equity, 0)",
    "debt_to_assets": "total_debt / NULLIF(total_assets, 0)",
    "debt_to_equity": "total_debt / NULLIF(book_equity, 0)",
    "net_debt_to_equity": "net_debt / NULLIF(book_equity, 0)",
    "liabilities_to_assets": "total_liabilities / NULLIF(total_assets, 0)",
    "cash_to_debt": "cash_and_equivalents / NULLIF(total_debt, 0)",
    "current_ratio": "current_assets / NULLIF(current_liabilities, 0)",
    "quick_ratio": "(current_assets - inventory) / NULLIF(current_liabilities, 0)",
    "asset_turnover": "revenue / NULLIF(total_assets, 0)",
    "r_and_d_intensity": "r_and_d_expense / NULLIF(revenue, 0)",
    "sga_intensity": "sga_expense / NULLIF(revenue, 0)",
    "capex_to_revenue": "ABS(capital_expenditures) / NULLIF(revenue, 0)",
    "operating_cash_flow_to_net_income": "operating_cash_flow / NULLIF(net_income, 0)",
    "free_cash_flow_to_net_income": "free_cash_flow / NULLIF(net_income, 0)",
    "dividend_payout_ratio": "ABS(dividends_paid) / NULLIF(net_income, 0)",
    "interest_coverage": "operating_income / NULLIF(interest_expense, 0)",
    "effective_tax_rate": "income_tax_expense / NULLIF(net_income + income_tax_expense, 0)",
    "basic_eps": "net_income / NULLIF(weighted_average_shares, 0)",
    "diluted_eps": "net_income / NULLIF(weighted_average_diluted_shares, 0)",
    "free_cash_flow_per_share": "free_cash_flow / NULLIF(weighted_average_diluted_shares, 0)",
    "earnings_yield": "net_income / NULLIF(market_cap, 0)",
    "free_cash_flow_yield": "free_cash_flow / NULLIF(market_cap, 0)",
    "sales_yield": "revenue / NULLIF(market_cap, 0)",
    "book_to_market": "book_equity / NULLIF(market_cap, 0)",
    "price_to_book": "market_cap / NULLIF(book_equity, 0)",
    "ev_to_sales": "enterprise_value / NULLIF(revenue, 0)",
    "ev_to_operating_income": "enterprise_value / NULLIF(operating_income, 0)",
    "ev_to_ebitda": "enterprise_value / NULLIF(ebitda, 0)",
    "ev_to_free_cash_flow": "enterprise_value / NULLIF(free_cash_flow, 0)",
}
MARKET = (
    "cumulative_return one_month_return three_month_return six_month_return one_year_return "
    "sharpe_ratio annualized_volatility max_drawdown beta_vs_spy"
).split()
TECHNICAL = ["price_vs_sma_50", "price_vs_sma_200", "sma_50_vs_sma_200", "macd_spread", "rsi_score", "volume_ratio"]
CAGRS = ["revenue_cagr", "net_income_cagr", "free_cash_flow_cagr"]
GROWTHS = ["revenue_growth", "net_income_growth", "free_cash_flow_growth"]


def score_sql(source: str, by: str = "as_of_date") -> str:
    """Robust scores, factor scores and overall score over `source`."""
    quantiles, scored, totals = [], [], []
    for metrics in FACTOR_METRICS.values():
        for m, _, higher in metrics:
            quantiles.append(
                f"COUNT({m}) AS {m}_n, MIN({m}) AS {m}_lo, MAX({m}) AS {m}_hi, "
                f"QUANTILE_CONT({m}, 0.05) AS {m}_q0, QUANTILE_CONT({m}, 0.95) AS {m}_q1"
            )
            value = f"(LEAST(GREATEST({m}, {m}_q0), {m}_q1) - {m}_q0) / ({m}_q1 - {m}_q0) * 100"
            if not higher:
                value = f"100 - {value}"
            scored.append(
                f"CASE WHEN {m}_n = 0 THEN NULL WHEN {m}_lo = {m}_hi OR {m}_q0 = {m}_q1 THEN 50.0 "
                f"WHEN {m} IS NOT NULL THEN LEAST(GREATEST({value}, 0), 100) END AS {m}_s"
            )
    for factor, metrics in FACTOR_METRICS.items():
        num = " + ".join(f"COALESCE({m}_s * {w}, 0)" for m, w, _ in metrics)
        den = " + ".join(f"CASE WHEN {m}_s IS NULL THEN 0 ELSE {w} END" for m, w, _ in metrics)
        totals.append(f"CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) AS {factor}")
    overall = " + ".join(f"COALESCE({f}, 0) * {w}" for f, w in FACTOR_WEIGHTS.items())
    return f"""SELECT *, CAST({overall} AS DOUBLE) AS overall_score FROM (
 SELECT *, {", ".join(totals)} FROM (
  SELECT w.*, {", ".join(scored)} FROM (
   SELECT x.*, b.* EXCLUDE (group_key) FROM {source} x JOIN (
     SELECT {by} AS group_key, {", ".join(quantiles)} FROM {source} GROUP BY {by}) b ON b.group_key = x.{by}) w) s) t"""


for p in ("", "brand_"):
    cte(
        f"{p}seen",
        f"SELECT d.as_of_date, s.* FROM {p}statements s JOIN as_of_dates d ON s.filed_date <= d.as_of_date",
        f"{p}statements",
        "as_of_dates",
    )
    cte(
        f"{p}last_periods",
        f"""SELECT * FROM {p}seen WHERE fiscal_period IN ('Q1', 'Q2', 'Q3', 'FY')
QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker, fiscal_year, fiscal_period
                           ORDER BY period_end_date DESC, filed_date DESC) = 1""",
        f"{p}seen",
    )
    q4 = ", ".join(
        [f"f.{m} - (q1.{m} + q2.{m} + q3.{m}) AS {m}" for m in FLOWS] + [f"f.{m} AS {m}" for m in BALANCES]
    )
    joins = " ".join(
        f"LEFT JOIN {p}last_periods {a} ON {a}.as_of_date = f.as_of_date AND {a}.ticker = f.ticker "
        f"AND {a}.fiscal_year = f.fiscal_year AND {a}.fiscal_period = '{a.upper()}'"
        for a in ("q1", "q2", "q3")
    )
    cte(
        f"{p}q4",
        f"""SELECT f.as_of_date, f.ticker, f.fiscal_year, 'Q4' AS fiscal_period, f.period_end_date, f.filed_date, {q4}
FROM {p}last_periods f {joins} WHERE f.fiscal_period = 'FY'""",
        f"{p}last_periods",
    )
    columns = ", ".join([*FUND_KEYS, "filed_date", *METRICS])
    cte(
        f"{p}quarterly",
        f"SELECT {columns} FROM {p}last_periods WHERE fiscal_period <> 'FY' UNION ALL SELECT {columns} FROM {p}q4",
        f"{p}last_periods",
        f"{p}q4",
    )
    growth = ", ".join(
        f"({m} - LAG({m}) OVER w) / NULLIF(ABS(LAG({m}) OVER w), 0) AS {m}_growth"
        for m in ("revenue", "net_income", "free_cash_flow")
    )
    cte(
        f"{p}ratios",
        f"""SELECT *, {", ".join(f"{e} AS {n}" for n, e in RATIO_SQL.items())} FROM (
 SELECT *, total_debt + book_equity AS invested_capital FROM (
  SELECT q.*, {growth}, m.market_cap, total_assets - total_liabilities AS book_equity,
    total_debt - cash_and_equivalents AS net_debt, operating_income + depreciation_and_amortization AS ebitda,
    market_cap + total_debt - cash_and_equivalents AS enterprise_value
  FROM {p}quarterly q LEFT JOIN (SELECT as_of_date, ticker, adjusted_close * shares_outstanding AS market_cap
     FROM {p}market_asof) m USING (as_of_date, ticker)
  WINDOW w AS (PARTITION BY q.as_of_date, q.ticker ORDER BY period_end_date, fiscal_period)) a) b""",
        f"{p}quarterly",
        f"{p}market_asof",
    )
    cagrs = ", ".join(
        f"CASE WHEN first.{m} > 0 AND n > 1 AND last.{m} >= 0 THEN POWER(last.{m} / first.{m}, 1.0 / (n - 1)) - 1 END AS {m}_cagr"
        for m in ("revenue", "net_income", "free_cash_flow")
    )
    cte(
        f"{p}cagr",
        f"""SELECT as_of_date, ticker, n AS periods_used, {cagrs} FROM (
SELECT as_of_date, ticker, COUNT(*) AS n,
  ARG_MIN({{'revenue': revenue, 'net_income': net_income, 'free_cash_flow': free_cash_flow}}, period_end_date) AS first,
  ARG_MAX({{'revenue': revenue, 'net_income': net_income, 'free_cash_flow': free_cash_flow}}, period_end_date) AS last
FROM {p}seen WHERE fiscal_period = 'FY' GROUP BY as_of_date, ticker) g""",
        f"{p}seen",
    )
    cte(
        f"{p}summary",
        f"""SELECT l.*, {", ".join(f"c.{x}" for x in CAGRS)}, COALESCE(c.periods_used, 0) AS periods_used
FROM (SELECT * FROM {p}ratios QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker
      ORDER BY period_end_date DESC, fiscal_period DESC) = 1) l
LEFT JOIN {p}cagr c ON c.as_of_date = l.as_of_date AND c.ticker = l.ticker""",
        f"{p}ratios",
        f"{p}cagr",
    )
    rest = ", ".join(
        f"s.{m}" for m in factors.RAW_COLUMNS if m not in MARKET and m not in TECHNICAL
    )
    cte(
        f"{p}raw",
        f"""SELECT m.as_of_date, m.ticker, m.return_count, m.adjusted_close * m.shares_outstanding AS market_cap,
  {", ".join(f"m.{c}" for c in MARKET)},
  t.price / NULLIF(t.sma_50, 0) - 1 AS price_vs_sma_50, t.price / NULLIF(t.sma_200, 0) - 1 AS price_vs_sma_200,
  t.sma_50 / NULLIF(t.sma_200, 0) - 1 AS sma_50_vs_sma_200,
  (t.macd - t.macd_signal) / NULLIF(t.price, 0) AS macd_spread,
  CASE WHEN t.rsi_14 IS NULL THEN NULL WHEN t.rsi_14 BETWEEN 50 AND 70 THEN 100.0
       WHEN t.rsi_14 >= 40 AND t.rsi_14 < 50 THEN 70.0 WHEN t.rsi_14 > 70 AND t.rsi_14 <= 80 THEN 60.0
       WHEN t.rsi_14 >= 30 AND t.rsi_14 < 40 THEN 40.0 ELSE 10.0 END AS rsi_score,
  t.volume_ratio, {rest}
FROM {p}market_asof m JOIN {p}technicals_asof t ON t.as_of_date = m.as_of_date AND t.ticker = m.ticker
LEFT JOIN {p}summary s ON s.as_of_date = m.as_of_date AND s.ticker = m.ticker
WHERE m.ticker <> 'Index#0'""",
        f"{p}market_asof",
        f"{p}technicals_asof",
        f"{p}summary",
    )
    cte(f"{p}scored", score_sql(f"{p}raw"), f"{p}raw")
    cte(
        f"{p}screen",
        f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC NULLS LAST, MD5(ticker), ticker) AS universe_rank
FROM {p}scored""",
        f"{p}scored",
    )

# --- queries -------------------------------------------------------------


def simple(name, build, keys, columns, source, *ctes):
    """columns: name -> digits; the twin reads the same names `FROM source`."""

    def query(spark, sf):
        return build(spark, sf).select(*keys, *[rnd(c, d).alias(c) for c, d in columns.items()])

    items = ", ".join([*keys, *[r(c, d, c) for c, d in columns.items()]])
    register(name, query, f"SELECT {items} FROM {source}", *(ctes or (source,)))


MONEY = {m: 2 for m in METRICS}
RATIOS = {c: 5 for c in fundamentals.RATIO_COLUMNS}
KEY = ["as_of_date", "ticker"]
LAST_BY_PERIOD = """QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker
    ORDER BY period_end_date DESC, fiscal_period DESC) = 1"""


def quarterly(spark, sf):
    return fundamentals.quarterly(seen(spark, sf))


def all_ratios(spark, sf):
    return fundamentals.ratios(quarterly(spark, sf), market_caps(spark, sf))


def summary(spark, sf):
    return fundamentals.summary(testbed.statements(spark, sf), market_caps(spark, sf), AS_OF)


def scored(spark, sf):
    return factors.score(raw(spark, sf))


def stored_scores(spark, sf):
    return SNAPSHOTS.get(spark, ("scored", sf), lambda: scored(spark, sf))


simple("q_pit_financials", seen, FUND_KEYS, MONEY, "seen")
simple(
    "j_asof_fundamental",
    lambda s, d: fundamentals.latest_period(seen(s, d)),
    FUND_KEYS,
    MONEY,
    f"seen {LAST_BY_PERIOD}",
    "seen",
)
simple("n_annual", lambda s, d: fundamentals.annual(seen(s, d)), FUND_KEYS, MONEY,
       "seen WHERE fiscal_period = 'FY'", "seen")
simple("n_infer_q4", lambda s, d: fundamentals.inferred_q4(seen(s, d)), FUND_KEYS, MONEY, "q4")
simple("n_quarterly", quarterly, FUND_KEYS, MONEY, "quarterly")
simple(
    "w_last_per_key",
    lambda s, d: fundamentals.quarterly(seen(s, d)).filter("fiscal_period <> 'Q4'"),
    FUND_KEYS,
    MONEY,
    "last_periods WHERE fiscal_period <> 'FY'",
    "last_periods",
)


def _modes(spark, sf):
    rows = seen(spark, sf)
    out = None
    for mode in ("quarterly", "annual", "raw"):
        part = (
            fundamentals.by_mode(rows, mode)
            .groupBy(*KEY)
            .agg(F.count("*").alias("periods"), rnd(F.sum("revenue"), 1).alias("revenue"))
            .withColumn("period_mode", F.lit(mode))
        )
        out = part if out is None else out.unionByName(part)
    return out


register(
    "n_period_mode",
    _modes,
    " UNION ALL ".join(
        f"SELECT as_of_date, ticker, COUNT(*) AS periods, {r('SUM(revenue)', 1, 'revenue')}, '{mode}' AS period_mode FROM {source} GROUP BY as_of_date, ticker"
        for mode, source in (
            ("quarterly", "quarterly"),
            ("annual", "(SELECT * FROM seen WHERE fiscal_period = 'FY') a"),
            ("raw", "seen"),
        )
    ),
    "quarterly",
    "seen",
)
simple("n_market_cap", market_caps, KEY, {"market_cap": 1},
       "(SELECT *, adjusted_close * shares_outstanding AS market_cap FROM market_asof) m", "market_asof")
simple("n_ratios", all_ratios, FUND_KEYS, RATIOS, "ratios")
simple("n_safe_divide", all_ratios, FUND_KEYS, {"return_on_equity": 5, "cash_to_debt": 5, "interest_coverage": 5}, "ratios")
simple("n_growth", all_ratios, FUND_KEYS, {c: 5 for c in GROWTHS}, "ratios")
simple("n_cagr", lambda s, d: fundamentals.annual_growth(seen(s, d)), [*KEY, "periods_used"], {c: 6 for c in CAGRS}, "cagr")


def _prev_period(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy(*KEY).orderBy("period_end_date", "fiscal_period")
    return quarterly(spark, sf).select(
        *FUND_KEYS,
        *[rnd(F.lag(m).over(w), 2).alias(f"previous_{m}") for m in ("revenue", "net_income", "free_cash_flow")],
    )


register(
    "w_prev_period",
    _prev_period,
    f"SELECT {', '.join(FUND_KEYS)}, "
    + ", ".join(r(f"LAG({m}) OVER w", 2, f"previous_{m}") for m in ("revenue", "net_income", "free_cash_flow"))
    + " FROM quarterly WINDOW w AS (PARTITION BY as_of_date, ticker ORDER BY period_end_date, fiscal_period)",
    "quarterly",
)


def _first_last(spark, sf):
    return (
        fundamentals.annual(seen(spark, sf))
        .groupBy(*KEY)
        .agg(
            F.min_by("revenue", "period_end_date").alias("first_revenue"),
            F.max_by("revenue", "period_end_date").alias("last_revenue"),
            F.count("*").alias("periods"),
        )
    )


register(
    "w_first_last_annual",
    _first_last,
    """SELECT as_of_date, ticker, ARG_MIN(revenue, period_end_date) AS first_revenue,
ARG_MAX(revenue, period_end_date) AS last_revenue, COUNT(*) AS periods
FROM seen WHERE fiscal_period = 'FY' GROUP BY as_of_date, ticker""",
    "seen",
)
simple("n_summary", summary, [*FUND_KEYS, "periods_used"], {**RATIOS, **{c: 5 for c in CAGRS}}, "summary")
simple("q_fin_history",
       lambda s, d: factors.top_k(quarterly(s, d), KEY, [F.desc("period_end_date"), F.desc("fiscal_period")], 12),
       FUND_KEYS, {"revenue": 2, "net_income": 2},
       """quarterly QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker
          ORDER BY period_end_date DESC, fiscal_period DESC) <= 12""", "quarterly")

simple("c_factor_raw", raw, [*KEY, "return_count"], {c: 5 for c in factors.RAW_COLUMNS}, "raw")
simple("c_tech_ratios", raw, KEY, {c: 5 for c in TECHNICAL[:4]}, "raw")
simple("c_rsi_score", raw, KEY, {"rsi_score": 1}, "raw")


def _robust(spark, sf):
    return factors.metric_scores(raw(spark, sf)).select(
        *KEY, *[F.col("metric_scores")[i].alias(m) for i, m in enumerate(SCORED_METRICS)]
    )


register(
    "c_robust_score",
    lambda s, d: _robust(s, d).select(*KEY, *[rnd(m, 3).alias(m) for m in SCORED_METRICS]),
    "SELECT as_of_date, ticker, " + ", ".join(r(f"{m}_s", 3, m) for m in SCORED_METRICS) + " FROM scored",
    "scored",
)
simple("c_weighted_factor", scored, KEY, {c: 3 for c in SCORE_COLUMNS}, "scored")
simple("c_overall", scored, KEY, {"overall_score": 4}, "scored")


def _config(spark, sf):
    """Which weights apply where: available weight per factor and date."""
    rows = factors.metric_scores(raw(spark, sf))
    parts = []
    for factor, metrics in FACTOR_METRICS.items():
        weight = sum(
            (
                F.when(F.col("metric_scores")[SCORED_METRICS.index(m)].isNotNull(), w).otherwise(0.0)
                for m, w, _ in metrics
            ),
            F.lit(0.0),
        )
        parts.append(
            F.struct(
                F.lit(factor).alias("factor"),
                F.lit(FACTOR_WEIGHTS[factor]).alias("overall_weight"),
                weight.alias("weight"),
            )
        )
    return (
        rows.select("as_of_date", F.explode(F.array(*parts)).alias("p"))
        .groupBy("as_of_date", "p.factor", "p.overall_weight")
        .agg(rnd(F.avg("p.weight"), 4).alias("available_weight"), F.count("*").alias("tickers"))
    )


register(
    "c_factor_config",
    _config,
    " UNION ALL ".join(
        "SELECT as_of_date, '{f}' AS factor, CAST({w} AS DOUBLE) AS overall_weight, COUNT(*) AS tickers, {avg} FROM scored GROUP BY as_of_date".format(
            f=factor,
            w=FACTOR_WEIGHTS[factor],
            avg=r("AVG(CAST(" + " + ".join(f"CASE WHEN {m}_s IS NULL THEN 0 ELSE {w} END" for m, w, _ in metrics) + " AS DOUBLE))", 4, "available_weight"),
        )
        for factor, metrics in FACTOR_METRICS.items()
    ),
    "scored",
)

simple("c_rank", lambda s, d: factors.rank_universe(scored(s, d)), [*KEY, "universe_rank"], {"overall_score": 4}, "screen")
simple("w_rank_universe", lambda s, d: factors.rank_universe(scored(s, d)), [*KEY, "universe_rank"], {c: 3 for c in SCORE_COLUMNS}, "screen")
simple("t_top_screen", lambda s, d: factors.best(scored(s, d), 100, name="universe_rank"), [*KEY, "universe_rank"], {"overall_score": 4},
       "screen WHERE universe_rank <= 100", "screen")

SCREEN_N, FINAL_N = 40, 10
cte("top_screen", f"SELECT * FROM screen WHERE universe_rank <= {SCREEN_N}", "screen")
cte(
    "inner_raw",
    "SELECT as_of_date, ticker, return_count, market_cap, " + ", ".join(factors.RAW_COLUMNS) + " FROM top_screen",
    "top_screen",
)
cte("inner_scored", score_sql("inner_raw"), "inner_raw")
cte(
    "inner_ranked",
    """SELECT i.*, t.universe_rank, t.overall_score AS universe_score,
ROW_NUMBER() OVER (PARTITION BY i.as_of_date ORDER BY i.overall_score DESC NULLS LAST, MD5(i.ticker), i.ticker) AS screen_rank
FROM inner_scored i JOIN top_screen t USING (as_of_date, ticker)""",
    "inner_scored",
    "top_screen",
)
cte("final_selection", f"SELECT * FROM inner_ranked WHERE screen_rank <= {FINAL_N}", "inner_ranked")


def selection(spark, sf, screen_n=SCREEN_N, final_n=FINAL_N):
    return SNAPSHOTS.get(
        spark, ("selection", sf, screen_n, final_n), lambda: factors.two_stage(raw(spark, sf), screen_n, final_n)
    )


simple("c_two_stage", selection, [*KEY, "universe_rank", "screen_rank"], {"overall_score": 4, "universe_score": 4}, "final_selection")
simple("w_rank_screen", lambda s, d: selection(s, d, SCREEN_N, SCREEN_N), [*KEY, "screen_rank"], {"overall_score": 4}, "inner_ranked")
simple("j_rank_lookup", lambda s, d: selection(s, d, SCREEN_N, SCREEN_N), [*KEY, "screen_rank", "universe_rank"], {"universe_score": 4}, "inner_ranked")
simple("t_top_final", selection, [*KEY, "screen_rank"], {c: 3 for c in SCORE_COLUMNS}, "final_selection")
simple("c_interactions", lambda s, d: factors.with_interactions(scored(s, d)), KEY, {c: 3 for c in INTERACTIONS},
       "(SELECT *, " + ", ".join(f"{a} * {b} / 100.0 AS {n}" for n, (a, b) in INTERACTIONS.items()) + " FROM scored) x", "scored")
SNAPSHOT = {**{c: 3 for c in SCORE_COLUMNS}, "overall_score": 4, **{c: 3 for c in INTERACTIONS}}
_SNAP_SQL = "(SELECT *, " + ", ".join(f"{a} * {b} / 100.0 AS {n}" for n, (a, b) in INTERACTIONS.items()) + " FROM scored) x"


def snapshot_panel(spark, sf, dates=AS_OF):
    return factors.with_interactions(factors.score(raw(spark, sf, dates=dates)))


simple("c_snapshots", snapshot_panel, KEY, SNAPSHOT, _SNAP_SQL, "scored")
simple("c_snapshot", lambda s, d: snapshot_panel(s, d, AS_OF[-1:]), KEY, SNAPSHOT,
       _SNAP_SQL + f" WHERE as_of_date = DATE '{AS_OF[-1]}'", "scored")

PEERS = [f"S#{i:09d}" for i in range(1, 8)]
cte("peer_raw", "SELECT * FROM raw WHERE ticker IN (" + ", ".join(f"'{t}'" for t in PEERS) + ")", "raw")
cte("peer_scored", score_sql("peer_raw"), "peer_raw")
simple("c_peer_profile", lambda s, d: factors.peer_profile(raw(s, d), PEERS[0], PEERS[1:]), KEY,
       {**{c: 3 for c in SCORE_COLUMNS}, "overall_score": 4}, f"peer_scored WHERE ticker = '{PEERS[0]}'", "peer_scored")


QUANTILE_COLUMNS = ["daily_return", "one_month_return", "volume"]
PROBABILITIES = [0.01, 0.05, 0.5, 0.95, 0.99]


def _quantiles(spark, sf):
    rows = prices.with_period_returns(base(spark, sf)).withColumn("year", F.year("date").cast("long"))
    out = exact_quantiles(melt(rows, ["year"], QUANTILE_COLUMNS), ["year", "metric"], PROBABILITIES)
    names = F.array(*[F.lit(c) for c in QUANTILE_COLUMNS])
    return out.select(
        "year", names[F.col("metric")].alias("metric"), "n",
        *[rnd(f"q{j}", 6).alias(f"q{j}") for j in range(5)],
    )


register(
    "a_quantile",
    _quantiles,
    " UNION ALL ".join(
        f"SELECT CAST(YEAR(date) AS BIGINT) AS year, '{c}' AS metric, COUNT({c}) AS n, "
        + ", ".join(r(f"QUANTILE_CONT({c}, {p})", 6, f"q{j}") for j, p in enumerate(PROBABILITIES))
        + " FROM risk GROUP BY 1"
        for c in QUANTILE_COLUMNS
    ),
    "risk",
)


def _distinct_one(spark, sf):
    """Metrics with one distinct value at a date: min = max, no distinct count."""
    rows = raw(spark, sf)
    out = None
    for m in ("rsi_score", "debt_to_assets", "r_and_d_intensity", "one_year_return"):
        part = rows.groupBy("as_of_date").agg(
            F.coalesce(F.min(m) == F.max(m), F.lit(False)).alias("single_value"),
            F.count(m).alias("present"),
        ).withColumn("metric", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


register(
    "a_nunique",
    _distinct_one,
    " UNION ALL ".join(
        f"SELECT as_of_date, COUNT(DISTINCT {m}) = 1 AS single_value, COUNT({m}) AS present, '{m}' AS metric FROM raw GROUP BY as_of_date"
        for m in ("rsi_score", "debt_to_assets", "r_and_d_intensity", "one_year_return")
    ),
    "raw",
)
