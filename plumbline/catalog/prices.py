"""Price measures: returns, risk, technicals and their as-of selection."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.twin import cte, r, register
from plumbline.functions.scalars import rnd
from plumbline.operators import asof, prices
from plumbline.operators.ranking import keep_last, ranked
from plumbline.sources import testbed

AS_OF = [date(1999, 6, 30), date(1999, 12, 31), date(2000, 6, 30), date(2000, 12, 31)]


def dates_sql(dates) -> str:
    return "SELECT UNNEST([" + ", ".join(f"DATE '{d}'" for d in dates) + "]) AS as_of_date"


def base(spark: SparkSession, sf: str) -> DataFrame:
    return prices.with_returns(testbed.bars(spark, sf))


def panel(spark: SparkSession, sf: str, by: str = testbed.SUPPLIER) -> DataFrame:
    return prices.price_panel(testbed.bars(spark, sf, by), testbed.BENCHMARK)


# --- twins ---------------------------------------------------------------

cte("as_of_dates", dates_sql(AS_OF))


def _ema(source: str, column: str, span: int) -> str:
    a = 2.0 / (span + 1.0)
    q = 1.0 - a
    return f"""SELECT t.ticker, t.rn,
       SUM(CASE WHEN i.rn = 0 THEN i.{column} ELSE {a!r} * i.{column} END
           * POWER({q!r}, t.rn - i.rn)) AS value
FROM {source} t JOIN {source} i ON i.ticker = t.ticker AND i.rn <= t.rn
GROUP BY t.ticker, t.rn"""


for p in ("", "brand_"):
    bars = f"{p}bars"
    cte(
        f"{p}returns",
        f"""SELECT *, price / NULLIF(LAG(price) OVER w, 0) - 1 AS daily_return FROM (
  SELECT *, COALESCE(adjusted_close, close) AS price,
         ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date) - 1 AS rn FROM {bars}) b
WINDOW w AS (PARTITION BY ticker ORDER BY date)""",
        bars,
    )
    cte(
        f"{p}risk",
        f"""SELECT *, MIN(drawdown) OVER w AS max_drawdown FROM (
  SELECT *, (price - peak) / NULLIF(peak, 0) AS drawdown,
    CASE WHEN ROUND(dev, 12) <> 0 THEN avg_return / dev * SQRT(252) END AS sharpe_ratio,
    CASE WHEN bench_var > 1e-18 THEN bench_cov / bench_var END AS beta_vs_spy
  FROM (
   SELECT b.*, dev * SQRT(252) AS annualized_volatility FROM (
    SELECT x.*, MAX(price) OVER w AS peak, STDDEV_SAMP(daily_return) OVER w AS dev,
      AVG(daily_return) OVER w AS avg_return, COUNT(daily_return) OVER w AS return_count,
      CASE WHEN rn >= 1 THEN price / NULLIF(FIRST_VALUE(price) OVER w, 0) - 1 END AS cumulative_return,
      price / NULLIF(LAG(price, 21) OVER w, 0) - 1 AS one_month_return,
      price / NULLIF(LAG(price, 63) OVER w, 0) - 1 AS three_month_return,
      price / NULLIF(LAG(price, 126) OVER w, 0) - 1 AS six_month_return,
      price / NULLIF(LAG(price, 252) OVER w, 0) - 1 AS one_year_return,
      VAR_SAMP(CASE WHEN daily_return IS NOT NULL THEN bench END) OVER w AS bench_var,
      COVAR_SAMP(daily_return, bench) OVER w AS bench_cov
    FROM (SELECT s.*, i.daily_return AS bench FROM {p}returns s
          LEFT JOIN {p}returns i ON i.ticker = 'Index#0' AND i.date = s.date) x
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) b) c) d
WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        f"{p}returns",
    )
    cte(f"{p}ema12", _ema(f"{p}returns", "price", 12), f"{p}returns")
    cte(f"{p}ema26", _ema(f"{p}returns", "price", 26), f"{p}returns")
    cte(
        f"{p}macd",
        f"SELECT a.ticker, a.rn, a.value AS ema_12, b.value AS ema_26, a.value - b.value AS macd "
        f"FROM {p}ema12 a JOIN {p}ema26 b ON a.ticker = b.ticker AND a.rn = b.rn",
        f"{p}ema12",
        f"{p}ema26",
    )
    cte(f"{p}ema9", _ema(f"{p}macd", "macd", 9), f"{p}macd")
    cte(
        f"{p}rolling",
        f"""SELECT *, CASE WHEN gain_n = 14 AND loss_avg = 0 AND gain_avg > 0 THEN 100.0
       WHEN gain_n = 14 THEN 100 - 100 / NULLIF(1 + gain_avg / NULLIF(loss_avg, 0), 0) END AS rsi_14,
       sma_20 AS bollinger_middle_20, sma_20 + 2 * dev_20 AS bollinger_upper_20,
       sma_20 - 2 * dev_20 AS bollinger_lower_20, volume / NULLIF(volume_sma_20, 0) AS volume_ratio
FROM (SELECT ticker, date, rn, price, volume,
  CASE WHEN COUNT(price) OVER w20 = 20 THEN AVG(price) OVER w20 END AS sma_20,
  CASE WHEN COUNT(price) OVER w50 = 50 THEN AVG(price) OVER w50 END AS sma_50,
  CASE WHEN COUNT(price) OVER w200 = 200 THEN AVG(price) OVER w200 END AS sma_200,
  CASE WHEN COUNT(volume) OVER w20 = 20 THEN AVG(volume) OVER w20 END AS volume_sma_20,
  CASE WHEN COUNT(price) OVER w20 = 20 THEN STDDEV_SAMP(price) OVER w20 END AS dev_20,
  COUNT(delta) OVER w14 AS gain_n,
  AVG(CASE WHEN delta IS NOT NULL THEN GREATEST(delta, 0.0) END) OVER w14 AS gain_avg,
  AVG(CASE WHEN delta IS NOT NULL THEN GREATEST(-delta, 0.0) END) OVER w14 AS loss_avg
 FROM (SELECT *, price - LAG(price) OVER (PARTITION BY ticker ORDER BY date) AS delta FROM {p}returns) z
 WINDOW w14 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
        w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
        w50 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
        w200 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)) y""",
        f"{p}returns",
    )
    cte(
        f"{p}technicals",
        f"""SELECT r.*, m.ema_12, m.ema_26, m.macd, s.value AS macd_signal, m.macd - s.value AS macd_histogram
FROM {p}rolling r JOIN {p}macd m ON m.ticker = r.ticker AND m.rn = r.rn
JOIN {p}ema9 s ON s.ticker = r.ticker AND s.rn = r.rn""",
        f"{p}rolling",
        f"{p}macd",
        f"{p}ema9",
    )
    cte(
        f"{p}market_asof",
        f"""SELECT d.as_of_date, p.* FROM {p}risk p JOIN as_of_dates d ON p.date <= d.as_of_date
QUALIFY ROW_NUMBER() OVER (PARTITION BY d.as_of_date, p.ticker ORDER BY p.date DESC) = 1""",
        f"{p}risk",
        "as_of_dates",
    )
    cte(
        f"{p}technicals_asof",
        f"""SELECT d.as_of_date, p.* FROM {p}technicals p JOIN as_of_dates d ON p.date <= d.as_of_date
QUALIFY ROW_NUMBER() OVER (PARTITION BY d.as_of_date, p.ticker ORDER BY p.date DESC) = 1""",
        f"{p}technicals",
        "as_of_dates",
    )


# --- one query per measure -----------------------------------------------


def measure(name: str, build, columns: dict[str, int], source: str) -> None:
    def query(spark, sf):
        return build(spark, sf).select(
            "ticker", "date", *[rnd(c, d).alias(c) for c, d in columns.items()]
        )

    items = ", ".join(r(c, d, c) for c, d in columns.items())
    register(name, query, f"SELECT ticker, date, {items} FROM {source}", source)


measure("w_price", lambda s, d: prices.with_price(testbed.bars(s, d)), {"price": 4}, "returns")
measure("w_daily_return", base, {"daily_return": 6}, "returns")
measure(
    "w_period_return",
    lambda s, d: prices.with_period_returns(base(s, d)),
    {name: 6 for name in prices.PERIODS},
    "risk",
)


def _risk(spark, sf):
    return prices.with_risk(base(spark, sf))


def _beta(spark, sf):
    all_bars = testbed.bars(spark, sf)
    return prices.with_beta(
        prices.with_returns(all_bars), prices.benchmark_returns(all_bars, testbed.BENCHMARK)
    )


def _tech(spark, sf):
    return prices.with_technicals(base(spark, sf))


measure("a_cum_return", _risk, {"cumulative_return": 6}, "risk")
measure("a_ann_vol", _risk, {"annualized_volatility": 6}, "risk")
measure("a_max_drawdown", _risk, {"max_drawdown": 6}, "risk")
measure("a_sharpe", _risk, {"sharpe_ratio": 6}, "risk")
measure("a_beta", _beta, {"beta_vs_spy": 6}, "risk")
measure("w_sma", _tech, {"sma_20": 4, "sma_50": 4, "sma_200": 4}, "rolling")
measure("w_ema", _tech, {"ema_12": 4, "ema_26": 4}, "technicals")
measure("w_rsi", _tech, {"rsi_14": 4}, "rolling")
measure("w_macd", _tech, {"macd": 4, "macd_signal": 4, "macd_histogram": 4}, "technicals")
measure(
    "w_bollinger",
    _tech,
    {"bollinger_middle_20": 4, "bollinger_upper_20": 4, "bollinger_lower_20": 4},
    "rolling",
)
measure("w_volume_sma", _tech, {"volume_sma_20": 4}, "rolling")

TECH_COLUMNS = {
    c: 4
    for c in (
        "price sma_20 sma_50 sma_200 ema_12 ema_26 rsi_14 macd macd_signal macd_histogram "
        "bollinger_middle_20 bollinger_upper_20 bollinger_lower_20 volume_sma_20 volume_ratio"
    ).split()
}
measure("w_tech_panel", _tech, TECH_COLUMNS, "technicals")


def _tech_latest(spark, sf):
    rows = asof.latest_rows(_tech(spark, sf), AS_OF)
    return rows.select(
        "as_of_date", "ticker", "date", *[rnd(c, d).alias(c) for c, d in TECH_COLUMNS.items()]
    )


register(
    "w_tech_latest",
    _tech_latest,
    "SELECT as_of_date, ticker, date, "
    + ", ".join(r(c, d, c) for c, d in TECH_COLUMNS.items())
    + " FROM technicals_asof",
    "technicals_asof",
)

MARKET_COLUMNS = {
    c: 5
    for c in (
        "cumulative_return one_month_return three_month_return six_month_return one_year_return "
        "annualized_volatility max_drawdown sharpe_ratio beta_vs_spy"
    ).split()
}


def market_summary(spark, sf, dates=AS_OF):
    return asof.latest_rows(panel(spark, sf), dates)


def _asof_price(spark, sf):
    return market_summary(spark, sf).select(
        "as_of_date", "ticker", "date", *[rnd(c, d).alias(c) for c, d in MARKET_COLUMNS.items()]
    )


register(
    "j_asof_price",
    _asof_price,
    "SELECT as_of_date, ticker, date, "
    + ", ".join(r(c, d, c) for c, d in MARKET_COLUMNS.items())
    + " FROM market_asof",
    "market_asof",
)


def _benchmark(spark, sf):
    all_bars = testbed.bars(spark, sf)
    bench = prices.benchmark_returns(all_bars, testbed.BENCHMARK)
    return (
        prices.with_returns(all_bars)
        .join(F.broadcast(bench), "date")
        .dropna(subset=["daily_return", "benchmark_return"])
        .select(
            "ticker",
            "date",
            rnd("daily_return", 6).alias("stock_return"),
            rnd("benchmark_return", 6).alias("benchmark_return"),
        )
    )


register(
    "j_benchmark",
    _benchmark,
    f"""SELECT ticker, date, {r('daily_return', 6, 'stock_return')}, {r('index_return', 6, 'benchmark_return')}
FROM (SELECT *, MAX(CASE WHEN ticker = 'Index#0' THEN daily_return END) OVER (PARTITION BY date) AS index_return FROM returns) x
WHERE daily_return IS NOT NULL AND index_return IS NOT NULL""",
    "returns",
)


def _min_history(spark, sf, rows: int = 252):
    summary = asof.latest_rows(prices.with_risk(base(spark, sf)), AS_OF)
    return summary.filter(F.col("return_count") >= rows).select(
        "as_of_date", "ticker", "return_count"
    )


register(
    "q_min_history",
    _min_history,
    "SELECT as_of_date, ticker, return_count FROM market_asof WHERE return_count >= 252",
    "market_asof",
)


def momentum_leaders(spark, sf):
    """Rank tickers by one-year return at each research date."""
    rows = market_summary(spark, sf).filter(
        F.col("one_year_return").isNotNull() & (F.col("ticker") != testbed.BENCHMARK)
    )
    placed = ranked(rows, ["as_of_date"], "one_year_return", "ticker", "momentum_rank")
    return placed.select(
        "as_of_date",
        "ticker",
        "momentum_rank",
        rnd("one_year_return", 6).alias("one_year_return"),
        rnd("annualized_volatility", 6).alias("annualized_volatility"),
        rnd("max_drawdown", 6).alias("max_drawdown"),
    )


register(
    "momentum_leaders",
    momentum_leaders,
    f"""SELECT as_of_date, ticker,
ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY one_year_return DESC, MD5(ticker), ticker) AS momentum_rank,
{r('one_year_return', 6, 'one_year_return')}, {r('annualized_volatility', 6, 'annualized_volatility')}, {r('max_drawdown', 6, 'max_drawdown')}
FROM market_asof WHERE one_year_return IS NOT NULL AND ticker <> 'Index#0'""",
    "market_asof",
)

register("w_dedup_keep_last",
         lambda s, d: keep_last(base(s, d).select("ticker", "date", "price"), ["ticker"], ["date"]).select("ticker", "date", rnd("price", 4).alias("price")),
         f"SELECT ticker, date, {r('COALESCE(adjusted_close, close)', 4, 'price')} FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", "bars")
