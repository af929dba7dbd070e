"""Calendars, labels, covariance, portfolios and backtests."""

from __future__ import annotations

import uuid
from dataclasses import replace
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog import factors as cf
from plumbline.catalog.prices import AS_OF, base
from plumbline.catalog.twin import SNAPSHOTS, cte, r, register
from plumbline.functions.factor_config import SCORE_COLUMNS
from plumbline.functions.scalars import rnd
from plumbline.operators import asof, backtest, calendars, covariance, factors, labels, portfolio, prices
from plumbline.plans.research import ResearchConfig, expected_returns, run
from plumbline.sources import tables, testbed
from plumbline.sources.stored import shared_folder

END = date(2001, 6, 30)
WINDOWS = calendars.holding_windows(AS_OF, END)
N, CAP, MIN_ROWS = 4, 0.40, 10
KEY = ["as_of_date", "ticker"]


def rounded(keys, columns):
    return [*keys, *[rnd(c, d).alias(c) for c, d in columns.items()]]


def rounded_sql(keys, columns):
    return ", ".join([*keys, *[r(c, d, c) for c, d in columns.items()]])


def add(name, build, keys, columns, source, *ctes, logs=None):
    """`logs`: columns of unbounded size, reported as sign(x) * ln(1 + |x|)."""
    logs = logs or {}

    def query(s, d):
        scaled = [
            rnd(F.signum(c) * F.log1p(F.abs(c)), n).alias(f"log_{c}") for c, n in logs.items()
        ]
        return build(s, d).select(*rounded(keys, columns), *scaled)

    items = [rounded_sql(keys, columns), *[r(f"SIGN({c}) * LN(1 + ABS({c}))", n, f"log_{c}") for c, n in logs.items()]]
    register(name, query, f"SELECT {', '.join(i for i in items if i)} FROM {source}", *(ctes or (source,)))


# --- calendars -----------------------------------------------------------

cte("spans", "SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date FROM bars GROUP BY ticker", "bars")


def _spans(s, d):
    return testbed.bars(s, d).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


register("l_rebalance_windows", lambda s, d: calendars.window_rows(_spans(s, d), "first_date", "last_date").select("ticker", "start_date", "end_date"),
         """SELECT ticker, start_date, LEAST(CAST(start_date + INTERVAL 3 MONTH AS DATE) - 1, last_date) AS end_date FROM (
SELECT ticker, last_date, CAST(UNNEST(GENERATE_SERIES(CASE WHEN DAY(first_date) = 1 THEN first_date ELSE CAST(DATE_TRUNC('month', first_date) + INTERVAL 1 MONTH AS DATE) END, last_date, INTERVAL 3 MONTH)) AS DATE) AS start_date FROM spans) x""", "spans")
register("l_training_dates", lambda s, d: _spans(s, d).select("ticker", F.explode(calendars.training_array(F.col("last_date"))).alias("training_date")),
         """SELECT ticker, CAST(DATE_TRUNC('month', last_date - INTERVAL 3 MONTH) - INTERVAL 3 MONTH * k AS DATE) AS training_date
FROM spans, (SELECT UNNEST(RANGE(0, 12)) AS k) t""", "spans")
register("l_boundaries", lambda s, d: _spans(s, d).select("ticker", F.explode(F.array_distinct(F.concat(calendars.training_array(F.col("last_date")), F.array("last_date")))).alias("boundary")),
         """SELECT ticker, CAST(DATE_TRUNC('month', last_date - INTERVAL 3 MONTH) - INTERVAL 3 MONTH * k AS DATE) AS boundary
FROM spans, (SELECT UNNEST(RANGE(0, 12)) AS k) t UNION SELECT ticker, last_date FROM spans""", "spans")
register("w_next_date", lambda s, d: calendars.next_dates(testbed.bars(s, d)),
         "SELECT date, LEAD(date) OVER (ORDER BY date) AS next_date FROM (SELECT DISTINCT date FROM bars) x", "bars")

# --- labels --------------------------------------------------------------

WINDOW_ROWS = " UNION ALL ".join(f"SELECT DATE '{a}' AS start_date, DATE '{b}' AS end_date" for a, b in WINDOWS)
cte("windows", WINDOW_ROWS)
for p in ("", "brand_"):
    cte(f"{p}held", f"""SELECT ticker, start_date, end_date, PRODUCT(1 + daily_return) - 1 AS holding_return, COUNT(*) AS return_rows
FROM {p}returns JOIN windows ON date BETWEEN start_date AND end_date WHERE daily_return IS NOT NULL GROUP BY ALL""", f"{p}returns", "windows")
    cte(f"{p}forward", f"""SELECT h.ticker, h.start_date AS as_of_date, h.end_date, h.return_rows, h.holding_return AS forward_return,
 COALESCE(b.holding_return, 0) AS benchmark_return, h.holding_return - COALESCE(b.holding_return, 0) AS forward_excess_return
FROM {p}held h LEFT JOIN (SELECT * FROM {p}held WHERE ticker = 'Index#0' AND return_rows >= {MIN_ROWS}) b USING (start_date)
WHERE h.ticker <> 'Index#0' AND h.return_rows >= {MIN_ROWS}""", f"{p}held")


def held(s, d):
    return labels.holding_returns(base(s, d), WINDOWS)


def forward(s, d):
    return labels.forward_returns(base(s, d), WINDOWS, testbed.BENCHMARK, MIN_ROWS)


HKEY = ["ticker", "start_date", "end_date", "return_rows"]
FKEY = ["ticker", "as_of_date", "end_date"]
register("j_interval_holding",
         lambda s, d: asof.rows_in_windows(base(s, d), WINDOWS).filter("daily_return IS NOT NULL").select(*rounded(["ticker", "date", "start_date", "end_date"], {"daily_return": 6})),
         f"SELECT ticker, date, start_date, end_date, {r('daily_return', 6, 'daily_return')} FROM returns JOIN windows ON date BETWEEN start_date AND end_date WHERE daily_return IS NOT NULL",
         "returns", "windows")
add("a_holding_return", held, HKEY, {"holding_return": 5}, "held")
add("a_compound", held, HKEY, {"holding_return": 5}, "held")
add("a_forward_return", forward, FKEY, {"forward_return": 5}, "forward")
add("a_bench_forward", forward, FKEY, {"benchmark_return": 5}, "forward")
add("a_excess", forward, FKEY, {"forward_excess_return": 5}, "forward")


def panel(s, d):
    return labels.labelled_panel(cf.stored_scores(s, d), forward(s, d))


PANEL = {**{c: 3 for c in SCORE_COLUMNS}, "forward_excess_return": 5}
PANEL_SQL = "(SELECT * FROM scored JOIN forward USING (as_of_date, ticker)) x"
add("l_labels", panel, KEY, PANEL, PANEL_SQL, "scored", "forward")
add("j_label", panel, KEY, {"overall_score": 4, "forward_return": 5, "benchmark_return": 5}, PANEL_SQL, "scored", "forward")
add("s_union_panels", lambda s, d: panel(s, d).groupBy("as_of_date").agg(F.count("*").alias("rows"), F.avg("forward_excess_return").alias("mean_label")),
    ["as_of_date", "rows"], {"mean_label": 5}, "(SELECT as_of_date, COUNT(*) AS rows, AVG(forward_excess_return) AS mean_label FROM scored JOIN forward USING (as_of_date, ticker) GROUP BY 1) x", "scored", "forward")
add("l_inputs", panel, KEY, {c: 4 for c in ("earnings_yield", "gross_margin", "one_month_return", "max_drawdown", "forward_excess_return")}, PANEL_SQL, "scored", "forward")


def _feature_columns(s, d):
    """Which preferred feature columns carry numbers, and how many rows."""
    rows = cf.raw(s, d)
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("present")) for c in factors.RAW_COLUMNS])
    return rows.select(F.explode(parts).alias("f")).groupBy("f.feature").agg(F.sum(F.col("f.present").cast("long")).alias("rows_present"))


register("l_feature_columns", _feature_columns,
         " UNION ALL ".join(f"SELECT '{c}' AS feature, COUNT({c}) AS rows_present FROM raw" for c in factors.RAW_COLUMNS), "raw")

# --- selection of brands -------------------------------------------------

SCREEN = 12
RAW_LIST = ", ".join(["as_of_date", "ticker", "return_count", "market_cap", *factors.RAW_COLUMNS])
cte("brand_top", f"SELECT {RAW_LIST}, universe_rank, overall_score AS universe_score FROM brand_screen WHERE universe_rank <= {SCREEN}", "brand_screen")
cte("brand_inner", cf.score_sql("brand_top"), "brand_top")
cte("brand_pick", f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC NULLS LAST, MD5(ticker), ticker) AS screen_rank FROM brand_inner
QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC NULLS LAST, MD5(ticker), ticker) <= {N}""", "brand_inner")
cte("candidates_raw", f"SELECT {RAW_LIST} FROM brand_pick", "brand_pick")
cte("candidates", cf.score_sql("candidates_raw"), "candidates_raw")


def picked(s, d):
    """Final candidates per date: N brands."""
    return SNAPSHOTS.get(s, ("picked", d), lambda: factors.two_stage(cf.raw(s, d, testbed.BRAND), SCREEN, N))


def candidates(s, d):
    """The candidates scored among themselves."""
    raw_columns = ["as_of_date", "ticker", "return_count", "market_cap", *factors.RAW_COLUMNS]
    return SNAPSHOTS.get(s, ("candidates", d), lambda: factors.score(picked(s, d).select(*raw_columns)))


def brand_returns(s, d):
    return prices.with_returns(testbed.bars(s, d, testbed.BRAND))


def complete(s, d):
    names = picked(s, d).select(*KEY)
    return SNAPSHOTS.get(s, ("complete", d), lambda: covariance.complete_returns(brand_returns(s, d), names))


cte("complete", f"""SELECT p.as_of_date, x.date, x.ticker, x.daily_return AS ret FROM brand_returns x JOIN brand_pick p ON p.ticker = x.ticker AND x.date <= p.as_of_date
WHERE x.daily_return IS NOT NULL QUALIFY COUNT(*) OVER (PARTITION BY p.as_of_date, x.date) = {N}""", "brand_returns", "brand_pick")
cte("cov_sample", """SELECT a.as_of_date, a.ticker AS t1, b.ticker AS t2, COVAR_SAMP(a.ret, b.ret) * 252 AS cov, COVAR_POP(a.ret, b.ret) AS pop, COUNT(*) AS n
FROM complete a JOIN complete b ON a.as_of_date = b.as_of_date AND a.date = b.date AND a.ticker <= b.ticker GROUP BY ALL""", "complete")
cte("ewma_rows", """SELECT *, raw_w / SUM(raw_w) OVER (PARTITION BY as_of_date, ticker) AS w FROM (
SELECT *, EXP(-(n / 60.0) * (1 - k / (n - 1.0))) AS raw_w FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date, ticker ORDER BY date) - 1 AS k,
 COUNT(*) OVER (PARTITION BY as_of_date, ticker) AS n FROM complete) a) b""", "complete")
cte("cov_ewma", """SELECT a.as_of_date, a.ticker AS t1, b.ticker AS t2, (SUM(a.w * a.ret * b.ret) - SUM(a.w * a.ret) * SUM(b.w * b.ret)) * 252 AS cov
FROM ewma_rows a JOIN ewma_rows b ON a.as_of_date = b.as_of_date AND a.date = b.date AND a.ticker <= b.ticker GROUP BY ALL""", "ewma_rows")
cte("shrink", f"""SELECT *, square / (p * p) AS alpha, (square - 2 * mu * tr + p * mu * mu) / p AS delta, (fourth / n - square) / (p * n) AS beta FROM (
SELECT as_of_date, SUM(CASE WHEN t1 = t2 THEN pop END) AS tr, SUM(CASE WHEN t1 = t2 THEN 1 ELSE 2 END * pop * pop) AS square,
 {N} AS p, MAX(n) AS n, SUM(CASE WHEN t1 = t2 THEN pop END) / {N} AS mu FROM cov_sample GROUP BY 1) m
JOIN (SELECT as_of_date, SUM(norm * norm) AS fourth FROM (SELECT as_of_date, date, SUM(x * x) AS norm FROM (
  SELECT *, ret - AVG(ret) OVER (PARTITION BY as_of_date, ticker) AS x FROM complete) c GROUP BY 1, 2) d GROUP BY 1) f USING (as_of_date)""", "cov_sample", "complete")
cte("cov_lw", """SELECT as_of_date, t1, t2, ((1 - s) * pop + CASE WHEN t1 = t2 THEN s * mu ELSE 0 END) * 252 AS cov FROM cov_sample
JOIN (SELECT *, CASE WHEN LEAST(beta, delta) = 0 THEN 0 ELSE LEAST(beta, delta) / delta END AS s FROM shrink) k USING (as_of_date)""", "cov_sample", "shrink")
cte("cov_oas", """SELECT as_of_date, t1, t2, ((1 - s) * pop + CASE WHEN t1 = t2 THEN s * mu ELSE 0 END) * 252 AS cov FROM (SELECT * EXCLUDE (n) FROM cov_sample) c
JOIN (SELECT *, LEAST((alpha + mu * mu) / NULLIF((n + 1) * (alpha - mu * mu / p), 0), 1) AS s FROM shrink) k USING (as_of_date)""", "cov_sample", "shrink")

add("j_returns_align", complete, ["as_of_date", "date", "ticker"], {"ret": 6}, "complete")
CKEY = ["as_of_date", "t1", "t2"]
add("a_cov_sample", lambda s, d: covariance.estimate(complete(s, d), "sample"), CKEY, {"cov": 5}, "cov_sample")
register("j_self_pairs", lambda s, d: covariance.estimate(complete(s, d)).select(*CKEY), "SELECT as_of_date, t1, t2 FROM cov_sample", "cov_sample")
add("a_cov_ewma", lambda s, d: covariance.estimate(complete(s, d), "ewma"), CKEY, {"cov": 5}, "cov_ewma")
add("a_cov_ledoit_wolf", lambda s, d: covariance.estimate(complete(s, d), "ledoit_wolf"), CKEY, {"cov": 5}, "cov_lw")
add("a_cov_oas", lambda s, d: covariance.estimate(complete(s, d), "oas"), CKEY, {"cov": 5}, "cov_oas")
add("a_corr_distance", lambda s, d: covariance.correlation_distance(covariance.estimate(complete(s, d))), CKEY, {"distance": 6},
    """(SELECT c.as_of_date, c.t1, c.t2, SQRT((1 - GREATEST(LEAST(COALESCE(c.cov / NULLIF(SQRT(a.cov) * SQRT(b.cov), 0), 0), 1), -1)) / 2) AS distance FROM cov_sample c
JOIN cov_sample a ON a.as_of_date = c.as_of_date AND a.t1 = c.t1 AND a.t2 = c.t1 JOIN cov_sample b ON b.as_of_date = c.as_of_date AND b.t1 = c.t2 AND b.t2 = c.t2) x""", "cov_sample")

# --- weights -------------------------------------------------------------

W = {"weight": 6}
WKEY = ["as_of_date", "ticker"]


def norm_sql(source, raw, weight="weight"):
    return f"""SELECT * FROM (SELECT *, GREATEST(COALESCE({raw}, 0), 0) / NULLIF(SUM(GREATEST(COALESCE({raw}, 0), 0)) OVER (PARTITION BY as_of_date), 0) AS {weight} FROM {source}) n WHERE {weight} IS NOT NULL"""


def cap_sql(source, cap, weight="weight"):
    """Cap twin: iterate rounds of capping, each round fixes the names above it."""
    rounds = f"SELECT as_of_date, ticker, {weight} AS w, FALSE AS fixed FROM {source}"
    for _ in range(N):
        rounds = f"""SELECT as_of_date, ticker, CASE WHEN fixed THEN w WHEN prop > {cap} THEN {cap} ELSE w END AS w, fixed OR prop > {cap} AS fixed FROM (
SELECT *, w / NULLIF(SUM(CASE WHEN NOT fixed THEN w END) OVER (PARTITION BY as_of_date), 0) * (1 - {cap} * SUM(CASE WHEN fixed THEN 1 ELSE 0 END) OVER (PARTITION BY as_of_date)) AS prop FROM ({rounds}) a) b"""
    return f"""SELECT as_of_date, ticker, CAST(CASE WHEN fixed THEN {cap} ELSE w / NULLIF(SUM(CASE WHEN NOT fixed THEN w END) OVER (PARTITION BY as_of_date), 0) * (1 - {cap} * SUM(CASE WHEN fixed THEN 1 ELSE 0 END) OVER (PARTITION BY as_of_date)) END AS DOUBLE) AS weight FROM ({rounds}) z"""


cte("w_score", norm_sql("candidates", "overall_score"), "candidates")
cte("w_risk", norm_sql("(SELECT *, overall_score / annualized_volatility AS ratio FROM candidates WHERE annualized_volatility > 0) c", "ratio"), "candidates")
cte("w_sharp", norm_sql("(SELECT *, POWER(overall_score, 3) AS sharp FROM candidates) c", "sharp"), "candidates")
cte("w_capped", cap_sql("w_sharp", CAP), "w_sharp")


def sharp(s, d):
    rows = candidates(s, d).withColumn("sharp", F.pow("overall_score", F.lit(3.0)))
    return portfolio.normalized(rows, "sharp")


def tilted(s, d):
    """Signed raw weights: distance of the score from 40."""
    return candidates(s, d).select(*KEY, (F.col("overall_score") - 40).alias("weight"))


cte("w_tilted", "SELECT as_of_date, ticker, overall_score - 40 AS raw FROM candidates", "candidates")
cte("w_gross_in", "SELECT *, ABS(raw) / SUM(ABS(raw)) OVER (PARTITION BY as_of_date) AS weight FROM w_tilted", "w_tilted")
cte("w_gross", f"SELECT c.as_of_date, c.ticker, c.weight * SIGN(t.raw) AS weight FROM ({cap_sql('w_gross_in', CAP)}) c JOIN w_tilted t USING (as_of_date, ticker)", "w_gross_in")
add("p_normalize", sharp, WKEY, W, "w_sharp")
add("p_equal", lambda s, d: portfolio.equal(picked(s, d)), WKEY, W, "(SELECT *, 1.0 / COUNT(*) OVER (PARTITION BY as_of_date) AS weight FROM brand_pick) e", "brand_pick")
add("p_top_n_equal", lambda s, d: portfolio.top_n_equal(candidates(s, d), "overall_score", 2), WKEY, W,
    "(SELECT *, 0.5 AS weight FROM candidates QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC, MD5(ticker), ticker) <= 2) e", "candidates")
register("t_top_n_equal", lambda s, d: portfolio.top_k(candidates(s, d), ["as_of_date"], [F.desc("overall_score"), F.md5("ticker"), F.col("ticker")], 3).select(*KEY, "position"),
         "SELECT as_of_date, ticker, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC, MD5(ticker), ticker) AS position FROM candidates QUALIFY position <= 3", "candidates")
add("p_score", lambda s, d: portfolio.score_weighted(candidates(s, d)), WKEY, W, "w_score")
add("p_risk_adjusted", lambda s, d: portfolio.risk_adjusted(candidates(s, d)), WKEY, W, "w_risk")
add("p_signal", candidates, WKEY, {"overall_score": 4}, "candidates")
add("p_cap_long", lambda s, d: portfolio.capped(sharp(s, d), CAP), WKEY, W, "w_capped")
add("p_cap_gross", lambda s, d: portfolio.capped_gross(tilted(s, d), CAP), WKEY, W, "w_gross")
cte("w_final_in", norm_sql("(SELECT *, POWER(GREATEST(raw, 0), 2) + 1 AS lifted FROM w_tilted) t", "lifted"), "w_tilted")
cte("w_final", cap_sql("w_final_in", CAP), "w_final_in")
add("p_finalize", lambda s, d: portfolio.finalized(tilted(s, d).withColumn("weight", F.pow(F.greatest("weight", F.lit(0.0)), F.lit(2.0)) + 1), True, CAP), WKEY, W, "w_final")


def signed(s, d):
    """Squared scores; the last name of each date is a small short position."""
    short = F.when(F.col("screen_rank") == N, -0.1).otherwise(1.0)
    return picked(s, d).select(*KEY, (short * F.pow("overall_score", F.lit(2.0))).alias("weight"))


def net_sql(source, cap):
    """Net twin: rounds that fix what is above the cap and scale the rest to the target."""
    by = "PARTITION BY as_of_date"
    rounds = f"SELECT as_of_date, ticker, weight / SUM(weight) OVER ({by}) AS w, FALSE AS fixed FROM {source}"
    for _ in range(N):
        rounds = f"""SELECT as_of_date, ticker, now AS fixed, CASE WHEN now OR NOT any_over THEN v
 WHEN free = 0 THEN (1 - held) / open ELSE v / free * (1 - held) END AS w FROM (
SELECT *, SUM(CASE WHEN now THEN v ELSE 0 END) OVER ({by}) AS held, SUM(CASE WHEN now THEN 0 ELSE v END) OVER ({by}) AS free, SUM(CASE WHEN now THEN 0 ELSE 1 END) OVER ({by}) AS open FROM (
SELECT as_of_date, ticker, fixed OR o AS now, CASE WHEN o THEN SIGN(w) * {cap} ELSE w END AS v, BOOL_OR(o) OVER ({by}) AS any_over FROM (
SELECT *, NOT fixed AND ABS(w) > {cap} + 1e-10 AS o FROM ({rounds}) a) b) c) d"""
    return f"SELECT as_of_date, ticker, CAST(w AS DOUBLE) AS weight FROM ({rounds}) z"


cte("w_signed", f"SELECT as_of_date, ticker, CASE WHEN screen_rank = {N} THEN -0.1 ELSE 1.0 END * POWER(overall_score, 2) AS weight FROM brand_pick", "brand_pick")
cte("w_net", net_sql("w_signed", 0.5), "w_signed")
add("p_cap_net", lambda s, d: portfolio.capped_net(signed(s, d), 0.5), WKEY, W, "w_net")
cte("w_inverse", "SELECT as_of_date, t1 AS ticker, (1 / cov) / SUM(1 / cov) OVER (PARTITION BY as_of_date) AS weight FROM cov_sample WHERE t1 = t2", "cov_sample")
add("p_inverse_variance", lambda s, d: portfolio.inverse_variance(covariance.estimate(complete(s, d))), WKEY, W, "w_inverse")


def _cluster_variance(s, d):
    cov = covariance.estimate(complete(s, d))
    w = portfolio.inverse_variance(cov)
    left, right = (w.withColumnsRenamed({"ticker": t, "weight": f"w_{t}"}) for t in ("t1", "t2"))
    twice = F.when(F.col("t1") == F.col("t2"), 1.0).otherwise(2.0)
    return (
        cov.join(F.broadcast(left), ["as_of_date", "t1"]).join(F.broadcast(right), ["as_of_date", "t2"])
        .groupBy("as_of_date").agg(F.sum(twice * F.col("cov") * F.col("w_t1") * F.col("w_t2")).alias("variance"))
    )


cte("cluster", """SELECT as_of_date, SUM(CASE WHEN c.t1 = c.t2 THEN 1 ELSE 2 END * c.cov * a.weight * b.weight) AS variance FROM cov_sample c
JOIN w_inverse a USING (as_of_date) JOIN w_inverse b USING (as_of_date) WHERE a.ticker = c.t1 AND b.ticker = c.t2 GROUP BY 1""", "cov_sample", "w_inverse")
add("p_cluster_variance", _cluster_variance, ["as_of_date"], {"variance": 5}, "cluster")
add("p_cluster_attractiveness",
    lambda s, d: _cluster_variance(s, d).join(candidates(s, d).groupBy("as_of_date").agg(F.avg("overall_score").alias("signal")), "as_of_date")
    .select("as_of_date", (F.greatest("signal", F.lit(0.0)) / F.sqrt("variance")).alias("attractiveness")),
    ["as_of_date"], {"attractiveness": 3},
    "(SELECT as_of_date, GREATEST(signal, 0) / SQRT(variance) AS attractiveness FROM cluster JOIN (SELECT as_of_date, AVG(overall_score) AS signal FROM candidates GROUP BY 1) g USING (as_of_date)) x", "cluster", "candidates")
add("a_cluster_signal", lambda s, d: candidates(s, d).groupBy("as_of_date").agg(F.avg("overall_score").alias("signal")), ["as_of_date"], {"signal": 3},
    "(SELECT as_of_date, AVG(overall_score) AS signal FROM candidates GROUP BY 1) g", "candidates")

METHODS = ["equal_weight", "top_n_equal_weight", "score_weighted", "risk_adjusted_score_weighted", *portfolio.SOLVED]


def signals(rows):
    return rows.select(*KEY, F.col("overall_score").alias("signal"))


def brand_alpha(s, d):
    """(as_of_date, ticker, alpha) of every brand and research date: stacked models of twelve training dates each."""
    build = lambda: expected_returns(testbed.bars(s, d, testbed.BRAND), testbed.statements(s, d, testbed.BRAND), cf.raw(s, d, testbed.BRAND), AS_OF, ROLLING)
    return SNAPSHOTS.get(s, ("brand_alpha", d), build)


ROLLING = ResearchConfig(benchmark=testbed.BENCHMARK, minimum_return_rows=20, minimum_label_rows=MIN_ROWS, top_screen_n=SCREEN, final_portfolio_n=N)


def with_alpha(s, d):
    """The candidates with their trained alpha as signal."""
    return candidates(s, d).join(brand_alpha(s, d), KEY, "left").withColumn("signal", F.col("alpha"))


def solved(s, d, methods=portfolio.SOLVED, signal=None, **finish):
    """Matrix methods under one exposure rule; the signal is the score unless (as_of_date, ticker, signal) is given."""
    rows = candidates(s, d) if signal is None else signal
    signal = signals(rows) if signal is None else signal.select(*KEY, "signal")
    raw_weights = portfolio.solved_weights(covariance.estimate(complete(s, d)), signal, methods)
    return portfolio.finalized(raw_weights, group=["as_of_date", "method"], **finish)


SOLVED_NAMES = {
    "minimum_variance": "p_min_variance", "maximum_sharpe": "p_max_sharpe", "mean_variance": "p_mean_variance",
    "risk_parity": "p_risk_parity", "hierarchical_risk_parity": "p_hrp",
}

# twin of the closed forms: Gauss-Jordan elimination of (covariance | ones | signal), one step per name
cte("system0", f"""SELECT as_of_date, i, j, v FROM (
SELECT c.as_of_date, a.k AS i, b.k AS j, c.cov AS v FROM cov_sample c JOIN places a ON a.as_of_date = c.as_of_date AND a.ticker = c.t1 JOIN places b ON b.as_of_date = c.as_of_date AND b.ticker = c.t2
UNION SELECT c.as_of_date, b.k, a.k, c.cov FROM cov_sample c JOIN places a ON a.as_of_date = c.as_of_date AND a.ticker = c.t1 JOIN places b ON b.as_of_date = c.as_of_date AND b.ticker = c.t2
UNION ALL SELECT as_of_date, k, {N + 1}, 1.0 FROM places UNION ALL SELECT as_of_date, k, {N + 2}, overall_score FROM places JOIN candidates USING (as_of_date, ticker)) x""",
    "cov_sample", "places", "candidates")
cte("places", "SELECT as_of_date, ticker, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY ticker) AS k FROM candidates", "candidates")
for _k in range(1, N + 1):
    cte(f"system{_k}", f"""SELECT a.as_of_date, a.i, a.j, CASE WHEN a.i = {_k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v FROM system{_k - 1} a
JOIN system{_k - 1} p ON p.as_of_date = a.as_of_date AND p.i = {_k} AND p.j = {_k}
JOIN system{_k - 1} c ON c.as_of_date = a.as_of_date AND c.i = a.i AND c.j = {_k}
JOIN system{_k - 1} r ON r.as_of_date = a.as_of_date AND r.i = {_k} AND r.j = a.j""", f"system{_k - 1}")


def _solved_twin(method):
    column = N + 1 if method == "minimum_variance" else N + 2
    cte(f"raw_{method}", f"SELECT p.as_of_date, p.ticker, m.v AS solution FROM places p JOIN system{N} m ON m.as_of_date = p.as_of_date AND m.i = p.k AND m.j = {column}", "places", f"system{N}")
    cte(f"long_{method}", norm_sql(f"raw_{method}", "solution"), f"raw_{method}")
    return f"SELECT '{method}' AS method, {rounded_sql(WKEY, W)} FROM ({cap_sql(f'long_{method}', CAP)}) w"


for method, name in SOLVED_NAMES.items():
    # the closed forms take the score as signal, which their twins can follow; the trained alpha is the signal elsewhere
    twin = (_solved_twin(method), f"long_{method}") if method in list(SOLVED_NAMES)[:3] else ()
    register(name, lambda s, d, m=method, t=twin: solved(s, d, [m], None if t else with_alpha(s, d), max_weight=CAP).select("method", *rounded(WKEY, W)), *twin)


def rule_weights(s, d):
    return SNAPSHOTS.get(s, ("rule_weights", d), lambda: _rule_weights(s, d))


def _rule_weights(s, d, rows=None, signal="overall_score"):
    rows = candidates(s, d) if rows is None else rows
    parts = {
        "equal_weight": portfolio.equal(rows),
        "top_n_equal_weight": portfolio.top_n_equal(rows, signal, 2),
        "score_weighted": portfolio.score_weighted(rows),
        "risk_adjusted_score_weighted": portfolio.risk_adjusted(rows),
    }
    out = None
    for method, part in parts.items():
        part = part.select(*KEY, F.lit(method).alias("method"), F.col("weight").cast("double").alias("weight"))
        out = part if out is None else out.unionByName(part)
    return out


def all_weights(s, d):
    """All nine methods; those that need a signal take the trained alpha."""
    rows = with_alpha(s, d)
    return _rule_weights(s, d, rows, "signal").unionByName(solved(s, d, signal=rows, max_weight=CAP).select(*KEY, "method", "weight"))


cte("rule_weights", """SELECT as_of_date, ticker, 'equal_weight' AS method, CAST(1.0 / COUNT(*) OVER (PARTITION BY as_of_date) AS DOUBLE) AS weight FROM candidates
UNION ALL SELECT as_of_date, ticker, 'score_weighted', weight FROM w_score UNION ALL SELECT as_of_date, ticker, 'risk_adjusted_score_weighted', weight FROM w_risk
UNION ALL SELECT as_of_date, ticker, 'top_n_equal_weight', 0.5 FROM (SELECT * FROM candidates QUALIFY ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC, MD5(ticker), ticker) <= 2) t""",
    "candidates", "w_score", "w_risk")
register("p_dispatch", lambda s, d: every_method(s, d).select("method", *rounded(WKEY, W)))
PERF = {"annual_return": 5, "annual_volatility": 5, "sharpe_ratio": 4}
register("p_compare", lambda s, d: portfolio.performance(every_method(s, d), complete(s, d)).select(*rounded(["as_of_date", "method"], PERF)))
cte("daily_fixed", "SELECT c.as_of_date, w.method, c.date, SUM(w.weight * c.ret) AS portfolio_return FROM complete c JOIN rule_weights w USING (as_of_date, ticker) GROUP BY ALL", "complete", "rule_weights")
add("a_portfolio_perf", lambda s, d: portfolio.performance(rule_weights(s, d), complete(s, d)), ["as_of_date", "method"], PERF,
    """(SELECT *, annual_return / NULLIF(annual_volatility, 0) AS sharpe_ratio FROM (SELECT as_of_date, method, AVG(portfolio_return) * 252 AS annual_return,
STDDEV_POP(portfolio_return) * SQRT(252) AS annual_volatility FROM daily_fixed GROUP BY ALL) a) x""", "daily_fixed")

# --- backtests -----------------------------------------------------------

RULES = METHODS[:4]
BY = ["as_of_date", "method"]
add("b_portfolio_returns", lambda s, d: backtest.portfolio_returns(rule_weights(s, d), complete(s, d)), [*BY, "date"], {"portfolio_return": 6}, "daily_fixed")
cte("rule_held", """SELECT x.*, COUNT(*) OVER (PARTITION BY as_of_date, method, date) AS have FROM (
SELECT w.as_of_date, w.method, v.end_date, x.date, w.ticker, w.weight, x.daily_return AS ret,
 (SELECT COUNT(*) FROM rule_weights k WHERE k.as_of_date = w.as_of_date AND k.method = w.method) AS names
FROM rule_weights w JOIN windows v ON v.start_date = w.as_of_date JOIN brand_returns x ON x.ticker = w.ticker AND x.date BETWEEN v.start_date AND v.end_date AND x.daily_return IS NOT NULL) x
QUALIFY have = names""", "rule_weights", "windows", "brand_returns")
cte("rule_growth", "SELECT *, EXP(SUM(LN(1 + ret)) OVER (PARTITION BY as_of_date, method, ticker ORDER BY date)) AS growth FROM rule_held", "rule_held")
cte("rule_daily", """SELECT *, COALESCE(value / LAG(value) OVER (PARTITION BY as_of_date, method ORDER BY date) - 1, 0) AS portfolio_return FROM (
SELECT as_of_date, end_date, method, date, SUM(weight * growth) AS value FROM rule_growth GROUP BY ALL) v""", "rule_growth")


def equity_sql(source, by):
    return f"""SELECT *, equity / MAX(equity) OVER (PARTITION BY {by} ORDER BY date) - 1 AS drawdown FROM (
SELECT *, EXP(SUM(LN(1 + portfolio_return)) OVER (PARTITION BY {by} ORDER BY date)) AS equity FROM {source}) e"""


METRICS = {"annualized_volatility": 4, "max_drawdown": 4, "win_rate": 5, "average_daily_return": 6, "best_day": 5, "worst_day": 5}
GROWN = {"total_return": 5, "total_return_full": 5, "annualized_return": 5, "sharpe_ratio": 5}
VALUE = {"ending_value": 5}


def metrics_sql(source, by):
    return f"""SELECT *, annualized_return / NULLIF(annualized_volatility, 0) AS sharpe_ratio FROM (
SELECT *, CASE WHEN total_return > -1 THEN POWER(1 + total_return, 252.0 / number_of_days) - 1 END AS annualized_return FROM (
SELECT {by}, ARG_MAX(equity, date) / ARG_MIN(equity, date) - 1 AS total_return, ARG_MAX(equity, date) - 1 AS total_return_full,
 STDDEV_SAMP(portfolio_return) * SQRT(252) AS annualized_volatility, MIN(drawdown) AS max_drawdown, AVG(CASE WHEN portfolio_return > 0 THEN 1.0 ELSE 0 END) AS win_rate,
 AVG(portfolio_return) AS average_daily_return, MAX(portfolio_return) AS best_day, MIN(portfolio_return) AS worst_day, COUNT(*) AS number_of_days
FROM {source} GROUP BY {by}) a) b"""


cte("fixed_equity", equity_sql("daily_fixed", "as_of_date, method"), "daily_fixed")
cte("fixed_metrics", metrics_sql("fixed_equity", "as_of_date, method"), "fixed_equity")
cte("rule_equity", equity_sql("rule_daily", "method"), "rule_daily")
cte("rule_metrics", metrics_sql("rule_equity", "method"), "rule_equity")


def fixed(s, d):
    return backtest.portfolio_returns(rule_weights(s, d), complete(s, d))


def rebalanced(s, d):
    return backtest.window_returns(brand_returns(s, d), rule_weights(s, d), WINDOWS)


def every_method(s, d):
    """Weights of all nine methods."""
    return SNAPSHOTS.get(s, ("all_weights", d), lambda: all_weights(s, d))


def compared(s, d):
    """All nine methods over the holding windows, best first."""
    held_rows = backtest.window_returns(brand_returns(s, d), every_method(s, d), WINDOWS)
    table = backtest.method_table(backtest.metrics(backtest.drifted(held_rows)))
    return table.select(*rounded(["method", "number_of_days"], METRICS))


def compared_static(s, d):
    table = backtest.metrics(backtest.portfolio_returns(every_method(s, d), complete(s, d)), BY)
    return table.select(*rounded([*BY, "number_of_days"], METRICS))


add("b_fixed", lambda s, d: backtest.with_equity(fixed(s, d), BY), [*BY, "date"], {"drawdown": 5}, "fixed_equity", logs={"equity": 5})
add("b_method", lambda s, d: backtest.metrics(fixed(s, d).filter("method = 'score_weighted'"), BY), [*BY, "number_of_days"], METRICS, "fixed_metrics WHERE method = 'score_weighted'", "fixed_metrics", logs=GROWN)
add("a_static_metrics", lambda s, d: backtest.metrics(fixed(s, d), BY), [*BY, "number_of_days"], METRICS, "fixed_metrics", logs=GROWN)
register("b_compare_static", compared_static)
add("w_ticker_growth", lambda s, d: backtest.ticker_growth(rebalanced(s, d)), [*BY, "date", "ticker"], {"growth": 5}, "rule_growth")
add("b_drift_daily", lambda s, d: backtest.drifted(rebalanced(s, d)), [*BY, "date"], {"value": 5, "portfolio_return": 6}, "rule_daily")
add("w_equity_curve", lambda s, d: backtest.with_equity(backtest.drifted(rebalanced(s, d))), ["method", "date"], {}, "rule_equity", logs={"equity": 5})
add("w_cummax_equity", lambda s, d: backtest.with_equity(backtest.drifted(rebalanced(s, d))), ["method", "date"], {"drawdown": 4}, "rule_equity")
add("s_concat_returns", lambda s, d: backtest.drifted(rebalanced(s, d)).orderBy("method", "date"), ["method", "date"], {"portfolio_return": 6}, "rule_daily")
add("a_backtest_metrics", lambda s, d: backtest.metrics(backtest.drifted(rebalanced(s, d))), ["method", "number_of_days"], METRICS, "rule_metrics", logs=GROWN)
add("a_method_table", lambda s, d: backtest.method_table(backtest.metrics(backtest.drifted(rebalanced(s, d)))), ["method", "number_of_days"], METRICS, "rule_metrics", logs=GROWN)
register("b_compare_rebalanced", compared)

ALL_WINDOWS = [(date(1996, 1, 1), date(1996, 3, 31)), *WINDOWS]
cte("history", f"""SELECT m.method, v.as_of_date, v.end_date, k.holdings, d.days, CASE WHEN s.as_of_date IS NULL THEN 'no selected tickers' WHEN k.holdings IS NULL THEN 'cash'
 WHEN d.days IS NULL THEN 'no returns' ELSE 'invested' END AS status, CASE WHEN s.as_of_date IS NOT NULL AND k.holdings IS NULL THEN 0 ELSE d.ret END AS period_return,
 EXP(SUM(LN(1 + COALESCE(d.ret, 0))) OVER (PARTITION BY m.method ORDER BY v.as_of_date)) AS ending_value
FROM ({' UNION ALL '.join(f"SELECT DATE '{a}' AS as_of_date, DATE '{b}' AS end_date" for a, b in ALL_WINDOWS)}) v
CROSS JOIN (SELECT UNNEST(['equal_weight', 'top_n_equal_weight', 'score_weighted', 'risk_adjusted_score_weighted', 'all_cash']) AS method) m
LEFT JOIN (SELECT as_of_date, method, COUNT(*) AS holdings FROM rule_weights GROUP BY ALL) k ON k.as_of_date = v.as_of_date AND k.method = m.method
LEFT JOIN (SELECT DISTINCT as_of_date FROM rule_weights) s ON s.as_of_date = v.as_of_date
LEFT JOIN (SELECT as_of_date, method, ARG_MAX(value, date) - 1 AS ret, COUNT(*) AS days FROM rule_daily GROUP BY ALL) d ON d.as_of_date = v.as_of_date AND d.method = m.method""",
    "rule_weights", "rule_daily")


def history(s, d):
    weights = rule_weights(s, d)
    return backtest.rebalance_history(backtest.drifted(rebalanced(s, d)), weights, ALL_WINDOWS, [*RULES, "all_cash"])


BKEY = ["method", "as_of_date", "end_date", "status"]
add("b_rebalanced", history, BKEY, {}, "history", logs={"period_return": 5, **VALUE})
add("b_history_flat", history, [*BKEY, "holdings", "days"], {}, "history", logs={"period_return": 5, **VALUE})
add("b_no_candidates", lambda s, d: history(s, d).filter("status = 'no selected tickers'"), BKEY, {}, "history WHERE status = 'no selected tickers'", "history", logs={"period_return": 5, **VALUE})
add("b_error_rows", lambda s, d: history(s, d).filter("status <> 'invested'"), BKEY, {}, "history WHERE status <> 'invested'", "history", logs={"period_return": 5, **VALUE})


def full_history(s, d):
    """Account value of all nine methods on alpha, window by window."""
    held_rows = backtest.window_returns(brand_returns(s, d), every_method(s, d), WINDOWS)
    return backtest.rebalance_history(backtest.drifted(held_rows), every_method(s, d), ALL_WINDOWS, [*METHODS, "all_cash"])


# on alpha there is no twin: a test compares the rows of the rule methods with the queries above
register("b_rebalanced_alpha", lambda s, d: full_history(s, d).select(*BKEY, *[rnd(F.signum(c) * F.log1p(F.abs(c)), 5).alias(f"log_{c}") for c in ("period_return", "ending_value")]))
register("b_history_flat_alpha", lambda s, d: full_history(s, d).select(*BKEY, "holdings", "days"))
register("b_weights_flat_alpha", lambda s, d: every_method(s, d).select(*KEY, "method", rnd("weight", 6).alias("weight")))
add("b_weights_flat", rule_weights, [*KEY, "method"], W, "rule_weights")
add("b_align_weights",
    lambda s, d: complete(s, d).select(*KEY).distinct().crossJoin(s.createDataFrame([(m,) for m in RULES], "method string")).join(rule_weights(s, d), [*KEY, "method"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))),
    [*KEY, "method"], W,
    "(SELECT c.as_of_date, c.ticker, m.method, COALESCE(w.weight, 0) AS weight FROM (SELECT DISTINCT as_of_date, ticker FROM complete) c CROSS JOIN (SELECT DISTINCT method FROM rule_weights) m LEFT JOIN rule_weights w ON w.as_of_date = c.as_of_date AND w.ticker = c.ticker AND w.method = m.method) x",
    "complete", "rule_weights")


def _cash(s, d):
    reference = picked(s, d).filter("screen_rank = 1").select(*KEY)
    return backtest.cash_days(brand_returns(s, d), reference, [*WINDOWS[:-1], (AS_OF[-1], END)])


add("b_cash", _cash, ["as_of_date", "date"], {"portfolio_return": 6},
    "(SELECT p.as_of_date, x.date, 0.0 AS portfolio_return FROM brand_pick p JOIN windows v ON v.start_date = p.as_of_date JOIN brand_returns x ON x.ticker = p.ticker AND x.date BETWEEN v.start_date AND v.end_date AND x.daily_return IS NOT NULL WHERE p.screen_rank = 1) x",
    "brand_pick", "windows", "brand_returns")


def brand_forward(s, d):
    return labels.forward_returns(brand_returns(s, d), WINDOWS, testbed.BENCHMARK, 1)


def _diagnostics(s, d):
    """Trained alpha of every selected name next to what came of it."""
    predicted = brand_alpha(s, d).select(*KEY, F.col("alpha").alias("predicted"))
    realised = brand_forward(s, d).select(*KEY, F.col("forward_return").alias("actual_return"), "benchmark_return")
    return backtest.diagnostics(picked(s, d), predicted, realised)


DIAG = {"predicted": 5, "actual_return": 5, "benchmark_return": 5, "forward_excess_return": 5, "prediction_error": 5}
register("b_diagnostics", lambda s, d: _diagnostics(s, d).select(*rounded(KEY, DIAG)))
cte("pred_actual", """SELECT p.as_of_date, p.ticker, p.overall_score / 1000 AS predicted, f.holding_return AS actual_return, b.holding_return AS benchmark_return,
 f.holding_return - b.holding_return AS forward_excess_return, p.overall_score / 1000 - (f.holding_return - b.holding_return) AS prediction_error, 0 * (f.holding_return - b.holding_return) AS residual
FROM brand_pick p LEFT JOIN brand_held f ON f.ticker = p.ticker AND f.start_date = p.as_of_date LEFT JOIN brand_held b ON b.ticker = 'Index#0' AND b.start_date = p.as_of_date""", "brand_pick", "brand_held")


def _pred_actual(s, d):
    """The score's prediction next to what came of it, and what is left of the trained one's error.

    A twin cannot train: the trained prediction enters as the residual of its error, which is nothing where there is a prediction.
    """
    trained = _diagnostics(s, d)
    residual = trained.select(*KEY, (F.col("predicted") - F.col("prediction_error") - F.col("forward_excess_return")).alias("residual"))
    scored = picked(s, d).select(*KEY, (F.col("overall_score") / 1000).alias("predicted"))
    realised = trained.select(*KEY, "actual_return", "benchmark_return")
    return backtest.diagnostics(picked(s, d), scored, realised).join(residual, KEY, "left")


add("j_pred_actual", _pred_actual, KEY, {**DIAG, "residual": 5}, "pred_actual")


def stored_run(s, d):
    """Folder of a written run: selection, weights, history and summary."""
    path = f"{shared_folder(s)}/run-{uuid.uuid4().hex}"
    summary = backtest.method_table(backtest.metrics(backtest.drifted(rebalanced(s, d))))
    made = {"selection": picked(s, d), "weights": rule_weights(s, d), "history": history(s, d), "summary": summary}
    tables.write_run(made, path)
    return path


def _replay(s, d):
    """The weights of a stored run, daily rebalanced inside each window."""
    weights = s.read.parquet(f"{stored_run(s, d)}/weights")
    held_rows = backtest.window_returns(brand_returns(s, d), weights, WINDOWS)
    return held_rows.groupBy("as_of_date", "method", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("portfolio_return"))


add("b_replay", _replay, [*BY, "date"], {"portfolio_return": 6},
    "(SELECT as_of_date, method, date, SUM(weight * ret) AS portfolio_return FROM rule_held GROUP BY ALL) x", "rule_held")


add("snk_run_history", lambda s, d: s.read.parquet(f"{stored_run(s, d)}/history"), [*BKEY, "holdings", "days"], {}, "history", logs={"period_return": 5, **VALUE})
add("snk_run_summary", lambda s, d: s.read.parquet(f"{stored_run(s, d)}/summary"), ["method", "number_of_days"], METRICS, "rule_metrics", logs=GROWN)

ENGINE = ResearchConfig(benchmark=testbed.BENCHMARK, top_screen_n=SCREEN, final_portfolio_n=N)


def _engine(s, d):
    """The research run: eligible -> ranked -> selected -> scored again -> weighted, for every date at once."""
    done = run(testbed.bars(s, d, testbed.BRAND), testbed.statements(s, d, testbed.BRAND), AS_OF, ENGINE)
    return done["weights"].join(done["selection"].select(*KEY, "universe_rank", "screen_rank", "overall_score"), KEY)


cte("engine_raw", "SELECT * FROM brand_raw WHERE return_count >= 252", "brand_raw")
cte("engine_scored", cf.score_sql("engine_raw"), "engine_raw")
cte("engine_top", f"SELECT {RAW_LIST}, overall_score AS universe_score, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC NULLS LAST, MD5(ticker), ticker) AS universe_rank FROM engine_scored QUALIFY universe_rank <= {SCREEN}", "engine_scored")
cte("engine_inner", cf.score_sql("engine_top"), "engine_top")
cte("engine_pick", f"SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY overall_score DESC NULLS LAST, MD5(ticker), ticker) AS screen_rank FROM engine_inner QUALIFY screen_rank <= {N}", "engine_inner")
cte("engine_inputs", f"SELECT {RAW_LIST} FROM engine_pick", "engine_pick")
cte("engine_final", cf.score_sql("engine_inputs"), "engine_inputs")
cte("engine_norm", norm_sql("engine_final", "overall_score"), "engine_final")
cte("engine_weights", "SELECT n.as_of_date, n.ticker, n.weight, p.universe_rank, p.screen_rank, p.overall_score FROM engine_norm n JOIN engine_pick p USING (as_of_date, ticker)", "engine_norm", "engine_pick")
add("b_engine", _engine, [*KEY, "universe_rank", "screen_rank"], {"overall_score": 4, "weight": 6}, "engine_weights")


ENGINE_ALPHA = replace(ROLLING, method="maximum_sharpe", max_weight=0.6)


def _engine_alpha(s, d):
    """The research run with a method that needs trained alpha."""
    done = run(testbed.bars(s, d, testbed.BRAND), testbed.statements(s, d, testbed.BRAND), AS_OF, ENGINE_ALPHA)
    return done["weights"].join(done["selection"].select(*KEY, "screen_rank"), KEY).join(done["alpha"], KEY, "left")


register("b_engine_alpha", lambda s, d: _engine_alpha(s, d).select(*KEY, "screen_rank", rnd("alpha", 6).alias("alpha"), rnd("weight", 6).alias("weight")))
