"""Quality rules, contexts, stored snapshots and streams."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from plumbline.catalog import factors as cf
from plumbline.catalog import portfolio as cp
from plumbline.catalog import text as ct
from plumbline.catalog.prices import AS_OF, MARKET_COLUMNS, market_summary
from plumbline.catalog.prices import panel as price_panel
from plumbline.catalog.twin import cte, r, register
from plumbline.functions.factor_config import SCORE_COLUMNS
from plumbline.functions.scalars import rnd
from plumbline.operators import asof, contexts, quality
from plumbline.operators import news as news_ops
from plumbline.operators.ranking import top_k
from plumbline.sources import landed, stored, tables, testbed
from plumbline.streaming import ingest

LAST = AS_OF[-1]
KEY = ["as_of_date", "ticker"]
JOIN = "ARRAY_TO_STRING(LIST_SORT(LIST_DISTINCT(LIST_FILTER([{0}], lambda x: x IS NOT NULL))), '; ')"


def joined(column="warnings"):
    return F.array_join(F.array_sort(column), "; ").alias("warnings")


def _company(s, d):
    market = market_summary(s, d, [LAST]).select("ticker", "date", "one_year_return", "sma_50")
    periods = cf.seen(s, d).filter(F.col("as_of_date") == F.lit(LAST)).groupBy("ticker").agg(F.count("*").alias("periods"))
    known = testbed.companies(s, d).withColumn("sector", F.when(F.col("sector") != "ASIA", F.col("sector")))
    return quality.company_warnings(known, market, periods, LAST).select("ticker", joined())


_RULES = ["CASE WHEN name IS NULL OR sector = 'ASIA' THEN 'company metadata incomplete' END", "CASE WHEN m.date IS NULL THEN 'no price history' END",
          "CASE WHEN COALESCE(p.n, 0) < 4 THEN 'fewer than 4 statement periods' END", "CASE WHEN one_year_return IS NULL THEN 'market summary incomplete' END",
          "CASE WHEN sma_50 IS NULL THEN 'technical indicators missing' END", f"CASE WHEN m.date IS NULL OR DATE '{LAST}' - m.date > 10 THEN 'latest price is stale' END"]
COMPANY_SQL = f"""SELECT c.ticker, {JOIN.format(', '.join(_RULES))} AS warnings FROM companies c LEFT JOIN (SELECT * FROM market_asof WHERE as_of_date = DATE '{LAST}') m ON m.ticker = c.ticker
LEFT JOIN (SELECT ticker, sma_50 FROM technicals_asof WHERE as_of_date = DATE '{LAST}') t ON t.ticker = c.ticker
LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM seen WHERE as_of_date = DATE '{LAST}' GROUP BY 1) p ON p.ticker = c.ticker"""
for _name in ("d_company", "d_company_report"):
    register(_name, _company, COMPANY_SQL, "companies", "market_asof", "technicals_asof", "seen")


def holdings(s, d):
    rows = cp.picked(s, d).select(*KEY, "universe_rank", "screen_rank", "overall_score")
    weights = cp.rule_weights(s, d).filter("method = 'score_weighted'").select(*KEY, "weight")
    articles = ct.chosen(s, d).groupBy("ticker").agg(F.count("*").alias("articles"))
    filed = ct.limited(s, d).groupBy("ticker").agg(F.count("*").alias("filings"))
    return (
        rows.join(weights, KEY, "left").join(F.broadcast(articles), "ticker", "left").join(F.broadcast(filed), "ticker", "left")
        .join(cp.brand_alpha(s, d), KEY, "left")
        .withColumns({"name": F.when(F.col("ticker") != "Brand#1", F.col("ticker")), "alpha": F.when(F.col("ticker") != "Brand#2", F.col("alpha"))})
    )


cte("holdings", """SELECT p.as_of_date, p.ticker, p.universe_rank, p.screen_rank, p.overall_score, w.weight, n.articles, f.filings,
 CASE WHEN p.ticker <> 'Brand#1' THEN p.ticker END AS name, CASE WHEN p.ticker <> 'Brand#2' THEN 1.0 END AS alpha
FROM brand_pick p LEFT JOIN w_score w USING (as_of_date, ticker) LEFT JOIN (SELECT ticker, COUNT(*) AS articles FROM chosen_news GROUP BY 1) n ON n.ticker = p.ticker
LEFT JOIN (SELECT ticker, COUNT(*) AS filings FROM limited GROUP BY 1) f ON f.ticker = p.ticker""", "brand_pick", "w_score", "chosen_news", "limited")
_HOLD = ["CASE WHEN name IS NULL THEN 'company name missing' END", "CASE WHEN alpha IS NULL THEN 'expected return missing' END", "CASE WHEN weight IS NULL THEN 'portfolio weight missing' END",
         "CASE WHEN COALESCE(articles, 0) = 0 THEN 'no news evidence' END", "CASE WHEN COALESCE(filings, 0) = 0 THEN 'no filing evidence' END"]
register("d_holding", lambda s, d: quality.holding_warnings(holdings(s, d)).select(*KEY, joined()), f"SELECT as_of_date, ticker, {JOIN.format(', '.join(_HOLD))} AS warnings FROM holdings", "holdings")
register("d_holding_context", lambda s, d: holdings(s, d).select(*KEY, "universe_rank", "screen_rank", "articles", "filings", rnd("overall_score", 4).alias("overall_score"), rnd("weight", 6).alias("weight")),
         f"SELECT as_of_date, ticker, universe_rank, screen_rank, articles, filings, {r('overall_score', 4, 'overall_score')}, {r('weight', 6, 'weight')} FROM holdings", "holdings")
register("d_portfolio_context", lambda s, d: holdings(s, d).groupBy("as_of_date").agg(F.array_join(F.array_sort(F.collect_list("ticker")), ",").alias("tickers"), rnd(F.sum("weight"), 6).alias("total_weight"), F.sum("articles").alias("articles")),
         f"SELECT as_of_date, STRING_AGG(ticker, ',' ORDER BY ticker) AS tickers, {r('SUM(weight)', 6, 'total_weight')}, CAST(SUM(articles) AS BIGINT) AS articles FROM holdings GROUP BY 1", "holdings")
register("d_portfolio", lambda s, d: holdings(s, d).groupBy("as_of_date").agg(F.sum(F.col("weight").isNull().cast("long")).alias("without_weight"), F.sum((F.coalesce("articles", F.lit(0)) == 0).cast("long")).alias("without_news"),
                                                                             F.sum(F.col("alpha").isNull().cast("long")).alias("without_alpha"), (F.sum("weight") < 0.999).alias("underinvested")),
         "SELECT as_of_date, COUNT(*) - COUNT(weight) AS without_weight, COUNT(*) - COUNT(articles) AS without_news, COUNT(*) - COUNT(alpha) AS without_alpha, SUM(weight) < 0.999 AS underinvested FROM holdings GROUP BY 1", "holdings")
register("d_weights_valid", lambda s, d: quality.weight_checks(cp.rule_weights(s, d), cp.picked(s, d), ["as_of_date", "method"]),
         """SELECT w.as_of_date, w.method, MIN(weight) >= 0 AS non_negative, MAX(weight) <= 1 AS at_most_one, SUM(weight) <= 1.000001 AS total_within_capital, SUM(weight) >= 0.999 AS fully_invested,
COUNT(p.ticker) = COUNT(*) AS subset_of_selection, COUNT(DISTINCT w.ticker) = COUNT(*) AS unique_holdings FROM rule_weights w LEFT JOIN brand_pick p ON p.as_of_date = w.as_of_date AND p.ticker = w.ticker GROUP BY 1, 2""", "rule_weights", "brand_pick")


def _reconcile(s, d):
    rows = cp.rule_weights(s, d)
    a, b = (rows.filter(F.col("method") == m) for m in ("equal_weight", "score_weighted"))
    return quality.reconciled(a, b.filter("weight > 0.2"), KEY).select(*KEY, "status")


register("d_reconcile", _reconcile,
         """SELECT as_of_date, ticker, CASE WHEN b.weight IS NULL THEN 'missing' WHEN a.weight IS NULL THEN 'unexpected' WHEN ABS(a.weight - b.weight) > 1e-8 THEN 'different' ELSE 'equal' END AS status
FROM (SELECT * FROM rule_weights WHERE method = 'equal_weight') a FULL JOIN (SELECT * FROM rule_weights WHERE method = 'score_weighted' AND weight > 0.2) b USING (as_of_date, ticker)""", "rule_weights")
register("d_result_shape", lambda s, d: cp.picked(s, d).select(*KEY).join(cp.rule_weights(s, d).filter("method = 'top_n_equal_weight'"), KEY, "left_anti"),
         "SELECT as_of_date, ticker FROM brand_pick ANTI JOIN (SELECT * FROM rule_weights WHERE method = 'top_n_equal_weight') t USING (as_of_date, ticker)", "brand_pick", "rule_weights")
register("d_split_record", lambda s, d: quality.split_record(cp.picked(s, d), ["universe_rank", "screen_rank"], SCORE_COLUMNS, ["gross_margin", "max_drawdown"]).select(*KEY, "ranks.universe_rank", rnd(F.col("scores")["value_score"], 3).alias("value_score"), rnd(F.col("metrics")["max_drawdown"], 5).alias("max_drawdown")),
         f"SELECT as_of_date, ticker, universe_rank, {r('value_score', 3, 'value_score')}, {r('max_drawdown', 5, 'max_drawdown')} FROM brand_pick", "brand_pick")
register("d_run_summary", lambda s, d: cp.rule_weights(s, d).groupBy("method").agg(F.count_distinct("as_of_date").alias("dates"), F.count("*").alias("positions"), F.count_distinct("ticker").alias("names")),
         "SELECT method, COUNT(DISTINCT as_of_date) AS dates, COUNT(*) AS positions, COUNT(DISTINCT ticker) AS names FROM rule_weights GROUP BY 1", "rule_weights")
register("d_research_bundle", lambda s, d: testbed.companies(s, d).select("ticker", "name").join(market_summary(s, d, [LAST]).select("ticker", *[rnd(c, n).alias(c) for c, n in MARKET_COLUMNS.items()]), "ticker", "left").join(_company(s, d), "ticker"),
         f"SELECT c.ticker, c.name, {', '.join(r(c, n, c) for c, n in MARKET_COLUMNS.items())}, w.warnings FROM companies c LEFT JOIN (SELECT * FROM market_asof WHERE as_of_date = DATE '{LAST}') m ON m.ticker = c.ticker JOIN ({COMPANY_SQL}) w ON w.ticker = c.ticker",
         "companies", "market_asof", "technicals_asof", "seen")


# --- nested contexts: arrays have no twin, tests check them -------------------

HOLDING_FIELDS = ["screen_rank", "ticker", "universe_rank", "overall_score", "alpha", "weight"]


def holding_evidence(s, d):
    rows = holdings(s, d).select(*KEY, "screen_rank", "universe_rank", "overall_score", "alpha", "weight")
    return contexts.holding_contexts(rows, news_ops.evidence(ct.chosen(s, d)), testbed.filings(s, d))


def _bundle(s, d):
    market = asof.latest_rows(price_panel(s, d, testbed.BRAND), [LAST]).select("ticker", *[rnd(c, n).alias(c) for c, n in MARKET_COLUMNS.items()])
    known = testbed.statements(s, d, testbed.BRAND).filter(F.col("filed_date") <= F.lit(LAST))
    names = market.select("ticker")
    evidence = contexts.holding_contexts(names.select(F.lit(LAST).alias("as_of_date"), "ticker"), news_ops.evidence(ct.chosen(s, d)), testbed.filings(s, d))
    return contexts.company_bundles(names, market, known, evidence)


register("d_holding_evidence", holding_evidence)
register("d_portfolio_evidence", lambda s, d: contexts.portfolio_contexts(holding_evidence(s, d), HOLDING_FIELDS))
register("d_company_bundle", _bundle)

# --- stored snapshots ----------------------------------------------------


def _snapshot(s, d):
    return market_summary(s, d).select(*KEY, *[rnd(c, n).alias(c) for c, n in MARKET_COLUMNS.items()])


def _written(s, d):
    path = f"{stored.shared_folder(s)}/snapshot-{uuid.uuid4().hex}"
    tables.write_snapshot(_snapshot(s, d), path)
    return path


SNAP = f"SELECT as_of_date, ticker, {', '.join(r(c, n, c) for c, n in MARKET_COLUMNS.items())} FROM market_asof"
register("snk_snapshot_write", lambda s, d: landed.read_snapshot(s, _written(s, d)), SNAP, "market_asof")
register("src_snapshot_read", lambda s, d: landed.read_snapshot(s, _written(s, d), AS_OF[1]), f"{SNAP} WHERE as_of_date = DATE '{AS_OF[1]}'", "market_asof")
ASOF = date(2000, 9, 15)
for _name in ("src_snapshot_asof", "j_asof_snapshot"):
    register(_name, lambda s, d: landed.latest_snapshot(_snapshot(s, d), ASOF), f"{SNAP} WHERE as_of_date = DATE '{AS_OF[2]}'", "market_asof")


register("snk_run_tables", lambda s, d: s.read.parquet(f"{cp.stored_run(s, d)}/weights").select(*KEY, "method", rnd("weight", 6).alias("weight")), f"SELECT as_of_date, ticker, method, {r('weight', 6, 'weight')} FROM rule_weights", "rule_weights")
register("src_saved_run", lambda s, d: landed.saved_selection(s, cp.stored_run(s, d), 2).select(*KEY, "screen_rank", "universe_rank"),
         "SELECT as_of_date, ticker, screen_rank, universe_rank FROM brand_pick WHERE screen_rank <= 2", "brand_pick")
register("t_period_cap", lambda s, d: top_k(testbed.statements(s, d), ["ticker"], [F.desc("period_end_date"), F.col("fiscal_period")], 20).select("ticker", "fiscal_year", "fiscal_period", "position"),
         "SELECT ticker, fiscal_year, fiscal_period, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end_date DESC, fiscal_period) AS position FROM statements QUALIFY position <= 20", "statements")

# --- streams -------------------------------------------------------------


def _paths(s, name):
    root = f"{stored.shared_folder(s)}/{name}-{uuid.uuid4().hex}"
    return f"{root}/table", f"{root}/checkpoint"


def _events(s, d):
    rows = ingest.file_stream(s, d, testbed.table(s, d, "events").schema, "events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))  # stored without zone, read as UTC


def _stream_prices(s, d):
    table, checkpoint = _paths(s, "prices")
    keyed = _events(s, d).select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("date").alias("date"), "event_id", "ts", F.col("value").alias("close"))
    first = ingest.first_seen(keyed, ["ticker", "date"], "ts", ["ts", "event_id"], ingest.PRICE_HORIZON, ingest.PRICE_DAYS)
    ingest.run_table(first, table, checkpoint)
    return s.read.parquet(table).select("ticker", "date", "event_id", "close")


def _stream_news(s, d):
    table, checkpoint = _paths(s, "news")
    keyed = _events(s, d).select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("url"), "event_id", "ts")
    first = ingest.first_seen(keyed, ["url"], "ts", ["ts", "event_id"], ingest.NEWS_HORIZON, ingest.NEWS_DAYS)
    ingest.run_table(first, table, checkpoint)
    return s.read.parquet(table).select("url", "event_id")


def _stream_bars(s, d):
    table, checkpoint = _paths(s, "bars")
    ingest.run_table(ingest.day_bars(_events(s, d), "event_type", "ts", "value"), table, checkpoint)
    done = s.read.parquet(table)
    return done.select("ticker", "date", *[rnd(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


register("z_ingest_prices", _stream_prices, """SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, event_id, value AS close FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""")
register("z_ingest_news", _stream_news, "SELECT CONCAT(event_type, '/', user_id) AS url, ARG_MIN(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
register("z_bars", _stream_bars, f"""SELECT event_type AS ticker, CAST(ts AS DATE) AS date, {r('ARG_MIN(value, (ts, event_id))', 4, 'open')}, {r('MAX(value)', 4, 'high')}, {r('MIN(value)', 4, 'low')},
{r('ARG_MAX(value, (ts, event_id))', 4, 'close')}, COUNT(*) AS volume FROM events GROUP BY 1, 2
HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT MAX(ts) - INTERVAL 1 DAY FROM events)""")


def _late(s, d):
    table, checkpoint = _paths(s, "late")
    ingest.run_with_quarantine(_events(s, d), table, f"{table}_quarantine", checkpoint, "ts", 7)
    return s.read.parquet(f"{table}_quarantine")


register("z_late", lambda s, d: _late(s, d).groupBy("event_type").agg(F.count("*").alias("late_rows")),
         "SELECT event_type, COUNT(*) AS late_rows FROM events WHERE ts < (SELECT MAX(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1")
