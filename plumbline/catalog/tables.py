"""Landed sources, table maintenance, lookups and company facts."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from plumbline.catalog.prices import AS_OF
from plumbline.catalog.twin import cte, r, register
from plumbline.functions.scalars import normal_ticker, rnd
from plumbline.operators import facts as facts_ops
from plumbline.operators import lookups
from plumbline.operators.ranking import ranked
from plumbline.sources import landed, tables, testbed
from plumbline.sources.keyed import KeyedTable
from plumbline.sources.stored import shared_folder

T = testbed.table
bars, news, filings, companies, statements = (
    testbed.bars, testbed.news, testbed.filings, testbed.companies, testbed.statements,
)
NEWS_AS_OF = date(2000, 10, 31)
FILING_AS_OF = date(2000, 6, 30)

BAR = ["ticker", "date", "open", "high", "low", "close", "adjusted_close", "volume"]
ART = ["news_article_id", "ticker", "source", "url", "published_on"]
FIL = ["filing_id", "ticker", "filing_type", "filing_date", "accession_number"]
STM = ["ticker", "fiscal_year", "fiscal_period", "period_end_date", "filed_date", "revenue", "net_income"]


def plain(name, build, columns, source, *ctes):
    """Twin: the same columns straight from `source`."""
    register(name, lambda s, d: build(s, d).select(*columns), f"SELECT {', '.join(columns)} FROM {source}", *(ctes or (source,)))


# --- 2.1 sources ---------------------------------------------------------


def _provider_bars(s, d):
    names = {ours: theirs for theirs, ours in landed.PRICE_COLUMNS.items()}
    rows = bars(s, d).withColumn("ticker", F.concat(F.lit(" "), F.lower("ticker")))
    return rows.withColumnsRenamed(names)


register("src_price_bars", lambda s, d: landed.price_bars(_provider_bars(s, d)),
         "SELECT UPPER(ticker) AS ticker, date, open, high, low, close, adjusted_close, volume, shares_outstanding FROM bars", "bars")


def _provider_companies(s, d):
    rows = companies(s, d)
    return rows.select(
        F.lower("ticker").alias("ticker"),
        F.when(F.col("company_id") % 3 == 0, F.col("name")).alias("long_name"),
        F.when(F.col("company_id") % 3 == 1, F.concat(F.col("name"), F.lit(" Inc"))).alias("short_name"),
        "sector", "industry", "exchange_code",
    )


EXCHANGE_SQL = "CASE exchange_code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in landed.EXCHANGES.items()) + " ELSE exchange_code END"
register("src_company", lambda s, d: landed.company_rows(_provider_companies(s, d)),
         f"""SELECT ticker, CASE company_id % 3 WHEN 0 THEN name WHEN 1 THEN CONCAT(name, ' Inc') ELSE LOWER(ticker) END AS name,
sector, industry, {EXCHANGE_SQL} AS exchange FROM companies""", "companies")
register("src_exchange_map",
         lambda s, d: companies(s, d).groupBy(landed.exchange_name("exchange_code").alias("exchange")).agg(F.count("*").alias("companies")),
         f"SELECT {EXCHANGE_SQL} AS exchange, COUNT(*) AS companies FROM companies GROUP BY 1", "companies")


def _ticker_lines(s, d):
    return companies(s, d).select(
        F.to_json(F.struct(F.lower("ticker").alias("ticker"), F.col("company_id").cast("long").alias("cik_str"))).alias("value")
    )


register("src_ticker_cik", lambda s, d: landed.ticker_ciks(_ticker_lines(s, d)), "SELECT ticker, cik FROM companies", "companies")

# company facts: tag -> (metric expression over a statement row, unit)
FACT_TAGS = {
    "Revenues": ("CASE WHEN fiscal_year % 2 = 0 THEN revenue END", "USD"),
    "SalesRevenueNet": ("revenue * 0.99D", "USD"),
    "NetIncomeLoss": ("net_income", "USD"),
    "GrossProfit": ("gross_profit", "USD"),
    "Assets": ("total_assets", "USD"),
    "CashAndCashEquivalentsAndShortTermInvestments": ("cash_and_equivalents", "USD"),
    "NetCashProvidedByUsedInOperatingActivities": ("operating_cash_flow", "USD"),
    "PaymentsToAcquireProductiveAssets": ("capital_expenditures", "USD"),
    "CommercialPaper": ("total_debt * 0.25D", "USD"),
    "LongTermDebtNoncurrent": ("total_debt * 0.5D", "USD"),
    "WeightedAverageNumberOfSharesOutstandingBasic": ("weighted_average_shares", "shares"),
}
# variants of one fact: (fiscal-year shift, months covered, filing delay, factor)
FACT_VARIANTS = {
    "first": ("0", "CASE fiscal_period WHEN 'FY' THEN 12 ELSE 3 END", "45", "1.0D"),
    "year to date": ("0", "12", "45", "2.0D"),
    "amended": ("0", "CASE fiscal_period WHEN 'FY' THEN 12 ELSE 3 END", "120", "1.01D"),
    "comparative": ("1", "CASE fiscal_period WHEN 'FY' THEN 12 ELSE 3 END", "410", "1.0D"),
}


def fact_rows(s, d):
    rows = statements(s, d)
    items = [
        F.struct(
            F.lit(tag).alias("tag"), F.lit(unit).alias("unit"), F.lit(v).cast("int").alias("variant"),
            F.expr(f"fiscal_year + {shift}").alias("fy"), F.col("fiscal_period").alias("fp"),
            F.expr(f"add_months(period_end_date, -({months}))").alias("start"),
            F.col("period_end_date").alias("end"),
            F.expr(f"date_add(period_end_date, {delay})").alias("filed"),
            F.expr(f"({expr}) * {factor}").alias("val"),
        )
        for tag, (expr, unit) in FACT_TAGS.items()
        for v, (shift, months, delay, factor) in enumerate(FACT_VARIANTS.values())
    ]
    return rows.select(F.lpad(F.regexp_extract("ticker", "[0-9]+", 0), 10, "0").alias("cik"), F.explode(F.array(*items)).alias("f")).select("cik", "f.*").filter(
        F.col("val").isNotNull()
    )


def fact_files(s, d):
    """One JSON document per company, as landed: a filer's own statements."""
    fact = F.struct("fy", "fp", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"),
                    F.col("filed").cast("string").alias("filed"), "val")
    ordered = F.array_sort(F.collect_list(F.struct("end", "variant", fact.alias("fact"))))
    by_tag = fact_rows(s, d).groupBy("cik", "tag", "unit").agg(F.transform(ordered, lambda x: x["fact"]).alias("facts"))
    body = F.struct(F.create_map("unit", "facts").alias("units"))
    by_cik = by_tag.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", body))).alias("tags"))
    return by_cik.select("cik", F.to_json(F.create_map(F.lit("us-gaap"), "tags")).alias("facts"))


def _fact_sql():
    parts = []
    for tag, (expr, unit) in FACT_TAGS.items():
        for v, (shift, months, delay, factor) in enumerate(FACT_VARIANTS.values()):
            parts.append(
                f"SELECT LPAD(REGEXP_EXTRACT(ticker, '[0-9]+'), 10, '0') AS cik, '{tag}' AS tag, '{unit}' AS unit, {v} AS variant, "
                f"fiscal_year + {shift} AS fy, fiscal_period AS fp, "
                f"CAST(period_end_date - INTERVAL 1 MONTH * ({months}) AS DATE) AS start, "
                f"period_end_date AS \"end\", CAST(period_end_date + {delay} AS DATE) AS filed, ({expr}) * {factor} AS val FROM statements"
            )
    import re

    sql = re.sub(r"(\d)D\b", r"\1", " UNION ALL ".join(parts))
    return f"""SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY cik, tag, unit ORDER BY "end", variant, fp, fy) - 1 AS INTEGER) AS pos
FROM ({sql}) f WHERE val IS NOT NULL"""


cte("fact_rows", _fact_sql(), "statements")


def parsed_facts(s, d):
    return landed.explode_facts(fact_files(s, d))


register("src_facts_explode",
         lambda s, d: parsed_facts(s, d).select("cik", "tag", "unit", "fy", "fp", "start", "end", "filed", rnd("val", 2).alias("val")),
         f"SELECT cik, tag, unit, fy, fp, start, \"end\", filed, {r('val', 2, 'val')} FROM fact_rows", "fact_rows")



def _landed_with_broken(s, d):
    """Every tenth company's document arrives cut in half."""
    cut = F.col("cik").cast("bigint") % 10 == 0
    half = F.col("facts").substr(F.lit(1), F.expr("int(length(facts) / 2)"))
    return fact_files(s, d).withColumn("facts", F.when(cut, half).otherwise(F.col("facts")))


register("src_facts_quarantine", lambda s, d: landed.broken_documents(_landed_with_broken(s, d), "facts").select("cik"),
         "SELECT DISTINCT cik FROM fact_rows WHERE CAST(cik AS BIGINT) % 10 = 0", "fact_rows")

REV = "('Revenues', 'SalesRevenueNet', 'RevenueFromContractWithCustomerExcludingAssessedTax')"
cte("periods", f"""SELECT cik, fy, fp, "end", filed FROM (
 SELECT * FROM fact_rows WHERE unit = 'USD' AND tag IN {REV}
 QUALIFY ROW_NUMBER() OVER (PARTITION BY cik, fp, "end" ORDER BY CASE WHEN fy = YEAR("end") THEN 0 ELSE 1 END,
   CASE tag WHEN 'Revenues' THEN 0 WHEN 'SalesRevenueNet' THEN 1 ELSE 2 END, pos) = 1) p
QUALIFY ROW_NUMBER() OVER (PARTITION BY cik ORDER BY "end" DESC, fp) <= 20""", "fact_rows")
cte("picked", """SELECT f.* FROM fact_rows f SEMI JOIN periods p ON p.cik = f.cik AND p.fy = f.fy AND p.fp = f.fp AND p."end" = f."end"
QUALIFY ROW_NUMBER() OVER (PARTITION BY f.cik, f.fy, f.fp, f."end", f.tag
 ORDER BY CASE WHEN f.fp <> 'FY' AND f.unit = 'USD' THEN DATE_DIFF('day', start, f."end") ELSE 0 END, filed DESC, pos) = 1""", "fact_rows", "periods")


def _one(tag):
    return f"MAX(CASE WHEN tag = '{tag}' THEN val END)"


cte("wide_facts", f"""SELECT p.cik, p.fy AS fiscal_year, p.fp AS fiscal_period, p."end" AS period_end_date, p.filed AS filed_date,
 COALESCE({_one('Revenues')}, {_one('SalesRevenueNet')}) AS revenue, {_one('NetIncomeLoss')} AS net_income,
 {_one('GrossProfit')} AS gross_profit, {_one('Assets')} AS total_assets,
 {_one('CashAndCashEquivalentsAndShortTermInvestments')} AS cash_and_equivalents,
 {_one('NetCashProvidedByUsedInOperatingActivities')} AS operating_cash_flow,
 {_one('PaymentsToAcquireProductiveAssets')} AS capital_expenditures,
 {_one('NetCashProvidedByUsedInOperatingActivities')} - ABS({_one('PaymentsToAcquireProductiveAssets')}) AS free_cash_flow,
 SUM(CASE WHEN tag IN ('CommercialPaper', 'LongTermDebtNoncurrent') THEN val END) AS total_debt,
 {_one('WeightedAverageNumberOfSharesOutstandingBasic')} AS weighted_average_shares
FROM periods p LEFT JOIN picked f ON p.cik = f.cik AND p.fy = f.fy AND p.fp = f.fp AND p."end" = f."end"
GROUP BY ALL""", "periods", "picked")
PKEY = ["cik", "fiscal_year", "fiscal_period", "period_end_date"]
plain("f_periods", lambda s, d: facts_ops.reporting_periods(parsed_facts(s, d)).withColumnRenamed("end", "period_end"),
      ["cik", "fy", "fp", "period_end", "filed"], '(SELECT *, "end" AS period_end FROM periods) p', "periods")
register("f_fact_pick",
         lambda s, d: (lambda f: facts_ops.picked_facts(f, facts_ops.reporting_periods(f)).select("cik", "fy", "fp", "tag", F.col("end").alias("period_end"), rnd("val", 2).alias("val")))(parsed_facts(s, d)),
         f"SELECT cik, fy, fp, tag, \"end\" AS period_end, {r('val', 2, 'val')} FROM picked", "picked")


def facts_query(name, columns):
    register(name, lambda s, d: facts_ops.statement_rows(parsed_facts(s, d)).select(*PKEY, *[rnd(c, 2).alias(c) for c in columns]),
             f"SELECT {', '.join(PKEY)}, {', '.join(r(c, 2, c) for c in columns)} FROM wide_facts", "wide_facts")


facts_query("f_tag_priority", ["revenue", "cash_and_equivalents", "capital_expenditures"])
facts_query("f_total_debt", ["total_debt"])
facts_query("f_shares", ["weighted_average_shares"])
facts_query("f_fcf", ["operating_cash_flow", "capital_expenditures", "free_cash_flow"])
facts_query("f_statement_pivot", ["revenue", "net_income", "gross_profit", "total_assets", "cash_and_equivalents", "total_debt", "free_cash_flow", "weighted_average_shares"])

# submissions: landed in files of at most 100 filings each
CHUNK = 100


def _submissions(s, d):
    rows = filings(s, d).withColumn("chunk", F.floor(F.col("filing_id") / CHUNK))
    ordered = F.array_sort(F.collect_list(F.struct("filing_id", "filing_type", F.col("filing_date").cast("string").alias("filing_date"), "accession_number")))
    return rows.groupBy("ticker", "chunk").agg(ordered.alias("f")).select(
        "ticker", "chunk", F.col("f.filing_type").alias("form"), F.col("f.filing_date").alias("filingDate"),
        F.col("f.accession_number").alias("accessionNumber"),
        F.transform("f", lambda x: F.concat(F.lit("d"), x["filing_id"].cast("string"), F.lit(".htm"))).alias("primaryDocument"),
    )


register("src_submissions_zip", lambda s, d: landed.zip_submissions(_submissions(s, d)),
         f"""SELECT ticker, filing_id // {CHUNK} AS chunk, ROW_NUMBER() OVER (PARTITION BY ticker, filing_id // {CHUNK} ORDER BY filing_id) - 1 AS pos,
filing_type, filing_date, accession_number, CONCAT('d', filing_id, '.htm') AS primary_document FROM filings""", "filings")
LIMIT_SQL = "CASE filing_type WHEN '10-K' THEN 3 WHEN '10-Q' THEN 4 WHEN '8-K' THEN 8 END"
register("src_form_limits",
         lambda s, d: landed.within_form_limits(landed.zip_submissions(_submissions(s, d)), [F.col("chunk"), F.col("pos")], landed.INGEST_FORM_LIMITS)
         .select("ticker", "filing_type", "form_position", "accession_number", "filing_date"),
         f"""SELECT ticker, filing_type, ROW_NUMBER() OVER w AS form_position, accession_number, filing_date FROM filings
WINDOW w AS (PARTITION BY ticker, filing_type ORDER BY filing_id) QUALIFY ROW_NUMBER() OVER w <= {LIMIT_SQL}""", "filings")
register("src_filing_url",
         lambda s, d: filings(s, d).select("filing_id", landed.filing_url(F.lpad(F.col("filing_id").cast("string"), 10, "0"), F.col("accession_number"), F.lit("main.htm")).alias("filing_url")),
         f"SELECT filing_id, CONCAT('{landed.FILING_HOST}', filing_id, '/', REPLACE(accession_number, '-', ''), '/main.htm') AS filing_url FROM filings", "filings")


def _html_sql(column):
    out = f"REGEXP_REPLACE({column}, '<(script|style)\\b.*?</(script|style)\\s*>', ' ', 'gsi')"
    out = f"REGEXP_REPLACE({out}, '<!--.*?-->', ' ', 'gs')"
    out = f"REGEXP_REPLACE({out}, '<[^>]*>', ' ', 'gs')"
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"REPLACE({out}, '{entity}', '{char}')"
    return f"TRIM(REGEXP_REPLACE({out}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


register("src_html_text", lambda s, d: T(s, d, "pages").select("page_id", landed.html_text(F.col("html")).alias("text")),
         f"SELECT page_id, {_html_sql('html')} AS text FROM pages")


def _news_lines(s, d):
    return news(s, d).select(
        "news_article_id", "ticker",
        F.to_json(F.struct(F.col("title").alias("headline"), "source", (F.unix_date("published_on") * 86400 + 3600).alias("datetime"), "url", "summary")).alias("value"),
    )


register("src_news_json",
         lambda s, d: landed.news_rows(_news_lines(s, d)),
         "SELECT news_article_id, ticker, title, source, CAST(published_on AS TIMESTAMP) + INTERVAL 1 HOUR AS published_at, url, summary FROM news", "news")


def _listing(s, d, table, key, name, exchange):
    rows = T(s, d, table)
    symbol = F.concat(F.lit("t."), (F.col(key) % 2000).cast("string"))
    line = F.concat_ws("|", symbol, F.col(name), F.lit(exchange),
                       F.when(F.col(key) % 9 == 4, "Y").otherwise("N"), F.when(F.col(key) % 13 == 5, "Y").otherwise("N"))
    lines = rows.select(F.col(key).alias("line"), line.alias("value"))
    return landed.listed_symbols(lines.union(lines.limit(1).selectExpr("-1L AS line", "'File Creation Time: 1||||' AS value"))).withColumn("line", F.col("line").cast("long"))


def _listings(s, d):
    return landed.union_listings(_listing(s, d, "supplier", "s_suppkey", "s_name", "NASDAQ"), _listing(s, d, "part", "p_partkey", "p_name", "NYSE"), "line")


def _listing_sql(table, key, name, exchange, source):
    return f"""SELECT CONCAT('T-', {key} % 2000) AS ticker, {name} AS security_name, '{exchange}' AS exchange, CASE WHEN {key} % 9 = 4 THEN 'Y' ELSE 'N' END AS etf,
CASE WHEN {key} % 13 = 5 THEN 'Y' ELSE 'N' END AS test_issue, {key} AS line, {source} AS source FROM {table}"""


cte("listing_a", _listing_sql("supplier", "s_suppkey", "s_name", "NASDAQ", 0))
cte("listing_b", _listing_sql("part", "p_partkey", "p_name", "NYSE", 1))
cte("listings", "SELECT * FROM (SELECT * FROM listing_a UNION ALL SELECT * FROM listing_b) u QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY source, line) = 1", "listing_a", "listing_b")
LIST = ["ticker", "security_name", "exchange", "etf", "test_issue"]
plain("src_listed_symbols", lambda s, d: _listing(s, d, "part", "p_partkey", "p_name", "NYSE"), ["line", *LIST], "listing_b")
plain("s_union_listings", _listings, LIST, "listings")
plain("q_listing_flags", lambda s, d: _listings(s, d).filter(landed.is_plain_listing()), LIST, "listings WHERE etf = 'N' AND test_issue = 'N'", "listings")
BLOCKED_SQL = "NOT (" + " OR ".join(f"CONTAINS(UPPER(p_name), '{t}')" for t in landed.BLOCKED_NAME_TERMS) + ")"
register("q_common_stock", lambda s, d: T(s, d, "part").filter(landed.is_common_stock(F.col("p_name"))).select("p_partkey", "p_name"),
         f"SELECT p_partkey, p_name FROM part WHERE {BLOCKED_SQL}")

# market value per ticker from its last bar
cte("last_bars", "SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY date DESC) = 1", "bars")


def _last_bars(s, d):
    return lookups.latest(bars(s, d), "ticker", ["date"])


register("q_eligible_universe",
         lambda s, d: _last_bars(s, d).withColumn("market_cap", F.col("close") * F.col("shares_outstanding")).filter("close >= 2 AND market_cap >= 300000000")
         .select("ticker", "close", rnd("market_cap", 0).alias("market_cap")),
         f"SELECT ticker, close, {r('close * shares_outstanding', 0, 'market_cap')} FROM last_bars WHERE close >= 2 AND close * shares_outstanding >= 300000000", "last_bars")


def _universe_csv(s, d):
    """Tickers of a list with market caps, largest first; position carries the order."""
    caps = _last_bars(s, d).select(F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), (F.col("close") * F.col("shares_outstanding")).alias("market_cap"))
    named = caps.select(normal_ticker("ticker").alias("ticker"), F.lit("all").alias("list"), "market_cap").filter(F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    return ranked(named, ["list"], "market_cap", "ticker", "position").select("ticker", "position")


register("src_universe_csv", _universe_csv, "SELECT UPPER(ticker) AS ticker, ROW_NUMBER() OVER (ORDER BY close * shares_outstanding DESC NULLS LAST, MD5(UPPER(ticker)), UPPER(ticker)) AS position FROM last_bars", "last_bars")
register("src_index_members", lambda s, d: T(s, d, "supplier").select(F.translate(normal_ticker(F.concat(F.lit("m."), F.col("s_suppkey").cast("string"))), ".", "-").alias("ticker")),
         "SELECT CONCAT('M-', s_suppkey) AS ticker FROM supplier")

# --- 2.2 table maintenance -----------------------------------------------

STORED_UNTIL, LANDED_FROM = date(2000, 7, 1), date(2000, 5, 1)
cte("stored_news", f"SELECT * FROM news WHERE published_on < DATE '{STORED_UNTIL}' QUALIFY ROW_NUMBER() OVER (PARTITION BY url ORDER BY news_article_id) = 1", "news")
cte("landed_news", f"SELECT * FROM news WHERE published_on >= DATE '{LANDED_FROM}'", "news")
cte("fresh_news", """SELECT * FROM landed_news WHERE url NOT IN (SELECT url FROM stored_news)
QUALIFY ROW_NUMBER() OVER (PARTITION BY url ORDER BY news_article_id) = 1""", "stored_news", "landed_news")


def _stored_news(s, d):
    return tables.first_per_key(news(s, d).filter(F.col("published_on") < F.lit(STORED_UNTIL)), ["url"], ["news_article_id"])


def _landed_news(s, d):
    return news(s, d).filter(F.col("published_on") >= F.lit(LANDED_FROM))


plain("snk_insert_news", lambda s, d: tables.insert_if_absent(_stored_news(s, d), _landed_news(s, d), ["url"], ["news_article_id"]), ART, "fresh_news")
plain("snk_in_batch_dup", lambda s, d: tables.first_per_key(_landed_news(s, d), ["url"], ["news_article_id"]), ART,
      "landed_news QUALIFY ROW_NUMBER() OVER (PARTITION BY url ORDER BY news_article_id) = 1", "landed_news")
plain("j_not_in_set", lambda s, d: _landed_news(s, d).join(_stored_news(s, d).select("url"), "url", "left_anti"), ART,
      "landed_news WHERE url NOT IN (SELECT url FROM stored_news)", "landed_news", "stored_news")
register("snk_refresh_counts", lambda s, d: tables.refresh_counts(_stored_news(s, d), _landed_news(s, d), ["url"], ["source"]),
         """SELECT source, CAST(SUM(f) AS BIGINT) AS fetched, CAST(SUM(b) AS BIGINT) AS stored_before, CAST(SUM(n) AS BIGINT) AS new_rows, CAST(SUM(b) + SUM(n) AS BIGINT) AS stored_after FROM (
 SELECT source, 1 AS f, 0 AS b, 0 AS n FROM landed_news UNION ALL SELECT source, 0, 1, 0 FROM stored_news
 UNION ALL SELECT source, 0, 0, 1 FROM fresh_news) u GROUP BY source""", "landed_news", "stored_news", "fresh_news")

PRICE_CUT, PRICE_FROM = date(1999, 1, 1), date(1998, 6, 1)


def _insert_prices(s, d):
    rows = bars(s, d)
    stored, landing = rows.filter(F.col("date") < F.lit(PRICE_CUT)), rows.filter(F.col("date") >= F.lit(PRICE_FROM))
    # the landing repeats every bar with a later, different close
    twice = landing.withColumn("seq", F.lit(0)).unionByName(landing.withColumn("seq", F.lit(1)).withColumn("close", F.col("close") + 1))
    return tables.insert_if_absent(stored.withColumn("seq", F.lit(0)), twice, ["ticker", "date"], ["seq"], within="date")


plain("snk_insert_prices", _insert_prices, BAR, f"bars WHERE date >= DATE '{PRICE_CUT}'", "bars")


def _insert_financials(s, d):
    rows = statements(s, d)
    stored = rows.filter("fiscal_year < 1999 AND fiscal_period <> 'FY'")
    return tables.insert_if_absent(stored, rows, ["ticker", "period_end_date", "fiscal_period"], ["filed_date"], within="period_end_date")


plain("snk_insert_financials", _insert_financials, STM, "statements WHERE NOT (fiscal_year < 1999 AND fiscal_period <> 'FY')", "statements")


def _upserted(s, name, before, landing, keys, order, present=None):
    """Load a keyed table, then bring in what has landed; only the buckets of its keys are written again."""
    table = KeyedTable(s, f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}", keys, buckets=8)
    table.upsert(before, order)
    table.upsert(landing, order, present)
    return table.read()


def _upsert_filings(s, d):
    rows = filings(s, d).drop("raw_text")
    stored = rows.filter("filing_date < DATE '2000-01-01'")
    landing = rows.filter("filing_date >= DATE '1999-10-01'").withColumn("filing_type", F.concat("filing_type", F.lit("/A")))
    return _upserted(s, "filings", stored, landing, ["accession_number"], ["filing_date"])


register("snk_upsert_filings", lambda s, d: _upsert_filings(s, d).select(*FIL),
         """SELECT filing_id, ticker, CASE WHEN filing_date >= DATE '1999-10-01' THEN CONCAT(filing_type, '/A') ELSE filing_type END AS filing_type,
filing_date, accession_number FROM filings""", "filings")


def _upsert_company(s, d):
    rows = companies(s, d).drop("company_id")
    landing = rows.filter("sector <> 'ASIA'").withColumns({"name": F.concat("name", F.lit(" (new)")), "cik": F.lit(None).cast("string")})
    # a refresh that does not know the identifier does not set it
    known = F.array(*[F.lit(c) for c in landing.columns if c not in ("ticker", "cik")])
    return _upserted(s, "companies", rows, landing.withColumn("known", known), ["ticker"], ["name"], "known")


register("snk_upsert_company", _upsert_company,
         """SELECT ticker, CASE WHEN sector <> 'ASIA' THEN CONCAT(name, ' (new)') ELSE name END AS name, sector, industry, exchange_code, cik FROM companies""", "companies")
plain("snk_require_company", lambda s, d: tables.with_parent(bars(s, d), companies(s, d), "ticker"), BAR, "bars SEMI JOIN companies USING (ticker)", "bars", "companies")
plain("snk_quarantine", lambda s, d: tables.orphans(bars(s, d), companies(s, d), "ticker"), BAR, "bars ANTI JOIN companies USING (ticker)", "bars", "companies")
register("snk_ingest_log",
         lambda s, d: lookups.universe_status(companies(s, d), bars(s, d), statements(s, d)).select("ticker", F.when(F.col("complete"), "skipped").otherwise("stored").alias("status"), "price_rows", "financial_rows"),
         """SELECT ticker, CASE WHEN COALESCE(p.n, 0) > 0 AND COALESCE(f.n, 0) > 0 THEN 'skipped' ELSE 'stored' END AS status, COALESCE(p.n, 0) AS price_rows, COALESCE(f.n, 0) AS financial_rows
FROM companies c LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM bars GROUP BY 1) p USING (ticker) LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM statements GROUP BY 1) f USING (ticker)""", "companies", "bars", "statements")
register("q_universe_status", lambda s, d: lookups.universe_status(companies(s, d), bars(s, d), statements(s, d)),
         """SELECT ticker, COALESCE(p.n, 0) AS price_rows, COALESCE(f.n, 0) AS financial_rows, COALESCE(p.n, 0) > 0 AND COALESCE(f.n, 0) > 0 AS complete
FROM companies c LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM bars GROUP BY 1) p USING (ticker) LEFT JOIN (SELECT ticker, COUNT(*) AS n FROM statements GROUP BY 1) f USING (ticker)""", "companies", "bars", "statements")

# --- 2.3 lookups ---------------------------------------------------------


def _requests(s, d):
    """Tickers as asked for by callers: every traded one, untidy and repeated."""
    return testbed.trades(s, d).select(F.concat(F.lit("  "), F.lower("ticker"), F.lit(" ")).alias("ticker"))


COM = ["company_id", "ticker", "name", "sector", "industry", "cik"]
ASKED = "companies WHERE ticker IN (SELECT ticker FROM trades)"
plain("q_company_by_ticker", lambda s, d: lookups.requested(companies(s, d), _requests(s, d)), COM, ASKED, "companies", "trades")
plain("q_company_id", lambda s, d: lookups.requested(companies(s, d), _requests(s, d)), ["ticker", "company_id"], ASKED, "companies", "trades")
register("q_company_exists", lambda s, d: lookups.exists_flags(companies(s, d).filter("sector <> 'ASIA'"), _requests(s, d)),
         "SELECT DISTINCT ticker, ticker IN (SELECT ticker FROM companies WHERE sector <> 'ASIA') AS known FROM trades", "companies", "trades")
plain("q_company_by_id", lambda s, d: companies(s, d).join(T(s, d, "lineitem").select(F.col("l_suppkey").alias("company_id")).distinct(), "company_id", "left_semi"), COM,
      "companies WHERE company_id IN (SELECT l_suppkey FROM lineitem)", "companies")
plain("q_companies_all", lambda s, d: companies(s, d).orderBy("ticker"), COM, "companies")
plain("q_companies_by_sector", lambda s, d: companies(s, d).filter(F.col("sector") == "EUROPE").orderBy("ticker"), COM, "companies WHERE sector = 'EUROPE'", "companies")
plain("q_prices_all", lambda s, d: bars(s, d).repartition("ticker").sortWithinPartitions("ticker", F.desc("date")), BAR, "bars")
plain("q_price_latest", _last_bars, BAR, "last_bars")
plain("q_prices_between", lambda s, d: lookups.between(bars(s, d), "date", date(1998, 1, 1), date(1999, 12, 31)), BAR, "bars WHERE date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'", "bars")
plain("q_prices_recent", lambda s, d: lookups.recent(bars(s, d), "date", AS_OF[-1], 90), BAR, f"bars WHERE date BETWEEN DATE '{AS_OF[-1]}' - 90 AND DATE '{AS_OF[-1]}'", "bars")
plain("q_price_count", lambda s, d: lookups.counts(bars(s, d), "ticker"), ["ticker", "row_count"], "(SELECT ticker, COUNT(*) AS row_count FROM bars GROUP BY ticker) c", "bars")
plain("q_pit_prices", lambda s, d: lookups.known_by(bars(s, d), "date", AS_OF[1]), BAR, f"bars WHERE date <= DATE '{AS_OF[1]}'", "bars")
plain("q_fin_all", lambda s, d: statements(s, d).repartition("ticker").sortWithinPartitions("ticker", F.desc("period_end_date")), STM, "statements")
plain("q_fin_latest", lambda s, d: lookups.latest(statements(s, d), "ticker", ["period_end_date", "fiscal_period"]), STM,
      "statements QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY period_end_date DESC, fiscal_period DESC) = 1", "statements")
plain("q_fin_between_years", lambda s, d: lookups.between(statements(s, d), "fiscal_year", 1997, 1999), STM, "statements WHERE fiscal_year BETWEEN 1997 AND 1999", "statements")
plain("q_fin_count", lambda s, d: lookups.counts(statements(s, d), "ticker"), ["ticker", "row_count"], "(SELECT ticker, COUNT(*) AS row_count FROM statements GROUP BY ticker) c", "statements")
plain("q_filings_all", lambda s, d: filings(s, d).repartition("ticker").sortWithinPartitions("ticker", F.desc("filing_date")), FIL, "filings")
def new_fil():
    return [F.desc("filing_date"), F.desc("filing_id")]


plain("q_filing_latest", lambda s, d: lookups.latest(filings(s, d).drop("raw_text"), "ticker", ["filing_date", "filing_id"]), FIL,
      "filings QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) = 1", "filings")
plain("q_filings_by_type", lambda s, d: filings(s, d).filter(F.col("filing_type") == "10-K"), FIL, "filings WHERE filing_type = '10-K'", "filings")
plain("q_filings_recent", lambda s, d: lookups.recent(filings(s, d), "filing_date", FILING_AS_OF, 120), FIL, f"filings WHERE filing_date BETWEEN DATE '{FILING_AS_OF}' - 120 AND DATE '{FILING_AS_OF}'", "filings")
plain("q_filing_by_accession", lambda s, d: filings(s, d).join(T(s, d, "labels").select(F.concat(F.lit("acc-"), F.col("doc_id").cast("string")).alias("accession_number")).distinct(), "accession_number", "left_semi"), FIL,
      "filings WHERE accession_number IN (SELECT CONCAT('acc-', doc_id) FROM labels)", "filings")
plain("q_pit_filings", lambda s, d: lookups.newest(lookups.known_by(filings(s, d).drop("raw_text"), "filing_date", FILING_AS_OF), ["ticker"], new_fil(), 20), [*FIL, "position"],
      f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) AS position FROM filings WHERE filing_date <= DATE '{FILING_AS_OF}') p WHERE position <= 20", "filings")
plain("q_filings_by_type_pit", lambda s, d: lookups.known_by(filings(s, d).filter("filing_type = '8-K'"), "filing_date", FILING_AS_OF), FIL, f"filings WHERE filing_type = '8-K' AND filing_date <= DATE '{FILING_AS_OF}'", "filings")
plain("q_filing_latest_pit", lambda s, d: lookups.latest(lookups.known_by(filings(s, d).drop("raw_text"), "filing_date", FILING_AS_OF), "ticker", ["filing_date", "filing_id"]), FIL,
      f"(SELECT * FROM filings WHERE filing_date <= DATE '{FILING_AS_OF}') p QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY filing_date DESC, filing_id DESC) = 1", "filings")
plain("q_drop_heavy", lambda s, d: filings(s, d).drop("raw_text"), FIL, "filings")


def _children(s, d):
    """Child rows per company key, summed before the join so a hot key is one row."""
    lines = T(s, d, "lineitem")
    return lines.groupBy(F.col("l_suppkey").alias("company_id")).agg(
        F.count("*").alias("child_rows"), rnd(F.sum("l_quantity"), 1).alias("quantity")
    )


# filings carry the ticker's number, companies the ticker: the join gives each filing its company
register("q_filing_with_ticker",
         lambda s, d: filings(s, d).withColumn("company_id", F.regexp_extract("ticker", "[0-9]+", 0).cast("bigint"))
         .select("filing_id", "filing_type", "filing_date", "company_id")
         .join(companies(s, d).select("company_id", "ticker"), "company_id").select("filing_id", "filing_type", "filing_date", "ticker"),
         "SELECT filing_id, filing_type, filing_date, c.ticker FROM filings f JOIN companies c ON c.company_id = CAST(REGEXP_EXTRACT(f.ticker, '[0-9]+') AS BIGINT)", "filings", "companies")
register("j_company_fk",
         lambda s, d: _children(s, d).join(companies(s, d), "company_id").select("ticker", "sector", "child_rows", "quantity"),
         f"SELECT ticker, sector, COUNT(*) AS child_rows, {r('SUM(l_quantity)', 1, 'quantity')} FROM lineitem JOIN companies ON company_id = l_suppkey GROUP BY ticker, sector", "companies")
plain("j_in_set", lambda s, d: bars(s, d).join(companies(s, d).filter("sector = 'EUROPE'").select("ticker"), "ticker", "left_semi"), BAR, "bars WHERE ticker IN (SELECT ticker FROM companies WHERE sector = 'EUROPE')", "bars", "companies")

def new_art():
    return [F.desc_nulls_first("published_on"), F.desc("news_article_id")]


plain("q_news_all", lambda s, d: news(s, d).repartition("ticker").sortWithinPartitions("ticker", *new_art()), ART, "news")
plain("q_news_recent", lambda s, d: lookups.recent(news(s, d), "published_on", NEWS_AS_OF, 30), ART, f"news WHERE published_on BETWEEN DATE '{NEWS_AS_OF}' - 30 AND DATE '{NEWS_AS_OF}'", "news")
plain("q_news_latest", lambda s, d: lookups.newest(news(s, d).drop("raw_text"), ["ticker"], new_art(), 5), [*ART, "position"],
      "(SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_on DESC NULLS FIRST, news_article_id DESC) AS position FROM news) n WHERE position <= 5", "news")
plain("q_news_by_source", lambda s, d: news(s, d).filter("source = 'src3'"), ART, "news WHERE source = 'src3'", "news")
plain("q_news_by_url", lambda s, d: news(s, d).join(_stored_news(s, d).select("url"), "url", "left_semi"), ART, "news WHERE url IN (SELECT url FROM stored_news)", "news", "stored_news")
plain("q_news_count", lambda s, d: lookups.counts(news(s, d), "ticker"), ["ticker", "row_count"], "(SELECT ticker, COUNT(*) AS row_count FROM news GROUP BY ticker) c", "news")
plain("q_news_search", lambda s, d: lookups.search(news(s, d), "Revenue", ["title", "summary"]), ART, "news WHERE title ILIKE '%revenue%' OR summary ILIKE '%revenue%'", "news")
plain("q_pit_news", lambda s, d: lookups.known_by(news(s, d), "published_on", NEWS_AS_OF, 90), ART, f"news WHERE published_on BETWEEN DATE '{NEWS_AS_OF}' - 90 AND DATE '{NEWS_AS_OF}'", "news")
plain("q_news_latest_pit", lambda s, d: lookups.latest(lookups.known_by(news(s, d).drop("raw_text"), "published_on", NEWS_AS_OF), "ticker", ["published_on", "news_article_id"]), ART,
      f"(SELECT * FROM news WHERE published_on <= DATE '{NEWS_AS_OF}') p QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY published_on DESC, news_article_id DESC) = 1", "news")
plain("q_news_by_url_ticker", lambda s, d: tables.first_per_key(news(s, d).drop("raw_text"), ["url"], ["news_article_id"]), ["url", "ticker", "news_article_id"],
      "news QUALIFY ROW_NUMBER() OVER (PARTITION BY url ORDER BY news_article_id) = 1", "news")
register("a_count_status", lambda s, d: filings(s, d).groupBy("ticker", "filing_type").agg(F.count("*").alias("n"), F.min("filing_date").alias("first_date"), F.max("filing_date").alias("last_date")),
         "SELECT ticker, filing_type, COUNT(*) AS n, MIN(filing_date) AS first_date, MAX(filing_date) AS last_date FROM filings GROUP BY ticker, filing_type", "filings")
register("a_min_max_dates", lambda s, d: bars(s, d).groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("n")),
         "SELECT ticker, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(*) AS n FROM bars GROUP BY ticker", "bars")

# --- 2.8 sets ------------------------------------------------------------

register("s_distinct_dates", lambda s, d: bars(s, d).select("date").union(s.range(1).select(F.lit(AS_OF[-1]).alias("date"))).distinct(),
         f"SELECT date FROM bars UNION SELECT DATE '{AS_OF[-1]}'", "bars")
register("s_distinct_tickers", lambda s, d: _requests(s, d).select(normal_ticker("ticker").alias("ticker")).filter("ticker <> ''").distinct(), "SELECT DISTINCT ticker FROM trades", "trades")
register("s_peer_union", lambda s, d: companies(s, d).filter("sector = 'EUROPE'").select("ticker").union(companies(s, d).filter("exchange_code = 'NMS'").select("ticker")).distinct(),
         "SELECT ticker FROM companies WHERE sector = 'EUROPE' UNION SELECT ticker FROM companies WHERE exchange_code = 'NMS'", "companies")
register("s_set_diff", lambda s, d: companies(s, d).select("ticker").join(bars(s, d).filter(F.col("date") > F.lit(date(2001, 10, 25))).select("ticker").distinct(), "ticker", "left_anti"),
         "SELECT ticker FROM companies WHERE ticker NOT IN (SELECT ticker FROM bars WHERE date > DATE '2001-10-25')", "companies", "bars")
