"""SQL twins: named CTEs with dependencies, assembled into one statement."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import testbed
from plumbline.sources.stored import Snapshots

Query = Callable[[SparkSession, str], DataFrame]

# panels shared by queries of one session, as the snapshot cache of a research run
SNAPSHOTS = Snapshots()
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    _CTES[name] = (needs, sql)


def statement(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in _CTES[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    return ("WITH RECURSIVE " if "walk" in order else "WITH ") + ",\n".join(f"{n} AS (\n{_CTES[n][1]}\n)" for n in order) + "\n" + body


def register(name: str, query: Query, body: str | None = None, *names: str) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} registered twice")
    QUERIES[name] = query
    if body is not None:
        TWINS[name] = statement(body, *names)


def r(expression: str, digits: int, alias: str | None = None) -> str:
    out = f"ROUND(CAST({expression} AS DOUBLE) + 1e-7, {digits})"
    return f"{out} AS {alias}" if alias else out


NUMBER = "CAST(REGEXP_EXTRACT(ticker, '[0-9]+') AS BIGINT) % 1000"

cte(
    "trades",
    """SELECT CONCAT('S#', LPAD(CAST(l_suppkey AS VARCHAR), 9, '0')) AS ticker,
       CAST(l_shipdate AS DATE) AS date, l_extendedprice AS ext, l_quantity AS qty,
       l_discount AS disc, l_tax AS tax, l_extendedprice / l_quantity AS unit
FROM lineitem""",
)
cte(
    "brand_trades",
    """SELECT p_brand AS ticker,
       CAST(l_shipdate AS DATE) AS date, l_extendedprice AS ext, l_quantity AS qty,
       l_discount AS disc, l_tax AS tax, l_extendedprice / l_quantity AS unit
FROM lineitem JOIN part ON l_partkey = p_partkey""",
)


def _bars(source: str) -> str:
    return f"""SELECT ticker, date, ROUND(AVG(unit) + 1e-7, 4) AS open, ROUND(MAX(unit) + 1e-7, 4) AS high,
       ROUND(MIN(unit) + 1e-7, 4) AS low, ROUND(SUM(ext) / SUM(qty) + 1e-7, 4) AS close,
       CASE WHEN CAST(SUM(qty) AS BIGINT) % 11 = 0 THEN NULL
            ELSE ROUND(0.98 * SUM(ext) / SUM(qty) + 1e-7, 4) END AS adjusted_close,
       CAST(SUM(qty) AS BIGINT) AS volume,
       1000000 + 1000 * ({NUMBER}) AS shares_outstanding
FROM (SELECT * FROM {source} UNION ALL
      SELECT 'Index#0' AS ticker, date, ext, qty, disc, tax, unit FROM {source}) t
GROUP BY ticker, date"""


cte("bars", _bars("trades"), "trades")
cte("brand_bars", _bars("brand_trades"), "brand_trades")


def _quarters(source: str) -> str:
    items = {**testbed.FLOWS, **testbed.BALANCES}
    # DOUBLE literals carry a D suffix in Spark only
    plain = {n: re.sub(r"(\d)D\b", r"\1", e) for n, e in items.items()}
    sums = ", ".join(f"ROUND(SUM({e}) + 1e-7, 2) AS {n}" for n, e in plain.items())
    return f"""SELECT * REPLACE (CASE WHEN ({NUMBER}) % 7 <> 3 THEN r_and_d_expense END AS r_and_d_expense),
       operating_cash_flow - ABS(capital_expenditures) AS free_cash_flow,
       CAST(1000000 + 1000 * ({NUMBER}) AS DOUBLE) AS weighted_average_shares,
       CAST(1.05 * (1000000 + 1000 * ({NUMBER})) AS DOUBLE) AS weighted_average_diluted_shares
FROM (SELECT ticker, YEAR(date) AS fiscal_year, QUARTER(date) AS q, {sums}
      FROM {source} GROUP BY ticker, YEAR(date), QUARTER(date)) s"""


def _statements(quarters: str) -> str:
    flows, balances = testbed.FLOW_COLUMNS, testbed.BALANCE_COLUMNS
    metrics = ", ".join(flows + balances)
    annual = ", ".join(
        [f"ROUND(SUM({m}) + 1e-7, 2) AS {m}" for m in flows] + [f"MAX({m}) AS {m}" for m in balances]
    )
    return f"""SELECT *, CAST(period_end_date + CASE fiscal_period WHEN 'FY' THEN 75 ELSE 45 END AS DATE) AS filed_date
FROM (
SELECT ticker, CAST(fiscal_year AS INTEGER) AS fiscal_year, CONCAT('Q', CAST(q AS VARCHAR)) AS fiscal_period,
       LAST_DAY(MAKE_DATE(CAST(fiscal_year AS INT), CAST(q * 3 AS INT), 1)) AS period_end_date, {metrics}
FROM {quarters} WHERE q < 4
UNION ALL
SELECT ticker, CAST(fiscal_year AS INTEGER), 'FY', MAKE_DATE(CAST(fiscal_year AS INT), 12, 31), {annual}
FROM {quarters} GROUP BY ticker, fiscal_year HAVING COUNT(*) = 4) u"""


for _p in ("", "brand_"):
    cte(f"{_p}quarters", _quarters(f"{_p}trades"), f"{_p}trades")
    cte(f"{_p}statements", _statements(f"{_p}quarters"), f"{_p}quarters")

cte(
    "companies",
    """SELECT s_suppkey AS company_id, CONCAT('S#', LPAD(CAST(s_suppkey AS VARCHAR), 9, '0')) AS ticker,
       s_name AS name, r_name AS sector, n_name AS industry,
       CASE s_suppkey % 8 WHEN 0 THEN 'NMS' WHEN 1 THEN 'NYQ' WHEN 2 THEN 'NCM' WHEN 3 THEN 'NGM'
            WHEN 4 THEN 'ASE' WHEN 5 THEN 'PCX' WHEN 6 THEN 'BTS' ELSE 'PNK' END AS exchange_code,
       LPAD(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)


def _noise(modulus: int, values: dict[int, str]) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in values.items())
    return f"CASE doc_id % {modulus} {whens} ELSE '' END"


cte(
    "news",
    f"""SELECT doc_id AS news_article_id, CONCAT('Brand#', CAST(1 + doc_id % 25 AS VARCHAR)) AS ticker,
       CONCAT(CASE WHEN cut > 0 THEN SUBSTR(flat, 1, cut - 1) ELSE flat END, {_noise(11, testbed.TITLE_NOISE)}) AS title,
       CONCAT(CASE WHEN cut > 0 THEN SUBSTR(flat, cut + 1) ELSE '' END, {_noise(7, testbed.SUMMARY_NOISE)}) AS summary,
       source, CONCAT('http://', source, '/', CAST(doc_id - doc_id % 2 AS VARCHAR)) AS url,
       text AS raw_text, CAST(DATE '2000-01-01' + CAST(doc_id % 365 AS INT) AS DATE) AS published_on
FROM (SELECT *, INSTR(flat, '.') AS cut FROM (SELECT *, REPLACE(text, CHR(10), ' ') AS flat FROM documents) a) b""",
)
cte(
    "filings",
    """SELECT doc_id AS filing_id, CONCAT('Brand#', CAST(1 + doc_id % 25 AS VARCHAR)) AS ticker,
       CASE doc_id % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' ELSE '8-K' END AS filing_type,
       CAST(DATE '1999-01-01' + CAST(doc_id % 700 AS INT) AS DATE) AS filing_date,
       CONCAT('acc-', CAST(doc_id AS VARCHAR)) AS accession_number,
       CASE doc_id % 3
         WHEN 0 THEN CONCAT('Item 2.02 Results of operations and financial condition. ', text,
                            ' Guidance for the year and other events follow. ', source)
         WHEN 1 THEN CONCAT(text, ' Item 1A. Risk Factors ', text, ' Legal Proceedings ', text)
         ELSE text END AS raw_text
FROM documents""",
)
