"""Nested research contexts: evidence arrays per holding, holdings per portfolio, company bundles.

Every array is bounded before it is collected: articles and filings by their limits per
holding, statement periods by theirs, holdings by the size of the portfolio.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.ranking import top_k

KEY = ["as_of_date", "ticker"]
ARTICLES, FILINGS, PERIODS = 12, 8, 4
ARTICLE_FIELDS = ["position", "title", "source", "published_on", "url", "summary", "relevance_score"]
FILING_FIELDS = ["position", "filing_type", "filing_date", "accession_number", "relevant_excerpt"]


def _arrays(rows: DataFrame, by: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """One array of structs per group, in the order of the first field."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def _or_empty(name: str) -> Column:
    """A missing array is an empty one."""
    return F.coalesce(F.col(name), F.array()).alias(name)


def articles_asof(holdings: DataFrame, articles: DataFrame, limit: int = ARTICLES) -> DataFrame:
    """Articles of each holding from the newest news date not after its research date.

    articles: (as_of_date, ticker, position, fields), selected for a few news dates.
    """
    dated = articles.withColumnRenamed("as_of_date", "news_date")
    known = holdings.select(*KEY).distinct().join(dated.select("ticker", "news_date").distinct(), "ticker")
    newest = known.filter("news_date <= as_of_date").groupBy(*KEY).agg(F.max("news_date").alias("news_date"))
    return newest.join(dated, ["ticker", "news_date"]).filter(F.col("position") <= limit)


def filings_asof(holdings: DataFrame, filings: DataFrame, limit: int = FILINGS) -> DataFrame:
    """The newest filings of each holding that were filed by its research date, with their position."""
    known = holdings.select(*KEY).distinct().join(filings, "ticker").filter("filing_date <= as_of_date")
    return top_k(known, KEY, [F.desc("filing_date"), F.desc("accession_number")], limit)


def holding_contexts(holdings: DataFrame, articles: DataFrame, filings: DataFrame) -> DataFrame:
    """Holdings with arrays `news` and `filings`; filings carry their excerpt, cut for the chosen ones only."""
    from plumbline.operators.filings import with_excerpt

    news = _arrays(articles_asof(holdings, articles), KEY, ARTICLE_FIELDS, "news")
    filed = _arrays(with_excerpt(filings_asof(holdings, filings)), KEY, FILING_FIELDS, "filings")
    rows = holdings.join(news, KEY, "left").join(filed, KEY, "left")
    return rows.select(*holdings.columns, _or_empty("news"), _or_empty("filings"))


def portfolio_contexts(holding_rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per research date: holdings in order of their first field, totals, and what is missing."""
    return holding_rows.groupBy("as_of_date").agg(
        F.array_sort(F.collect_list(F.struct(*fields, "news", "filings"))).alias("holdings"),
        F.sum("weight").alias("total_weight"),
        F.sum(F.size("news")).alias("articles"),
        F.sum(F.size("filings")).alias("filings"),
        F.sum((F.size("news") == 0).cast("long")).alias("without_news"),
    )


def company_bundles(
    companies: DataFrame, market: DataFrame, statements: DataFrame, evidence: DataFrame, periods: int = PERIODS
) -> DataFrame:
    """One row per company: market measures, its latest statement periods, news, filings.

    market: one row per ticker; statements: rows known at the date; evidence: (ticker, news, filings).
    """
    latest = top_k(statements, ["ticker"], [F.desc("period_end_date"), F.col("fiscal_period")], periods)
    fields = ["position", "period_end_date", "fiscal_period", "revenue", "net_income", "total_assets"]
    measures = market.select("ticker", F.struct(*[c for c in market.columns if c != "ticker"]).alias("market"))
    rows = (
        companies.join(measures, "ticker", "left")
        .join(_arrays(latest, ["ticker"], fields, "statements"), "ticker", "left")
        .join(evidence.select("ticker", "news", "filings"), "ticker", "left")
    )
    return rows.select(*companies.columns, "market", _or_empty("statements"), _or_empty("news"), _or_empty("filings"))
