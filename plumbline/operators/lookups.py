"""Point and range lookups, for one key or for a table of requests."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import normal_ticker
from plumbline.operators.ranking import top_k


def requested(rows: DataFrame, requests: DataFrame, key: str = "ticker") -> DataFrame:
    """Rows whose key is asked for; requests are normalised and deduplicated."""
    wanted = requests.select(normal_ticker(key).alias(key)).filter(F.col(key) != "").distinct()
    return rows.join(wanted, key, "left_semi")


def exists_flags(rows: DataFrame, requests: DataFrame, key: str = "ticker") -> DataFrame:
    wanted = requests.select(normal_ticker(key).alias(key)).filter(F.col(key) != "").distinct()
    known = rows.select(key).distinct().withColumn("known", F.lit(True))
    return wanted.join(known, key, "left").select(key, F.coalesce("known", F.lit(False)).alias("known"))


def latest(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row per key, combined map-side."""
    body = [c for c in rows.columns if c != key]
    return (
        rows.groupBy(key)
        .agg(F.max_by(F.struct(*body), F.struct(*order)).alias("r"))
        .select(key, "r.*")
    )


def newest(rows: DataFrame, key: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    return top_k(rows, key, order, n)


def between(rows: DataFrame, column: str, low, high) -> DataFrame:
    return rows.filter(F.col(column).between(F.lit(low), F.lit(high)))


def recent(rows: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Last `days` calendar days up to a stated date, never the wall clock."""
    return rows.filter(
        (F.col(column) >= F.date_sub(F.lit(as_of), days)) & (F.col(column) <= F.lit(as_of))
    )


def counts(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("row_count"))


def search(rows: DataFrame, keyword: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive substring in any column; % and _ are literal."""
    needle = F.lit(keyword.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    return rows.filter(hit)


def known_by(rows: DataFrame, column: str, as_of: date, days_back: int | None = None) -> DataFrame:
    """Point in time: dated, not after the date, optionally not too old."""
    seen = F.col(column) <= F.lit(as_of)
    if days_back is not None:
        seen = seen & (F.col(column) >= F.date_sub(F.lit(as_of), days_back))
    return rows.filter(seen)


def universe_status(companies: DataFrame, bars: DataFrame, statements: DataFrame) -> DataFrame:
    """Stored rows per company and whether a load can be skipped."""
    prices = bars.groupBy("ticker").agg(F.count("*").alias("price_rows"))
    financials = statements.groupBy("ticker").agg(F.count("*").alias("financial_rows"))
    joined = companies.select("ticker").join(prices, "ticker", "left").join(financials, "ticker", "left")
    return joined.select(
        "ticker",
        F.coalesce("price_rows", F.lit(0)).alias("price_rows"),
        F.coalesce("financial_rows", F.lit(0)).alias("financial_rows"),
    ).withColumn("complete", (F.col("price_rows") > 0) & (F.col("financial_rows") > 0))
