"""Data-quality rules: warnings as arrays, checks as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-8


def warnings(rules: Sequence[tuple[Column, str]]) -> Column:
    """Distinct messages of the rules that fire."""
    return F.array_distinct(
        F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), message) for rule, message in rules]))
    )


def company_warnings(companies: DataFrame, latest: DataFrame, periods: DataFrame, as_of, stale_days: int = 10) -> DataFrame:
    """latest: (ticker, date, one_year_return, sma_50); periods: (ticker, periods)."""
    rows = companies.join(latest, "ticker", "left").join(periods, "ticker", "left")
    rules = [
        (F.col("name").isNull() | F.col("sector").isNull(), "company metadata incomplete"),
        (F.col("date").isNull(), "no price history"),
        (F.coalesce("periods", F.lit(0)) < 4, "fewer than 4 statement periods"),
        (F.col("one_year_return").isNull(), "market summary incomplete"),
        (F.col("sma_50").isNull(), "technical indicators missing"),
        (F.datediff(F.lit(as_of), "date") > stale_days, "latest price is stale"),
    ]
    return rows.select("ticker", warnings(rules).alias("warnings"))


def holding_warnings(holdings: DataFrame) -> DataFrame:
    """holdings carries name, rank, score, alpha, weight, articles and filings."""
    rules = [
        (F.col("name").isNull(), "company name missing"),
        (F.col("universe_rank").isNull(), "universe rank missing"),
        (F.col("overall_score").isNull(), "overall score missing"),
        (F.col("alpha").isNull(), "expected return missing"),
        (F.col("weight").isNull(), "portfolio weight missing"),
        (F.coalesce("articles", F.lit(0)) == 0, "no news evidence"),
        (F.coalesce("filings", F.lit(0)) == 0, "no filing evidence"),
    ]
    return holdings.withColumn("warnings", warnings(rules))


def weight_checks(weights: DataFrame, selection: DataFrame, group: Sequence[str]) -> DataFrame:
    """Range, total, subset and uniqueness of the weights of each portfolio."""
    chosen = selection.select("as_of_date", "ticker").distinct().withColumn("_known", F.lit(True))
    rows = weights.join(chosen, ["as_of_date", "ticker"], "left")
    w = F.col("weight")
    return rows.groupBy(*group).agg(
        (F.min(w) >= 0).alias("non_negative"),
        (F.max(w) <= 1).alias("at_most_one"),
        (F.sum(w) <= 1.000001).alias("total_within_capital"),
        (F.sum(w) >= 0.999).alias("fully_invested"),
        (F.count("_known") == F.count("*")).alias("subset_of_selection"),
        (F.count_distinct("ticker") == F.count("*")).alias("unique_holdings"),
    )


def reconciled(stored: DataFrame, reported: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both weight tables side by side with the kind of difference."""
    a = stored.select(*keys, F.col("weight").alias("stored_weight"))
    b = reported.select(*keys, F.col("weight").alias("reported_weight"))
    status = (
        F.when(F.col("reported_weight").isNull(), "missing")
        .when(F.col("stored_weight").isNull(), "unexpected")
        .when(F.abs(F.col("stored_weight") - F.col("reported_weight")) > TOLERANCE, "different")
        .otherwise("equal")
    )
    return a.join(b, list(keys), "full_outer").withColumn("status", status)


def split_record(rows: DataFrame, ranks: Sequence[str], scores: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A wide quantitative row as ranks struct, score map and metric map."""

    def mapped(columns: Sequence[str]) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(c) for c in columns]))

    return rows.select(
        "as_of_date", "ticker", F.struct(*ranks).alias("ranks"), mapped(scores).alias("scores"), mapped(metrics).alias("metrics")
    )
