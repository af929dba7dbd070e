"""Company facts -> statement rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.sources.landed import literal_map

# Taxonomy tags of each statement metric, best first.
USD_TAGS = {
    "revenue": ["Revenues", "SalesRevenueNet", "RevenueFromContractWithCustomerExcludingAssessedTax"],
    "net_income": ["NetIncomeLoss"],
    "operating_income": ["OperatingIncomeLoss"],
    "gross_profit": ["GrossProfit"],
    "total_assets": ["Assets"],
    "total_liabilities": ["Liabilities"],
    "cash_and_equivalents": [
        "CashAndCashEquivalentsAtCarryingValue", "CashAndCashEquivalentsAndShortTermInvestments",
    ],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
    "capital_expenditures": [
        "PaymentsToAcquirePropertyPlantAndEquipment", "PaymentsToAcquireProductiveAssets",
    ],
    "depreciation_and_amortization": [
        "DepreciationDepletionAndAmortization", "DepreciationDepletionAndAmortizationExpense",
        "DepreciationAmortizationAndAccretionNet",
    ],
    "r_and_d_expense": ["ResearchAndDevelopmentExpense"],
    "sga_expense": ["SellingGeneralAndAdministrativeExpense"],
    "current_assets": ["AssetsCurrent"],
    "current_liabilities": ["LiabilitiesCurrent"],
    "inventory": ["InventoryNet"],
    "accounts_receivable": ["AccountsReceivableNetCurrent", "ReceivablesNetCurrent"],
    "accounts_payable": ["AccountsPayableCurrent"],
    "interest_expense": ["InterestExpenseNonOperating", "InterestExpense"],
    "income_tax_expense": ["IncomeTaxExpenseBenefit"],
    "dividends_paid": ["PaymentsOfDividends", "PaymentsOfDividendsCommonStock"],
}
DEBT_TAGS = [
    "ShortTermBorrowings", "CommercialPaper", "LongTermDebtCurrent", "LongTermDebtNoncurrent",
    "LongTermDebtAndFinanceLeaseObligationsCurrent",
    "LongTermDebtAndFinanceLeaseObligationsNoncurrent",
]
SHARE_TAGS = {
    "weighted_average_shares": ["WeightedAverageNumberOfSharesOutstandingBasic"],
    "weighted_average_diluted_shares": ["WeightedAverageNumberOfDilutedSharesOutstanding"],
}

PERIOD = ["cik", "fy", "fp", "end"]
NEVER = 10**6


def _priorities() -> dict[str, int]:
    return {tag: i for tags in [*USD_TAGS.values(), *SHARE_TAGS.values()] for i, tag in enumerate(tags)}


def _concepts() -> dict[str, str]:
    named = {tag: metric for metric, tags in {**USD_TAGS, **SHARE_TAGS}.items() for tag in tags}
    return {**named, **{tag: "total_debt" for tag in DEBT_TAGS}}


def lookup(values: dict, tag: str = "tag") -> Column:
    return F.try_element_at(literal_map(values), F.col(tag))


def reporting_periods(facts: DataFrame, years_back: int = 5, interim: bool = True) -> DataFrame:
    """Periods to load: one per (fp, end), comparatives removed, newest kept."""
    allowed = ["FY", "Q1", "Q2", "Q3", "Q4"] if interim else ["FY"]
    candidates = facts.filter(
        (F.col("unit") == "USD")
        & F.col("tag").isin(USD_TAGS["revenue"])
        & F.col("fp").isin(allowed)
        & F.col("fy").isNotNull()
        & F.col("end").isNotNull()
    )
    order = F.struct(
        (F.col("fy") != F.year("end")).alias("comparative"),
        lookup(_priorities()).alias("priority"),
        "pos",
    )
    periods = candidates.groupBy("cik", "fp", "end").agg(
        F.min_by(F.struct("fy", "filed"), order).alias("kept")
    )
    newest = Window.partitionBy("cik").orderBy(F.desc("end"), "fp")
    return (
        periods.select("cik", "fp", "end", "kept.fy", "kept.filed")
        .withColumn("n", F.row_number().over(newest))
        .filter(F.col("n") <= years_back * (4 if interim else 1))
        .drop("n")
    )


def picked_facts(facts: DataFrame, periods: DataFrame) -> DataFrame:
    """One value per (period, tag).

    USD quarters: shortest duration first (a quarter, not year to date), then
    latest filed. Annual periods and shares: latest filed.
    """
    duration = F.when(
        (F.col("fp") != "FY") & (F.col("unit") == "USD"),
        F.coalesce(F.datediff("end", "start"), F.lit(NEVER)),
    ).otherwise(F.lit(0))
    age = F.coalesce(-F.unix_date("filed"), F.lit(NEVER))
    wanted = facts.filter(lookup(_concepts()).isNotNull())
    return (
        wanted.join(periods.select(*PERIOD), PERIOD, "left_semi")
        .groupBy(*PERIOD, "tag")
        .agg(F.min_by("val", F.struct(duration.alias("d"), age.alias("a"), "pos")).alias("val"))
    )


def concept_values(picked: DataFrame) -> DataFrame:
    """(period, metric, val): first tag with a value; debt is a sum of tags."""
    rows = picked.filter(F.col("val").isNotNull()).withColumns(
        {"metric": lookup(_concepts()), "priority": F.coalesce(lookup(_priorities()), F.lit(0))}
    )
    return rows.groupBy(*PERIOD, "metric").agg(
        F.when(F.col("metric") == "total_debt", F.sum("val"))
        .otherwise(F.min_by("val", "priority"))
        .alias("val")
    )


def statement_rows(facts: DataFrame, years_back: int = 5) -> DataFrame:
    """One row per period with a column per metric and free cash flow."""
    periods = reporting_periods(facts, years_back)
    metrics = [*USD_TAGS, *SHARE_TAGS, "total_debt"]
    values = concept_values(picked_facts(facts, periods))
    wide = values.groupBy(*PERIOD).agg(
        *[F.max(F.when(F.col("metric") == m, F.col("val"))).alias(m) for m in metrics]
    )
    return (
        periods.join(wide, PERIOD, "left")
        .withColumn("free_cash_flow", F.col("operating_cash_flow") - F.abs("capital_expenditures"))
        .withColumnsRenamed(
            {"fy": "fiscal_year", "fp": "fiscal_period", "end": "period_end_date", "filed": "filed_date"}
        )
    )
