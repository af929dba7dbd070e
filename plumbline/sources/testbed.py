"""Logical tables derived from the star-schema parquet files.

Price bars come from order lines (a supplier or a brand stands for a company,
an order line for a trade), statements from quarterly sums, news and filings
from documents. The derivations are plain plans and grow with their inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scalars import rnd

BENCHMARK = "Index#0"
SUPPLIER = "supplier"
BRAND = "brand"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker_number():
    return F.regexp_extract("ticker", "[0-9]+", 0).cast("long") % 1000


def trades(spark: SparkSession, sf_dir: str, by: str = SUPPLIER) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if by == BRAND:
        part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
        lines = lines.join(part, lines.l_partkey == part.p_partkey)
    else:
        key = F.lpad(F.col("l_suppkey").cast("string"), 9, "0")
        lines = lines.withColumn("ticker", F.concat(F.lit("S#"), key))
    return lines.select(
        "ticker",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("ext"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("disc"),
        F.col("l_tax").alias("tax"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )


def bars(spark: SparkSession, sf_dir: str, by: str = SUPPLIER) -> DataFrame:
    """Daily bars of all tickers plus the market index.

    The index is summed from the per-ticker partial sums, not from a second
    pass over the lines.
    """
    parts = (
        trades(spark, sf_dir, by)
        .groupBy("ticker", "date")
        .agg(
            F.sum("unit").alias("unit"),
            F.count("unit").alias("n"),
            F.max("unit").alias("high"),
            F.min("unit").alias("low"),
            F.sum("ext").alias("ext"),
            F.sum("qty").alias("qty"),
        )
    )
    index = parts.groupBy("date").agg(
        F.sum("unit").alias("unit"),
        F.sum("n").alias("n"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("ext").alias("ext"),
        F.sum("qty").alias("qty"),
    )
    sums = parts.unionByName(index.withColumn("ticker", F.lit(BENCHMARK)))
    volume = F.col("qty").cast("long")
    return sums.select(
        "ticker",
        "date",
        rnd(F.col("unit") / F.col("n"), 4).alias("open"),
        rnd("high", 4).alias("high"),
        rnd("low", 4).alias("low"),
        rnd(F.col("ext") / F.col("qty"), 4).alias("close"),
        F.when(volume % 11 != 0, rnd(0.98 * F.col("ext") / F.col("qty"), 4)).alias("adjusted_close"),
        volume.alias("volume"),
        (1000000 + 1000 * ticker_number()).alias("shares_outstanding"),
    )


# Statement lines as sums over order lines: name -> (expression, kind).
FLOWS = {
    "revenue": "ext",
    "gross_profit": "ext * (0.4D - disc)",
    "operating_income": "ext * (0.4D - disc - tax)",
    "net_income": "ext * (0.3D - disc - tax)",
    "operating_cash_flow": "ext * (0.35D - disc)",
    "capital_expenditures": "-1.0D * ext * tax",
    "depreciation_and_amortization": "ext * disc * 0.5D",
    "r_and_d_expense": "ext * disc * 0.3D",
    "sga_expense": "ext * tax * 0.8D",
    "interest_expense": "ext * tax * 0.1D",
    "income_tax_expense": "ext * disc * 0.2D",
    "dividends_paid": "-1.0D * ext * disc * 0.05D",
}
BALANCES = {
    "total_assets": "qty * 5000.0D",
    "total_liabilities": "qty * 3000.0D",
    "cash_and_equivalents": "qty * disc * 4000.0D",
    "total_debt": "qty * tax * 6000.0D",
    "current_assets": "qty * 2000.0D",
    "current_liabilities": "qty * (1.0D - disc) * 1500.0D",
    "inventory": "qty * tax * 2500.0D",
    "accounts_receivable": "qty * disc * 900.0D",
    "accounts_payable": "qty * tax * 700.0D",
}
FLOW_COLUMNS = [*FLOWS, "free_cash_flow"]
BALANCE_COLUMNS = [*BALANCES, "weighted_average_shares", "weighted_average_diluted_shares"]


def statements(spark: SparkSession, sf_dir: str, by: str = SUPPLIER) -> DataFrame:
    """Q1..Q3 and FY rows with 24 metrics; Q4 is left to be inferred."""
    sums = [F.expr(f"sum({e})").alias(n) for n, e in {**FLOWS, **BALANCES}.items()]
    quarters = (
        trades(spark, sf_dir, by)
        .groupBy("ticker", F.year("date").alias("fiscal_year"), F.quarter("date").alias("q"))
        .agg(*sums)
    )
    quarters = quarters.select(
        "ticker", "fiscal_year", "q", *[rnd(n, 2).alias(n) for n in {**FLOWS, **BALANCES}]
    )
    quarters = quarters.withColumns(
        {
            # some filers do not report research cost
            "r_and_d_expense": F.when(ticker_number() % 7 != 3, F.col("r_and_d_expense")),
            "free_cash_flow": F.col("operating_cash_flow") - F.abs("capital_expenditures"),
            "weighted_average_shares": (1000000 + 1000 * ticker_number()).cast("double"),
            "weighted_average_diluted_shares": 1.05 * (1000000 + 1000 * ticker_number()),
        }
    )
    metrics = FLOW_COLUMNS + BALANCE_COLUMNS
    # both kinds of rows come from one pass over the order lines
    years = quarters.groupBy("ticker", "fiscal_year").agg(
        F.count("*").alias("n"),
        F.collect_list(F.struct("q", *metrics)).alias("quarters"),
        *[rnd(F.sum(m), 2).alias(m) for m in FLOW_COLUMNS],
        *[F.max(m).alias(m) for m in BALANCE_COLUMNS],
    )
    interim = F.transform(
        F.filter("quarters", lambda x: x["q"] < 4),
        lambda x: F.struct(
            F.concat(F.lit("Q"), x["q"].cast("string")).alias("fiscal_period"),
            F.last_day(F.make_date("fiscal_year", x["q"] * 3, F.lit(1))).alias("period_end_date"),
            *[x[m].alias(m) for m in metrics],
        ),
    )
    annual = F.struct(
        F.lit("FY").alias("fiscal_period"),
        F.make_date("fiscal_year", F.lit(12), F.lit(31)).alias("period_end_date"),
        *metrics,
    )
    rows = F.concat(interim, F.when(F.col("n") == 4, F.array(annual)).otherwise(F.array()))
    out = years.select("ticker", "fiscal_year", F.explode(rows).alias("row")).select("ticker", "fiscal_year", "row.*")
    lag = F.when(F.col("fiscal_period") == "FY", 75).otherwise(45)
    return out.withColumn("filed_date", F.date_add("period_end_date", lag))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    key = F.lpad(F.col("s_suppkey").cast("string"), 9, "0")
    return (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            F.col("s_suppkey").alias("company_id"),
            F.concat(F.lit("S#"), key).alias("ticker"),
            F.col("s_name").alias("name"),
            F.col("r_name").alias("sector"),
            F.col("n_name").alias("industry"),
            F.element_at(
                F.array(*[F.lit(x) for x in ("NMS", "NYQ", "NCM", "NGM", "ASE", "PCX", "BTS", "PNK")]),
                (F.col("s_suppkey") % 8 + 1).cast("int"),
            ).alias("exchange_code"),
            F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("cik"),
        )
    )


TITLE_NOISE = {
    0: " earnings guidance raised",
    1: " best stocks to buy",
    3: " Brand#3 and $Brand#7 on revenue outlook",
    5: " Brand company lawsuit",
}
SUMMARY_NOISE = {0: " quarterly revenue and margin", 2: " retire on passive income", 3: " Brand#3"}


def noise(column, modulus: int, values: dict[int, str]):
    out = F.lit("")
    for key, text in values.items():
        out = F.when(column % modulus == key, F.lit(text)).otherwise(out)
    return out


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: first sentence = title, the rest = summary."""
    docs = table(spark, sf_dir, "documents")
    flat = F.translate("text", "\n", " ")
    cut = F.locate(".", flat)
    title = F.when(cut > 0, F.substring(flat, F.lit(1), cut - 1)).otherwise(flat)
    summary = F.when(cut > 0, F.substring(flat, cut + 1, F.length(flat))).otherwise(F.lit(""))
    doc_id = F.col("doc_id")
    return docs.select(
        doc_id.alias("news_article_id"),
        F.concat(F.lit("Brand#"), (1 + doc_id % 25).cast("string")).alias("ticker"),
        F.concat(title, noise(doc_id, 11, TITLE_NOISE)).alias("title"),
        F.concat(summary, noise(doc_id, 7, SUMMARY_NOISE)).alias("summary"),
        "source",
        F.concat(
            F.lit("http://"), F.col("source"), F.lit("/"), (doc_id - doc_id % 2).cast("string")
        ).alias("url"),
        F.col("text").alias("raw_text"),
        F.date_add(F.lit("2000-01-01").cast("date"), (doc_id % 365).cast("int")).alias("published_on"),
    )


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings, section headings worked into the text."""
    docs = table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    text = (
        F.when(
            doc_id % 3 == 0,
            F.concat(
                F.lit("Item 2.02 Results of operations and financial condition. "),
                "text",
                F.lit(" Guidance for the year and other events follow. "),
                "source",
            ),
        )
        .when(
            doc_id % 3 == 1,
            F.concat(
                "text", F.lit(" Item 1A. Risk Factors "), "text", F.lit(" Legal Proceedings "), "text"
            ),
        )
        .otherwise(F.col("text"))
    )
    return docs.select(
        doc_id.alias("filing_id"),
        F.concat(F.lit("Brand#"), (1 + doc_id % 25).cast("string")).alias("ticker"),
        F.when(doc_id % 4 == 0, "10-K").when(doc_id % 4 == 1, "10-Q").otherwise("8-K").alias("filing_type"),
        F.date_add(F.lit("1999-01-01").cast("date"), (doc_id % 700).cast("int")).alias("filing_date"),
        F.concat(F.lit("acc-"), doc_id.cast("string")).alias("accession_number"),
        text.alias("raw_text"),
    )
