"""Landed files -> typed rows. Readers name their schema; nothing is inferred.

Each parser takes the raw DataFrame (`spark.read.csv/json/text/parquet`) so the
same code serves batch reads and streams.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import normal_ticker

PRICE_SCHEMA = (
    "ticker string, date date, open double, high double, low double, close double, "
    "adjusted_close double, volume bigint, shares_outstanding bigint"
)
FACT = "struct<fy:int,fp:string,start:string,end:string,filed:string,val:double>"
FACTS_SCHEMA = f"map<string,map<string,struct<units:map<string,array<{FACT}>>>>>"
NEWS_SCHEMA = "headline string, source string, datetime bigint, url string, summary string"
TICKER_SCHEMA = "ticker string, cik_str bigint"
LISTING_SCHEMA = "symbol string, security_name string, exchange string, etf string, test_issue string"

# Provider column names of a price file.
PRICE_COLUMNS = {
    "Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close",
    "Adj Close": "adjusted_close", "Volume": "volume",
}
# Exchange codes and names; other codes pass through.
EXCHANGES = {
    "NMS": "NASDAQ", "NGM": "NASDAQ", "NCM": "NASDAQ", "NYQ": "NYSE", "ASE": "NYSE American",
    "PCX": "NYSE Arca", "PNK": "OTC Pink", "OTC": "OTC",
}
# Filings kept per form at ingest.
INGEST_FORM_LIMITS = {"10-K": 3, "10-Q": 4, "8-K": 8}
# Name parts that mark a listing as other than common stock.
BLOCKED_NAME_TERMS = [
    "ETF", "ETN", "FUND", "MUTUAL FUND", "CLOSED-END FUND", "CLOSED END FUND", "BOND",
    "DEBENTURE", "NOTE", "NOTES", "PREFERRED", "PREFERENCE", "PFD", "WARRANT", "WARRANTS",
    "RIGHT", "RIGHTS", "UNIT", "UNITS", "SPAC", "ACQUISITION CORP", "ACQUISITION CORPORATION",
    "ACQUISITION COMPANY",
]
FILING_HOST = "https://www.sec.gov/Archives/edgar/data/"


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    reader = spark.read.schema(PRICE_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def price_bars(raw: DataFrame) -> DataFrame:
    """Provider names -> bar columns; the file also carries ticker and shares. No rows: an error."""
    if raw.isEmpty():
        raise ValueError("no price rows landed")
    return raw.select(
        normal_ticker("ticker").alias("ticker"),
        *[F.col(f"`{theirs}`").alias(ours) for theirs, ours in PRICE_COLUMNS.items()],
        "shares_outstanding",
    )


def exchange_name(code: Column | str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    return F.coalesce(F.try_element_at(literal_map(EXCHANGES), code), code)


def company_rows(raw: DataFrame) -> DataFrame:
    return raw.select(
        normal_ticker("ticker").alias("ticker"),
        F.coalesce("long_name", "short_name", "ticker").alias("name"),
        "sector",
        "industry",
        exchange_name("exchange_code").alias("exchange"),
    )


def ticker_ciks(raw: DataFrame, column: str = "value") -> DataFrame:
    parsed = raw.select(F.from_json(column, TICKER_SCHEMA).alias("m"))
    return parsed.select(
        normal_ticker("m.ticker").alias("ticker"),
        F.lpad(F.col("m.cik_str").cast("string"), 10, "0").alias("cik"),
    )


def explode_facts(raw: DataFrame, column: str = "facts") -> DataFrame:
    """cik + JSON facts -> one row per fact, USD and share units."""
    parsed = raw.select("cik", F.from_json(column, FACTS_SCHEMA).alias("facts"))
    tags = parsed.select("cik", F.explode(F.col("facts")["us-gaap"]).alias("tag", "body"))
    usd = F.try_element_at("body.units", F.lit("USD"))
    shares = F.coalesce(
        F.try_element_at("body.units", F.lit("shares")), F.try_element_at("body.units", F.lit("Shares"))
    )
    units = F.array(
        F.struct(F.lit("USD").alias("unit"), usd.alias("facts")),
        F.struct(F.lit("shares").alias("unit"), shares.alias("facts")),
    )
    return (
        tags.select("cik", "tag", F.explode(units).alias("u"))
        .select("cik", "tag", "u.unit", F.posexplode("u.facts").alias("pos", "fact"))
        .select(
            "cik",
            "tag",
            "unit",
            "pos",
            "fact.fy",
            "fact.fp",
            F.col("fact.start").cast("date").alias("start"),
            F.col("fact.end").cast("date").alias("end"),
            F.col("fact.filed").cast("date").alias("filed"),
            "fact.val",
        )
    )


def broken_documents(raw: DataFrame, column: str) -> DataFrame:
    """Landed rows whose JSON cannot be parsed, for quarantine; the parsers above leave them out."""
    return raw.filter(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def zip_submissions(raw: DataFrame) -> DataFrame:
    """Parallel arrays of recent filings -> rows with their position."""
    zipped = F.arrays_zip("form", "filingDate", "accessionNumber", "primaryDocument")
    keys = [c for c in raw.columns if c not in ("form", "filingDate", "accessionNumber", "primaryDocument")]
    return raw.select(*keys, F.posexplode(zipped).alias("pos", "f")).select(
        *keys,
        F.col("pos").cast("long").alias("pos"),
        F.col("f.form").alias("filing_type"),
        F.col("f.filingDate").cast("date").alias("filing_date"),
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.primaryDocument").alias("primary_document"),
    )


def within_form_limits(
    filings: DataFrame,
    order: Sequence[Column],
    limits: Mapping[str, int],
    key: str = "ticker",
) -> DataFrame:
    """First rows per form in the given order; forms without a limit drop out."""
    window = Window.partitionBy(key, "filing_type").orderBy(*order)
    largest = max(limits.values())
    limit = F.try_element_at(literal_map(limits), F.col("filing_type"))
    return (
        filings.filter(F.col("filing_type").isin(*limits))
        .withColumn("form_position", F.row_number().over(window))
        # the constant bound lets Spark cut the groups before the shuffle
        .filter(F.col("form_position") <= largest)
        .filter(F.col("form_position") <= limit)
        .withColumn("form_position", F.col("form_position").cast("long"))
    )


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat(
        F.lit(FILING_HOST),
        cik.cast("long").cast("string"),
        F.lit("/"),
        F.translate(accession, "-", ""),
        F.lit("/"),
        document,
    )


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags drop, spaces collapse."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return collapse(out)


def news_rows(raw: DataFrame, column: str = "value") -> DataFrame:
    """One provider article per line -> article columns."""
    keep = [c for c in raw.columns if c != column]
    return raw.select(*keep, F.from_json(column, NEWS_SCHEMA).alias("a")).select(
        *keep,
        F.col("a.headline").alias("title"),
        "a.source",
        F.timestamp_seconds("a.datetime").alias("published_at"),
        "a.url",
        "a.summary",
    )


def listed_symbols(lines: DataFrame, column: str = "value") -> DataFrame:
    """Pipe-separated listing lines; the trailer row is dropped."""
    keep = [c for c in lines.columns if c != column]
    rows = lines.select(
        *keep, F.from_csv(column, LISTING_SCHEMA, {"sep": "|"}).alias("s")
    ).select(*keep, "s.*")
    return rows.filter(
        F.col("symbol").isNotNull() & ~F.startswith("symbol", F.lit("File Creation Time"))
    ).withColumn("ticker", listing_ticker(F.col("symbol")))


def listing_ticker(symbol: Column) -> Column:
    return F.translate(normal_ticker(symbol), "./", "--")


def union_listings(first: DataFrame, second: DataFrame, order: str) -> DataFrame:
    """Both listings, the first one wins per ticker (combined map-side)."""
    both = first.withColumn("_source", F.lit(0)).unionByName(second.withColumn("_source", F.lit(1)))
    body = [c for c in first.columns if c != "ticker"]
    return (
        both.groupBy("ticker")
        .agg(F.min_by(F.struct(*body), F.struct("_source", order)).alias("r"))
        .select("ticker", "r.*")
    )


def is_plain_listing() -> Column:
    return (F.coalesce("etf", F.lit("N")) == "N") & (F.coalesce("test_issue", F.lit("N")) == "N")


def is_common_stock(name: Column) -> Column:
    """No blocked term anywhere in the upper-cased name."""
    upper = F.upper(name)
    blocked = F.lit(False)
    for term in BLOCKED_NAME_TERMS:
        blocked = blocked | F.contains(upper, F.lit(term))
    return ~blocked


def read_snapshot(spark: SparkSession, path: str, as_of=None) -> DataFrame:
    """A stored snapshot table; a date prunes to its partition."""
    snapshot = spark.read.parquet(path)
    return snapshot if as_of is None else snapshot.filter(F.col("as_of_date") == F.lit(as_of))


def latest_snapshot(snapshot: DataFrame, as_of) -> DataFrame:
    """Rows of the newest snapshot at or before a date."""
    newest = snapshot.filter(F.col("as_of_date") <= F.lit(as_of)).agg(
        F.max("as_of_date").alias("as_of_date")
    )
    return snapshot.join(F.broadcast(newest), "as_of_date", "left_semi")


def saved_selection(spark: SparkSession, path: str, top: int) -> DataFrame:
    """The best `top` names per research date of a stored run's selection."""
    return spark.read.parquet(f"{path}/selection").filter(F.col("screen_rank") <= top)
