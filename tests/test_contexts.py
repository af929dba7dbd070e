"""Nested contexts on small tables."""

from datetime import date

from plumbline.operators import contexts

D = date(2000, 6, 30)


def holdings(spark):
    rows = [(D, "A", 1, 0.6), (D, "B", 2, 0.4), (date(1999, 6, 30), "A", 1, 1.0)]
    return spark.createDataFrame(rows, "as_of_date date, ticker string, screen_rank int, weight double")


def articles(spark):
    rows = [(day, "A", i, f"t{i}", "s", day, f"u{i}", None, 5.0 - i) for day in (date(2000, 5, 1), date(2000, 8, 1)) for i in range(1, 15)]
    return spark.createDataFrame(rows, "as_of_date date, ticker string, position long, title string, source string, published_on date, url string, summary string, relevance_score double")


def filings(spark):
    rows = [(t, date(1999, 1 + k, 1), "8-K", f"{t}{k:02d}", "<p>Item 1. Business text.</p>") for t in "AB" for k in range(11)] + [("A", date(2000, 7, 1), "10-K", "late", "later")]
    return spark.createDataFrame(rows, "ticker string, filing_date date, filing_type string, accession_number string, raw_text string")


def test_holding_contexts_are_bounded_ordered_and_point_in_time(spark):
    out = {(r.as_of_date, r.ticker): r for r in contexts.holding_contexts(holdings(spark), articles(spark), filings(spark)).collect()}
    assert len(out) == 3
    a, b, early = out[D, "A"], out[D, "B"], out[date(1999, 6, 30), "A"]
    assert [x.position for x in a.news] == list(range(1, 13)) and {x.published_on for x in a.news} == {date(2000, 5, 1)}
    assert [x.accession_number for x in a.filings] == [f"A{k:02d}" for k in range(10, 2, -1)]
    assert all("Business text" in x.relevant_excerpt for x in a.filings)
    assert b.news == [] and len(b.filings) == 8
    assert early.news == [] and [x.accession_number for x in early.filings] == [f"A{k:02d}" for k in range(5, -1, -1)]


def test_portfolio_contexts(spark):
    rows = contexts.holding_contexts(holdings(spark), articles(spark), filings(spark))
    out = {r.as_of_date: r for r in contexts.portfolio_contexts(rows, ["screen_rank", "ticker", "weight"]).collect()}
    one = out[D]
    assert [h.ticker for h in one.holdings] == ["A", "B"] and abs(one.total_weight - 1) < 1e-9
    assert (one.articles, one.filings, one.without_news) == (12, 16, 1)
    assert len(one.holdings[0].news) == 12


def test_company_bundles(spark):
    companies = spark.createDataFrame([("A", "a"), ("C", "c")], "ticker string, name string")
    market = spark.createDataFrame([("A", 1.5)], "ticker string, sma_50 double")
    statements = spark.createDataFrame([("A", date(1999, m, 28), f"Q{m}", float(m), 1.0, 2.0) for m in range(1, 8)], "ticker string, period_end_date date, fiscal_period string, revenue double, net_income double, total_assets double")
    evidence = contexts.holding_contexts(holdings(spark).filter("screen_rank = 1").filter("weight < 1"), articles(spark), filings(spark))
    out = {r.ticker: r for r in contexts.company_bundles(companies, market, statements, evidence).collect()}
    assert [s.revenue for s in out["A"].statements] == [7.0, 6.0, 5.0, 4.0] and out["A"].market.sma_50 == 1.5
    assert out["C"].market is None and out["C"].statements == [] and out["C"].news == [] and out["C"].name == "c"
