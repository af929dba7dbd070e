"""Work per row and per round that must not grow with the tables."""

from __future__ import annotations

import re
import threading
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import load
from plumbline.operators import factors, learned, models, prices
from plumbline.streaming import ingest


def _bars(spark, n=260):
    rng = np.random.default_rng(3)
    rows = []
    for ticker in ("a", "b"):
        for i in range(n):
            price = None if ticker == "b" and i == 40 else (5.0 if ticker == "b" and i < 30 else float(rng.uniform(10, 20)))
            rows.append((ticker, date(2020, 1, 1) + timedelta(days=i), price, price, int(rng.integers(1, 99))))
    return spark.createDataFrame(rows, "ticker string, date date, close double, adjusted_close double, volume long")


def test_long_averages_are_put_together_from_short_frames(spark):
    out = prices.with_technicals(prices.with_returns(_bars(spark)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    reach = [int(n) for n in re.findall(r"RowFrame, -(\d+), currentrow", plan)]
    assert reach and max(reach) < 20  # every row reads its moving frame anew
    got = out.orderBy("ticker", "date").toPandas()
    for _, part in got.groupby("ticker"):
        part = part.reset_index(drop=True)
        price = part["price"].astype(float)
        for n in (20, 50, 200):
            np.testing.assert_allclose(part[f"sma_{n}"].astype(float), price.rolling(n).mean(), rtol=1e-12)
        np.testing.assert_allclose(part["volume_sma_20"], part["volume"].rolling(20).mean(), rtol=1e-12)
        width = (part["bollinger_upper_20"] - part["sma_20"]).astype(float) / 2
        np.testing.assert_allclose(width, price.rolling(20).std(), rtol=1e-9, atol=1e-6)
        delta = price.diff()
        gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta).clip(lower=0).rolling(14).mean()
        expected = 100 - 100 / (1 + gain / loss)
        known = expected.notna() & (loss > 1e-9)
        np.testing.assert_allclose(part["rsi_14"].astype(float)[known], expected[known], rtol=1e-6)
        assert pd.isna(part["sma_200"].iloc[198]) and (part["ticker"][0] == "b" or pd.notna(part["sma_200"].iloc[199]))


def test_keys_of_a_stream_share_calls_and_stay_exact(spark, tmp_path):
    rows = [(f"k{i % 500}", datetime(2024, 1, 1 + i % 3, 12), 2**60 + i, None if i % 7 else i) for i in range(1500)]
    schema = "name string, ts timestamp, seq long, value long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/landing")
    stream = ingest.file_stream(spark, f"{tmp_path}/landing", schema)
    first = ingest.first_seen(stream, ["name"], "ts", ["ts", "seq"], "7 days", 7, buckets=16)
    progress = ingest.run_table(first, f"{tmp_path}/table", f"{tmp_path}/checkpoint")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]) <= 16
    expected = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        expected.setdefault(row[0], row)
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/table").collect()} == set(expected.values())


def test_forest_histograms_and_folds(spark, monkeypatch):
    assert learned.TREES_AT_ONCE >= learned.EXTRA["trees"]  # levels of all trees share their sums
    assert learned.FOREST_ROWS_PER_TASK < learned.ROWS_PER_TASK
    running, most, both = [], [], threading.Event()

    def fit_predict(train, score, features, names, **sizes):
        running.append(1)
        most.append(len(running))
        if len(running) > 1:
            both.set()
        both.wait(20)
        running.pop()
        return score.select(*models.KEY, F.lit(1.0).alias("ridge"))

    monkeypatch.setattr(models, "fit_predict", fit_predict)
    rows = [(date(2020, 1 + i, 1), t, 0.1, 1.0) for i in range(4) for t in "ab"]
    panel = spark.createDataFrame(rows, f"as_of_date date, ticker string, {models.TARGET} double, x double")
    out = models.out_of_fold(panel, ["x"], ["ridge"], 2)
    assert max(most) == 2 and out.count() == 4


def test_prediction_columns_are_whole():
    _, twins = load()
    for column in ("predicted", "prediction_error", "actual_return", "benchmark_return", "residual"):
        assert f" AS {column}" in twins["j_pred_actual"]


def test_bars_without_a_date_count_and_later_bars_do_not(spark, monkeypatch):
    seen = {}

    def panel(bars, benchmark):
        seen["dates"] = {r.date for r in bars.select("date").collect()}
        raise StopIteration

    monkeypatch.setattr(prices, "price_panel", panel)
    days = [None, date(2020, 1, 1), date(2020, 1, 2)]
    bars = spark.createDataFrame([("a", day) for day in days], "ticker string, date date")
    with pytest.raises(StopIteration):
        factors.raw_factors(bars, bars, [date(2020, 1, 1)], "x")
    assert seen["dates"] == {None, date(2020, 1, 1)}


def test_model_queries_share_one_price_panel(spark, monkeypatch):
    """Training dates and the research date come from one raw_factors call over stored bars and statements."""
    from plumbline.catalog import models as catalog
    from plumbline.catalog.twin import SNAPSHOTS
    from plumbline.operators import factors
    from plumbline.sources import testbed

    folder = "/root/testdata/sf0.001"
    panels, sums = [], []
    raw_factors, bars = factors.raw_factors, testbed.bars
    monkeypatch.setattr(factors, "raw_factors", lambda b, s, dates, *rest: panels.append(sorted(dates)) or raw_factors(b, s, dates, *rest))
    monkeypatch.setattr(testbed, "bars", lambda *a: sums.append(a) or bars(*a))
    monkeypatch.setattr(SNAPSHOTS, "_frames", {})
    trained, now = catalog.training(spark, folder), catalog.current(spark, folder)
    assert len(panels) == 1 and panels[0][-1] == catalog.DAY and len(panels[0]) == 13
    assert len(sums) == 1
    assert {r[0] for r in now.select("as_of_date").distinct().collect()} == {catalog.DAY}
    assert catalog.DAY not in {r[0] for r in trained.select("as_of_date").distinct().collect()}


def test_target_bounds_are_not_computed_by_every_pass(spark):
    """The clipped rows hold the bounds as numbers: no join, no quantile job below them."""
    from plumbline.operators import models

    panel = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], f"{models.TARGET} double")
    rows = models.prepared(panel)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert sorted(r[0] for r in rows.collect()) == [1.0, *map(float, range(1, 100)), 99.0]
    assert models.prepared(panel.limit(0)).count() == 0


def test_wide_panel_is_not_sorted_again_for_the_as_of_rows(spark):
    """The next bar's date is taken before the exponential averages; rows without a date answer no date."""
    from datetime import date

    from plumbline.operators import asof

    rows = spark.createDataFrame(
        [("a", date(2000, 1, 1)), ("a", date(2000, 3, 1)), ("a", None), ("b", date(2000, 2, 1))], "ticker string, date date"
    )
    dates = [date(2000, 1, 31), date(2000, 3, 31)]
    got = asof.answering(asof.with_validity(rows), dates).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, asof.latest_rows(rows, dates).collect()))
    assert len(got) == 3


def test_measures_of_marked_rows_equal_those_of_windows(spark):
    """Factors measure the bars that answer a date, not every bar; missing prices, zeros and short histories included."""
    rng = np.random.default_rng(5)
    rows = []
    for ticker, n in (("a", 700), ("b", 260), ("c", 3), ("d", 1), ("x", 700), (None, 40)):
        for i in range(n):
            price = None if rng.random() < 0.02 and ticker != "d" else float(rng.uniform(10, 20))
            if ticker == "b" and i < 30:
                price = 0.0 if i < 2 else 5.0
            day = None if ticker == "b" and i == 259 else date(2020, 1, 1) + timedelta(days=i)
            rows.append((ticker, day, price, price, int(rng.integers(1, 99)), int(rng.integers(1, 9))))
    schema = "ticker string, date date, close double, adjusted_close double, volume long, shares_outstanding long"
    # several batches to a ticker, several tickers to a batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        bars = spark.createDataFrame(rows, schema).repartition("ticker")
        every = prices.price_panel(bars, "x").filter("ticker is not null and hash(ticker, date) % 5 = 0").toPandas()
        marked = bars.withColumn(prices.WANTED, F.expr("coalesce(hash(ticker, date) % 5 = 0, false)"))
        panel = prices.price_panel(marked, "x")
        assert "_part_" not in panel._jdf.queryExecution().optimizedPlan().toString()  # sums of the exponential averages of every bar
        some = panel.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    every, some = (f.sort_values(["ticker", "date"]).reset_index(drop=True) for f in (every, some))
    assert len(some) > 200 and some[["ticker", "date"]].equals(every[["ticker", "date"]])
    for column in ["price", "return_count", "macd", "macd_signal", *[m for m in prices.MEASURES if m[0] != "_"]]:
        np.testing.assert_allclose(some[column].astype(float), every[column].astype(float), rtol=1e-8, atol=1e-9, err_msg=column)


def test_quotients_are_taken_for_the_newest_periods_alone(spark):
    from plumbline.operators import fundamentals

    rng = np.random.default_rng(6)
    rows = [
        (t, 2018 + i // 4, "FY" if i % 4 == 3 else f"Q{i % 4 + 1}", date(2018 + i // 4, 3 * (i % 4) + 3, 28), date(2018 + i // 4, 3 * (i % 4) + 3, 28) + timedelta(days=60),
         *[None if rng.random() < 0.05 else float(v) for v in rng.uniform(1, 9, len(fundamentals.METRICS))])
        for t in ("a", "b") for i in range(10 if t == "a" else 2)
    ]
    schema = "ticker string, fiscal_year int, fiscal_period string, period_end_date date, filed_date date, "
    statements = spark.createDataFrame(rows, schema + ", ".join(f"{m} double" for m in fundamentals.METRICS))
    dates = [date(2018, 6, 30), date(2019, 12, 31), date(2021, 1, 1)]
    caps = spark.createDataFrame([(d, "a", 7.0) for d in dates], "as_of_date date, ticker string, market_cap double")
    got = fundamentals.summary(statements, caps, dates)
    seen = fundamentals.visible(statements, dates)
    want = fundamentals.latest_period(fundamentals.ratios(fundamentals.by_mode(seen, "quarterly"), caps))
    columns = want.columns
    assert sorted(map(repr, got.select(columns).collect())) == sorted(map(repr, want.collect())) and want.count() == 6
    picks = [f._jdf.queryExecution().optimizedPlan().toString().count("max_by(struct(fiscal_year") for f in (want, got)]
    assert picks == [1, 0]  # no period row but the newest carries the quotients


def test_shares_of_bin_edges_are_built_once(spark, monkeypatch):
    seen = []
    percentile = F.percentile_approx
    monkeypatch.setattr(learned.F, "percentile_approx", lambda value, shares, *rest: seen.append(shares) or percentile(value, shares, *rest))
    rows = spark.createDataFrame([([float(i), float(i % 3)],) for i in range(40)], "z array<double>")
    assert learned.bin_edges(rows, 2, 4) == [[9.0, 19.0, 29.0], [0.0, 1.0, 2.0]]
    assert len(seen) == 2 and seen[0] is seen[1] and not isinstance(seen[0], list)


def test_statements_read_the_order_lines_once(spark, tmp_path):
    from plumbline.sources import testbed

    rows = [
        (s, datetime(2020, 3 * q + 1, 5), 10.0 + s + q, 2.0, 0.01 * q, 0.02)
        for s in (1, 3) for q in range(4) if not (s == 3 and q == 1)
    ]
    schema = "l_suppkey long, l_shipdate timestamp, l_extendedprice double, l_quantity double, l_discount double, l_tax double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = testbed.statements(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    got = {(r.ticker[-1], r.fiscal_period): r for r in out.collect()}
    # three quarters give no annual row
    assert set(got) == {("1", "Q1"), ("1", "Q2"), ("1", "Q3"), ("1", "FY"), ("3", "Q1"), ("3", "Q3")}
    assert got["1", "FY"].revenue == 11 + 12 + 13 + 14 and got["1", "Q2"].revenue == 12
    assert got["1", "FY"].period_end_date == date(2020, 12, 31) and got["1", "Q3"].period_end_date == date(2020, 9, 30)
    assert got["1", "FY"].filed_date == date(2021, 3, 16) and got["3", "Q3"].filed_date == date(2020, 11, 14)
    assert got["3", "Q1"].r_and_d_expense is None and got["1", "Q1"].r_and_d_expense == 0.0
