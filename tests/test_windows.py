"""Windows, as-of marks, side-by-side sketches and price measures against plain Python."""

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import asof, prices
from plumbline.operators.quantiles import column_quantiles

DAY = date(2020, 1, 1)


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_windows_come_from_a_calendar(spark):
    days = [None, *[DAY + timedelta(days=i) for i in (0, 1, 5, 9, 10, 30)]]
    windows = [(DAY, DAY + timedelta(days=5)), (DAY + timedelta(days=5), DAY + timedelta(days=10)), (DAY + timedelta(days=9), DAY)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "id int, date date")
    inside = asof.rows_in_windows(rows, windows)
    got = sorted((r.id, r.start_date, r.end_date) for r in inside.collect())
    assert got == sorted((i, a, b) for i, d in enumerate(days) if d for a, b in windows if a <= d <= b)
    assert inside.columns == ["id", "date", "start_date", "end_date"]
    # no array of windows is filtered for a row
    assert "Join" in plan(inside) and "lambdafunction" not in plan(inside)


def test_marked_rows_are_those_that_answer_a_date(spark):
    days = [None, *[DAY + timedelta(days=i) for i in (0, 2, 3, 40)]]
    rows = spark.createDataFrame([("a", d) for d in days] + [("b", DAY)], "ticker string, date date")
    dates = [DAY - timedelta(days=1), DAY + timedelta(days=2), DAY + timedelta(days=30)]
    both = asof.with_validity(rows).select(asof.answers(dates).alias("mark"), (F.size(asof.answered(dates)) > 0).alias("same"))
    assert all(r.mark == r.same for r in both.collect()) and both.filter("mark").count() == 3


def test_columns_are_sketched_side_by_side(spark):
    rng = np.random.default_rng(3)
    values = [(int(i % 3), None if i % 7 == 0 else float(x), float(i % 5)) for i, x in enumerate(rng.normal(size=3000))]
    frame = spark.createDataFrame([(*v, None) for v in values], "g int, a double, b double, c double")
    got = {(r.g, r.metric): r for r in column_quantiles(frame, ["g"], ["a", "b", "c"], [0.05, 0.95]).collect()}
    assert set(got) == {(g, m) for g in range(3) for m in range(3)}
    for (g, m), r in got.items():
        have = [v[m + 1] for v in values if v[0] == g and v[m + 1] is not None] if m < 2 else []
        assert r.n == len(have)
        if have:
            assert (r.low, r.high) == (min(have), max(have))
            assert [r.q0, r.q1] == pytest.approx(list(np.quantile(have, [0.05, 0.95])))
        else:
            assert r.low is None and r.q0 is None


def test_measures_of_all_places_at_once():
    rng = np.random.default_rng(5)
    price = rng.uniform(5, 9, 400)
    price[[7, 50]], volume, index = np.nan, rng.uniform(1, 9, 400), rng.normal(0, 0.01, 400)
    index[20] = np.nan
    at = np.array([0, 1, 3, 60, 399])
    got = prices.measures_at(price, volume, index, at)
    returns = np.concatenate([[np.nan], price[1:] / price[:-1] - 1])
    for row, place in zip(got, at):
        seen, market = returns[: place + 1], index[: place + 1]
        both = ~np.isnan(seen) & ~np.isnan(market)
        measure = dict(zip(["n", *prices.MEASURES], row))
        assert measure["n"] == (~np.isnan(seen)).sum()
        wanted = {
            "annualized_volatility": np.nanstd(seen, ddof=1) * 252**0.5 if measure["n"] > 1 else np.nan,
            "beta_vs_spy": np.cov(seen[both], market[both])[0, 1] / np.var(market[both], ddof=1) if both.sum() > 1 else np.nan,
            "one_year_return": price[place] / price[place - 252] - 1 if place >= 252 else np.nan,
        }
        for name, value in wanted.items():
            assert measure[name] == pytest.approx(value, nan_ok=True), name
    # equal returns do not vary
    level = prices.measures_at(1.5 ** np.arange(30.0), np.ones(30), np.zeros(30), np.array([5, 29]))
    assert np.isnan(level[:, prices.MEASURES.index("sharpe_ratio") + 1]).all()
    assert np.isnan(level[:, prices.MEASURES.index("beta_vs_spy") + 1]).all()
