"""Rolling alpha from shared passes against separate fits."""

from datetime import date

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import calendars, models, rolling

FEATURES = ["a", "b", "c"]


def rows_of(seed=0, names=24):
    rng = np.random.default_rng(seed)
    days = calendars.training_dates(date(2001, 1, 1), 9)
    research = [date(2000, 10, 1), date(2001, 1, 1)]
    panel, current = [], []
    for r, day in enumerate(research):
        for d in days[r : r + 8]:
            own = np.random.default_rng([d.toordinal()])
            for t in range(names):
                x = own.normal(size=3) * [1, 10, 0.1] + [0, 50, 0]
                y = float(0.1 * x[0] - 0.01 * x[1] + own.normal() * 0.2)
                x = [None if own.random() < 0.1 else float(v) for v in x]
                panel.append((day, d, f"T{t:02d}", *x, None if own.random() < 0.05 else y))
        current += [(day, f"T{t:02d}", *map(float, rng.normal(size=3) * [1, 10, 0.1])) for t in range(names)]
    return panel, current


def test_rolling_alpha_equals_separate_fits(spark):
    panel_rows, current_rows = rows_of()
    kinds = ", ".join(f"{f} double" for f in FEATURES)
    panel = spark.createDataFrame(panel_rows, f"research_date date, as_of_date date, ticker string, {kinds}, {models.TARGET} double")
    current = spark.createDataFrame(current_rows, f"as_of_date date, ticker string, {kinds}")
    got = {(r.as_of_date, r.ticker): r.alpha for r in rolling.rolling_alpha(panel, current, FEATURES, min_train=6).collect()}
    assert len(got) == len(current_rows)
    for day in {r[0] for r in current_rows}:
        one = panel.filter(F.col("research_date") == F.lit(day)).drop("research_date")
        now = current.filter(F.col("as_of_date") == F.lit(day))
        want = models.train_predict(one, now, FEATURES, rolling.GRAM_MODELS, 6).collect()
        for r in want:
            assert abs(got[r.as_of_date, r.ticker] - r.alpha_expected_excess_return) < 1e-8


def test_too_few_dates_have_no_alpha(spark):
    panel_rows, current_rows = rows_of()
    kinds = ", ".join(f"{f} double" for f in FEATURES)
    first = min(r[0] for r in panel_rows)
    panel = spark.createDataFrame([r for r in panel_rows if r[0] != first or r[1] < date(1999, 6, 1)], f"research_date date, as_of_date date, ticker string, {kinds}, {models.TARGET} double")
    current = spark.createDataFrame(current_rows, f"as_of_date date, ticker string, {kinds}")
    out = rolling.rolling_alpha(panel, current, FEATURES, ["ridge"], 6)
    assert {r.as_of_date for r in out.select("as_of_date").distinct().collect()} == {r[0] for r in current_rows} - {first}


def test_plan_of_fits():
    days = calendars.training_dates(date(2001, 1, 1), 4)
    train, tests, whole = rolling.plan_fits({date(2001, 1, 1): days}, 2)
    assert [t[1:] for t in tests] == [(days[2], 0), (days[3], 1)] and whole == [(date(2001, 1, 1), 2)]
    assert [len([t for t in train if t[2] == k]) for k in range(3)] == [2, 3, 4]


def test_histories_on_alpha_agree_with_the_rule_methods(spark, monkeypatch):
    """With the score as alpha, the nine-method history holds the four-method one."""
    from plumbline.catalog import portfolio as cp

    sf = "/root/testdata/sf0.001"
    cp.SNAPSHOTS.clear()
    monkeypatch.setattr(cp, "brand_alpha", lambda s, d: cp.candidates(s, d).select(*cp.KEY, F.col("overall_score").alias("alpha")))
    rules = {(r.method, r.as_of_date): (r.status, r.holdings, r.ending_value) for r in cp.history(spark, sf).collect()}
    every = {(r.method, r.as_of_date): (r.status, r.holdings, r.ending_value) for r in cp.full_history(spark, sf).collect()}
    cp.SNAPSHOTS.clear()
    assert {m for m, _ in every} == {*cp.METHODS, "all_cash"}
    for key, (status, holdings, value) in rules.items():
        assert every[key][:2] == (status, holdings)
        assert value is None and every[key][2] is None or abs(every[key][2] - value) < 1e-9 * max(1, abs(value))
