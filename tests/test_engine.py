"""Micro fixtures, pandas cross-checks, plan checks."""

import re
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import asof, calendars, covariance, fundamentals, portfolio, prices
from plumbline.operators.quantiles import exact_quantiles
from plumbline.operators.ranking import ranked
from plumbline.sources import tables, testbed

SF = "/root/testdata/sf0.001"
DAY = date(2000, 1, 1)


def bars(spark, values, ticker="T"):
    rows = [(ticker, DAY + timedelta(days=i), float(v), float(v), 10) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "ticker string, date date, close double, adjusted_close double, volume long")


def test_technicals_match_pandas(spark):
    """1,300 rows cross two block borders of the exponential averages."""
    values = (100 + np.cumsum(np.random.default_rng(1).normal(size=1300))).tolist()
    got = prices.with_technicals(prices.with_returns(bars(spark, values))).orderBy("date").toPandas()
    p = pd.Series(values)
    ema = lambda s, n: s.ewm(span=n, adjust=False).mean()
    macd = ema(p, 12) - ema(p, 26)
    np.testing.assert_allclose(got["ema_26"], ema(p, 26), rtol=1e-9)
    np.testing.assert_allclose(got["macd_signal"], ema(macd, 9), rtol=1e-6, atol=1e-9)
    delta = p.diff()
    rs = delta.clip(lower=0).rolling(14).mean() / (-delta.clip(upper=0)).rolling(14).mean()
    np.testing.assert_allclose(got["rsi_14"], 100 - 100 / (1 + rs), rtol=1e-7)
    np.testing.assert_allclose(got["sma_200"], p.rolling(200).mean(), rtol=1e-9)


def test_flat_and_rising_series(spark):
    flat = prices.with_technicals(prices.with_risk(prices.with_returns(bars(spark, [5.0] * 20)))).orderBy("date").collect()[-1]
    assert flat.sharpe_ratio is None and flat.rsi_14 is None
    up = prices.with_technicals(prices.with_returns(bars(spark, [float(i + 1) for i in range(20)]))).orderBy("date").collect()[-1]
    assert up.rsi_14 == 100.0


def test_future_rows_never_change_the_past(spark):
    rows = prices.with_risk(prices.with_returns(bars(spark, [10.0, 11, 9, 12, 15, 8])))
    short = prices.with_risk(prices.with_returns(bars(spark, [10.0, 11, 9, 12])))
    day = [DAY + timedelta(days=3)]
    pick = lambda f: asof.latest_rows(f, day).select("annualized_volatility", "max_drawdown", "cumulative_return").first()
    assert pick(rows) == pick(short)


def test_q4_inference(spark):
    metrics = fundamentals.METRICS
    def row(fy, fp, end, revenue):
        return ("T", fy, fp, end, end + timedelta(days=40), *[revenue if m == "revenue" else 1.0 for m in metrics])
    rows = [
        row(1999, "Q1", date(1999, 3, 31), 10.0), row(1999, "Q1", date(1999, 4, 1), 11.0),
        row(1999, "Q2", date(1999, 6, 30), 20.0), row(1999, "Q3", date(1999, 9, 30), None),
        row(1999, "FY", date(1999, 12, 31), 100.0), row(1998, "Q1", date(1998, 3, 31), 1.0),
        row(1998, "Q2", date(1998, 6, 30), 2.0), row(1998, "Q3", date(1998, 9, 30), 3.0),
        row(1998, "Q4", date(1998, 12, 31), 77.0), row(1998, "FY", date(1998, 12, 31), 10.0),
    ]
    schema = "ticker string, fiscal_year int, fiscal_period string, period_end_date date, filed_date date, " + ", ".join(f"{m} double" for m in metrics)
    seen = fundamentals.visible(spark.createDataFrame(rows, schema), [date(2000, 6, 30)])
    q4 = {r.fiscal_year: r for r in fundamentals.inferred_q4(seen).collect()}
    assert q4[1998].revenue == 4.0 and q4[1999].revenue is None
    assert q4[1999].net_income == -2.0 and q4[1999].total_assets == 1.0


def test_exact_quantiles_on_large_tied_groups(spark):
    """20,000 rows, a third of them one value: the narrow bracket path."""
    values = np.random.default_rng(2).normal(size=20000)
    values[: len(values) // 3] = 0.25
    frame = spark.createDataFrame(pd.DataFrame({"g": 1, "value": values}))
    row = exact_quantiles(frame, ["g"], [0.01, 0.05, 0.5, 0.95]).first()
    np.testing.assert_allclose([row.q0, row.q1, row.q2, row.q3], np.quantile(values, [0.01, 0.05, 0.5, 0.95]), rtol=1e-12)


def test_ranking_with_ties(spark):
    import hashlib

    data = [("d", f"k{i}", float(i % 7) if i % 3 else 1.0) for i in range(300)] + [("d", "none", None)]
    frame = spark.createDataFrame(data, "as_of_date string, ticker string, s double")
    got = [r.ticker for r in ranked(frame, ["as_of_date"], "s", "ticker", "rank").orderBy("rank").collect()]
    key = lambda t: (t[2] is None, -(t[2] or 0), hashlib.md5(t[1].encode()).hexdigest(), t[1])
    assert got == [t[1] for t in sorted(data, key=key)]


def brute_cap(weights, cap):
    free, out, left = dict(weights), {}, 1.0
    while free:
        total = sum(free.values())
        share = {k: v / total * left for k, v in free.items()}
        over = [k for k, v in share.items() if v > cap]
        if not over:
            return {**out, **share}
        for k in over:
            out[k] = cap
            left -= cap
            free.pop(k)
    return out


def test_caps(spark):
    weights = {"A": 0.7, "B": 0.2, "C": 0.07, "D": 0.03}
    frame = spark.createDataFrame([(DAY, k, v) for k, v in weights.items()], "as_of_date date, ticker string, weight double")
    got = {r.ticker: r.weight for r in portfolio.capped(frame, 0.4).collect()}
    assert got == pytest.approx(brute_cap(weights, 0.4))
    net = {r.ticker: r.weight for r in portfolio.capped_net(frame, 0.4).collect()}
    assert sum(net.values()) == pytest.approx(1.0) and max(net.values()) <= 0.4 + 1e-9
    with pytest.raises(Exception, match="1 / N"):
        portfolio.capped(frame, 0.2).collect()


def test_covariance_and_risk_parity(spark):
    x = np.random.default_rng(3).normal(size=(40, 3))
    rows = [(DAY, DAY + timedelta(days=i), f"T{j}", float(x[i, j])) for i in range(40) for j in range(3)]
    frame = spark.createDataFrame(rows, "as_of_date date, date date, ticker string, ret double")
    got = {(r.t1, r.t2): r["cov"] for r in covariance.sample(frame).collect()}
    want = np.cov(x, rowvar=False) * 252
    assert got[("T0", "T2")] == pytest.approx(want[0, 2]) and got[("T1", "T1")] == pytest.approx(want[1, 1])
    even = 0.04 * (0.7 * np.eye(3) + 0.3)
    assert portfolio.equal_risk(even) == pytest.approx(np.full(3, 1 / 3))
    assert portfolio.hierarchical(want, np.array([1.0, np.nan, 2.0])).sum() == pytest.approx(1.0)


def test_calendar():
    windows = calendars.rebalance_windows(date(2024, 4, 1), date(2026, 3, 31))
    assert len(windows) == 8 and windows[0] == (date(2024, 4, 1), date(2024, 6, 30)) and windows[-1][1] == date(2026, 3, 31)
    days = calendars.training_dates(date(2024, 4, 1))
    assert len(days) == 12 and days[-1] == date(2024, 1, 1) and days[0] == date(2021, 4, 1)


def test_insert_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, seq int, v int")
    first = tables.insert_if_absent(rows.limit(0), rows, ["k"], ["seq"])
    assert sorted(map(tuple, first.collect())) == [("a", 1, 1), ("b", 1, 3)]
    assert tables.insert_if_absent(first, rows, ["k"], ["seq"]).count() == 0


def test_price_panel_plan(spark):
    """One ticker shuffle feeds all windows; nothing runs in Python."""
    plan = prices.price_panel(testbed.bars(spark, SF), testbed.BENCHMARK)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    # one for the tickers, one for the benchmark's own series
    assert len(re.findall(r"hashpartitioning\(ticker#\d+, \d+\)", plan)) <= 2


def test_every_twin_belongs_to_a_query():
    from plumbline.catalog import load

    queries, twins = load()
    assert set(twins) <= set(queries) and len(queries) > 230


@pytest.mark.parametrize("method", ["score_weighted", "hierarchical_risk_parity"])
def test_research_run(spark, method):
    from plumbline.plans.research import ResearchConfig, run

    config = ResearchConfig(testbed.BENCHMARK, minimum_return_rows=50, top_screen_n=6, final_portfolio_n=3, method=method, max_weight=0.5)
    out = run(testbed.bars(spark, SF, testbed.BRAND), testbed.statements(spark, SF, testbed.BRAND), [date(2000, 12, 31)], config)
    weights = out["weights"].collect()
    assert out["selection"].count() == 3 and sum(w.weight for w in weights) == pytest.approx(1.0)
    assert max(w.weight for w in weights) <= 1.0


def test_long_averages_carry_their_whole_history(spark):
    values = (100 + np.cumsum(np.random.default_rng(5).normal(size=3000))).tolist()
    spans = {"ema_5": 5, "ema_200": 200, "ema_500": 500}
    rows = prices.with_emas(prices.with_returns(bars(spark, values)), "price", spans).orderBy("date").toPandas()
    for name, span in spans.items():
        np.testing.assert_allclose(rows[name], pd.Series(values).ewm(span=span, adjust=False).mean(), rtol=1e-9)


def test_quantiles_of_small_groups(spark):
    rng = np.random.default_rng(4)
    data = {g: rng.normal(size=n) for g, n in enumerate([1, 2, 3, 7, 10, 11, 99, 150, 1001])}
    frame = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g int, value double")
    for row in exact_quantiles(frame, ["g"], [0.0, 0.05, 0.5, 0.99]).collect():
        np.testing.assert_allclose([row.q0, row.q1, row.q2, row.q3], np.quantile(data[row.g], [0.0, 0.05, 0.5, 0.99]), rtol=1e-12)


def test_risk_contributions_are_equal():
    x = np.random.default_rng(6).normal(size=(500, 12)) @ np.random.default_rng(7).normal(size=(12, 12))
    matrix = np.cov(x.T)
    weights = portfolio.equal_risk(matrix)
    share = weights * (matrix @ weights) / (weights @ matrix @ weights)
    np.testing.assert_allclose(share, 1 / 12, rtol=1e-8)
    assert weights.sum() == pytest.approx(1)
    assert portfolio.equal_risk(np.zeros((4, 4))).tolist() == [0.25] * 4


def test_hierarchy_merges_and_shares():
    points = np.array([0.0, 0.1, 5.0, 5.3, 20.0])
    distance = np.abs(points[:, None] - points)
    for linkage in portfolio.LINKAGES:
        order = portfolio.merge_order(distance, linkage)
        assert [sorted(a + b) for a, b in order] == [[0, 1], [2, 3], [0, 1, 2, 3], [0, 1, 2, 3, 4]]
    weights = portfolio.hierarchical(np.diag([1.0, 4.0, 2.0]), np.full(3, np.nan), use_signal=False)
    assert weights.sum() == pytest.approx(1) and weights[0] > weights[1]
    block = np.array([[4.0, 1.0], [1.0, 2.0]])
    inverse = np.array([0.25, 0.5]) / 0.75
    assert portfolio.cluster_variance(block, [0, 1]) == pytest.approx(inverse @ block @ inverse)


def test_covariance_of_many_names(spark):
    """150 names, more than any portfolio of the defaults."""
    x = np.random.default_rng(8).normal(size=(30, 150))
    rows = [(DAY, DAY + timedelta(days=i), f"T{j:03d}", float(x[i, j])) for i in range(30) for j in range(150)]
    frame = spark.createDataFrame(rows, "as_of_date date, date date, ticker string, ret double")
    got = covariance.sample(frame).toPandas().pivot(index="t1", columns="t2", values="cov").to_numpy()
    want = np.cov(x.T) * 252
    upper = np.triu_indices(150)
    np.testing.assert_allclose(got[upper], want[upper], rtol=1e-9)


def test_elastic_net_grid_against_plain_descent(spark):
    from plumbline.operators import models

    rng = np.random.default_rng(9)
    x = rng.normal(size=(203, 4))
    y = x @ np.array([0.5, 0.0, -0.3, 0.0]) + rng.normal(size=203) * 0.4
    bounds = np.cumsum([0, 41, 41, 41, 40, 40])
    parts = {k: (lambda z: z.T @ z)(np.column_stack([np.ones(b - a), x[a:b], y[a:b]])) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))}
    beta = models.elastic_net(parts)

    def descent(xs, ys, alpha, ratio):
        xs, ys, b = xs - xs.mean(0), ys - ys.mean(), np.zeros(4)
        for _ in range(2000):
            for i in range(4):
                rest = xs[:, i] @ (ys - xs @ b + xs[:, i] * b[i]) / len(ys)
                b[i] = np.sign(rest) * max(abs(rest) - alpha * ratio, 0) / (xs[:, i] @ xs[:, i] / len(ys) + alpha * (1 - ratio))
        return b

    def error(alpha, ratio):
        out = []
        for a, b in zip(bounds, bounds[1:]):
            keep = np.r_[0:a, b:203]
            coef = descent(x[keep], y[keep], alpha, ratio)
            out.append(((y[a:b] - y[keep].mean() - (x[a:b] - x[keep].mean(0)) @ coef) ** 2).mean())
        return np.mean(out)

    best = min(((r, a) for r in models.NET_RATIOS for a in models.NET_ALPHAS), key=lambda k: error(k[1], k[0]))
    np.testing.assert_allclose(beta, descent(x, y, best[1], best[0]), atol=1e-7)
    frame = spark.createDataFrame([(DAY + timedelta(days=i // 50), f"T{i:03d}") for i in range(203)], "as_of_date date, ticker string")
    folds = models.contiguous_folds(frame).orderBy("as_of_date", "ticker").toPandas()["net_fold"]
    assert folds.value_counts().sort_index().tolist() == [41, 41, 41, 40, 40] and folds.is_monotonic_increasing


def test_base_models_against_numpy(spark):
    """Ridge, Bayesian ridge, PCR and PLS on the Gram matrix against the row-wise formulas."""
    from plumbline.operators import models

    rng = np.random.default_rng(11)
    x = rng.normal(size=(160, 5)) @ rng.normal(size=(5, 5))
    y = x @ np.array([0.3, -0.2, 0.0, 0.1, 0.05]) + rng.normal(size=160) * 0.5
    rows = [(DAY + timedelta(days=i // 40), f"T{i:03d}", *map(float, x[i]), float(y[i])) for i in range(160)]
    names = [f"x{j}" for j in range(5)]
    frame = spark.createDataFrame(rows, "as_of_date date, ticker string, " + ", ".join(f"{n} double" for n in names) + f", {models.TARGET} double")
    got = {}
    for r in models.trained(frame, names).collect():
        got.setdefault(r.model, np.zeros(5))[names.index(r.feature)] = r.coefficient
    low, high = np.quantile(y, [0.01, 0.99])
    t = np.clip(y, low, high)
    z = (x - x.mean(0)) / x.std(0)
    c = t - t.mean()

    def loo(z, alpha):
        hat = z @ np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T) + 1 / len(z)
        return (((c - (hat - 1 / len(z)) @ c) / (1 - np.diag(hat))) ** 2).sum()

    solve = lambda z, a: np.linalg.solve(z.T @ z + a * np.eye(z.shape[1]), z.T @ c)
    np.testing.assert_allclose(got["ridge"], solve(z, min(models.ALPHAS, key=lambda a: loo(z, a))), atol=1e-6)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    scores = z @ vt.T
    want = vt.T @ solve(scores, min(models.ALPHAS, key=lambda a: loo(scores, a)))
    np.testing.assert_allclose(got["principal_components"], want, atol=1e-6)
    full = np.linalg.lstsq(z, c, rcond=None)[0]
    np.testing.assert_allclose(got["partial_least_squares"], full, atol=1e-6)  # as many components as features
    noise, weight = 1 / c.var(), 1.0
    for _ in range(500):
        cover = np.linalg.inv(weight * np.eye(5) + noise * z.T @ z)
        mean = noise * cover @ z.T @ c
        used = 5 - weight * np.trace(cover)
        weight, noise = (used + 2e-6) / (mean @ mean + 2e-6), (160 - used + 2e-6) / (((c - z @ mean) ** 2).sum() + 2e-6)
    np.testing.assert_allclose(got["bayesian_ridge"], mean, atol=2e-3)
    assert set(got) == set(models.STATISTICAL)


def test_combined_stack_has_every_base_at_full_size(monkeypatch):
    """The meta model sees six statistical and four learned models, none of them shortened, on configured training dates."""
    from unittest.mock import MagicMock

    from plumbline.catalog import models as catalog
    from plumbline.operators import learned, models

    calls, stacks = [], []
    frame = MagicMock()
    for name in ("training", "current", "oof", "base"):
        monkeypatch.setattr(catalog, name, lambda s, d: frame)
    monkeypatch.setattr(catalog.SNAPSHOTS, "get", lambda s, key, build: build())
    monkeypatch.setattr(models, "fit_predict", lambda p, n, f, m, **sizes: calls.append((list(m), sizes)) or frame)
    monkeypatch.setattr(models, "out_of_fold", lambda p, f, m, k: calls.append((list(m), k)) or frame)
    monkeypatch.setattr(models, "stacked", lambda o, b, m, n: stacks.append(list(m)) or frame)
    catalog.combined(None, "d")
    bases = ["random_forest", "extra_trees", "gradient_boosting", "mlp"]
    assert (bases, {}) in calls and (bases, 8) in calls
    assert stacks == [[*models.STATISTICAL, *bases]]
    assert learned.BOOSTING["rounds"] == 250 and learned.EXTRA["trees"] == 300 and catalog.TRAINING.training_lookback_periods == 12


def test_research_run_trains_before_it_weighs(spark):
    """Alpha comes from dates before the research date only, and is the signal of the signal methods."""
    from plumbline.plans import research

    brand = testbed.BRAND
    data = SF.replace("sf0.001", "sf0.01")
    bars_in, statements_in = testbed.bars(spark, data, brand), testbed.statements(spark, data, brand)
    day = date(2000, 6, 30)
    config = research.ResearchConfig(
        benchmark=testbed.BENCHMARK, minimum_return_rows=50, minimum_label_rows=5, top_screen_n=12, final_portfolio_n=4,
        method="maximum_sharpe", training_lookback_periods=3, min_train_periods=2, base_models=("ridge",), max_weight=0.6,
    )
    panel = research.training_panel(bars_in, statements_in, day, config)
    assert panel.agg(F.max("as_of_date")).first()[0] < day
    out = research.run(bars_in, statements_in, [day], config)
    weights = out["weights"].toPandas()
    assert weights["weight"].sum() == pytest.approx(1) and weights["weight"].max() <= 0.6 + 1e-9
    assert set(weights["ticker"]) <= {r.ticker for r in out["selection"].collect()}
    assert out["alpha"].filter("alpha IS NOT NULL").count() > 4


def test_written_tables_leave_no_shuffle_setting_behind(spark):
    from plumbline.sources import stored

    before = spark.conf.get(stored.FREE_SHUFFLES, "false")
    table = stored.settle(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(stored.FREE_SHUFFLES, "false") == before
    assert sorted(r["count"] for r in table.collect()) == [142, 143, 143, 143, 143, 143, 143]


def test_released_tables_are_gone(spark):
    from plumbline.sources import stored

    table = stored.settle(spark.range(10), "numbers")
    assert stored.listing(spark, table._stored_at)
    stored.release(table)
    assert stored.listing(spark, table._stored_at) == ()
