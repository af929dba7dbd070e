"""Boosting, extremely random trees and the network: one task or several, and plain NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import learned, models

KEYS = ["as_of_date", "ticker"]


def sample(rows=420, seed=0, width=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, width)), 3).astype(np.float32)
    y = np.where(x[:, 0] > 0.3, 1.0, 0.0) + 0.5 * x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=rows)
    return x, y


def frame(spark, x, y):
    rows = [(i // 40, f"t{i}", [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "as_of_date int, ticker string, z array<double>, y double")


def plain_boosting(x, y, edges, rounds, rate, leaves, leaf_rows, l2):
    """Best-first boosting over explicit sets of rows and every candidate cut."""
    guess = np.full(len(y), y.mean())
    for _ in range(rounds):
        slope = guess - y

        def cut_of(rows):
            best = (0.0, None, None)
            score = lambda r: slope[r].sum() ** 2 / (len(r) + l2)
            for f, ends in enumerate(edges):
                for e in ends:
                    left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
                    if min(len(left), len(right)) >= leaf_rows:
                        gain = score(left) + score(right) - score(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, e)
            return best

        grown = [(np.arange(len(y)), cut_of(np.arange(len(y))))]
        while len(grown) < leaves:
            at = max(range(len(grown)), key=lambda i: grown[i][1][0])
            rows, (gain, f, e) = grown[at]
            if f is None:
                break
            left, right = rows[x[rows, f] <= e], rows[x[rows, f] > e]
            grown[at : at + 1] = [(left, cut_of(left)), (right, cut_of(right))]
        for rows, _ in grown:
            guess[rows] -= rate * slope[rows].sum() / (len(rows) + l2)
    return guess


def test_boosting_equals_plain_version(spark):
    x, y = sample()
    rows = frame(spark, x, y)
    setting = {"rounds": 3, "rate": 0.2, "leaves": 7, "leaf_rows": 15, "l2": 0.1, "bins": 40}
    edges = learned.bin_edges(rows, 4, 40)
    want = plain_boosting(x, y, edges, 3, 0.2, 7, 15, 0.1)
    for share in (None, 220):
        model = learned.fit_boosting(rows, KEYS, "y", 4, rows_per_task=share, **setting)
        np.testing.assert_allclose(learned.values_of(model, x), want, atol=1e-9)
    assert max(len(t) for t in model["trees"]) <= 2 * 7 - 1
    got = learned.predicted(rows, model, "p").orderBy(F.expr("int(substr(ticker, 2))")).collect()
    np.testing.assert_allclose([r["p"] for r in got], want, atol=1e-9)


def test_boosting_leaf_limits_and_constant_target(spark):
    x, y = sample(200, 1)
    model = learned.fit_boosting(frame(spark, x, y), KEYS, "y", 4, rounds=3)
    assert all(len(t) <= 29 for t in model["trees"]) and len(model["trees"]) == 3
    flat = learned.fit_boosting(frame(spark, x, np.full(len(y), 2.5)), KEYS, "y", 4, rounds=3)
    np.testing.assert_allclose(learned.values_of(flat, x), 2.5)


def test_extra_trees_do_not_depend_on_tasks_and_respect_leaves(spark):
    x, y = sample(500, 2)
    rows = frame(spark, x, y)
    one, many = (learned.fit_extra_trees(rows, KEYS, "y", rows_per_task=n, trees=12, depth=d) for n, d in ((None, 3), (260, 3)))
    np.testing.assert_allclose(learned.values_of(one, x), learned.values_of(many, x), atol=1e-9)
    one = learned.fit_extra_trees(rows, KEYS, "y", trees=12)
    for nodes in one["trees"]:
        depth = {0: 0}
        for i, (feature, cut, left, right, value) in enumerate(nodes):
            if feature >= 0:
                depth[left] = depth[right] = depth[i] + 1
        assert max(depth.values()) <= 6
        at = np.zeros(len(x), int)
        for _ in range(6):
            for i in range(len(x)):
                feature, cut, left, right, _v = nodes[at[i]]
                if feature >= 0:
                    at[i] = left if x[i, feature] <= cut else right
        for leaf in set(at):
            inside = at == leaf
            assert inside.sum() >= 25
            np.testing.assert_allclose(nodes[leaf][4], y[inside].mean(), atol=1e-9)
    noise = ((y - y.mean()) ** 2).mean()
    assert ((learned.values_of(one, x) - y) ** 2).mean() < 0.75 * noise


def test_network_gradients_and_fit(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 3)), rng.normal(size=30)
    weights, biases = [rng.normal(size=s) for s in ((3, 5), (5, 4), (4, 1))], [rng.normal(size=n) for n in (5, 4, 1)]
    loss = lambda: 0.5 * ((learned.layers_of(x, weights, biases)[-1][:, 0] - y) ** 2).sum()
    by_weight, by_bias = learned.gradients(x, y, weights, biases)
    for cells, slopes in ((weights, by_weight), (biases, by_bias)):
        for cell, slope in zip(cells, slopes):
            for at in np.ndindex(cell.shape):
                old = cell[at]
                cell[at] = old + 1e-6
                up = loss()
                cell[at] = old - 1e-6
                down = loss()
                cell[at] = old
                assert abs((up - down) / 2e-6 - slope[at]) < 1e-4 * max(1, abs(slope[at]))
    x, y = sample(600, 4)
    model = learned.fit_network(frame(spark, x, y), KEYS, "y", epochs=150)
    assert ((learned.values_of(model, x) - y) ** 2).mean() < 0.5 * y.var()
    assert learned.fit_network(frame(spark, x, y), KEYS, "y", epochs=150) == model
    start, shared = (learned.fit_network(frame(spark, x, y), KEYS, "y", rows_per_task=310, epochs=n, batch=10) for n in (1, 9))
    loss = lambda m: ((learned.values_of(m, x) - y) ** 2).mean()
    assert loss(shared) < loss(start)


def test_failing_base_gives_null_and_huber_is_trained(spark, monkeypatch):
    x, y = sample(80, 5)
    rows = [(i // 20, f"t{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    panel = spark.createDataFrame(rows, f"as_of_date int, ticker string, a double, b double, c double, d double, {models.TARGET} double")
    features = list("abcd")

    def broken(*args, **kwargs):
        raise ValueError("no fit")

    monkeypatch.setattr(models, "bayesian_ridge", broken)
    with pytest.warns(RuntimeWarning, match="bayesian_ridge"):
        out = models.fit_predict(panel, panel, features, ["ridge", "bayesian_ridge", "mlp"]).collect()
    assert all(r["bayesian_ridge"] is None and r["ridge"] is not None and r["mlp"] is not None for r in out)
    with pytest.warns(RuntimeWarning, match="bayesian_ridge"):
        cells = {(r["model"], r["feature"]): r["coefficient"] for r in models.trained(panel, features).collect()}
    assert {m for m, _ in cells} == set(models.STATISTICAL) and cells["bayesian_ridge", "a"] is None
    # the largest effect is the largest coefficient of the robust fit too
    assert cells["huber", "a"] == max(cells["huber", f] for f in features)


def labelled(spark, rows=80, seed=6):
    x, y = sample(rows, seed)
    made = [(i // 20, f"t{i}", *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(made, f"as_of_date int, ticker string, a double, b double, c double, d double, {models.TARGET} double")


def failing(error):
    def broken(*args, **kwargs):
        raise error

    return broken


def test_a_failed_fit_is_no_result(spark, monkeypatch):
    panel, features = labelled(spark), list("abcd")
    with monkeypatch.context() as patch:
        patch.setattr(models, "principal_regression", failing(ValueError("no fit")))
        with pytest.raises(ValueError, match="no fit"):  # the only model asked for
            models.fit_predict(panel, panel, features, ["principal_components"])
        both = models.Required(["ridge", "principal_components"])
        for call in (models.fit_predict, lambda t, _, *more: models.trained(t, *more)):
            with pytest.raises(ValueError, match="no fit"):
                call(panel, panel, features, both)
    with monkeypatch.context() as patch:
        # a lost executor or a fault in the code is no property of the data
        patch.setattr(models.learned, "fit_network", failing(RuntimeError("job aborted")))
        with pytest.raises(RuntimeError, match="job aborted"):
            models.fit_predict(panel, panel, features, ["ridge", "mlp"])
    for name in ("extra_trees", "random_forest", "gradient_boosting", "mlp", "ridge"):
        with pytest.raises(ValueError, match="no training rows"):
            models.fit_predict(panel.withColumn(models.TARGET, F.lit(None).cast("double")), panel, features, [name])


def test_penalties_and_coefficients_that_are_not_finite():
    assert models.least_error([float("nan"), 3.0, None, 2.0, float("inf")]) == 3
    with pytest.raises(ValueError, match="finite"):
        models.least_error([float("nan"), None])
    with pytest.raises(ValueError, match="coefficients"):
        models.all_finite(np.array([1.0, np.nan]), "coefficients")


@pytest.mark.parametrize(
    "query, place", [("m_random_forest", "spark_fitted"), ("m_extra_trees", "learned_model"), ("m_mlp", "learned_model"), ("m_ml_stack", "spark_fitted"), ("m_pcr", "principal_regression")]
)
def test_queries_fail_with_their_models(spark, monkeypatch, tmp_path, query, place):
    from plumbline.catalog import load
    from plumbline.catalog import models as queries

    panel = labelled(spark, 240)
    names = dict.fromkeys([*queries.RAW, *queries.SCORE_COLUMNS])
    wide = panel.select(*KEYS, models.TARGET, *[(F.col("abcd"[i % 4]) * (i + 1)).alias(c) for i, c in enumerate(names)])
    monkeypatch.setattr(queries, "training", lambda s, d: wide)
    monkeypatch.setattr(queries, "current", lambda s, d: wide.drop(models.TARGET))
    monkeypatch.setattr(models, place, failing(ValueError("no fit")))
    with pytest.raises(ValueError, match="no fit"):
        load()[0][query](spark, str(tmp_path))


def test_boosting_takes_pairs_and_bins_and_few_sums(monkeypatch):
    x, y = sample(12_000, 7, width=5)
    draw = np.arange(len(y)) % 100
    edges = [[float(v) for v in np.unique(np.quantile(x[:, i], np.arange(1, 40) / 40).astype(np.float32))] for i in range(5)]
    setting = {**learned.BOOSTING, "rounds": 4, "bins": 40}

    class Counting(learned.Team):
        sums = 0

        def sum(self, values):
            self.sums += 1
            return super().sum(values)

    want = learned.boosted(x, y, draw, learned.Team(1), edges, **setting)
    # held-out rows follow the trees as the others do
    guess = learned.values_of(want, x)
    assert ((guess - y) ** 2)[draw < 10].mean() < y[draw < 10].var()
    monkeypatch.setattr(learned, "PAIRED_FROM", 50)
    for given in (x, learned.bins_of(x, edges)):
        got = learned.boosted(given, y, draw, learned.Team(1), edges, **setting)
        assert [[n[:4] for n in t] for t in got["trees"]] == [[n[:4] for n in t] for t in want["trees"]]
        np.testing.assert_allclose(learned.values_of(got, x), guess, atol=1e-9)
    # rows and start, then a root (with the error of the trees so far) and its children a round
    team = Counting(1)
    learned.boosted(x, y, draw, team, edges, **{**setting, "leaves": 2})
    assert team.sums == 2 + 2 * 4


def test_base_is_fitted_beside_the_folds(spark, monkeypatch, tmp_path):
    import threading

    from plumbline.catalog import load
    from plumbline.catalog import models as queries

    both = threading.Barrier(2, timeout=60)

    def fit(s, d):
        both.wait()  # breaks where one waits for the other to end
        return s.range(1)

    result = spark.createDataFrame([(1, "t", 0.5)], "as_of_date int, ticker string, machine_learning double")
    monkeypatch.setattr(queries, "training", lambda s, d: None)
    monkeypatch.setattr(queries, "current", lambda s, d: None)
    monkeypatch.setattr(queries, "learned_oof", fit)
    monkeypatch.setattr(queries, "learned_base", fit)
    monkeypatch.setattr(models, "stacked", lambda *args: result)
    assert [tuple(r) for r in load()[0]["m_ml_stack"](spark, str(tmp_path)).collect()] == [(1, "t", 0.5)]
