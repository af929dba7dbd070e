"""Expected-return models.

Linear models need only the Gram matrix of the scaled features (at most 60 x 60
numbers): Spark sums it over all rows in one pass, the solve is a few lines of
NumPy on the driver. The robust model and the random forest are Spark ML estimators, the
other learned models stand in `learned`. Fitting runs Spark jobs while the plan is built.

A failed Spark job or a fault in the code raises. Of several models, one that the data do not determine gives a
warning and NULL predictions, unless the caller names them as `Required`; the only model asked for raises.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip
from plumbline.operators import learned
from plumbline.operators.quantiles import exact_quantiles, melt
from plumbline.sources.stored import settle

TARGET = "forward_excess_return"
# Penalty grids of the base models and of the meta model.
ALPHAS = [0.01, 0.1, 1.0, 3.0, 10.0, 30.0, 100.0]
META_ALPHAS = [0.01, 0.1, 1.0, 3.0, 10.0, 30.0]
NET_RATIOS = [0.1, 0.3, 0.5, 0.7, 0.9]
NET_ALPHAS = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0]
NET_FOLDS = 5
HUBER_PENALTY = 1e-4
KEY = ["as_of_date", "ticker"]
FOLDS_AT_ONCE = 4


def prepared(panel: DataFrame, target: str = TARGET) -> DataFrame:
    """Rows with a target, clipped to its 1st and 99th percentile.

    The bounds (one row) are computed here, not again by every pass over the result.
    """
    rows = panel.filter(F.col(target).isNotNull())
    long = rows.select(F.lit(0).alias("g"), F.col(target).alias("value"))
    bounds = exact_quantiles(long, ["g"], [0.01, 0.99]).first()
    return rows if bounds is None else rows.withColumn(target, clip(target, F.lit(bounds.q0), F.lit(bounds.q1)))


@dataclass
class Scaler:
    """Medians, means and population deviations of the features, and the rows they come from."""

    features: list[str]
    median: list[float]
    mean: list[float]
    deviation: list[float]
    rows: int | None = None

    def transform(self, rows: DataFrame, column: str = "z") -> DataFrame:
        parts = [
            (F.coalesce(F.col(f), F.lit(m)) - F.lit(a)) / F.lit(s)
            for f, m, a, s in zip(self.features, self.median, self.mean, self.deviation)
        ]
        return rows.withColumn(column, F.array(*[p.cast("double") for p in parts]))


def fit_scaler(rows: DataFrame, features: Sequence[str]) -> Scaler:
    """Exact medians, then moments of the imputed columns: one small row each."""
    features = list(features)
    long = melt(rows, [], features)
    medians = {r["metric"]: r["q0"] for r in exact_quantiles(long, ["metric"], [0.5]).collect()}
    median = [float(medians[i]) if medians.get(i) is not None else 0.0 for i in range(len(features))]
    imputed = [F.coalesce(F.col(f), F.lit(m)) for f, m in zip(features, median)]
    row = rows.agg(
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(imputed)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(imputed)],
        F.count("*").alias("n"),
    ).first()
    mean = [float(row[f"a{i}"] or 0.0) for i in range(len(features))]
    deviation = [float(row[f"s{i}"] or 0.0) or 1.0 for i in range(len(features))]
    return Scaler(features, median, mean, deviation, row["n"])


@dataclass
class Moments:
    """Sums over all rows: count, X'X, X'y, means, y'y."""

    n: int
    xx: np.ndarray
    xy: np.ndarray
    y_mean: float
    yy: float


def grams(scaled: DataFrame, target: str = TARGET, by: str | None = None) -> dict[int, np.ndarray]:
    """Sums of (1, x, y)'(1, x, y) per value of `by`: partial sums per task, p^2 numbers a fold reach the driver."""

    def partial(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, part in batch.groupby("fold"):
                x = np.column_stack([np.ones(len(part)), np.vstack(part["z"]), part["y"]])
                totals[fold] = totals.get(fold, 0.0) + x.T @ x
        for fold, total in totals.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"fold": fold, "i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    fold = F.col(by).cast("int") if by else F.lit(0)
    cells = scaled.select(fold.alias("fold"), "z", F.col(target).alias("y")).mapInPandas(
        partial, "fold int, i int, j int, v double"
    )
    rows = cells.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect()
    size = max(r.i for r in rows) + 1
    out = {r.fold: np.zeros((size, size)) for r in rows}
    for r in rows:
        out[r.fold][r.i, r.j] = r.v
    return out


def centered(full: np.ndarray) -> Moments:
    n, y_mean = full[0, 0], full[0, -1] / full[0, 0]
    rest = full - np.outer(full[:, 0], full[0, :]) / n
    return Moments(int(n), rest[1:-1, 1:-1], rest[1:-1, -1], y_mean, rest[-1, -1])


def moments(scaled: DataFrame, target: str = TARGET) -> Moments:
    return centered(grams(scaled, target)[0])


def contiguous_folds(rows: DataFrame, folds: int = NET_FOLDS, by: Sequence[str] = ()) -> DataFrame:
    """Adds net_fold: equal runs of the rows of each `by` in the order of date and ticker, the longer ones first.

    Positions come from a count per date (few rows) and the place within the date.
    """
    by = list(by)
    days = rows.groupBy(*by, "as_of_date").agg(F.count("*").alias("_rows"))
    group = by or [F.lit(0)]
    before = Window.partitionBy(*group).orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select(
        *by,
        "as_of_date",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(*group)).alias("_all"),
    )
    inside = Window.partitionBy(*by, "as_of_date").orderBy("ticker")
    at = F.col("_start") + F.row_number().over(inside) - 1
    short, longer = F.expr(f"_all div {folds}"), F.col("_all") % folds
    head = longer * (short + 1)
    fold = F.when(F.col("_at") < head, F.expr(f"_at div (_all div {folds} + 1)")).otherwise(
        longer + F.floor((F.col("_at") - head) / F.greatest(short, F.lit(1)))
    )
    placed = rows.join(F.broadcast(starts), [*by, "as_of_date"]).withColumn("_at", at)
    return placed.withColumn("net_fold", fold.cast("int")).drop("_start", "_all", "_at")


def net_path(m: Moments, ratio: float, alphas: Sequence[float], steps: int = 10_000, tolerance: float = 1e-10):
    """Elastic-net coefficients for falling penalties, by coordinate descent on the Gram matrix."""
    beta, out = np.zeros(len(m.xy)), {}
    diagonal = np.diag(m.xx)
    for alpha in sorted(alphas, reverse=True):
        l1, l2 = alpha * ratio * m.n, alpha * (1 - ratio) * m.n
        pull = m.xx @ beta
        for _ in range(steps):
            largest = 0.0
            for i in np.flatnonzero(diagonal > 0):
                rest = m.xy[i] - pull[i] + diagonal[i] * beta[i]
                fresh = np.sign(rest) * max(abs(rest) - l1, 0.0) / (diagonal[i] + l2)
                if fresh != beta[i]:
                    pull += m.xx[:, i] * (fresh - beta[i])
                    largest = max(largest, abs(fresh - beta[i]))
                    beta[i] = fresh
            if largest < tolerance:
                break
        out[alpha] = beta.copy()
    return out


def elastic_net(parts: dict[int, np.ndarray], ratios=NET_RATIOS, alphas=NET_ALPHAS) -> np.ndarray:
    """Mixing and penalty with the least mean error over the folds, fitted on all rows; no pass over rows."""
    total = sum(parts.values())
    errors: dict[tuple[float, float], list[float]] = {}
    for held in parts.values():
        if len(parts) == 1:
            continue
        m = centered(total - held)
        x_mean = (total - held)[0, 1:-1] / (total - held)[0, 0]
        for ratio in ratios:
            for alpha, beta in net_path(m, ratio, alphas).items():
                # (1, x, y) times these weights is a row's residual
                residual = np.concatenate(([x_mean @ beta - m.y_mean], -beta, [1.0]))
                errors.setdefault((ratio, alpha), []).append(float(residual @ held @ residual) / held[0, 0])
    order = [(r, a) for r in ratios for a in sorted(alphas, reverse=True)]
    ratio, alpha = min(order, key=lambda k: np.mean(errors.get(k, [0.0])))
    return net_path(centered(total), ratio, alphas)[alpha]


def ridge_path(m: Moments, alphas: Sequence[float] = ALPHAS) -> list[np.ndarray]:
    return [np.linalg.solve(m.xx + a * np.eye(len(m.xy)), m.xy) for a in alphas]


def ridge(scaled: DataFrame, m: Moments, alphas: Sequence[float] = ALPHAS, target: str = TARGET) -> np.ndarray:
    """Ridge whose alpha has the least exact leave-one-out error.

    One pass over the rows gives the squared deleted residuals of all alphas.
    """
    betas = np.array(ridge_path(m, alphas))
    inverses = [np.linalg.inv(m.xx + a * np.eye(len(m.xy))) for a in alphas]

    def deleted(batches):
        for batch in batches:
            if len(batch):
                x, y = np.vstack(batch["z"]), batch["y"].to_numpy() - m.y_mean
                out = {}
                for k, (beta, inverse) in enumerate(zip(betas, inverses)):
                    leverage = np.einsum("ij,jk,ik->i", x, inverse, x) + 1.0 / m.n
                    out[f"e{k}"] = [float((((y - x @ beta) / (1 - leverage)) ** 2).sum())]
                yield pd.DataFrame(out)

    schema = ", ".join(f"e{k} double" for k in range(len(alphas)))
    row = scaled.select("z", F.col(target).alias("y")).mapInPandas(deleted, schema).agg(
        *[F.sum(f"e{k}").alias(f"e{k}") for k in range(len(alphas))]
    ).first()
    return betas[least_error(list(row))]


def least_error(errors: Sequence[float | None]) -> int:
    """Place of the least finite error; an error that is not a number never wins."""
    known = np.array(errors, float)
    if not np.isfinite(known).any():
        raise ValueError("no penalty has a finite leave-one-out error")
    return int(np.argmin(np.where(np.isfinite(known), known, np.inf)))


def bayesian_ridge(m: Moments, steps: int = 300, tolerance: float = 1e-3) -> np.ndarray:
    """Evidence maximisation on the Gram matrix, flat gamma priors of 1e-6."""
    values, vectors = np.linalg.eigh(m.xx)
    rotated, prior = vectors.T @ m.xy, 1e-6
    noise, weight = 1.0 / max(m.yy / m.n, 1e-300), 1.0
    beta = np.zeros(len(m.xy))
    for _ in range(steps):
        fresh = vectors @ (rotated / (values + weight / noise))
        error = max(m.yy - 2 * fresh @ m.xy + fresh @ m.xx @ fresh, 0.0)
        used = float((noise * values / (weight + noise * values)).sum())
        weight = (used + 2 * prior) / (float(fresh @ fresh) + 2 * prior)
        noise = (m.n - used + 2 * prior) / (error + 2 * prior)
        moved, beta = np.abs(beta - fresh).sum(), fresh
        if moved < tolerance:
            break
    return beta


def principal_regression(scaled: DataFrame, m: Moments, components: int = 8, target: str = TARGET) -> np.ndarray:
    """Ridge on the leading principal components, its penalty by leave-one-out error."""
    values, vectors = np.linalg.eigh(m.xx)
    basis = vectors[:, np.argsort(values)[::-1][: min(components, len(values))]]
    inner = Moments(m.n, basis.T @ m.xx @ basis, basis.T @ m.xy, m.y_mean, m.yy)
    rotation = F.array(
        *[
            F.aggregate(
                F.zip_with("z", F.array(*[F.lit(float(v)) for v in column]), lambda a, b: a * b),
                F.lit(0.0),
                lambda total, x: total + x,
            )
            for column in basis.T
        ]
    )
    return basis @ ridge(scaled.withColumn("z", rotation), inner, target=target)


def partial_least_squares(m: Moments, components: int = 6) -> np.ndarray:
    """PLS coefficients from X'X and X'y by deflation of X'y."""
    directions, xy = [], m.xy.copy()
    for _ in range(min(components, len(xy))):
        if np.linalg.norm(xy) < 1e-12:
            break
        w = xy.copy()
        for d in directions:
            w -= d * (d @ m.xx @ w) / (d @ m.xx @ d)
        directions.append(w)
        fit = np.array(directions).T
        beta = fit @ np.linalg.lstsq(fit.T @ m.xx @ fit, fit.T @ m.xy, rcond=None)[0]
        xy = m.xy - m.xx @ beta
    return beta if directions else np.zeros(len(m.xy))


def linear_prediction(rows: DataFrame, beta: np.ndarray, intercept: float, name: str) -> DataFrame:
    terms = F.zip_with(F.col("z"), F.array(*[F.lit(float(b)) for b in beta]), lambda a, b: a * b)
    total = F.aggregate(terms, F.lit(float(intercept)), lambda acc, x: acc + x)
    return rows.withColumn(name, total)


STATISTICAL = ["ridge", "elastic_net", "bayesian_ridge", "huber", "principal_components", "partial_least_squares"]
LEARNED = ["random_forest", "extra_trees", "gradient_boosting", "mlp"]


def spark_model(name: str, rows: int, target: str = TARGET, trees: int = learned.EXTRA["trees"]):
    common = {"featuresCol": "features", "labelCol": target, "predictionCol": name}
    if name == "huber":
        # Spark halves the mean loss and the penalty: a penalty on the sum is divided by the rows
        return LinearRegression(
            **common, loss="huber", epsilon=1.35, regParam=HUBER_PENALTY / rows, standardization=False, maxIter=1000
        )
    if name == "random_forest":
        return RandomForestRegressor(
            **common, numTrees=trees, maxDepth=6, minInstancesPerNode=25, featureSubsetStrategy="sqrt", seed=42
        )
    raise ValueError(f"unknown base model: {name}")


def spark_fitted(name: str, vectors: DataFrame, rows: int, target: str = TARGET, **sizes):
    """A fitted model of Spark ML."""
    model = spark_model(name, rows, target, **sizes).fit(vectors)
    if name == "huber":
        all_finite([*model.coefficients.toArray(), model.intercept], "coefficients")
    return model


def learned_model(name: str, rows: DataFrame, target: str, width: int, trees: int | None, rounds: int | None) -> dict:
    """A fitted model of `learned` for rows with keys, `z` and the target."""
    if name == "mlp":
        model = learned.fit_network(rows, KEY, target)
        all_finite([w for layer in (*model["weights"], *model["biases"]) for w in layer], "weights")
        return model
    if name == "gradient_boosting":
        model = learned.fit_boosting(rows, KEY, target, width, **({"rounds": rounds} if rounds else {}))
    elif name == "extra_trees":
        model = learned.fit_extra_trees(rows, KEY, target, **({"trees": trees} if trees else {}))
    else:
        raise KeyError(f"unknown base model: {name}")
    all_finite([model["start"], *([node[4] for node in nodes] for nodes in model["trees"])], "values of leaves")
    return model


class Required(tuple):
    """Names of models that must all be fitted: one that fails raises instead of being left out."""


def may_miss(models: Sequence[str]) -> bool:
    return len(models) > 1 and not isinstance(models, Required)


def or_none(name: str, fit, partial: bool):
    """The fit's result. partial: a model that the data do not determine is reported and left out, else it raises."""
    try:
        return fit()
    except (ValueError, ArithmeticError) as error:
        # a failed job of Spark is no property of the data
        if not partial or isinstance(error, PySparkException):
            error.add_note(f"base model {name} failed")
            raise
        warnings.warn(f"base model {name} failed: {error}", RuntimeWarning, stacklevel=2)
        return None


def all_finite(values, what: str):
    """The numbers of a fitted model; raises where one is not finite, as predictions would not be."""
    if not np.isfinite(np.concatenate([np.ravel(np.asarray(v, float)) for v in values] or [np.zeros(0)])).all():
        raise ValueError(f"{what} are not finite")
    return values


def linear_coefficients(
    fitted: DataFrame,
    m: Moments | None,
    parts: dict[int, np.ndarray],
    models: Sequence[str],
    target: str,
    alphas: Sequence[float],
    partial: bool,
) -> dict[str, np.ndarray]:
    """Coefficients on the scaled features of the models that the Gram matrix determines; partial: None where a fit fails."""
    solvers = {
        "ridge": lambda: ridge(fitted, m, alphas, target),
        "elastic_net": lambda: elastic_net(parts),
        "bayesian_ridge": lambda: bayesian_ridge(m),
        "principal_components": lambda: principal_regression(fitted, m, target=target),
        "partial_least_squares": lambda: partial_least_squares(m),
    }
    chosen = [name for name in models if name in solvers]
    return {name: or_none(name, lambda: all_finite(solvers[name](), "coefficients"), partial) for name in chosen}


def trained(
    panel: DataFrame, features: Sequence[str], models: Sequence[str] = STATISTICAL, target: str = TARGET
) -> DataFrame:
    """(model, feature, coefficient) of the linear base models on the whole panel; NULL where a fit may fail (`Required`)."""
    partial = may_miss(models)
    rows = prepared(panel, target)
    fitted = fit_scaler(rows, features).transform(rows)
    parts = grams(contiguous_folds(fitted), target, "net_fold")
    m = centered(sum(parts.values()))
    betas = linear_coefficients(fitted, m, parts, models, target, ALPHAS, partial)
    if "huber" in models:
        # fitted on the scaled features and not standardised again: on the others' scale
        input_rows = settle(fitted.select(array_to_vector("z").alias("features"), target), "features")
        solve = lambda: all_finite(spark_model("huber", m.n, target).fit(input_rows).coefficients.toArray(), "coefficients")
        betas["huber"] = or_none("huber", solve, partial)
    cells = [
        (name, f, None if betas[name] is None else float(betas[name][i])) for name in models for i, f in enumerate(features)
    ]
    return panel.sparkSession.createDataFrame(cells, "model string, feature string, coefficient double")


def fit_predict(
    train: DataFrame,
    score: DataFrame,
    features: Sequence[str],
    models: Sequence[str] = STATISTICAL,
    target: str = TARGET,
    alphas: Sequence[float] = ALPHAS,
    trees: int | None = None,
    rounds: int | None = None,
) -> DataFrame:
    """Fit every base model on `train`, add one prediction column each to `score`; NULL where a fit may fail (`Required`)."""
    partial = may_miss(models)
    rows = prepared(train, target)
    scaler = fit_scaler(rows, features)
    if not scaler.rows:
        raise ValueError("no training rows with a target")
    fitted = scaler.transform(rows)
    out = scaler.transform(score).withColumn("features", array_to_vector("z"))
    parts = grams(contiguous_folds(fitted), target, "net_fold") if set(models) - set(LEARNED) else {}
    m = centered(sum(parts.values())) if parts else None
    betas = linear_coefficients(fitted, m, parts, models, target, alphas, partial)
    # iterative fits read their input again and again: once from a written table, not from the panel's plan
    rest = [name for name in models if name not in betas]
    if rest:
        keys = [k for k in KEY if k in fitted.columns]
        stored = settle(fitted.select(*keys, "z", target), "features")
        vectors = stored.select(array_to_vector("z").alias("features"), target)
    for name in models:
        if name in betas:
            beta = betas[name]
            out = linear_prediction(out, beta, m.y_mean, name) if beta is not None else without(out, name)
        elif name in ("huber", "random_forest"):
            sizes = {"trees": trees} if trees else {}
            model = or_none(name, lambda: spark_fitted(name, vectors, m.n if m else 1, target, **sizes), partial)
            out = model.transform(out) if model else without(out, name)
        else:
            model = or_none(name, lambda: learned_model(name, stored, target, len(features), trees, rounds), partial)
            out = learned.predicted(out, model, name) if model else without(out, name)
    return out.select(*score.columns, *models)


def without(rows: DataFrame, name: str) -> DataFrame:
    return rows.withColumn(name, F.lit(None).cast("double"))


def side_by_side(spark: SparkSession | None, calls: Sequence, at_once: int | None = None) -> list:
    """Results of calls that do not depend on each other: their Spark jobs share the slots. The first error is raised."""
    run = lambda call: call()
    one = inheritable_thread_target(spark)(run) if spark else run
    with ThreadPool(min(len(calls), at_once or len(calls))) as pool:
        return pool.map(one, calls, chunksize=1)


def expanding_folds(panel: DataFrame, min_train: int = 8) -> DataFrame:
    """(fold, as_of_date, role): train on all dates before, test on one date.

    One row per research date on either side of the join.
    """
    days = panel.select("as_of_date").distinct()
    dated = days.withColumn("idx", F.row_number().over(Window.partitionBy().orderBy("as_of_date")) - 1)
    tests = dated.filter(F.col("idx") >= min_train).select(F.col("idx").alias("fold"))
    return (
        dated.join(F.broadcast(tests), F.col("idx") <= F.col("fold"))
        .select(
            F.col("fold").cast("long").alias("fold"),
            "as_of_date",
            F.when(F.col("idx") == F.col("fold"), "test").otherwise("train").alias("role"),
        )
    )


def shuffled_folds(panel: DataFrame, folds: int = 5) -> DataFrame:
    """Fallback folds by key hash when dates are too few."""
    return panel.withColumn("fold", F.pmod(F.xxhash64(*KEY), F.lit(folds)).cast("long"))


def out_of_fold(
    panel: DataFrame, features: Sequence[str], models: Sequence[str] = STATISTICAL, min_train: int = 8, **sizes
) -> DataFrame:
    """Predictions for each test date from models fitted on earlier dates only.

    Folds (a few research dates) do not depend on each other: their Spark jobs run side by side.
    """
    days = sorted(r.as_of_date for r in panel.select("as_of_date").distinct().collect())
    keep = panel.select(*KEY, TARGET, *features)
    splits = [
        (keep.filter(F.col("as_of_date") < F.lit(day)), keep.filter(F.col("as_of_date") == F.lit(day)))
        for day in days[min_train:]
    ]
    if not splits:
        rows = shuffled_folds(keep)
        splits = [(rows.filter(F.col("fold") != k).drop("fold"), rows.filter(F.col("fold") == k).drop("fold")) for k in range(5)]
    fits = [lambda split=split: fit_predict(*split, features, models, **sizes) for split in splits]
    parts = side_by_side(panel.sparkSession, fits, FOLDS_AT_ONCE)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    some = F.lit(False)
    for name in models:
        some = some | F.col(name).isNotNull()
    return out.filter(some)


def stacked(oof: DataFrame, base: DataFrame, models: Sequence[str], name: str = "alpha_expected_excess_return") -> DataFrame:
    """Ridge over the out-of-fold columns, applied to the base predictions."""
    names = {m: f"base_{m}" for m in models}
    train, score = oof.withColumnsRenamed(names), base.select(*KEY, *models).withColumnsRenamed(names)
    return fit_predict(train, score, list(names.values()), ["ridge"], alphas=META_ALPHAS).select(*KEY, F.col("ridge").alias(name))


def train_predict(
    panel: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    models: Sequence[str] = STATISTICAL,
    min_train: int = 8,
    **sizes,
) -> DataFrame:
    """Stacked expected excess return of the current rows."""
    oof = out_of_fold(panel, features, models, min_train, **sizes)
    base = fit_predict(panel.select(*KEY, TARGET, *features), current.select(*KEY, *features), features, models, **sizes)
    return stacked(oof, base, models)


def signal(*columns: str):
    """First finite of the given prediction columns."""
    from plumbline.functions.scalars import finite

    return F.coalesce(*[finite(c) for c in columns])


