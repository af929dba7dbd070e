"""Stacked expected returns of many research dates, their fits sharing passes over the rows.

Every research date needs a fit per out-of-fold date and one on all its training dates, all of
them over runs of the same few dates. A row goes to the fits that contain its date; per fit, target
bounds and medians come from one grouped quantile job, and one pass sums the Gram matrices of imputed
features and clipped target by fit and cross-validation run. Means, deviations and
standardised Gram matrices follow from these sums by a linear map, so no fit reads rows again but
for leave-one-out errors, which a second pass gives for all fits, penalties and models.

What reaches the driver are p x p numbers a fit. The results equal those of separate fits
(`models.train_predict`) to rounding.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clip
from plumbline.operators import models
from plumbline.operators.models import KEY, TARGET
from plumbline.operators.quantiles import exact_quantiles, melt
from plumbline.sources.stored import settle

# models that the Gram matrix and leave-one-out errors determine; the robust model is fitted by Spark ML, fit by fit
GRAM_MODELS = ["ridge", "elastic_net", "bayesian_ridge", "principal_components", "partial_least_squares"]
COMPONENTS = 8


@dataclass
class Fit:
    """Medians, target bounds, moments of the features, and coefficients on standardised features by model."""

    low: float
    high: float
    median: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    intercept: float
    betas: dict
    robust_intercept: float = 0.0

    def values(self, part: pd.DataFrame, features: Sequence[str], name: str) -> np.ndarray:
        start = self.robust_intercept if name == "huber" else self.intercept
        return self.standardised(part, features) @ self.betas[name] + start

    def standardised(self, part: pd.DataFrame, features: Sequence[str]) -> np.ndarray:
        x = part[list(features)].to_numpy(float)
        return (np.where(np.isnan(x), self.median, x) - self.mean) / self.deviation


def _statistics(rows: DataFrame, features: Sequence[str]) -> dict[int, tuple]:
    """Per fit: bounds of the target and medians of the features."""
    long = rows.select("fit", F.col(TARGET).alias("value"))
    bounds = {r.fit: (r.q0, r.q1) for r in exact_quantiles(long, ["fit"], [0.01, 0.99]).collect()}
    medians = {fit: np.zeros(len(features)) for fit in bounds}
    for r in exact_quantiles(melt(rows, ["fit"], features), ["fit", "metric"], [0.5]).collect():
        if r.q0 is not None:
            medians[r.fit][r.metric] = r.q0
    return {fit: (*bounds[fit], medians[fit]) for fit in bounds}


def _sums(rows: DataFrame, columns: Sequence[str], schema: str, group: Sequence[str], partial) -> list:
    """Partial sums per task, added up by Spark."""
    cells = rows.select(*columns).mapInPandas(partial, schema)
    return cells.groupBy(*group).agg(F.sum("v").alias("v")).collect()


def _grams(rows: DataFrame, features: Sequence[str], known: dict[int, tuple]) -> dict[int, dict[int, np.ndarray]]:
    """Per fit and cross-validation run: sums of (1, x, y)'(1, x, y) with imputed x and clipped y; one pass."""
    features = list(features)

    def partial(batches):
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for key, part in batch.groupby(["fit", "net_fold"]):
                low, high, median = known[key[0]]
                x = part[features].to_numpy(float)
                y = np.clip(part[TARGET].to_numpy(float), low, high)
                full = np.column_stack([np.ones(len(part)), np.where(np.isnan(x), median, x), y])
                totals[key] = totals.get(key, 0.0) + full.T @ full
        for (fit, fold), total in totals.items():
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"fit": fit, "fold": fold, "i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    folded = models.contiguous_folds(rows, by=["fit"])
    schema = "fit int, fold int, i int, j int, v double"
    size, out = len(features) + 2, {}
    for r in _sums(folded, ["fit", "net_fold", *features, TARGET], schema, ["fit", "fold", "i", "j"], partial):
        out.setdefault(r.fit, {}).setdefault(r.fold, np.zeros((size, size)))[r.i, r.j] = r.v
    return out


def _standard(parts: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """Means and deviations of the features, and the Gram matrices of the standardised rows."""
    total = sum(parts.values())
    n = total[0, 0]
    mean = total[0, 1:-1] / n
    spread = np.diag(total)[1:-1] / n - mean * mean
    # a constant column leaves only rounding
    deviation = np.where(spread > 1e-12 * (1 + mean * mean), np.sqrt(np.maximum(spread, 0)), 1.0)
    change = np.eye(len(total))
    change[1:-1, 0] = -mean / deviation
    change[1:-1, 1:-1] = np.diag(1 / deviation)
    return mean, deviation, {k: change @ v @ change.T for k, v in parts.items()}


def _leave_one_out(rows: DataFrame, features, fits: dict[int, Fit], problems: dict[tuple, tuple]) -> dict[tuple, np.ndarray]:
    """Sums of squared deleted residuals per (fit, model) and penalty; one pass over the rows.

    A problem is (basis, moments, coefficients by penalty, inverses by penalty).
    """
    by_fit: dict[int, list] = {}
    for (fit, name), problem in problems.items():
        by_fit.setdefault(fit, []).append((name, *problem))

    def partial(batches):
        totals: dict[tuple, float] = {}
        for batch in batches:
            for number, part in batch.groupby("fit"):
                fit = fits[number]
                z = fit.standardised(part, features)
                y = np.clip(part[TARGET].to_numpy(float), fit.low, fit.high) - fit.intercept
                for name, basis, m, betas, inverses in by_fit[number]:
                    x = z @ basis
                    for k, (beta, inverse) in enumerate(zip(betas, inverses)):
                        leverage = np.einsum("ij,jk,ik->i", x, inverse, x) + 1.0 / m.n
                        error = float((((y - x @ beta) / (1 - leverage)) ** 2).sum())
                        totals[number, name, k] = totals.get((number, name, k), 0.0) + error
        if totals:
            yield pd.DataFrame([(*key, v) for key, v in totals.items()], columns=["fit", "name", "k", "v"])

    out: dict[tuple, dict] = {}
    schema = "fit int, name string, k int, v double"
    for r in _sums(rows, ["fit", *features, TARGET], schema, ["fit", "name", "k"], partial):
        out.setdefault((r.fit, r.name), {})[r.k] = r.v
    return {key: np.array([v[k] for k in sorted(v)]) for key, v in out.items()}


def fit_all(
    rows: DataFrame,
    features: Sequence[str],
    names: Sequence[str] = GRAM_MODELS,
    alphas: Sequence[float] = models.ALPHAS,
    partial: bool = False,
) -> dict[int, Fit]:
    """Fits of `rows` (fit, as_of_date, ticker, features, target) by the number in `fit`; rows without a target are left out.

    partial: a model that the data do not determine is missing (with a warning), else it raises.
    """
    unknown = set(names) - set(models.STATISTICAL)
    if unknown:
        raise ValueError(f"no linear models: {sorted(unknown)}")
    rows = rows.filter(F.col(TARGET).isNotNull())
    known = _statistics(rows, features)
    fits, problems, parts_of, moments_of = {}, {}, {}, {}
    for number, parts in _grams(rows, features, known).items():
        mean, deviation, parts = _standard(parts)
        m = models.centered(sum(parts.values()))
        fits[number] = Fit(*known[number], mean, deviation, m.y_mean, {})
        parts_of[number], moments_of[number] = parts, m
        whole = np.eye(len(m.xy))
        values, vectors = np.linalg.eigh(m.xx)
        leading = vectors[:, np.argsort(values)[::-1][: min(COMPONENTS, len(values))]]
        for name, basis in (("ridge", whole), ("principal_components", leading)):
            if name in names:
                inner = models.Moments(m.n, basis.T @ m.xx @ basis, basis.T @ m.xy, m.y_mean, m.yy)
                inverses = [np.linalg.inv(inner.xx + a * np.eye(len(inner.xy))) for a in alphas]
                problems[number, name] = basis, inner, models.ridge_path(inner, alphas), inverses
    errors = _leave_one_out(rows, features, fits, problems) if problems else {}
    for (number, name), (basis, _, betas, _) in problems.items():
        fits[number].betas[name] = basis @ betas[models.least_error(errors[number, name])]
    solvers = {
        "elastic_net": lambda k: models.elastic_net(parts_of[k]),
        "bayesian_ridge": lambda k: models.bayesian_ridge(moments_of[k]),
        "partial_least_squares": lambda k: models.partial_least_squares(moments_of[k]),
    }
    for number, fit in fits.items():
        for name in names:
            if name in solvers:
                solve = lambda: models.all_finite(solvers[name](number), "coefficients")
                fit.betas[name] = models.or_none(name, solve, partial)
        if "huber" in names:
            own = rows.filter(F.col("fit") == number).withColumn(TARGET, clip(TARGET, F.lit(fit.low), F.lit(fit.high)))
            scaler = models.Scaler(list(features), list(fit.median), list(fit.mean), list(fit.deviation))
            vectors = scaler.transform(own).select(array_to_vector("z").alias("features"), TARGET)
            made = models.or_none("huber", lambda: models.spark_fitted("huber", vectors, moments_of[number].n), partial)
            if made:
                fit.betas["huber"], fit.robust_intercept = made.coefficients.toArray(), made.intercept
    return fits


def predict_all(rows: DataFrame, fits: dict[int, Fit], features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Adds a column per model: the prediction of the row's fit; NULL where there is none."""
    features, names = list(features), list(names)
    kinds = F.struct(*[F.col(f).cast("double").alias(f) for f in features])

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def apply(fit: pd.Series, x: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(np.nan, index=fit.index, columns=names)
        for number, part in x.groupby(fit):
            own = fits.get(number)
            for name in names:
                if own is not None and own.betas.get(name) is not None:
                    out.loc[part.index, name] = own.values(part, features, name)
        return out

    made = rows.withColumn("_p", apply("fit", kinds))
    return made.withColumns({n: F.when(~F.isnan(F.col("_p")[n]), F.col("_p")[n]) for n in names}).drop("_p")


def plan_fits(dates: dict[date, list[date]], min_train: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Rows (research_date, as_of_date, fit) of training, of out-of-fold tests, and (research_date, fit) of whole fits."""
    train, tests, whole, number = [], [], [], 0
    for day in sorted(dates):
        known = sorted(dates[day])
        for k in range(min_train, len(known)):
            train += [(day, d, number) for d in known[:k]]
            tests.append((day, known[k], number))
            number += 1
        train += [(day, d, number) for d in known]
        whole.append((day, number))
        number += 1
    return train, tests, whole


def rolling_alpha(
    panel: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    names: Sequence[str] = GRAM_MODELS,
    min_train: int = 8,
) -> DataFrame:
    """(as_of_date, ticker, base columns, alpha) of every research date.

    panel: research_date, as_of_date, ticker, features, target; current: as_of_date (the research date), ticker,
    features. A research date with too few training dates for an out-of-fold prediction has no alpha.
    """
    spark, features, names = panel.sparkSession, list(features), list(names)
    pairs = panel.filter(F.col(TARGET).isNotNull()).select("research_date", "as_of_date").distinct().collect()
    dates: dict[date, list[date]] = {}
    for r in pairs:
        dates.setdefault(r.research_date, []).append(r.as_of_date)
    dates = {day: known for day, known in dates.items() if len(known) > min_train}
    schema = "research_date date, as_of_date date, fit int"
    train, tests, whole = plan_fits(dates, min_train)
    keep = panel.select("research_date", *KEY, TARGET, *features)
    # one row per research date, training date and fit
    spread = keep.join(F.broadcast(spark.createDataFrame(train, schema)), ["research_date", "as_of_date"])
    rows = settle(spread, "fits")
    fits = fit_all(rows, features, names)
    held = keep.join(F.broadcast(spark.createDataFrame(tests, schema)), ["research_date", "as_of_date"])
    some = F.coalesce(*[F.col(n) for n in names]).isNotNull()
    oof = predict_all(held, fits, features, names).filter(some)
    latest = spark.createDataFrame(whole, "as_of_date date, fit int")
    base = predict_all(current.select(*KEY, *features).join(F.broadcast(latest), "as_of_date"), fits, features, names)
    base = settle(base.select(*KEY, "fit", *names), "base")
    # the meta models: one fit per research date, under the number of its whole fit
    numbers = latest.withColumnRenamed("as_of_date", "research_date")
    meta_rows = oof.drop("fit").join(F.broadcast(numbers), "research_date").select("fit", *KEY, TARGET, *names)
    meta = fit_all(settle(meta_rows, "out_of_fold"), names, ["ridge"], models.META_ALPHAS)
    out = predict_all(base, meta, names, ["ridge"])
    return out.select(*KEY, *names, F.col("ridge").alias("alpha"))
