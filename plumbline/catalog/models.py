"""Expected-return models over the labelled panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.catalog import factors as cf
from plumbline.catalog import portfolio as cp
from plumbline.catalog.prices import AS_OF
from plumbline.catalog.twin import SNAPSHOTS, cte, r, register
from plumbline.functions.factor_config import RAW_FEATURES, SCORE_COLUMNS
from plumbline.functions.scalars import rnd
from plumbline.operators import factors, models, rolling
from plumbline.operators.ranking import top_k
from plumbline.plans.research import ResearchConfig, training_panels, training_spans
from plumbline.sources import testbed

KEY = models.KEY
MIN_TRAIN = 2
RAW = RAW_FEATURES


def panel(s, d):
    return SNAPSHOTS.get(s, ("panel", d), lambda: cp.panel(s, d))


cte("panel", "SELECT * FROM scored JOIN forward USING (as_of_date, ticker)", "scored", "forward")
cte("panel_clip", """SELECT * REPLACE (LEAST(GREATEST(forward_excess_return, q0), q1) AS forward_excess_return) FROM panel
CROSS JOIN (SELECT QUANTILE_CONT(forward_excess_return, 0.01) AS q0, QUANTILE_CONT(forward_excess_return, 0.99) AS q1 FROM panel) q""", "panel")
register("m_prepare", lambda s, d: models.prepared(panel(s, d)).select(*KEY, rnd(models.TARGET, 5).alias(models.TARGET)),
         f"SELECT as_of_date, ticker, {r('forward_excess_return', 5, 'forward_excess_return')} FROM panel_clip", "panel_clip")


def _scaled(s, d):
    rows = models.prepared(panel(s, d))
    out = models.fit_scaler(rows, SCORE_COLUMNS).transform(rows)
    return out.select(*KEY, *[rnd(F.col("z")[i], 4).alias(c) for i, c in enumerate(SCORE_COLUMNS)])


cte("panel_filled", "SELECT as_of_date, ticker, " + ", ".join(f"COALESCE({c}, m_{c}) AS {c}" for c in SCORE_COLUMNS) + " FROM panel_clip CROSS JOIN (SELECT "
    + ", ".join(f"QUANTILE_CONT({c}, 0.5) AS m_{c}" for c in SCORE_COLUMNS) + " FROM panel_clip) q", "panel_clip")
register("m_impute_scale", _scaled,
         "SELECT as_of_date, ticker, " + ", ".join(r(f"({c} - AVG({c}) OVER ()) / NULLIF(STDDEV_POP({c}) OVER (), 0)", 4, c) for c in SCORE_COLUMNS) + " FROM panel_filled", "panel_filled")


# --- training as configured: twelve dates before the research date, eight at least before a fold -----------

DAY = AS_OF[-1]
TRAINING = ResearchConfig(benchmark=testbed.BENCHMARK, minimum_return_rows=20, minimum_label_rows=cp.MIN_ROWS)
FOLDS_FROM = TRAINING.min_train_periods
# a query has all its models or fails
LINEAR = models.Required(models.STATISTICAL)
LEARNED = models.Required(models.LEARNED)


def raw(s, d):
    """Raw factors of the training dates and of the research date, from one price panel."""
    return cf.raw(s, d, dates=[*sorted({span[1] for span in training_spans([DAY], TRAINING)}), DAY])


def raw_now(s, d):
    return raw(s, d).filter(F.col("as_of_date") == F.lit(DAY))


def current(s, d):
    """Scores of the research date: every date is scored by itself."""
    return SNAPSHOTS.get(s, ("current", d), lambda: factors.score(raw_now(s, d)))


def training(s, d):
    """Labelled scores and raw factors of the twelve training dates of the last research date."""
    build = lambda: training_panels(cf.stored_bars(s, d), None, [DAY], TRAINING, [*SCORE_COLUMNS, *RAW], raw(s, d))
    return SNAPSHOTS.get(s, ("training", d), build)


def scores_of(s, d):
    return training(s, d).select(*KEY, models.TARGET, *SCORE_COLUMNS)


def single(name, model):
    register(name, lambda s, d: models.fit_predict(scores_of(s, d), current(s, d).select(*KEY, *SCORE_COLUMNS), SCORE_COLUMNS, [model]).select(*KEY, rnd(model, 6).alias("prediction")))


for _name, _model in zip(
    ["m_ridge", "m_elastic_net", "m_bayesian_ridge", "m_huber", "m_pcr", "m_pls"], models.STATISTICAL
):
    single(_name, _model)


def learned_base(s, d):
    """The four learned bases on raw factors, fitted on all training dates."""
    rows = training(s, d).select(*KEY, models.TARGET, *RAW)
    return SNAPSHOTS.get(s, ("learned_base", d), lambda: models.fit_predict(rows, current(s, d).select(*KEY, *RAW), RAW, LEARNED).select(*KEY, *models.LEARNED))


def learned_one(s, d, model):
    """One learned base on raw factors: the others are not fitted for it."""
    rows = training(s, d).select(*KEY, models.TARGET, *RAW)
    return SNAPSHOTS.get(s, ("learned_one", model, d), lambda: models.fit_predict(rows, current(s, d).select(*KEY, *RAW), RAW, [model]).select(*KEY, model))


def learned_oof(s, d):
    rows = training(s, d).select(*KEY, models.TARGET, *RAW)
    return SNAPSHOTS.get(s, ("learned_oof", d), lambda: models.out_of_fold(rows, RAW, LEARNED, FOLDS_FROM))


for _name, _model in (("m_random_forest", "random_forest"), ("m_extra_trees", "extra_trees"), ("m_gbt", "gradient_boosting"), ("m_mlp", "mlp")):
    register(_name, lambda s, d, m=_model: learned_one(s, d, m).select(*KEY, rnd(m, 6).alias("prediction")))
register("m_expanding_folds", lambda s, d: models.expanding_folds(panel(s, d), MIN_TRAIN),
         f"""SELECT f.idx AS fold, d.as_of_date, CASE WHEN d.idx = f.idx THEN 'test' ELSE 'train' END AS role FROM (SELECT as_of_date, ROW_NUMBER() OVER (ORDER BY as_of_date) - 1 AS idx FROM (SELECT DISTINCT as_of_date FROM panel) x) d
JOIN (SELECT ROW_NUMBER() OVER (ORDER BY as_of_date) - 1 AS idx FROM (SELECT DISTINCT as_of_date FROM panel) x) f ON d.idx <= f.idx WHERE f.idx >= {MIN_TRAIN}""", "panel")


def _fallback(s, d):
    """One training date gives no expanding fold: five shuffled folds are fitted instead."""
    rows = scores_of(s, d)
    last = rows.agg(F.max("as_of_date")).first()[0]
    one = rows.filter(F.col("as_of_date") == F.lit(last))
    return models.out_of_fold(one, SCORE_COLUMNS, ["ridge"], FOLDS_FROM).select(*KEY, rnd("ridge", 6).alias("ridge"))


register("m_kfold_fallback", _fallback)


def oof(s, d):
    return SNAPSHOTS.get(s, ("oof", d), lambda: models.out_of_fold(scores_of(s, d), SCORE_COLUMNS, LINEAR, FOLDS_FROM))


def base(s, d):
    return SNAPSHOTS.get(s, ("base", d), lambda: models.fit_predict(scores_of(s, d), current(s, d).select(*KEY, *SCORE_COLUMNS), SCORE_COLUMNS, LINEAR))


def alpha(s, d):
    return SNAPSHOTS.get(s, ("alpha", d), lambda: models.stacked(oof(s, d), base(s, d), LINEAR).select(*KEY, F.col("alpha_expected_excess_return").alias("alpha")))


register("m_oof", lambda s, d: oof(s, d).select(*KEY, *[rnd(m, 6).alias(m) for m in LINEAR]))
register("m_predict_base", lambda s, d: base(s, d).select(*KEY, *[rnd(m, 6).alias(m) for m in LINEAR]))


def _fitted_stack(s, d):
    """The meta model applied to the out-of-fold predictions it was fitted on."""
    rows = oof(s, d)
    return models.stacked(rows, rows, LINEAR).select(*KEY, F.col("alpha_expected_excess_return").alias("alpha"))


def _train_predict(s, d):
    """Folds, bases and meta model in one call, the fits sharing their passes."""
    rows = scores_of(s, d).withColumn("research_date", F.lit(DAY))
    return rolling.rolling_alpha(rows, current(s, d), SCORE_COLUMNS, LINEAR, FOLDS_FROM).select(*KEY, "alpha")


register("m_stack", lambda s, d: _fitted_stack(s, d).select(*KEY, rnd("alpha", 6).alias("alpha")))
register("m_train", lambda s, d: models.trained(scores_of(s, d), SCORE_COLUMNS, LINEAR).select("model", "feature", rnd("coefficient", 6).alias("coefficient")))
register("m_predict", lambda s, d: models.stacked(oof(s, d), base(s, d), LINEAR, "prediction").select(*KEY, rnd("prediction", 6).alias("prediction")))
register("m_train_predict", lambda s, d: _train_predict(s, d).select(*KEY, rnd("alpha", 6).alias("alpha")))
register("m_alpha", lambda s, d: alpha(s, d).select(*KEY, rnd("alpha", 6).alias("alpha")))


def together(s, d, *fits):
    """Fits that do not depend on each other, side by side; the panels that they share are stored first."""
    training(s, d), current(s, d)
    return models.side_by_side(s, [lambda fit=fit: fit(s, d) for fit in fits])


def learned_stack(s, d):
    """Meta model over the four learned bases."""
    build = lambda: models.stacked(*together(s, d, learned_oof, learned_base), models.LEARNED, "machine_learning")
    return SNAPSHOTS.get(s, ("learned_stack", d), build)


def combined(s, d):
    """Statistical models on scores and learned models on raw factors, ten bases, one meta model."""
    both = [*LINEAR, *LEARNED]

    def build():
        tree_oof, tree_base, linear_oof, linear_base = together(s, d, learned_oof, learned_base, oof, base)
        rows = linear_oof.join(tree_oof.select(*KEY, *models.LEARNED), KEY)
        return models.stacked(rows, linear_base.join(tree_base, KEY), both, "combined")

    return SNAPSHOTS.get(s, ("combined", d), build)


register("m_ml_stack", lambda s, d: learned_stack(s, d).select(*KEY, rnd("machine_learning", 6).alias("machine_learning")))
register("m_combined", lambda s, d: combined(s, d).select(*KEY, rnd("combined", 6).alias("combined")))


def signal_columns(s, d):
    """All four signals of a name: final, statistical, combined and machine-learning."""
    final = alpha(s, d)
    names = current(s, d).select(*KEY)
    statistical = final.withColumnRenamed("alpha", "statistical")
    # the final signal is that of the statistical stack, for selected names only
    chosen = factors.two_stage(raw_now(s, d), cf.SCREEN_N, cf.FINAL_N).select(*KEY)
    return (
        names.join(final.join(chosen, KEY, "left_semi"), KEY, "left").join(statistical, KEY, "left")
        .join(combined(s, d), KEY, "left").join(learned_stack(s, d), KEY, "left")
    )


SIGNALS = ["alpha", "statistical", "combined", "machine_learning"]
register("m_signal_pick", lambda s, d: signal_columns(s, d).select(*KEY, *[rnd(c, 6).alias(c) for c in SIGNALS], rnd(models.signal(*SIGNALS), 6).alias("signal")))
register("j_alpha", lambda s, d: current(s, d).select(*KEY, "overall_score").join(alpha(s, d), KEY, "left").select(*KEY, rnd("overall_score", 4).alias("overall_score"), rnd("alpha", 6).alias("alpha")))
register("j_selected_alpha", lambda s, d: cf.selection(s, d).select(*KEY, "screen_rank").join(alpha(s, d), KEY, "left").select(*KEY, "screen_rank", rnd("alpha", 6).alias("alpha")))
register("j_factor_alpha", lambda s, d: current(s, d).select(*KEY, "overall_score").join(alpha(s, d).groupBy(*KEY).agg(F.max("alpha").alias("alpha")), KEY, "left").select(*KEY, rnd("overall_score", 4).alias("overall_score"), rnd("alpha", 6).alias("alpha")))
register("t_top_alpha", lambda s, d: top_k(alpha(s, d).filter("alpha IS NOT NULL"), ["as_of_date"], [F.desc("alpha"), F.col("ticker")], 10).select(*KEY, "position", rnd("alpha", 6).alias("alpha")))
