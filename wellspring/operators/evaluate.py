"""Forecast errors, band decisions, cutoffs, baselines and models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.functions import stress
from wellspring.functions.numeric import half_even
from wellspring.operators import days as dy
from wellspring.operators.ordering import add_previous, asof_backward, exact_quantiles, value_counts
from wellspring.operators.series import daily_at, ring_at


# ------------------------------------------------------------------- errors
def _error_columns(error: Column) -> list[Column]:
    return [
        F.count(error).alias("n"),
        half_even(F.avg(F.abs(error)), 3).alias("mae"),
        half_even(F.sqrt(F.avg(error * error)), 3).alias("rmse"),
        half_even(F.avg(error), 3).alias("bias"),
    ]


def error_metrics(pred: DataFrame, groups: list[str], horizon: str = "horizon_d") -> DataFrame:
    """n, MAE, RMSE and bias per group, for each horizon and over all (horizon NULL)."""
    e = F.col("y_pred") - F.col("y_true")
    keys = [F.col(g) for g in groups]
    scored = pred.where(e.isNotNull())
    return scored.groupingSets([[*keys, F.col(horizon)], keys], *keys, F.col(horizon)).agg(*_error_columns(e))


def absolute_error_quantiles(pred: DataFrame, groups: list[str]) -> DataFrame:
    """Exact p50 / p80 / p95 of |error| with MAE and n, for groups of any size."""
    e = F.abs(F.col("y_pred") - F.col("y_true"))
    counts = value_counts(pred.select(*groups, e.alias("abs_error")), groups, "abs_error", "_rows")
    q = exact_quantiles(
        counts, groups, "abs_error", {"p50": 0.50, "p80": 0.80, "p95": 0.95}, weight="_rows"
    )
    total = F.sum("_rows")
    mean = F.sum(F.col("abs_error") * F.col("_rows")) / total
    base = counts.groupBy(*groups).agg(total.alias("n"), half_even(mean, 3).alias("mae"))
    return base.join(q, groups).select(
        *groups, "n", "mae", *[half_even(F.col(p), 3).alias(p) for p in ("p50", "p80", "p95")]
    )


def interval_for(requests: DataFrame, intervals: DataFrame) -> DataFrame:
    """Measured 80% interval by (method, horizon); NULL where none was measured."""
    table = intervals.select(
        "method", "horizon_d", F.col("p80").alias("plus_minus_m"), "p50", "p95", "n"
    )
    return requests.join(table, ["method", "horizon_d"], "left")


def reconstruction_error(errors: DataFrame) -> DataFrame:
    """MAE, RMSE, bias and 90th percentile of |error| over held-out readings."""
    tagged = errors.select(F.lit("all").alias("scope"), "error", F.abs("error").alias("abs_error"))
    q = exact_quantiles(tagged, ["scope"], "abs_error", {"p90": 0.90})
    e = F.col("error")
    base = tagged.groupBy("scope").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("abs_error").alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    )
    return base.join(q, "scope")


_CORRELATED = {"corr_level": ("level", "target_level_t30"), "corr_lag_30": ("level_lag_30", "target_level_t30")}
_MOMENTS = ("n", "x", "y", "xy", "xx", "yy")


def _moments_of(b: dy.Block) -> dy.Answer:
    """Count, means and centred products of each pair of columns over a block."""
    out = {"entity_type": np.array([b.entity_type])}
    for name, pair in _CORRELATED.items():
        both = b.kept & (b[pair[0]] == b[pair[0]]) & (b[pair[1]] == b[pair[1]])
        x, y = (b[c][both] for c in pair)
        mx, my = (x.mean(), y.mean()) if len(x) else (0.0, 0.0)
        x, y = x - mx, y - my
        for m, v in zip(_MOMENTS, (len(x), mx, my, x @ y, x @ x, y @ y)):
            out[f"{name}_{m}"] = np.array([v])
    return out


def _moments(features: DataFrame | dy.Days) -> DataFrame:
    if isinstance(features, dy.Days):
        schema = ", ".join(f"{name}_{m} {'long' if m == 'n' else 'double'}" for name in _CORRELATED for m in _MOMENTS)
        return features.partial(_moments_of, f"entity_type string, {schema}")
    aggs = []
    for name, (a, b) in _CORRELATED.items():
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        x, y, n = F.when(both, F.col(a)), F.when(both, F.col(b)), F.count_if(both)
        found = (n, F.avg(x), F.avg(y), F.covar_pop(x, y) * n, F.var_pop(x) * n, F.var_pop(y) * n)
        aggs += [F.coalesce(v, F.lit(0)).alias(f"{name}_{m}") for m, v in zip(_MOMENTS, found)]
    return features.groupBy("entity_type").agg(*aggs)


def target_correlation(*features: DataFrame | dy.Days) -> DataFrame:
    """Correlation of the level now and of 30 days ago with the level in 30 days, per track.

    Moments are merged about their common mean, so that large levels lose no digits.
    """
    parts = reduce(DataFrame.unionByName, [_moments(f) for f in features])
    track = Window.partitionBy("entity_type")
    centred, corr = parts, {}
    for name in _CORRELATED:
        n, x, y, xy, xx, yy = (F.col(f"{name}_{m}") for m in _MOMENTS)
        total = F.nullif(F.sum(n).over(track), F.lit(0))
        dx, dy_ = x - F.sum(n * x).over(track) / total, y - F.sum(n * y).over(track) / total
        whole = {"xy": xy + n * dx * dy_, "xx": xx + n * dx * dx, "yy": yy + n * dy_ * dy_}
        centred = centred.withColumns({f"_{name}_{m}": v for m, v in whole.items()})
        xy, xx, yy = (F.sum(f"_{name}_{m}") for m in whole)
        corr[name] = F.when(F.sum(n) > 1, xy / F.sqrt(xx * yy))
    return centred.groupBy("entity_type").agg(*[v.alias(name) for name, v in corr.items()])


# -------------------------------------------------------------------- bands
def reference_levels(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Shallow and interpolated crisis level per well from train readings, n >= 4.

    One reading per well and day bounds a group by the calendar, so the
    built-in exact ``percentile`` is safe here.
    """
    train = readings.where(F.col("obs_date") <= F.lit(settings.train_end).cast("date"))
    return (
        train.groupBy("well_id")
        .agg(
            F.min("level_mbgl").alias("shallow"),
            F.percentile("level_mbgl", F.lit(settings.crisis_share)).alias("crisis"),
            F.count(F.lit(1)).alias("n_train_obs"),
        )
        .where(F.col("n_train_obs") >= 4)
    )


def forecaster_scores(
    features: DataFrame, reference: DataFrame, model: DataFrame | Column | None = None
) -> DataFrame:
    """True and forecast score per row for each forecaster, one row each.

    Forecasters: ``climatology`` (well mean where the season is missing),
    ``last_reading`` and, given ``model`` (keys + model_level), ``model``. A model that
    is a column of the features is met where the rows lie by well, as if its non-null
    rows were joined: rows that share a key meet each other's.
    """
    keys = ["well_id", "origin_date", "horizon_d"]
    df = features.join(reference, "well_id")
    if isinstance(model, Column):
        alike = F.collect_list(model).over(Window.partitionBy(*keys))
        df = df.withColumn("_model", alike).withColumn("model_level", F.explode_outer("_model"))
    elif model is not None:
        df = df.join(model, keys, "left")
    levels = {
        "climatology": F.coalesce("clim_season", "clim_well"),
        "last_reading": F.col("last_obs_level"),
        **({"model": F.col("model_level")} if model is not None else {}),
    }

    def score(level: Column) -> Column:
        return stress.level_score(
            level, F.col("shallow"), F.col("crisis"), F.col("obs_trend_m_per_day"), F.col("well_depth")
        )

    options = F.array(
        *[F.struct(F.lit(n).alias("forecaster"), c.alias("y_pred"), score(c).alias("pred_score")) for n, c in levels.items()]
    )
    return df.select(
        "well_id", "origin_date", "horizon_d", "split", F.col("target_level").alias("y_true"),
        score(F.col("target_level")).alias("true_score"), F.explode(options).alias("o"),
    ).select("well_id", "origin_date", "horizon_d", "split", "y_true", "true_score", "o.*")


def confusion_matrix(scored: DataFrame, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """All nine (actual, predicted) cells per group, empty ones as 0."""
    actual, predicted = stress.band(F.col("true_score"), settings), stress.band(F.col("pred_score"), settings)
    cells = [(a, p) for a in stress.BANDS for p in stress.BANDS]
    counts = scored.groupBy(*groups).agg(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("actual"), F.lit(p).alias("predicted"),
                    F.count_if((actual == a) & (predicted == p)).alias("n"),
                )
                for a, p in cells
            ]
        ).alias("cells")
    )
    return counts.select(*groups, F.inline("cells"))


def band_accuracy(scored: DataFrame, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Exact and within-one share, ACT NOW recall, precision, misses, false alarms."""
    actual, predicted = stress.band(F.col("true_score"), settings), stress.band(F.col("pred_score"), settings)
    rows = scored.where(actual.isNotNull() & predicted.isNotNull()).withColumns(
        {
            "_off": F.abs(stress.band_rank(actual) - stress.band_rank(predicted)),
            "_t": actual == "ACT NOW",
            "_p": predicted == "ACT NOW",
        }
    )
    sums = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_off") == 0).alias("n_exact"),
        F.count_if(F.col("_off") <= 1).alias("n_near"),
        F.count_if(F.col("_t") & F.col("_p")).alias("caught"),
        F.count_if(F.col("_t") & ~F.col("_p")).alias("misses"),
        F.count_if(~F.col("_t") & F.col("_p")).alias("false_alarms"),
    )
    return sums.select(
        *groups, "n",
        half_even(F.col("n_exact") / F.col("n"), 4).alias("exact_band"),
        half_even(F.col("n_near") / F.col("n"), 4).alias("within_one_band"),
        half_even(_share("caught", "misses"), 4).alias("act_now_recall"),
        half_even(_share("caught", "false_alarms"), 4).alias("act_now_precision"),
        "misses", "false_alarms",
    )


def _share(hit: str, other: str) -> Column:
    return F.col(hit) / F.nullif(F.col(hit) + F.col(other), F.lit(0))


def threshold_curve(
    scored: DataFrame, groups: list[str], low: int = 30, high: int = 90, settings: Settings = DEFAULTS
) -> DataFrame:
    """Alert counts at every integer cutoff from one pass over the scores.

    Scores fall into at most ``high - low + 2`` bins per group (the number of
    cutoffs they exceed); a running sum from the top gives every cutoff. No
    row is repeated per cutoff.
    """
    truth = F.col("true_score") > settings.truth_cutoff
    top = F.least(F.lit(high), F.greatest(F.lit(low - 1), F.ceil("pred_score").cast("int") - 1))
    binned = scored.where(F.col("pred_score").isNotNull() & F.col("true_score").isNotNull())
    bins = binned.groupBy(*groups, top.alias("cutoff")).agg(
        F.count_if(truth).alias("_hit"), F.count_if(~truth).alias("_noise")
    )
    ladder = bins.select(*groups).distinct().withColumn(
        "cutoff", F.explode(F.sequence(F.lit(low - 1), F.lit(high)))
    )
    full = ladder.join(bins, [*groups, "cutoff"], "left").na.fill(0, ["_hit", "_noise"])
    above = Window.partitionBy(*groups).orderBy(F.desc("cutoff")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(*groups)
    out = full.withColumns(
        {
            "caught": F.sum("_hit").over(above),
            "false_alarms": F.sum("_noise").over(above),
            "crises": F.sum("_hit").over(everything),
        }
    ).where(F.col("cutoff") >= low)
    return out.select(
        *groups, "cutoff",
        (F.col("caught") + F.col("false_alarms")).alias("alerts"),
        "caught",
        (F.col("crises") - F.col("caught")).alias("misses"),
        "false_alarms", "crises",
        (F.col("caught") / F.nullif(F.col("crises"), F.lit(0))).alias("recall"),
        (F.col("caught") / F.nullif(F.col("caught") + F.col("false_alarms"), F.lit(0))).alias("precision"),
    )


def choose_cutoff(curve: DataFrame, groups: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Highest cutoff that reaches the target recall, else the one with most recall.

    Among equal best recalls the lowest cutoff is taken.
    """
    reached = F.max(F.when((F.col("recall") > 0) & (F.col("recall") >= settings.target_recall), F.col("cutoff")))
    best = F.max_by("cutoff", F.when(F.col("recall") > 0, F.struct(F.col("recall"), -F.col("cutoff"))))
    return curve.groupBy(*groups).agg(F.coalesce(reached, best).alias("chosen_cutoff"))


def operating_point(scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cutoff fitted on validation, with test counts at it, the default and the shipped one."""
    curve = threshold_curve(scored, ["forecaster", "split"], settings=settings)
    chosen = choose_cutoff(curve.where(F.col("split") == "val"), ["forecaster"], settings)
    named = chosen.select(
        "forecaster",
        F.explode(
            F.array(
                F.struct(F.lit("default").alias("label"), F.lit(int(settings.truth_cutoff)).alias("cutoff")),
                F.struct(F.lit("tuned").alias("label"), F.col("chosen_cutoff").alias("cutoff")),
                F.struct(F.lit("shipped").alias("label"), F.lit(int(settings.act_now_above)).alias("cutoff")),
            )
        ).alias("c"),
    ).select("forecaster", "c.label", "c.cutoff")
    return named.join(curve.where(F.col("split") == "test").drop("split"), ["forecaster", "cutoff"])


# ---------------------------------------------------------------- baselines
def baseline_predictions(
    daily: DataFrame,
    readings: DataFrame,
    horizons: tuple[int, ...] = (7, 15, 30),
    observed_only: bool = True,
    settings: Settings = DEFAULTS,
    wells: DataFrame | None = None,
) -> DataFrame:
    """Four baselines for every target whose origin day has a daily state.

    Given ``wells``, the state is computed for the asked days alone and not met
    in ``daily``, which must be the daily table of these readings and wells.
    """
    source = (
        readings.select("well_id", F.col("obs_date").alias("target_date"), F.col("level_mbgl").alias("y_true"))
        if observed_only
        else daily.select("well_id", F.col("date").alias("target_date"), F.col("level_mbgl").alias("y_true"))
    )
    targets = source.select(
        "*", F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_d")
    ).withColumns(
        {"date": F.date_sub("target_date", F.col("horizon_d")), "split": cal.split_of(F.col("target_date"), settings),
         "doy": F.dayofyear("target_date")}
    )
    pairs = targets.where(F.col("split").isin("val", "test"))
    if wells is None:
        pairs = pairs.join(daily.select("well_id", "date", "level_mbgl"), ["well_id", "date"])
    else:
        pairs = daily_at(pairs, readings, wells, settings)
    pairs = pairs.withColumnRenamed("level_mbgl", "persistence_daily")
    known = readings.select("well_id", F.col("obs_date").alias("last_date"), F.col("level_mbgl").alias("persistence_obs"))
    pairs = asof_backward(pairs, known, "well_id", "date", "last_date", ["persistence_obs"])
    pairs = ring_at(pairs, daily, settings)
    names = ["persistence_daily", "persistence_obs", "climatology", "well_mean"]
    wide = pairs.withColumnRenamed("clim", "climatology")
    return wide.unpivot(["well_id", "target_date", "horizon_d", "split", "y_true"], names, "forecaster", "y_pred")


def baseline_verdict(metrics: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per horizon on test: is the daily state leaking, and which honest baseline is best."""
    test = metrics.where((F.col("split") == "test") & F.col("horizon_d").isNotNull() & F.col("mae").isNotNull())
    def mae_of(name: str) -> Column:
        return F.max(F.when(F.col("forecaster") == name, F.col("mae")))

    rows = test.groupBy("horizon_d").agg(
        mae_of("persistence_daily").alias("daily_state_mae"),
        mae_of("persistence_obs").alias("last_reading_mae"),
        F.min(F.when(F.col("forecaster") != "persistence_daily", F.struct("mae", "forecaster"))).alias("_clean"),
        F.min(F.struct("mae", "forecaster")).alias("_any"),
    )
    leaks = F.coalesce(F.col("daily_state_mae") < F.col("last_reading_mae") * 0.8, F.lit(False))
    any_leak = F.max(leaks).over(Window.partitionBy(F.lit(1)))
    best = F.when(any_leak, F.col("_clean")).otherwise(F.col("_any"))
    return rows.withColumn("leaks", leaks).withColumn("_best", best).select(
        "horizon_d", "daily_state_mae", "last_reading_mae", "leaks",
        F.col("_best.forecaster").alias("best_baseline"), F.col("_best.mae").alias("best_mae"),
    )


def skill(model_metrics: DataFrame, verdict: DataFrame, flat_below: float = 0.05) -> DataFrame:
    """1 - MAE / best baseline MAE per horizon, and whether error is flat across them."""
    out = model_metrics.join(verdict.select("horizon_d", "best_baseline", "best_mae"), "horizon_d")
    every = Window.partitionBy(F.lit(1))
    spread = F.max("mae").over(every) - F.min("mae").over(every)
    several = F.count(F.lit(1)).over(every) > 1
    return out.withColumns(
        {"skill": half_even(F.lit(1.0) - F.col("mae") / F.col("best_mae"), 4), "flat": several & (spread < flat_below)}
    )


def served_vs_published(served: DataFrame, published: DataFrame, tolerance_m: float = 0.02) -> DataFrame:
    """MAE by horizon of served predictions against the published figure.

    A horizon without a published figure cannot diverge.
    """
    mae = served.groupBy("horizon_d").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_pred") - F.col("y_true"))).alias("served_mae")
    )
    out = mae.join(published.select("horizon_d", "published_mae"), "horizon_d", "left")
    delta = F.col("served_mae") - F.col("published_mae")
    return out.withColumns({"delta": delta, "diverged": F.coalesce(F.abs(delta) > tolerance_m, F.lit(False))})


# ------------------------------------------------------------------- models
TARGETS = ("level", "delta_obs", "delta_clim")


def residual_target(kind: str) -> tuple[Column, Column]:
    """(what to fit, what to add back)."""
    base = {
        "level": F.lit(0.0),
        "delta_obs": F.col("last_obs_level"),
        "delta_clim": F.coalesce("clim_season", "clim_well"),
    }[kind]
    return F.col("target_level") - base, base


def residual_summary(features: DataFrame, groups: list[str]) -> DataFrame:
    """Per kind of target and group: rows, rows that can be fitted, mean and mean absolute residual.

    All kinds come from one pass over the features and one aggregate.
    """
    each = F.array(*(F.struct(F.lit(kind).alias("target"), residual_target(kind)[0].alias("residual")) for kind in TARGETS))
    rows = features.select(*groups, F.inline(each))
    return rows.groupBy("target", *groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count("residual").alias("n_fit"),
        F.avg("residual").alias("mean_residual"),
        F.avg(F.abs("residual")).alias("mean_abs_residual"),
    )


def train_residual_model(
    matrix: DataFrame,
    names: list[str],
    target: str = "delta_clim",
    rounds: int = 40,
    depth: int = 5,
    step: float = 0.1,
    seed: int = 42,
):
    """Boosted trees on absolute error with validation early stop.

    Missing inputs are imputed beside a 0/1 missing flag, because Spark ML
    trees have no missing branch. Returns (fitted pipeline, prepared frame).
    Training reads ``matrix`` several times: give a stored one. The flags are
    made where it is read and not stored beside it.
    """
    y, base = residual_target(target)
    missing = {c: F.col(c).isNull() | F.isnan(c) for c in names}
    flags = {f"{c}_missing": m.cast("double") for c, m in missing.items()}
    ready = matrix.withColumns({**flags, "_y": y, "_base": base, "_is_val": F.col("split") == "val"})
    filled = [f"{c}_filled" for c in names]
    stages = [
        Imputer(inputCols=names, outputCols=filled, strategy="mean"),
        VectorAssembler(inputCols=[*filled, *flags], outputCol="inputs", handleInvalid="error"),
        GBTRegressor(
            featuresCol="inputs", labelCol="_y", lossType="absolute", maxIter=rounds, maxDepth=depth,
            stepSize=step, subsamplingRate=0.8, seed=seed, validationIndicatorCol="_is_val",
        ),
    ]
    fit_rows = ready.where(F.col("split").isin("train", "val") & F.col("_y").isNotNull())
    return Pipeline(stages=stages).fit(fit_rows), ready


def predict_residual(model, ready: DataFrame) -> DataFrame:
    """Predicted level = model output + the base it was fitted against."""
    return model.transform(ready).select(
        "well_id", "origin_date", "target_date", F.col("horizon_d").cast("int").alias("horizon_d"), "split",
        F.col("target_level").alias("y_true"), (F.col("prediction") + F.col("_base")).alias("y_pred"),
    )


def train_per_horizon(matrix: DataFrame, names: list[str], horizons: tuple[int, ...], **options) -> DataFrame:
    """One model per horizon; their predictions in one table. Each reads the same stored ``matrix``.

    Each horizon needs rows to fit; Spark ML raises where there are none.
    """
    inputs = [c for c in names if c != "horizon_d"]
    parts = []
    for h in horizons:
        model, ready = train_residual_model(matrix.where(F.col("horizon_d") == h), inputs, **options)
        parts.append(predict_residual(model, ready))
    return reduce(DataFrame.unionByName, parts)


def gain_importance(spark, model, names: list[str]) -> DataFrame:
    """Share of total gain per input, flags folded into their column."""
    weights = model.stages[-1].featureImportances.toArray()
    share = {n: float(weights[i] + weights[i + len(names)]) for i, n in enumerate(names)}
    return spark.createDataFrame(sorted(share.items(), key=lambda kv: -kv[1]), "feature string, gain_share double")


def sequence_rows(readings: DataFrame, lags: int = 4, settings: Settings = DEFAULTS) -> DataFrame:
    """Readings with their k previous readings, train climatology and split.

    Where a season was not seen in training the well's overall mean is used.
    """
    lagged = add_previous(readings, "well_id", "obs_date", "level_mbgl", lags)
    season = (
        readings.where(F.col("obs_date") <= F.lit(settings.train_end).cast("date"))
        .groupBy("well_id", "season")
        .agg(F.avg("level_mbgl").alias("_season"))
    )
    whole = F.avg("level_mbgl").over(Window.partitionBy("well_id"))
    names = [f"lag_{i}" for i in range(1, lags + 1)]
    out = lagged.withColumn("_whole", whole).join(season, ["well_id", "season"], "left")
    return out.select(
        "well_id", "obs_date", "level_mbgl",
        cal.split_of(F.col("obs_date"), settings).alias("split"),
        F.coalesce("_season", "_whole").alias("clim"),
        F.date_diff("obs_date", "lag_date_1").alias("gap_d"),
        *names,
    ).dropna(subset=[*names, "clim", "split"])


def line_fit(rows: DataFrame, x: str) -> DataFrame:
    """One-input least squares on train, error on test: aggregates only."""
    fit = rows.where(F.col("split") == "train").agg(
        F.regr_slope("level_mbgl", x).alias("slope"), F.regr_intercept("level_mbgl", x).alias("const")
    )
    test = rows.where(F.col("split") == "test").select("level_mbgl", F.col(x).alias("_x"))
    pred = test.withColumns({name: fit.select(name).scalar() for name in ("const", "slope")})
    return pred.agg(
        F.lit(x).alias("variant"), F.first("const").alias("const"), F.first("slope").alias("slope"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(F.col("const") + F.col("slope") * F.col("_x") - F.col("level_mbgl"))).alias("mae"),
    )


def gram_sums(rows: DataFrame, inputs: list[str], label: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of all rows, with a constant first: one aggregate that merges like any sum."""
    names = ["1", *inputs, label]
    value = lambda n: F.lit(1.0) if n == "1" else F.col(n).cast("double")
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    one = rows.agg(*(F.sum(value(names[i]) * value(names[j])).alias(f"s{i}_{j}") for i, j in pairs)).first()
    whole = np.zeros((len(names), len(names)))
    for i, j in pairs:
        whole[i, j] = whole[j, i] = one[f"s{i}_{j}"] or 0.0
    return whole[:-1, :-1], whole[:-1, -1]


def autoregressions(
    rows: DataFrame, variants: dict[str, list[str]], label: str = "level_mbgl"
) -> tuple[dict[str, dict[str, float]], DataFrame]:
    """Pooled least squares of several variants: coefficients, and a table of them with n and MAE on test.

    The train rows are read once for all variants: each solves its part of the same
    matrix of sums (k x k numbers, whatever the rows). One more aggregate scores all of
    them. A variant that the rows do not determine takes the least coefficients.
    """
    inputs = list(dict.fromkeys(x for xs in variants.values() for x in xs))
    train = rows.where(F.col("split") == "train")
    xx, xy = gram_sums(train, inputs, label)
    fitted: dict[str, dict[str, float]] = {}
    for name, xs in variants.items():
        at = [0, *(1 + inputs.index(x) for x in xs)]
        scale = 1 / np.sqrt(np.maximum(np.diag(xx)[at], np.finfo(float).tiny))
        part = xx[np.ix_(at, at)] * np.outer(scale, scale)
        solved = np.linalg.lstsq(part, xy[at] * scale, rcond=1e-12)[0] * scale
        fitted[name] = dict(zip(["const", *xs], solved.tolist(), strict=True))
    test = rows.where(F.col("split") == "test")
    errors = [F.avg(F.abs(linear(fit) - F.col(label))).alias(f"m{k}") for k, fit in enumerate(fitted.values())]
    one = test.agg(F.count(F.lit(1)).alias("n"), *errors)
    lines = [
        F.struct(F.lit(name).alias("variant"), F.lit(term).alias("term"), F.lit(float(c)).alias("coefficient"), F.col("n"), F.col(f"m{k}").alias("mae"))
        for k, (name, fit) in enumerate(fitted.items())
        for term, c in fit.items()
    ]
    return fitted, one.select(F.inline(F.array(*lines)))


def linear(fit: dict[str, float]) -> Column:
    """The prediction of a fit as an expression, for rows that have its inputs."""
    return reduce(lambda a, b: a + b, (F.lit(c) if term == "const" else F.lit(c) * F.col(term) for term, c in fit.items()))
