"""Queries: forecast evaluation, baselines, models, quality gates and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wellspring.functions.numeric import half_even
from wellspring.operators import evaluate as ev
from wellspring.operators import features as ft
from wellspring.operators import places as pl
from wellspring.operators import quality as dq
from wellspring.operators import reports as rp
from wellspring.operators import score as sc
from wellspring.operators.lineage import cut_lineage
from wellspring.plans import timeseries as ts
from wellspring.plans.fixtures import HORIZONS, SETTINGS
from wellspring.plans.registry import query
from wellspring.plans.scoring import _CR1
from wellspring.plans.sql_views import level_score, r
from wellspring.streaming import messages as ms
from wellspring.streaming import reports as sr


def _scored(fx):
    return ev.forecaster_scores(fx.causal, ev.reference_levels(fx.readings, fx.settings))


def _errors_sql(source: str, groups: str) -> str:
    e = "(y_pred - y_true)"
    cols = f"count({e}) AS n, {r(f'avg(abs({e}))',3)} AS mae, {r(f'sqrt(avg({e}*{e}))',3)} AS rmse, {r(f'avg({e})',3)} AS bias"
    return (
        f"SELECT {groups}, horizon_d, {cols} FROM ({source}) WHERE {e} IS NOT NULL GROUP BY {groups}, horizon_d "
        f"UNION ALL SELECT {groups}, NULL, {cols} FROM ({source}) WHERE {e} IS NOT NULL GROUP BY {groups}"
    )


@query("AG-9", _errors_sql("SELECT * FROM fx_scored", "split, forecaster"))
def error_metrics(fx):
    return ev.error_metrics(_scored(fx), ["split", "forecaster"])


_Q = f"""SELECT forecaster, horizon_d, count(*) AS n, {r('avg(e)',3)} AS mae, {r('quantile_cont(e,0.5)',3)} AS p50, {r('quantile_cont(e,0.8)',3)} AS p80, {r('quantile_cont(e,0.95)',3)} AS p95
    FROM (SELECT forecaster, horizon_d, abs(y_pred - y_true) AS e FROM fx_scored WHERE split = 'test' AND y_pred IS NOT NULL) GROUP BY 1,2"""


@query("AG-10 ML-4", _Q)
def error_quantiles(fx):
    return ev.absolute_error_quantiles(_scored(fx).where(F.col("split") == "test"), ["forecaster", "horizon_d"])


@query(
    "SC-20",
    f"""SELECT doc_id, x.method, x.horizon_d, p80 AS plus_minus_m, p50, p95, q.n FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'climatology' ELSE 'none' END AS method,
          CAST([7,15,30,90][doc_id % 4 + 1] AS INTEGER) AS horizon_d FROM documents) x LEFT JOIN ({_Q}) q ON q.forecaster = x.method AND q.horizon_d = x.horizon_d""",
)
def interval_lookup(fx):
    k = F.col("doc_id")
    asked = fx.table("documents", "doc_id").select(
        "doc_id",
        F.when(k % 2 == 0, "climatology").otherwise("none").alias("method"),
        F.element_at(F.array(*[F.lit(h) for h in (7, 15, 30, 90)]), (k % 4).cast("int") + 1).alias("horizon_d"),
    )
    return ev.interval_for(asked, error_quantiles(fx).withColumnRenamed("forecaster", "method"))


@query(
    "PR-14 SC-20",
    f"""SELECT c.entity_id, c.status, c.reason, c.score, c.band, c.forecast_level AS headline, c.s_depth AS depth, c.s_trend AS trend, c.s_headroom AS headroom,
               c.driving_well, c.wells_scored, c.date - c.last_obs_date AS days_since, CASE WHEN c.status = 'ok' THEN q.p80 END AS plus_minus_m, coalesce(w.wells, '') AS wells
        FROM fx_area_cards c LEFT JOIN ({_Q}) q ON q.forecaster = 'climatology' AND q.horizon_d = 30
        LEFT JOIN (SELECT taluka, string_agg(well_id || ':' || score, ' ' ORDER BY score DESC, well_id) AS wells
                   FROM (SELECT *, row_number() OVER (PARTITION BY taluka ORDER BY score DESC, well_id) AS k FROM fx_well_scores) WHERE k <= 3 GROUP BY 1) w ON w.taluka = c.entity_id""",
)
def score_cards(fx):
    """Nested cards of all areas, spread out to columns."""
    cards = sc.rural_score(fx.readings, fx.base_wells, settings=fx.settings, listed=3)
    measured = error_quantiles(fx).where(F.col("forecaster") == "climatology").withColumn("method", F.lit(sc.RURAL_METHOD))
    out = sc.nested_cards(cards, measured, fx.settings)
    wells = F.array_join(F.transform("wells", lambda w: F.concat(w["well_id"], F.lit(":"), w["score"])), " ")
    return out.select(
        "entity_id", "status", "reason", "score", "band", F.col("headline.value").alias("headline"), "components.depth", "components.trend",
        "components.headroom", "detail.driving_well", "detail.wells_scored", F.col("detail.days_since_last_reading").alias("days_since"),
        "interval.plus_minus_m", wells.alias("wells"),
    )


@query("AG-8", f"SELECT well_id, shallow, {r('crisis',6)} AS crisis, n_train_obs FROM fx_reference")
def reference_levels(fx):
    return ev.reference_levels(fx.readings, fx.settings).withColumn("crisis", half_even(F.col("crisis"), 6))


_BANDED = """(SELECT *, CASE WHEN true_score > 70 THEN 2 WHEN true_score > 40 THEN 1 ELSE 0 END AS a, CASE WHEN pred_score > 70 THEN 2 WHEN pred_score > 40 THEN 1 ELSE 0 END AS p
   FROM fx_scored WHERE split = 'test' AND pred_score IS NOT NULL AND true_score IS NOT NULL)"""


@query(
    "AG-12",
    f"""SELECT forecaster, ['SAFE','MONITOR','ACT NOW'][i+1] AS actual, ['SAFE','MONITOR','ACT NOW'][j+1] AS predicted, count(*) FILTER (a = i AND p = j) AS n
        FROM {_BANDED}, range(3) x(i), range(3) y(j) GROUP BY 1, i, j""",
)
def confusion_matrix(fx):
    return ev.confusion_matrix(_scored(fx).where(F.col("split") == "test"), ["forecaster"], fx.settings)


@query(
    "AG-12 ML-4",
    f"""SELECT forecaster, count(*) AS n, {r('count(*) FILTER (a = p)/count(*)',4)} AS exact_band, {r('count(*) FILTER (abs(a-p) <= 1)/count(*)',4)} AS within_one_band,
          {r('count(*) FILTER (a = 2 AND p = 2)/nullif(count(*) FILTER (a = 2),0)',4)} AS act_now_recall, {r('count(*) FILTER (a = 2 AND p = 2)/nullif(count(*) FILTER (p = 2),0)',4)} AS act_now_precision,
          count(*) FILTER (a = 2 AND p < 2) AS misses, count(*) FILTER (a < 2 AND p = 2) AS false_alarms FROM {_BANDED} GROUP BY 1""",
)
def band_accuracy(fx):
    return ev.band_accuracy(_scored(fx).where(F.col("split") == "test"), ["forecaster"], fx.settings)


def _curve_sql(source: str) -> str:
    return f"""SELECT forecaster, split, CAST(c AS INTEGER) AS cutoff, count(*) FILTER (pred_score > c) AS alerts, count(*) FILTER (pred_score > c AND true_score > 71) AS caught,
      count(*) FILTER (pred_score <= c AND true_score > 71) AS misses, count(*) FILTER (pred_score > c AND NOT true_score > 71) AS false_alarms, count(*) FILTER (true_score > 71) AS crises,
      count(*) FILTER (pred_score > c AND true_score > 71)/nullif(count(*) FILTER (true_score > 71),0) AS recall,
      count(*) FILTER (pred_score > c AND true_score > 71)/nullif(count(*) FILTER (pred_score > c),0) AS precision
    FROM {source}, range(30, 91) v(c) WHERE pred_score IS NOT NULL AND true_score IS NOT NULL GROUP BY 1,2,3"""


_CUT = "forecaster, split, cutoff, alerts, caught, misses, false_alarms, crises, {} AS recall, {} AS precision".format(r("recall", 9), r("precision", 9))


def _rounded(df):
    return df.withColumns({"recall": half_even(F.col("recall"), 9), "precision": half_even(F.col("precision"), 9)})


@query("AG-13", f"SELECT {_CUT} FROM ({_curve_sql('fx_pred')})")
def threshold_curve(fx):
    return _rounded(ev.threshold_curve(fx.scored_documents, ["forecaster", "split"], settings=fx.settings))


@query(
    "AG-13 ML-4",
    f"""WITH curve AS ({_curve_sql('fx_scored')}),
        chosen AS (SELECT forecaster, coalesce(max(cutoff) FILTER (recall > 0 AND recall >= 0.8e0), arg_max(cutoff, (recall, -cutoff)) FILTER (recall > 0)) AS c FROM curve WHERE split = 'val' GROUP BY 1),
        named AS (SELECT forecaster, 'default' AS label, 71 AS cutoff FROM chosen UNION ALL SELECT forecaster, 'tuned', c FROM chosen UNION ALL SELECT forecaster, 'shipped', 70 FROM chosen)
        SELECT n.label, {_CUT.replace('split, ', '')} FROM named n JOIN curve USING (forecaster, cutoff) WHERE split = 'test'""",
)
def operating_point(fx):
    return _rounded(ev.operating_point(_scored(fx), fx.settings))


# ------------------------------------------------------------------ baselines
_BASE = ts._RING + """, o3 AS (SELECT o.well_id, o.obs_date AS target_date, o.level_mbgl AS y_true, h AS horizon_d, CAST(o.obs_date - h AS DATE) AS at,
        CASE WHEN obs_date <= DATE '1999-06-30' THEN 'train' WHEN obs_date <= DATE '2000-06-30' THEN 'val' WHEN obs_date <= DATE '2001-08-31' THEN 'test' END AS split FROM fx_obs o, (VALUES (7),(15),(30)) v(h)),
     pr AS (SELECT o3.*, d.level_mbgl AS persistence_daily, x.level_mbgl AS persistence_obs, coalesce(sm.c, sm.well_mean) AS climatology, sm.well_mean
        FROM o3 JOIN fx_daily d ON d.well_id = o3.well_id AND d.date = o3.at ASOF LEFT JOIN fx_obs x ON x.well_id = o3.well_id AND o3.at >= x.obs_date
        LEFT JOIN (SELECT * FROM sm WHERE k = 0) sm ON sm.well_id = o3.well_id AND sm.doy = dayofyear(o3.target_date) WHERE split IN ('val','test')),
     bp AS (SELECT horizon_d, split, y_true, unnest(['persistence_daily','persistence_obs','climatology','well_mean']) AS forecaster, unnest([persistence_daily, persistence_obs, climatology, well_mean]) AS y_pred FROM pr),
     bm AS (""" + _errors_sql("SELECT * FROM bp", "split, forecaster") + ")"


def _baselines(fx):
    pred = ev.baseline_predictions(fx.daily, fx.readings, HORIZONS, settings=fx.settings, wells=fx.wells)
    return ev.error_metrics(pred, ["split", "forecaster"])


@query("ML-1", f"{_BASE} SELECT * FROM bm")
def baseline_metrics(fx):
    return _baselines(fx)


_VERDICT = """SELECT horizon_d, d AS daily_state_mae, l AS last_reading_mae, coalesce(d < l*0.8e0, false) AS leaks,
      CASE WHEN bool_or(coalesce(d < l*0.8e0, false)) OVER () THEN bc ELSE ba END AS best_baseline, CASE WHEN bool_or(coalesce(d < l*0.8e0, false)) OVER () THEN mc ELSE ma END AS best_mae
   FROM (SELECT horizon_d, max(mae) FILTER (forecaster = 'persistence_daily') d, max(mae) FILTER (forecaster = 'persistence_obs') l,
        arg_min(forecaster, (mae, forecaster)) FILTER (forecaster <> 'persistence_daily') bc, min(mae) FILTER (forecaster <> 'persistence_daily') mc, arg_min(forecaster, (mae, forecaster)) ba, min(mae) ma
      FROM bm WHERE split = 'test' AND horizon_d IS NOT NULL GROUP BY 1)"""


@query("AG-14", f"{_BASE} {_VERDICT}")
def baseline_verdict(fx):
    return ev.baseline_verdict(_baselines(fx), fx.settings)


@query(
    "AG-14",
    f"""{_BASE}, vd AS ({_VERDICT}), mm AS (SELECT horizon_d, {r('avg(abs(y_pred-y_true))',3)} AS mae FROM fx_scored WHERE forecaster = 'climatology' AND split = 'test' AND y_pred IS NOT NULL GROUP BY 1)
        SELECT horizon_d, mae, best_baseline, best_mae, {r('1e0 - mae/best_mae',4)} AS skill, count(*) OVER () > 1 AND max(mae) OVER () - min(mae) OVER () < 0.05 AS flat FROM mm JOIN vd USING (horizon_d)""",
)
def seasonal_skill(fx):
    """Skill of the seasonal-mean forecast over the best honest baseline."""
    own = ev.error_metrics(_scored(fx), ["split", "forecaster"]).where(
        (F.col("forecaster") == "climatology") & (F.col("split") == "test") & F.col("horizon_d").isNotNull()
    )
    return ev.skill(own.select("horizon_d", "mae"), ev.baseline_verdict(_baselines(fx), fx.settings))


@query(
    "ML-5",
    f"""SELECT horizon_d, n, {r('served',6)} AS served_mae, published AS published_mae, {r('served - published',6)} AS delta, coalesce(abs(served - published) > 0.02e0, false) AS diverged FROM
        (SELECT horizon_d, count(*) AS n, avg(abs(y_pred - y_true)) AS served FROM fx_scored WHERE forecaster = 'climatology' AND split = 'test' AND y_pred IS NOT NULL GROUP BY 1)
        LEFT JOIN (VALUES (7, 12.0e0), (15, 12.5e0)) p(h, published) ON h = horizon_d""",
)
def served_vs_published(fx):
    served = _scored(fx).where((F.col("forecaster") == "climatology") & (F.col("split") == "test") & F.col("y_pred").isNotNull())
    published = fx.spark.createDataFrame([(7, 12.0), (15, 12.5)], "horizon_d int, published_mae double")
    out = ev.served_vs_published(served, published)
    return out.withColumns({"served_mae": half_even(F.col("served_mae"), 6), "delta": half_even(F.col("delta"), 6)})


_SEQ = """SELECT * FROM (SELECT o.well_id, o.obs_date, o.level_mbgl, CASE WHEN obs_date <= DATE '1999-06-30' THEN 'train' WHEN obs_date <= DATE '2000-06-30' THEN 'val' WHEN obs_date <= DATE '2001-08-31' THEN 'test' END AS split,
     coalesce(m, avg(level_mbgl) OVER (PARTITION BY o.well_id)) AS clim, lag(level_mbgl,1) OVER w AS lag_1, lag(level_mbgl,2) OVER w AS lag_2, lag(level_mbgl,3) OVER w AS lag_3, lag(level_mbgl,4) OVER w AS lag_4
   FROM fx_obs o LEFT JOIN (SELECT well_id, season, avg(level_mbgl) m FROM fx_obs WHERE obs_date <= DATE '1999-06-30' GROUP BY 1,2) c ON c.well_id = o.well_id AND c.season = o.season WINDOW w AS (PARTITION BY o.well_id ORDER BY o.obs_date))
   WHERE lag_4 IS NOT NULL AND split IS NOT NULL"""


def _line_sql(x: str) -> str:
    return f"""SELECT '{x}' AS variant, {r('max(b0)',5)} AS const, {r('max(b1)',5)} AS slope, count(*) AS n, {r(f'avg(abs(b0 + b1*{x} - level_mbgl))',5)} AS mae
      FROM ({_SEQ}) s, (SELECT regr_slope(level_mbgl, {x}) b1, regr_intercept(level_mbgl, {x}) b0 FROM ({_SEQ}) WHERE split = 'train') f WHERE split = 'test'"""


@query("ML-3", f"{_line_sql('clim')} UNION ALL {_line_sql('lag_1')}")
def line_fits(fx):
    rows = ev.sequence_rows(fx.readings, 4, fx.settings)
    both = ev.line_fit(rows, "clim").unionByName(ev.line_fit(rows, "lag_1"))
    return both.withColumns({c: half_even(F.col(c), 5) for c in ("const", "slope", "mae")})


_VARIANTS = {
    "climatology": ["clim"],
    "last reading": ["lag_1"],
    "lags": ["lag_1", "lag_2", "lag_3", "lag_4"],
    "lags + climatology": ["lag_1", "lag_2", "lag_3", "lag_4", "clim"],
}


def _normal_equations(variant: str, inputs: list[str]) -> str:
    """Sums of products, Gauss-Jordan elimination over them, and the error on test."""
    terms = ["1e0", *inputs]
    rows = ", ".join("[" + ", ".join(f"sum({a}*{b})" for b in [*terms, "level_mbgl"]) + "]" for a in terms)
    size, pred = len(terms), " + ".join(f"c[{i + 1}]*{t}" for i, t in enumerate(terms))
    names = ", ".join(f"'{t}'" for t in ["const", *inputs])
    return f"""
      SELECT '{variant}' AS variant, t.term, {r('c[t.i]', 3)} AS coefficient, n, {r('mae', 3)} AS mae FROM (
        WITH RECURSIVE e AS (
          SELECT 0 AS k, [{rows}] AS m FROM s WHERE split = 'train'
          UNION ALL
          SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
                 ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM e WHERE k < {size})
        SELECT any_value(c) AS c, count(*) AS n, avg(abs({pred} - level_mbgl)) AS mae
        FROM s, (SELECT list_transform(m, lambda row: row[{size + 1}]) AS c FROM e WHERE k = {size}) WHERE split = 'test') x,
        (SELECT unnest([{names}]) AS term, unnest(range(1, {size + 1})) AS i) t"""


@query("ML-3", f"WITH s AS ({_SEQ})" + " UNION ALL ".join(_normal_equations(v, xs) for v, xs in _VARIANTS.items()))
def autoregressions(fx):
    rows = ev.sequence_rows(fx.readings, 4, fx.settings)
    _, table = ev.autoregressions(rows, _VARIANTS)
    return table.withColumns({c: half_even(F.col(c), 3) for c in ("coefficient", "mae")})


_MODEL_INPUTS = ["last_obs_level", "clim"]


def _model_fit_sql() -> str:
    """Rows scored by a pooled regression of the target on the last reading and the climatology."""
    terms = ["1e0", *_MODEL_INPUTS]
    rows = ", ".join("[" + ", ".join(f"sum({a}*{b})" for b in [*terms, "target_level"]) + "]" for a in terms)
    size, pred = len(terms), " + ".join(f"c[{i + 1}]*{t}" for i, t in enumerate(terms))
    return f"""WITH s AS (SELECT * FROM (SELECT *, coalesce(clim_season, clim_well) AS clim FROM fx_causal)
                          WHERE target_level IS NOT NULL AND last_obs_level IS NOT NULL AND clim IS NOT NULL AND split IS NOT NULL),
      k AS (WITH RECURSIVE e AS (
              SELECT 0 AS k, [{rows}] AS m FROM s WHERE split = 'train'
              UNION ALL
              SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda x: x / row[k + 1])
                     ELSE list_transform(row, lambda x, j: x - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM e WHERE k < {size})
            SELECT list_transform(m, lambda row: row[{size + 1}]) AS c FROM e WHERE k = {size}),
      p AS (SELECT s.*, shallow, crisis, {r(pred, 4)} AS y_pred FROM s JOIN fx_reference USING (well_id), k),
      sm AS (SELECT split, horizon_d, 'model' AS forecaster, target_level AS y_true, y_pred, {level_score('target_level')} AS true_score, {level_score('y_pred')} AS pred_score FROM p)"""


def _model_scored(fx, split=None):
    """Scores of the pooled regression as a forecaster of its own, of all splits or one."""
    rows = fx.causal.withColumn("clim", F.coalesce("clim_season", "clim_well"))
    numbers = ["target_level", *_MODEL_INPUTS]
    whole = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) for c in numbers), F.col("split").isNotNull())
    fits, _ = ev.autoregressions(rows.where(whole), {"model": _MODEL_INPUTS}, "target_level")
    model = F.when(whole, half_even(ev.linear(fits["model"]), 4))
    asked = rows if split is None else rows.where(F.col("split") == split)
    scored = ev.forecaster_scores(asked, ev.reference_levels(fx.readings, fx.settings), model)
    return scored.where((F.col("forecaster") == "model") & F.col("y_pred").isNotNull() & F.col("split").isNotNull())


@query("ML-4 ML-3", f"{_model_fit_sql()}, bm AS (" + _errors_sql("SELECT * FROM sm", "split, forecaster") + ") SELECT * FROM bm")
def model_metrics(fx):
    return ev.error_metrics(_model_scored(fx), ["split", "forecaster"])


@query(
    "ML-4 AG-10",
    f"""{_model_fit_sql()} SELECT forecaster, horizon_d, count(*) AS n, {r('avg(e)', 3)} AS mae, {r('quantile_cont(e,0.5)', 3)} AS p50, {r('quantile_cont(e,0.8)', 3)} AS p80, {r('quantile_cont(e,0.95)', 3)} AS p95
        FROM (SELECT forecaster, horizon_d, abs(y_pred - y_true) AS e FROM sm WHERE split = 'test') GROUP BY 1, 2""",
)
def model_intervals(fx):
    return ev.absolute_error_quantiles(_model_scored(fx, "test"), ["forecaster", "horizon_d"])


@query(
    "ML-4 AG-12",
    f"""{_model_fit_sql()}, bb AS (SELECT *, CASE WHEN true_score > 70 THEN 2 WHEN true_score > 40 THEN 1 ELSE 0 END AS a, CASE WHEN pred_score > 70 THEN 2 WHEN pred_score > 40 THEN 1 ELSE 0 END AS p
          FROM sm WHERE split = 'test' AND pred_score IS NOT NULL AND true_score IS NOT NULL)
        SELECT forecaster, count(*) AS n, {r('count(*) FILTER (a = p)/count(*)', 4)} AS exact_band, {r('count(*) FILTER (abs(a-p) <= 1)/count(*)', 4)} AS within_one_band,
          {r('count(*) FILTER (a = 2 AND p = 2)/nullif(count(*) FILTER (a = 2),0)', 4)} AS act_now_recall, {r('count(*) FILTER (a = 2 AND p = 2)/nullif(count(*) FILTER (p = 2),0)', 4)} AS act_now_precision,
          count(*) FILTER (a = 2 AND p < 2) AS misses, count(*) FILTER (a < 2 AND p = 2) AS false_alarms FROM bb GROUP BY 1""",
)
def model_bands(fx):
    return ev.band_accuracy(_model_scored(fx, "test"), ["forecaster"], fx.settings)


def _matrix(fx):
    """Model inputs from stored features: the one copy of them that is counted, trained on and scored."""
    return ft.model_matrix(cut_lineage(fx.causal))


@query("ML-2 PR-13")
def residual_model_metrics(fx):
    """Boosted trees on the residual to climatology, scored on val and test."""
    model, ready = ev.train_residual_model(*_matrix(fx))
    pred = ev.predict_residual(model, ready).where(F.col("split").isin("val", "test"))
    return ev.error_metrics(pred, ["split"])


@query("ML-2")
def horizon_model_metrics(fx):
    """A model of its own per horizon, scored on val and test."""
    pred = ev.train_per_horizon(*_matrix(fx), HORIZONS).where(F.col("split").isin("val", "test"))
    return ev.error_metrics(pred, ["split"])


@query("ML-2")
def feature_gains(fx):
    """Share of the trees' gain per input."""
    matrix, names = _matrix(fx)
    model, _ = ev.train_residual_model(matrix, names)
    gains = ev.gain_importance(fx.spark, model, names)
    return gains.withColumn("gain_share", half_even(F.col("gain_share"), 6))


_BASES = {"level": "0e0", "delta_obs": "last_obs_level", "delta_clim": "coalesce(clim_season, clim_well)"}


@query(
    "ML-2",
    " UNION ALL ".join(
        f"""SELECT '{kind}' AS target, split, horizon_d, count(*) AS n_rows, count(target_level - {base}) AS n_fit,
              {r(f'avg(target_level - {base})', 6)} AS mean_residual, {r(f'avg(abs(target_level - {base}))', 6)} AS mean_abs_residual
            FROM fx_causal GROUP BY split, horizon_d"""
        for kind, base in _BASES.items()
    ),
)
def residual_targets(fx):
    """What each kind of target leaves to be learnt, and from how many rows."""
    out = ev.residual_summary(fx.causal, ["split", "horizon_d"])
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("mean_residual", "mean_abs_residual")})


# -------------------------------------------------------------------- quality
_CHECK_SQL = {
    "w": (
        "SELECT count(*) AS n, count(*) FILTER (NOT (lat BETWEEN 15.6 AND 22.1 AND lon BETWEEN 72.6 AND 80.9)) AS outside, count(*) FILTER (lower(taluka) = 'nation_1-machinery') AS focus, count(specific_yield) AS n_sy, count(*) FILTER (NOT specific_yield BETWEEN 0.001 AND 0.35) AS bad_sy FROM fx_registry",
        "wells",
        [("populated", "n", "n > 0"), ("inside_box", "outside", "outside = 0"), ("focus_area_has_wells", "focus", "focus > 0"), ("specific_yield_present", "n_sy", "n_sy > 0"), ("specific_yield_plausible", "bad_sy", "bad_sy = 0")],
    ),
    "o": (
        "SELECT count(*) AS n, count(*) FILTER (source = 'synthetic') AS synthetic, abs(max(obs_date) - DATE '{gw_end}') AS off_end, DATE '{scenario_date}' - max(obs_date) AS stale, count(*) FILTER (is_last_5y) AS recent, count(*) FILTER (NOT level_mbgl BETWEEN 0 AND 100) AS bad_level, (SELECT count(*) FROM (SELECT 1 FROM fx_obs GROUP BY well_id HAVING count(*) < 8)) AS few, (SELECT count(*) FROM fx_obs WHERE well_id NOT IN (SELECT well_id FROM fx_wells)) AS orphans FROM fx_obs",
        "readings",
        [("populated", "n", "n > 0"), ("no_synthetic_rows", "synthetic", "synthetic = 0"), ("end_matches_config", "off_end", "off_end <= 31"), ("scenario_not_far_past_data", "stale", "stale <= 400"), ("recency_flag_not_constant", "recent * 1e0 / n", "recent > 0 AND recent < n"), ("levels_plausible", "bad_level", "bad_level = 0"), ("eight_readings_per_well", "few", "few = 0"), ("no_orphan_readings", "orphans", "orphans = 0")],
    ),
    "d": (
        "SELECT count(*) AS n, count(*) FILTER (is_observed) AS n_real, count(*) FILTER (NOT confidence BETWEEN 0 AND 1) AS bad_conf, coalesce(avg(confidence) FILTER (is_observed) - avg(confidence) FILTER (NOT is_observed), 0) AS margin, max(step) AS gap FROM (SELECT *, date - lag(date) OVER (PARTITION BY well_id ORDER BY date) AS step FROM fx_daily)",
        "daily",
        [("populated", "n", "n > 0"), ("some_rows_observed", "n_real", "n_real > 0"), ("not_all_observed", "100e0 * n_real / n", "100e0 * n_real / n < 50"), ("confidence_in_unit_range", "bad_conf", "bad_conf = 0"), ("observed_rows_more_confident", "margin", "margin >= 0"), ("no_calendar_gaps", "gap", "coalesce(gap, 1) <= 1")],
    ),
    "m": (
        "SELECT count(*) AS n, count(*) FILTER (precip_mm IS NULL) AS nulls, (SELECT arg_max(mo, (p, -mo)) FROM (SELECT month(date) AS mo, avg(precip_mm) AS p FROM fx_weather GROUP BY 1)) AS peak, (SELECT quantile_cont(mm, 0.5) FROM (SELECT cell_id, year(date) AS y, sum(precip_mm) AS mm, max(lo) AS lo, max(hi) AS hi FROM (SELECT *, min(date) OVER (PARTITION BY cell_id) AS lo, max(date) OVER (PARTITION BY cell_id) AS hi FROM fx_weather) GROUP BY 1, 2) WHERE make_date(y, 1, 1) >= lo AND make_date(y, 12, 31) <= hi) AS median, (SELECT count(*) FROM fx_daily d LEFT JOIN fx_cells c USING (well_id) WHERE NOT EXISTS (SELECT 1 FROM fx_weather x WHERE x.cell_id = c.cell_id AND x.date = d.date)) AS bare FROM fx_weather",
        "weather",
        [("populated", "n", "n > 0"), ("no_null_rain", "nulls", "nulls = 0"), ("peak_in_monsoon", "peak", "peak BETWEEN 6 AND 9"), ("annual_rain_plausible", "median", "median BETWEEN 400 AND 3000"), ("every_well_day_has_weather", "bare", "bare = 0")],
    ),
    "v": (
        "SELECT count(*) AS n, count(*) FILTER (source IS NULL) AS no_source, count(*) FILTER (date = DATE '{scenario_date}') AS on_day FROM fx_reservoir",
        "reservoir_daily",
        [("populated", "n", "n > 0"), ("provenance_on_every_row", "no_source", "no_source = 0"), ("scenario_day_present", "on_day", "on_day > 0")],
    ),
    "f": (
        "SELECT count(*) AS n, "
        + ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in dq.REQUIRED_FEATURES)
        + f", count(*) FILTER (split = 'test' AND month(date) IN (3, 4, 5) AND is_observed) AS season_match, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, (SELECT count(*) FROM (SELECT 1 FROM ff GROUP BY entity_id, date HAVING count(*) > 1)) AS dupes, (SELECT count(*) FROM (SELECT lo <= lag(hi) OVER (ORDER BY array_position(['train', 'val', 'test'], split)) AS bad FROM (SELECT split, min(date) AS lo, max(date) AS hi FROM ff GROUP BY 1)) WHERE bad) AS overlap FROM ff",
        "features",
        [("populated", "n", "n > 0"), *((f"no_nulls_{c}", f"null_{c}", f"null_{c} = 0") for c in dq.REQUIRED_FEATURES), ("test_has_real_pre_monsoon", "season_match", "season_match > 0"), ("val_and_test_not_empty", "least(n_val, n_test)", "n_val > 0 AND n_test > 0"), ("test_not_large", "n_test * 1e0 / n_train", "n_test * 1e0 / n_train <= 0.6"), ("no_duplicate_keys", "dupes", "dupes = 0"), ("splits_chronological", "overlap", "overlap = 0")],
    ),
}
_WARNS = {"specific_yield_present", "scenario_not_far_past_data", "test_not_large"}


def _all_checks_sql() -> str:
    sources = ", ".join(f"{k} AS ({text.format(gw_end=SETTINGS.gw_end, scenario_date=SETTINGS.scenario_date)})" for k, (text, _, _) in _CHECK_SQL.items())
    rows = [
        f"SELECT '{table}' AS table_name, '{name}' AS check_name, CASE WHEN {ok} THEN 'PASS' ELSE '{'WARN' if name in _WARNS or (table, name) == ('reservoir_daily', 'populated') else 'FAIL'}' END AS status, {r(f'CAST({value} AS DOUBLE)', 6)} AS measured FROM {k}"
        for k, (_, table, checks) in _CHECK_SQL.items()
        for name, value, ok in checks
    ]
    return f"WITH ff AS ({ts.RURAL_FEATURES}), {sources} " + " UNION ALL ".join(rows)


def _tables(fx) -> dict:
    """The tables under check. Weather is read by several checks and stored; daily rows
    are made for each of theirs, from readings, as arrays of their series."""
    fx.weather = cut_lineage(fx.weather)
    return {
        "wells": fx.wells, "readings": fx.readings, "daily": fx.daily_series, "daily_by_cell": fx.daily_series_by_cell, "weather": fx.weather,
        "cells": fx.cells, "reservoir_daily": fx.reservoir_daily, "features": ts.rural_features(fx),
    }


@query("DQ-1", _all_checks_sql())
def quality_checks(fx):
    checks = dq.run_checks(_tables(fx), "NATION_1-MACHINERY", fx.settings)
    return checks.withColumn("measured", half_even(F.col("measured"), 6))


@query(
    "DQ-1",
    f"""WITH f AS ({ts.RURAL_FEATURES}), c AS (
      SELECT 'readings' AS table_name, 'eight_readings_per_well' AS check_name, (SELECT count(*) FROM (SELECT 1 FROM fx_obs GROUP BY well_id HAVING count(*) < 8)) AS bad
      UNION ALL SELECT 'readings', 'no_orphan_readings', (SELECT count(*) FROM fx_obs WHERE well_id NOT IN (SELECT well_id FROM fx_wells))
      UNION ALL SELECT 'readings', 'levels_plausible', (SELECT count(*) FROM fx_obs WHERE NOT level_mbgl BETWEEN 0 AND 100)
      UNION ALL SELECT 'daily', 'confidence_in_unit_range', (SELECT count(*) FROM fx_daily WHERE NOT confidence BETWEEN 0 AND 1)
      UNION ALL SELECT 'weather', 'no_null_rain', (SELECT count(*) FROM fx_weather WHERE precip_mm IS NULL)
      UNION ALL SELECT 'features', 'no_nulls_precip_mm', (SELECT count(*) FROM f WHERE precip_mm IS NULL)
      UNION ALL SELECT 'features', 'no_duplicate_keys', (SELECT count(*) FROM (SELECT 1 FROM f GROUP BY entity_id, date HAVING count(*) > 1)))
    SELECT table_name, check_name, CASE WHEN bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(bad AS DOUBLE) AS measured FROM c""",
)
def zero_count_checks(fx):
    """The checks that count offending rows, built alone, next to the same counts in SQL."""
    names = (
        "eight_readings_per_well", "no_orphan_readings", "levels_plausible", "confidence_in_unit_range", "no_null_rain",
        "no_nulls_precip_mm", "no_duplicate_keys",
    )
    return dq.run_checks(_tables(fx), "NATION_1-MACHINERY", fx.settings, names)


@query(
    "DQ-1",
    """WITH r AS (SELECT well_id, CASE WHEN day(obs_date) = 1 THEN level_mbgl + 1000 ELSE level_mbgl END AS level_mbgl FROM fx_obs),
       c AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM r GROUP BY well_id HAVING count(*) < 8)) AS bad
         UNION ALL SELECT (SELECT count(*) FROM r WHERE well_id NOT IN (SELECT well_id FROM fx_wells))
         UNION ALL SELECT (SELECT count(*) FROM r WHERE NOT level_mbgl BETWEEN 0 AND 100))
       SELECT count(*) FILTER (bad = 0) AS passed, 0 AS warnings, count(*) FILTER (bad > 0) AS failed, CASE WHEN count(*) FILTER (bad > 0) > 0 THEN 1 ELSE 0 END AS exit_status FROM c""",
)
def gate_status(fx):
    """The gate over three counting checks of readings with planted impossible levels."""
    level = F.when(F.dayofmonth("obs_date") == 1, F.col("level_mbgl") + 1000).otherwise(F.col("level_mbgl"))
    tables = {"readings": fx.readings.withColumn("level_mbgl", level), "wells": fx.base_wells}
    return dq.exit_status(dq.run_checks(tables, "", fx.settings, ("eight_readings_per_well", "no_orphan_readings", "levels_plausible")))


# -------------------------------------------------------------------- streams
@query("ST-1", _CR1)
def streamed_reports(fx):
    """Reports read as a stream; verdicts are those of the batch query."""
    source = fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.dir}/events*.parquet")
    reports = source.select(
        F.concat(F.lit("rep"), F.col("event_id")).alias("report_id"), F.col("ts").cast("timestamp").alias("created_at"),
        F.concat(F.lit("W"), F.col("user_id")).alias("well_id"), (F.col("value") / F.lit(10.0)).alias("level_mbgl"),
        F.col("ts").cast("date").alias("reported_for"),
    )
    out = fx.fresh_dir("reports")
    sr.write_reports(
        reports, fx.readings, fx.base_wells, f"{out}/table", f"{out}/checkpoint", fx.settings, buckets=16
    ).awaitTermination()
    return fx.spark.read.parquet(f"{out}/table").select("report_id", *rp.VERDICT_COLUMNS).withColumns(
        {c: half_even(F.col(c), 5) for c in ("prior_mean", "prior_sd", "z_score", "post_mean", "post_sd")}
    )


_INTENTS_SQL = """
WITH RECURSIVE raw AS (
  SELECT conv_id * 1000 + turn AS message_id, '+91' || conv_id AS phone, turn, CASE (conv_id + turn) % 10
    WHEN 0 THEN 'BOOK' WHEN 1 THEN CAST((conv_id + turn) % 3 + 1 AS VARCHAR) WHEN 2 THEN 'depth: 17,4 m' WHEN 3 THEN 'help'
    WHEN 4 THEN 'near Customer#' || lpad(CAST(conv_id % 40 + 1 AS VARCHAR), 9, '0') WHEN 5 THEN 'Score'
    WHEN 6 THEN 'note ' || coalesce(length(text), 0) WHEN 7 THEN (turn + 2) || '.5' WHEN 8 THEN 'France Building' ELSE 'xyz ' || role END AS body
  FROM conversations),
g AS (SELECT DISTINCT 'taluka' AS et, taluka AS ei, trim(regexp_replace(lower(taluka), '[^a-z0-9]+', ' ', 'g')) AS key, district FROM fx_wells
      UNION ALL SELECT 'well', well_id, trim(regexp_replace(lower(village), '[^a-z0-9]+', ' ', 'g')), district FROM fx_wells),
b AS (SELECT DISTINCT body, trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')) AS key FROM raw),
hit AS (SELECT body, any_value(et) AS et, any_value(ei) AS ei FROM b JOIN g ON contains(b.key, g.key) OR contains(g.key, b.key) GROUP BY body HAVING count(*) = 1),
best AS (SELECT taluka, arg_min(well_id, (-n, well_id)) AS well FROM (SELECT taluka, w.well_id, count(o.obs_date) AS n FROM fx_wells w LEFT JOIN fx_obs o USING (well_id) GROUP BY 1, 2) GROUP BY 1),
c AS (
  SELECT message_id, phone, row_number() OVER (PARTITION BY phone ORDER BY turn, message_id) AS rn, upper(body) AS up, length(body) AS len,
         CASE WHEN et = 'well' THEN ei ELSE best.well END AS place, u.well_id AS user_well, u.entity_id AS user_entity,
         CAST(replace(nullif(regexp_extract(body, '^(?:depth: )?([0-9]+(?:[.,][0-9]+)?)(?: m)?$', 1), ''), ',', '.') AS DOUBLE) AS depth
  FROM raw LEFT JOIN hit USING (body) LEFT JOIN best ON hit.et = 'taluka' AND best.taluka = hit.ei
  LEFT JOIN (SELECT '+91' || user_no AS phone, well_id, entity_id FROM fx_users WHERE user_no % 3 = 0 AND entity_id IS NOT NULL) u USING (phone)),
walk AS (
  SELECT phone, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS message_id, 'idle' AS step, CAST(NULL AS VARCHAR) AS well, CAST(NULL AS VARCHAR) AS action,
         CAST(NULL AS DOUBLE) AS depth, CAST(NULL AS VARCHAR) AS up FROM (SELECT DISTINCT phone FROM c)
  UNION ALL
  SELECT phone, rn, message_id,
         CASE WHEN action = 'book' THEN 'choosing' WHEN action IN ('booked', 'report') THEN 'idle' WHEN action = 'ask_depth' THEN 'measuring'
              WHEN action = 'retry_place' OR (action = 'ask_place' AND up <> 'SCORE') THEN 'placing'
              WHEN step = 'choosing' AND action = 'help' AND up NOT IN ('HELP', 'MENU', '?') THEN 'idle' ELSE step END,
         CASE WHEN action = 'report' THEN known WHEN action = 'ask_depth' THEN place ELSE well END, action, depth, up
  FROM (SELECT w.step, w.well, c.*, coalesce(w.well, c.user_well) AS known,
          CASE WHEN up IN ('HELP', 'MENU', '?') THEN 'help' WHEN up = 'STOP' THEN 'stop' WHEN up = 'BOOK' THEN 'book'
               WHEN up = 'SCORE' THEN CASE WHEN user_entity IS NOT NULL OR well IS NOT NULL THEN 'score' ELSE 'ask_place' END
               WHEN step = 'choosing' AND up IN ('1', '2', '3') THEN 'booked'
               WHEN step = 'placing' AND depth IS NULL THEN CASE WHEN place IS NULL THEN 'retry_place' ELSE 'ask_depth' END
               WHEN depth IS NOT NULL THEN CASE WHEN coalesce(well, user_well) IS NULL THEN 'ask_place' ELSE 'report' END
               WHEN coalesce(well, user_well) IS NOT NULL THEN 'help'
               WHEN place IS NOT NULL AND len >= 3 THEN 'ask_depth' ELSE 'ask_place' END AS action
        FROM (SELECT phone, rn AS last, step, well FROM walk) w JOIN c USING (phone) WHERE c.rn = w.last + 1))
SELECT message_id, phone, action, CASE WHEN action IN ('report', 'ask_depth', 'score') THEN well END AS well_id,
       CASE WHEN action = 'report' THEN depth END AS level_mbgl, CASE WHEN action = 'booked' THEN up END AS workshop FROM walk WHERE rn > 0"""


@query("ST-2", _INTENTS_SQL)
def streamed_intents(fx):
    """Conversation turns as messages of a phone; place, depth and menu texts by their number."""
    source = fx.spark.readStream.schema(fx.table("conversations").schema).parquet(f"{fx.dir}/conversations*.parquet")
    k = F.col("conv_id") + F.col("turn")
    texts = [
        F.lit("BOOK"), (k % 3 + 1).cast("string"), F.lit("depth: 17,4 m"), F.lit("help"),
        F.concat(F.lit("near Customer#"), F.lpad((F.col("conv_id") % 40 + 1).cast("string"), 9, "0")), F.lit("Score"),
        F.concat(F.lit("note "), F.coalesce(F.length("text"), F.lit(0))), F.concat(F.col("turn") + 2, F.lit(".5")),
        F.lit("France Building"), F.concat(F.lit("xyz "), F.col("role")),
    ]
    messages = source.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), F.concat(F.lit("+91"), F.col("conv_id")).alias("phone"),
        F.element_at(F.array(*texts), (k % 10 + 1).cast("int")).alias("body"), F.timestamp_seconds(F.col("turn")).alias("sent_at"),
    )
    registered = fx.users.where((F.col("user_no") % 3 == 0) & F.col("entity_id").isNotNull())
    users = registered.select(F.concat(F.lit("+91"), F.col("user_no")).alias("phone"), "well_id", "entity_id")
    out = fx.fresh_dir("intents")
    ms.write_packets(
        messages, users, fx.wells, pl.gazetteer(fx.base_wells), f"{out}/packets", f"{out}/checkpoint-in"
    ).awaitTermination()
    intents = ms.converse(ms.read_packets(fx.spark, f"{out}/packets"))
    ms.write_intents(intents, f"{out}/table", f"{out}/checkpoint-out").awaitTermination()
    return fx.spark.read.schema(ms.INTENTS).parquet(f"{out}/table").drop("sent_at")
