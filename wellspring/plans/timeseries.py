"""Queries: dense series, windows, features and as-of joins.

Daily tables hold one row per well and day. Their queries run over all of it
and return per-well-and-year aggregates of every column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wellspring.functions import calendar as cal
from wellspring.functions.numeric import half_even
from wellspring.operators import days as dy
from wellspring.operators import features as ft
from wellspring.operators import ordering as order
from wellspring.operators import series as ser
from wellspring.operators import weather as wx
from wellspring.operators.evaluate import reconstruction_error
from wellspring.plans.fixtures import HORIZONS
from wellspring.plans.registry import query
from wellspring.plans.sql_views import r


def _years_of(b: dy.Block, columns: list[str]) -> dy.Answer:
    """Count and sum of each column by the years of each series of a block."""
    begins, of = b.runs(b["year"])
    rows = np.add.reduceat(b.kept, begins, dtype=np.int64)
    some = rows > 0
    out = {"key": of[some], "year": b["year"][begins[some]], "n_rows": rows[some]}
    for c in columns:
        x = b[c]
        held, n = b.kept, rows
        if (gone := held & (x != x)).any():
            held, n = held & ~gone, rows - np.add.reduceat(gone, begins, dtype=np.int64)
        total = np.add.reduceat(np.where(held, x, 0), begins).astype(float)
        total[n == 0] = np.nan
        out |= {f"n_{c}": n[some], f"sum_{c}": total[some]}
    return out


def yearly(df, key: str, date: str, columns: list[str]):
    """Count and sum of each column per key and year."""
    if isinstance(df, dy.Days):
        schema = "key string, year long, n_rows long, " + ", ".join(f"n_{c} long, sum_{c} double" for c in columns)
        parts = df.partial(lambda b: _years_of(b, columns), schema)
        sums = [F.sum("n_rows").alias("n_rows")]
        for c in columns:
            nudge, places = precision(c)
            sums += [F.sum(f"n_{c}").alias(f"n_{c}"), half_even(F.sum(f"sum_{c}") + nudge, places).alias(f"sum_{c}")]
        return parts.groupBy(F.col("key").alias(key), "year").agg(*sums)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        nudge, places = precision(c)
        aggs += [F.count(c).alias(f"n_{c}"), half_even(F.sum(c) + nudge, places).alias(f"sum_{c}")]
    return df.groupBy(key, F.year(date).cast("long").alias("year")).agg(*aggs)


def precision(column: str) -> tuple[float, int]:
    """Sums are compared at 4 decimals. Levels are themselves rounded to 4, where
    the last bit of a mean can turn one of them over, so their sums are compared
    at 1 decimal and kept off exact ties."""
    return (0.00003, 1) if "level" in column else (0.0, 4)


def yearly_sql(source: str, key: str, date: str, columns: list[str]) -> str:
    def total(c: str) -> str:
        nudge, places = precision(c)
        return r(f"sum(CAST({c} AS DOUBLE)) + {nudge:.5f}", places)

    aggs = ", ".join(f"count({c}) AS n_{c}, {total(c)} AS sum_{c}" for c in columns)
    return f"SELECT {key}, year({date}) AS year, count(*) AS n_rows, {aggs} FROM {source} GROUP BY 1, 2"


# ------------------------------------------------------------ reconstruction
@query("WN-1", yearly_sql("fx_weather", "cell_id", "date", ["precip_mm", "et0_mm"]))
def dense_calendar(fx):
    return yearly(fx.weather, "cell_id", "date", ["precip_mm", "et0_mm"])


_LINEAR = """SELECT well_id, CAST(obs_date + CAST(i AS INTEGER) AS DATE) AS date, v + coalesce((nv-v)/gap,0)*i AS level_mbgl,
                CASE WHEN i = 0 THEN 1 ELSE 0 END AS is_observed, least(i, coalesce(gap-i,i)) AS days_from_reading
         FROM (SELECT *, unnest(generate_series(0, coalesce(gap-1,0))) AS i FROM
            (SELECT well_id, obs_date, level_mbgl v, lead(level_mbgl) OVER w nv, lead(obs_date) OVER w - obs_date AS gap FROM fx_obs WINDOW w AS (PARTITION BY well_id ORDER BY obs_date)))"""


@query("WN-9 WN-10", yearly_sql(f"({_LINEAR})", "well_id", "date", ["level_mbgl", "is_observed", "days_from_reading"]))
def linear_interpolation(fx):
    d = ser.interpolate_linear(fx.readings, "well_id", "obs_date", "level_mbgl").withColumnRenamed("obs_date", "date")
    return yearly(d.withColumn("is_observed", F.col("is_observed").cast("int")), "well_id", "date", ["level_mbgl", "is_observed", "days_from_reading"])


@query(
    "SR-2 SC-9",
    yearly_sql("(SELECT *, CAST(is_observed AS INTEGER) AS obs FROM fx_daily)", "well_id", "date", ["level_mbgl", "obs", "confidence"]),
)
def reconstructed_daily(fx):
    d = fx.daily.withColumn("obs", F.col("is_observed").cast("int"))
    return yearly(d, "well_id", "date", ["level_mbgl", "obs", "confidence"])


@query(
    "SR-3 WN-15",
    f"""WITH marked AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY well_id ORDER BY obs_date) AS rn, count(*) OVER (PARTITION BY well_id) AS n FROM fx_obs o)
                   WHERE n >= 8 AND n - n//4 >= 4),
        kept AS (SELECT * FROM marked WHERE rn % 4 <> 0),
        knots AS (SELECT well_id, CASE m WHEN 1 THEN 15 WHEN 2 THEN 46 WHEN 3 THEN 74 WHEN 4 THEN 105 WHEN 5 THEN 135 WHEN 6 THEN 166
               WHEN 7 THEN 196 WHEN 8 THEN 227 WHEN 9 THEN 258 WHEN 10 THEN 288 WHEN 11 THEN 319 ELSE 349 END AS d, v
               FROM (SELECT well_id, month(obs_date) m, avg(level_mbgl) v FROM kept GROUP BY 1,2)),
        ring AS (SELECT well_id, d, v, lead(d) OVER w nd, lead(v) OVER w nv FROM (SELECT * FROM knots UNION ALL SELECT well_id, max(d)-366, max_by(v,d) FROM knots GROUP BY 1
               UNION ALL SELECT well_id, min(d)+366, min_by(v,d) FROM knots GROUP BY 1) WINDOW w AS (PARTITION BY well_id ORDER BY d)),
        cl AS (SELECT m.*, v + coalesce((nv-v)/nullif(nd-d,0),0)*(dayofyear(obs_date)-d) AS clim FROM marked m JOIN ring g ON g.well_id = m.well_id AND dayofyear(obs_date) >= d AND dayofyear(obs_date) < nd),
        kk AS (SELECT well_id, obs_date, level_mbgl - clim AS an FROM cl WHERE rn % 4 <> 0),
        h AS (SELECT c.well_id, c.obs_date, c.level_mbgl, c.clim, a.obs_date ad, a.an aan, b.obs_date bd, b.an ban
              FROM (SELECT * FROM cl WHERE rn % 4 = 0) c ASOF JOIN kk a ON a.well_id = c.well_id AND c.obs_date > a.obs_date
              ASOF JOIN kk b ON b.well_id = c.well_id AND c.obs_date < b.obs_date),
        e AS (SELECT round_even(greatest(0.05e0, CASE WHEN well_depth > 0.05 THEN least(well_depth, lv) ELSE lv END)*1e4,0)/1e4 - level_mbgl AS err
              FROM (SELECT h.*, clim + aan + (ban-aan)/(bd-ad)*(obs_date-ad) AS lv FROM h) JOIN fx_wells USING (well_id))
        SELECT 'all' AS scope, count(*) AS n, {r('avg(abs(err))',6)} AS mae, {r('sqrt(avg(err*err))',6)} AS rmse, {r('avg(err)',6)} AS bias, {r('quantile_cont(abs(err),0.9)',6)} AS p90 FROM e""",
)
def reconstruction_holdout(fx):
    out = reconstruction_error(ser.holdout_errors(fx.readings, fx.wells, fx.settings))
    return out.withColumns({c: half_even(F.col(c), 6) for c in ("mae", "rmse", "bias", "p90")})


@query("SR-7 WN-9", "SELECT * FROM fx_reservoir")
def interpolated_anchors(fx):
    return fx.reservoir_daily


# ------------------------------------------------------------------- weather
_WX = ["rain_7d", "rain_30d", "rain_90d", "et0_30d", "rain_cum", "et0_cum", "days_since_last_rain", "cum_monsoon_rainfall"]


@query("WN-4 WN-6 WN-7 WN-8", yearly_sql("fx_weather_features", "cell_id", "date", _WX))
def weather_features(fx):
    return yearly(wx.weather_features(fx.weather, fx.settings), "cell_id", "date", _WX)


@query(
    "AG-7",
    f"SELECT month(date) AS month, {r('avg(precip_mm)',6)} AS mean_precip, count(precip_mm) AS n_days FROM fx_weather GROUP BY 1",
)
def monthly_rain(fx):
    return wx.monthly_rain(fx.weather).select(
        F.col("month").cast("long").alias("month"), half_even(F.col("mean_precip"), 6).alias("mean_precip"), "n_days"
    )


@query(
    "AG-7",
    """SELECT (SELECT max_by(m, (v, -m)) FROM (SELECT month(date) m, avg(precip_mm) v FROM fx_weather GROUP BY 1)) AS peak_month,
              (SELECT quantile_cont(mm, 0.5) FROM (SELECT sum(precip_mm) mm FROM fx_weather GROUP BY cell_id, year(date))) AS median_annual_mm""",
)
def rain_peak_and_median(fx):
    annual = wx.annual_rain(fx.weather).where(F.col("annual_mm").isNotNull()).withColumn("_all", F.lit(1))
    median = order.exact_quantiles(annual, ["_all"], "annual_mm", {"median_annual_mm": 0.5})
    peak = wx.peak_month(fx.weather).withColumn("_all", F.lit(1))
    return peak.join(median, "_all").select(F.col("peak_month").cast("long").alias("peak_month"), "median_annual_mm")


# ------------------------------------------------------------------ features
_JN1 = ["level", "precip_mm", "et0_mm", "temp_max", "confidence"]


@query(
    "JN-1",
    yearly_sql(
        "(SELECT d.well_id AS entity_id, d.date, level_mbgl AS level, confidence, precip_mm, et0_mm, temp_max FROM fx_daily d LEFT JOIN fx_cells c ON c.well_id = d.well_id LEFT JOIN fx_weather w ON w.cell_id = c.cell_id AND w.date = d.date)",
        "entity_id", "date", _JN1,
    ),
)
def daily_levels_with_weather(fx):
    return yearly(ft.with_weather(ft.rural_levels(fx.daily_by_cell), fx.weather, fx.cells), "entity_id", "date", _JN1)


_FT1 = [
    "level", "level_lag_7", "level_lag_15", "level_lag_30", "level_lag_60", "level_lag_90", "rain_7d", "rain_30d", "rain_90d",
    "et0_30d", "days_since_last_rain", "cum_monsoon_rainfall", "level_change_7d", "level_change_30d", "target_level_t30", "doy",
]


def _ft1_sql(levels: str, split_sql: str) -> str:
    lags = ", ".join(f"lag(level,{n}) OVER w AS level_lag_{n}" for n in (7, 15, 30, 60, 90))
    rolls = ", ".join(
        f"CASE WHEN count({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {m} THEN sum({c}) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {name}"
        for c, n, m, name in (("precip_mm", 7, 3, "rain_7d"), ("precip_mm", 30, 15, "rain_30d"), ("precip_mm", 90, 45, "rain_90d"), ("et0_mm", 30, 15, "et0_30d"))
    )
    return f"""SELECT * FROM (SELECT *, {split_sql} AS split, {lags}, {rolls}, CAST(dayofyear(date) AS INTEGER) AS doy,
        date - max(CASE WHEN precip_mm >= 2.5 THEN date END) OVER w AS days_since_last_rain,
        sum(coalesce(precip_mm,0)) OVER (PARTITION BY entity_id, year(date) - CASE WHEN month(date) < 6 THEN 1 ELSE 0 END ORDER BY date) AS cum_monsoon_rainfall,
        level - lag(level,7) OVER w AS level_change_7d, level - lag(level,30) OVER w AS level_change_30d, lead(level,30) OVER w AS target_level_t30
      FROM ({levels}) WINDOW w AS (PARTITION BY entity_id ORDER BY date))
      WHERE split IS NOT NULL AND target_level_t30 IS NOT NULL AND level_lag_30 IS NOT NULL AND rain_30d IS NOT NULL"""


_RURAL_LEVELS = """SELECT d.well_id AS entity_id, d.date, level_mbgl AS level, d.is_observed, precip_mm, et0_mm FROM fx_daily d
    LEFT JOIN fx_cells c ON c.well_id = d.well_id LEFT JOIN fx_weather w ON w.cell_id = c.cell_id AND w.date = d.date"""
_URBAN_LEVELS = """SELECT r.reservoir_id AS entity_id, r.date, live_storage_pct AS level, r.source <> 'interpolated' AS is_observed, precip_mm, et0_mm FROM fx_reservoir r
    LEFT JOIN fx_weather w ON w.cell_id = '1' AND w.date = r.date"""
RURAL_FEATURES = _ft1_sql(
    _RURAL_LEVELS,
    "CASE WHEN date <= DATE '1999-06-30' THEN 'train' WHEN date <= DATE '2000-06-30' THEN 'val' WHEN date <= DATE '2001-08-31' THEN 'test' END",
)
URBAN_FEATURES = _ft1_sql(_URBAN_LEVELS, "'test'")


def rural_features(fx):
    """Daily features as arrays of their series."""
    return ft.daily_features(ft.rural_levels(fx.daily_series_by_cell), fx.weather, fx.cells, "rural", fx.settings)


def urban_features(fx):
    cells = fx.systems.select(F.col("reservoir_id").alias("well_id"), F.lit("1").alias("cell_id"))
    return ft.daily_features(ft.urban_levels(fx.reservoir_daily), fx.weather, cells, "urban", fx.settings)


@query("FT-1 WN-2 WN-3 WN-5 WN-6 WN-7", yearly_sql(f"({RURAL_FEATURES})", "entity_id", "date", _FT1))
def daily_features_rural(fx):
    return yearly(rural_features(fx), "entity_id", "date", _FT1)


@query("FT-1 JN-1", yearly_sql(f"({URBAN_FEATURES})", "entity_id", "date", _FT1))
def daily_features_urban(fx):
    return yearly(urban_features(fx), "entity_id", "date", _FT1)


@query(
    "AG-11",
    f"""SELECT entity_type, {r('corr(level, target_level_t30)',5)} AS corr_level, {r('corr(level_lag_30, target_level_t30)',5)} AS corr_lag_30 FROM
        (SELECT 'well' AS entity_type, level, level_lag_30, target_level_t30 FROM ({RURAL_FEATURES})
         UNION ALL SELECT 'reservoir', level, level_lag_30, target_level_t30 FROM ({URBAN_FEATURES})) GROUP BY 1""",
)
def target_correlation(fx):
    from wellspring.operators.evaluate import target_correlation as corr

    return corr(rural_features(fx), urban_features(fx)).withColumns({c: half_even(F.col(c), 5) for c in ("corr_level", "corr_lag_30")})


# -------------------------------------------------------------- point in time
@query(
    "JN-2 JN-3 WN-13",
    f"""SELECT e.event_id, h.last_obs_date, h.last_obs_level, h.prev_obs_level, CAST(h.last_obs_date - h.prev_obs_date AS INTEGER) AS prev_gap,
          {r('(h.last_obs_level - h.prev_obs_level)/nullif(h.last_obs_date - h.prev_obs_date, 0)',6)} AS slope
        FROM (SELECT event_id, 'W'||user_id AS well_id, CAST(CAST(ts AS DATE) - 9000 + CAST(event_id % 2500 AS INTEGER) AS DATE) AS at FROM events) e
        ASOF LEFT JOIN (SELECT well_id, obs_date AS last_obs_date, level_mbgl AS last_obs_level, lag(level_mbgl) OVER w AS prev_obs_level, lag(obs_date) OVER w AS prev_obs_date
                        FROM fx_obs WINDOW w AS (PARTITION BY well_id ORDER BY obs_date)) h ON h.well_id = e.well_id AND e.at >= h.last_obs_date""",
)
def asof_last_reading(fx):
    """The last reading at or before a day, for every event spread over the history."""
    e = fx.table("events", "event_id", "user_id", "ts").select(
        "event_id",
        F.concat(F.lit("W"), F.col("user_id")).alias("well_id"),
        F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 2500 - 9000).cast("int")).alias("at"),
    )
    hit = order.asof_backward(
        e, ft.reading_history(fx.readings), "well_id", "at", "last_obs_date", ["last_obs_level", "prev_obs_level", "prev_obs_date"]
    )
    gap = F.date_diff("last_obs_date", "prev_obs_date")
    slope = (F.col("last_obs_level") - F.col("prev_obs_level")) / F.nullif(gap, F.lit(0))
    return hit.select(
        "event_id", "last_obs_date", "last_obs_level", "prev_obs_level", gap.alias("prev_gap"), half_even(slope, 6).alias("slope")
    )


_CAUSAL = {
    "keys": ["well_id", "origin_date", "target_date", "horizon_d", "split", "season"],
    "exact": ["days_since_obs", "prev_obs_gap_d", "month", "doy", "days_since_last_rain", "last_obs_level", "prev_obs_level", "target_level",
              "specific_yield", "well_depth", "lat", "lon", "rain_7d", "rain_30d", "rain_90d", "rain_since_obs", "cum_monsoon_rainfall"],
    "rounded": ["obs_trend_m_per_day", "last_obs_anomaly", "et0_since_obs", "et0_30d", "temp_max", "clim_season", "clim_well"],
}


@query(
    "FT-2 JN-4 JN-5 AG-6",
    "SELECT " + ", ".join(_CAUSAL["keys"] + _CAUSAL["exact"]) + ", "
    + ", ".join(f"{r(c, 5)} AS {c}" for c in _CAUSAL["rounded"]) + " FROM fx_causal",
)
def causal_features(fx):
    f = fx.causal
    return f.select(*_CAUSAL["keys"], *_CAUSAL["exact"], *[half_even(F.col(c), 5).alias(c) for c in _CAUSAL["rounded"]])


# Some rows of the first three days of a month made wrong: origin on the target, origin a day early, label far off.
_LEAKY = """SELECT well_id, split, horizon_d,
       CAST(CASE day(target_date) WHEN 1 THEN target_date WHEN 2 THEN origin_date - 1 ELSE origin_date END AS DATE) AS origin_date,
       CAST(CASE WHEN day(target_date) = 3 THEN target_date + 36525 ELSE target_date END AS DATE) AS target_date FROM fx_causal"""


def _ranges_sql(source: str) -> str:
    return f"""SELECT split, n, first_date, last_date, coalesce(first_date <= lag(last_date) OVER (ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END), false) AS overlaps
       FROM (SELECT split, count(*) AS n, min(target_date) AS first_date, max(target_date) AS last_date FROM ({source}) GROUP BY 1)"""


def _audit_sql(source: str) -> str:
    return f"""WITH b AS ({source}) SELECT 'origin_not_before_target' AS check_name, count(*) AS n_bad FROM b WHERE origin_date >= target_date
       UNION ALL SELECT 'horizon_mismatch', count(*) FROM b WHERE CAST(target_date - horizon_d AS DATE) <> origin_date
       UNION ALL SELECT 'label_not_a_reading', count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM fx_obs o WHERE o.well_id = b.well_id AND o.obs_date = b.target_date)
       UNION ALL SELECT 'split_overlap', count(*) FROM ({_ranges_sql(source)}) q WHERE q."overlaps" """


def _leaky(fx):
    day, far = F.dayofmonth("target_date"), F.date_add("target_date", 36525)
    origin = F.when(day == 1, F.col("target_date")).when(day == 2, F.date_sub("origin_date", 1)).otherwise(F.col("origin_date"))
    return fx.causal.withColumns({"origin_date": origin, "target_date": F.when(day == 3, far).otherwise(F.col("target_date"))})


@query("FT-3", _audit_sql("SELECT * FROM fx_causal"))
def leakage_audit(fx):
    return ft.leakage_audit(fx.causal, fx.readings)


@query("FT-3", _audit_sql(_LEAKY))
def leakage_found(fx):
    """The audit over features with planted leaks."""
    return ft.leakage_audit(_leaky(fx), fx.readings)


@query("AG-19", _ranges_sql("SELECT * FROM fx_causal"))
def split_ranges(fx):
    return ft.split_ranges(fx.causal, "target_date")


@query("AG-19", _ranges_sql(_LEAKY))
def overlapping_splits(fx):
    """Split ranges over features whose training labels reach past the others."""
    return ft.split_ranges(_leaky(fx), "target_date")


def _served(fx):
    points = fx.causal.select("well_id", "origin_date", "horizon_d")
    kept = ft.qualified_readings(fx.readings, 8, fx.settings)
    return ft.features_as_of(points, kept, fx.weather, fx.cells, fx.wells, fx.settings)


@query(
    "FT-4",
    f"""SELECT well_id, origin_date, horizon_d, last_obs_level, days_since_obs, rain_30d, {r('last_obs_anomaly',5)} AS last_obs_anomaly, {r('clim_season',5)} AS clim_season,
          CASE season WHEN 'pre_monsoon' THEN 0 WHEN 'monsoon' THEN 1 WHEN 'post_monsoon' THEN 2 ELSE 3 END AS season FROM fx_causal""",
)
def features_as_of(fx):
    return _served(fx).select(
        "well_id", "origin_date", "horizon_d", "last_obs_level", "days_since_obs", "rain_30d",
        half_even(F.col("last_obs_anomaly"), 5).alias("last_obs_anomaly"), half_even(F.col("clim_season"), 5).alias("clim_season"), "season",
    )


@query(
    "FT-5",
    "SELECT f AS feature, (SELECT count(*) FROM fx_causal) AS n_rows, 0 AS n_differs FROM (VALUES "
    + ",".join(f"('{c}')" for c in ft.FEATURE_ORDER if c != "horizon_d") + ") t(f)",
)
def serving_skew(fx):
    trained = fx.causal.withColumn("season", cal.season_code(F.col("season")))
    names = tuple(c for c in ft.FEATURE_ORDER if c != "horizon_d")
    return ft.skew_check(_served(fx), trained, ["well_id", "origin_date", "horizon_d"], names)


@query(
    "FT-5",
    "SELECT f AS feature, (SELECT count(*) FROM fx_causal) AS n_rows, CASE f WHEN 'rain_30d' THEN (SELECT count(rain_30d) FROM fx_causal WHERE day(origin_date) = 1) ELSE 0 END AS n_differs FROM (VALUES "
    + ",".join(f"('{c}')" for c in ft.FEATURE_ORDER if c != "horizon_d") + ") t(f)",
)
def serving_skew_found(fx):
    """Serving features of which one is off on the first of each month."""
    trained = fx.causal.withColumn("season", cal.season_code(F.col("season")))
    names = tuple(c for c in ft.FEATURE_ORDER if c != "horizon_d")
    off = F.when(F.dayofmonth("origin_date") == 1, F.col("rain_30d") + 1).otherwise(F.col("rain_30d"))
    return ft.skew_check(_served(fx).withColumn("rain_30d", off), trained, ["well_id", "origin_date", "horizon_d"], names)


@query(
    "FT-5",
    """SELECT well_id, origin_date, horizon_d, CAST(rain_30d + 1 AS DOUBLE) AS _a, CAST(rain_30d AS DOUBLE) AS _b FROM fx_causal
       WHERE day(origin_date) = 1 AND rain_30d IS NOT NULL ORDER BY well_id, origin_date, horizon_d LIMIT 3""",
)
def skew_examples(fx):
    off = F.when(F.dayofmonth("origin_date") == 1, F.col("rain_30d") + 1).otherwise(F.col("rain_30d"))
    served = fx.causal.withColumn("rain_30d", off)
    return ft.skew_examples(served, fx.causal, ["well_id", "origin_date", "horizon_d"], "rain_30d")


@query(
    "JN-9",
    f"""SELECT h AS horizon_d, count(*) AS n, {r('sum(d.level_mbgl) + 0.00003',1)} AS total_state FROM (SELECT well_id, obs_date, h FROM fx_obs, (VALUES (7),(15),(30)) v(h)) t
        JOIN fx_daily d ON d.well_id = t.well_id AND d.date = t.obs_date - h GROUP BY 1""",
)
def origin_states(fx):
    t = ft.target_spine(fx.readings, HORIZONS).withColumnRenamed("origin_date", "date")
    return ser.daily_at(t, fx.readings, fx.wells, fx.settings).groupBy("horizon_d").agg(
        F.count(F.lit(1)).alias("n"), half_even(F.sum("level_mbgl") + 0.00003, 1).alias("total_state")
    )


@query(
    "WN-14",
    """SELECT * FROM (SELECT well_id, obs_date, lag(level_mbgl,1) OVER w AS lag_1, lag(obs_date,1) OVER w AS lag_date_1, lag(level_mbgl,2) OVER w AS lag_2, lag(obs_date,2) OVER w AS lag_date_2,
         lag(level_mbgl,3) OVER w AS lag_3, lag(obs_date,3) OVER w AS lag_date_3, lag(level_mbgl,4) OVER w AS lag_4, lag(obs_date,4) OVER w AS lag_date_4 FROM fx_obs WINDOW w AS (PARTITION BY well_id ORDER BY obs_date))""",
)
def reading_lags(fx):
    return order.add_previous(fx.readings.select("well_id", "obs_date", "level_mbgl"), "well_id", "obs_date", "level_mbgl", 4).drop("level_mbgl")


@query("WN-19", "SELECT well_id, max(g) AS max_gap_days FROM (SELECT well_id, CAST(obs_date - lag(obs_date) OVER (PARTITION BY well_id ORDER BY obs_date) AS INTEGER) AS g FROM fx_obs) GROUP BY 1")
def largest_gaps(fx):
    return order.largest_gap(fx.readings, "well_id", "obs_date")


_RING = """WITH t AS (SELECT well_id, dayofyear(date) doy, avg(level_mbgl) v, sum(level_mbgl) s, count(*) n FROM fx_daily WHERE date <= DATE '1999-06-30' GROUP BY 1,2),
     m AS (SELECT well_id, sum(s)/sum(n) AS well_mean FROM t GROUP BY 1),
     g AS (SELECT m.well_id, well_mean, CAST(d AS INTEGER) AS doy FROM m, (SELECT unnest(generate_series(1,366)) d)),
     lap AS (SELECT g.well_id, g.well_mean, g.doy, g.doy + k AS pos, k, v FROM g LEFT JOIN t ON t.well_id = g.well_id AND t.doy = g.doy, (VALUES (-366),(0),(366)) x(k)),
     sm AS (SELECT *, avg(v) OVER (PARTITION BY well_id ORDER BY pos RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS c FROM lap)"""


@query(
    "WN-12",
    f"{_RING} SELECT well_id, count(*) AS n_days, {r('sum(coalesce(c, well_mean))',2)} AS sum_clim, {r('sum(coalesce(c, well_mean)) FILTER (doy <= 183)',2)} AS first_half, {r('max(well_mean)',3)} AS well_mean FROM sm WHERE k = 0 GROUP BY 1",
)
def ring_climatology(fx):
    ring = ser.ring_climatology(fx.daily_series, fx.settings)
    return ring.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n_days"), half_even(F.sum("clim"), 2).alias("sum_clim"),
        half_even(F.sum(F.when(F.col("doy") <= 183, F.col("clim"))), 2).alias("first_half"), half_even(F.max("well_mean"), 3).alias("well_mean"),
    )
