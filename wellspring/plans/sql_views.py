"""Named SQL building blocks over the given tables, for the comparison SQL.

``compose`` puts in front of a statement the views it names, directly or
through other views. Everything is plain SQL run by the checking engine.
"""

from __future__ import annotations

import re


def r(expr: str, places: int) -> str:
    """Round half to even, the way the Spark side does it."""
    scale = f"1e{places}"
    return f"(round_even(({expr})*{scale}, 0)/{scale})"


def season(month: str) -> str:
    return (
        f"CASE WHEN {month} IN (3,4,5) THEN 'pre_monsoon' WHEN {month} IN (6,7,8,9) THEN 'monsoon' "
        f"WHEN {month} IN (10,11) THEN 'post_monsoon' ELSE 'rabi' END"
    )


def split(date: str) -> str:
    return (
        f"CASE WHEN {date} <= DATE '1999-06-30' THEN 'train' WHEN {date} <= DATE '2000-06-30' THEN 'val' "
        f"WHEN {date} <= DATE '2001-08-31' THEN 'test' END"
    )


def haversine(a: str, b: str) -> str:
    return (
        f"2.0e0*6371e0*asin(sqrt(pow(sin((radians({b}.lat)-radians({a}.lat))/2e0),2)"
        f"+cos(radians({a}.lat))*cos(radians({b}.lat))*pow(sin(radians({b}.lon-{a}.lon)/2e0),2)))"
    )


def band(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} > 70 THEN 'ACT NOW' "
        f"WHEN {score} > 40 THEN 'MONITOR' ELSE 'SAFE' END"
    )


def level_score(level: str, trend: str = "obs_trend_m_per_day") -> str:
    return (
        f"(least(60e0, greatest(0e0, ({level}-shallow)/greatest(crisis-shallow,0.5e0)*60e0))"
        f" + CASE WHEN {trend} > 0 THEN least(25e0, {trend}/0.05e0*25e0) ELSE 0e0 END"
        f" + CASE WHEN well_depth > 0 THEN least(15e0, greatest(0e0, ({level}/well_depth-0.6e0)/0.4e0*15e0)) ELSE 0e0 END)"
    )


VIEWS = {
    "fx_wells": """
        SELECT c_custkey AS well_no, 'W'||c_custkey AS well_id,
               15.6e0 + (c_custkey*7919 % 6500)/1000e0 AS lat,
               72.6e0 + (c_custkey*104729 % 8300)/1000e0 AS lon,
               n_name AS district, n_name||'-'||c_mktsegment AS taluka, c_name AS village,
               c_mktsegment AS aquifer_type,
               CASE WHEN c_custkey % 10 <> 0 THEN 20e0 + c_custkey % 60 END AS well_depth,
               c_nationkey AS nation_no
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "fx_donors": """
        SELECT well_id, lat, lon, district,
               CASE (well_no // 4) % 4 WHEN 0 THEN 0.018e0 WHEN 1 THEN 0.020e0 WHEN 2 THEN 0.023e0 ELSE 0.130e0 END AS reference_sy
        FROM fx_wells WHERE well_no % 4 = 0 AND nation_no % 5 <> 0""",
    "fx_obs": f"""
        SELECT well_id, obs_date, level_mbgl, 'survey' AS source, {season('month(obs_date)')} AS season,
               obs_date >= DATE '1997-01-01' AS is_last_5y
        FROM (SELECT 'W'||o_custkey AS well_id, CAST(o_orderdate AS DATE) AS obs_date,
                     floor(o_totalprice/100)/100e0 AS level_mbgl,
                     row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS k
              FROM orders) WHERE k = 1""",
    "fx_registry": """
        SELECT w.*, CASE well_no % 4 WHEN 0 THEN 0.018e0 WHEN 1 THEN 0.020e0 WHEN 2 THEN 0.023e0 ELSE 0.130e0 END AS specific_yield,
               CAST(coalesce(n,0) AS INTEGER) AS n_observations, first_obs, last_obs
        FROM fx_wells w LEFT JOIN (SELECT well_id, count(*) n, min(obs_date) first_obs, max(obs_date) last_obs
                                   FROM fx_obs GROUP BY 1) USING (well_id)""",
    "fx_long": """
        SELECT well_id, obs_date, level_mbgl, season, 'wide' AS source, obs_date >= DATE '1997-01-01' AS is_last_5y
        FROM (SELECT well_id, make_date(CAST(2000 + y - 1995 AS INTEGER), CASE q WHEN 1 THEN 1 WHEN 2 THEN 5 WHEN 3 THEN 8 ELSE 11 END, 15) AS obs_date,
                     CASE q WHEN 1 THEN 'rabi' WHEN 2 THEN 'pre_monsoon' WHEN 3 THEN 'monsoon' ELSE 'post_monsoon' END AS season,
                     level_mbgl
              FROM (SELECT well_id, year(obs_date) y, quarter(obs_date) q, avg(level_mbgl) level_mbgl
                    FROM fx_obs JOIN fx_wells USING (well_id) GROUP BY 1,2,3))""",
    "fx_cells": """
        SELECT well_id, CAST(well_no % (SELECT greatest(10, count(*) // 10) FROM supplier) AS VARCHAR) AS cell_id FROM fx_wells""",
    "fx_weather_raw": """
        SELECT CAST(l_suppkey % (SELECT greatest(10, count(*) // 10) FROM supplier) AS VARCHAR) AS cell_id, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS precip_mm,
               sum(round_even(l_discount*100,0))/count(*) AS et0_mm, 20e0+sum(round_even(l_tax*100,0))/count(*) AS temp_max
        FROM lineitem GROUP BY 1,2""",
    "fx_weather": """
        SELECT cell_id, date, precip_mm, et0_mm, temp_max
        FROM (SELECT cell_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date
              FROM fx_weather_raw GROUP BY 1) LEFT JOIN fx_weather_raw USING (cell_id, date)""",
    "fx_weather_features": """
        SELECT cell_id, date, temp_max, precip_mm, et0_mm,
               sum(precip_mm) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS rain_7d,
               sum(precip_mm) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rain_30d,
               sum(precip_mm) OVER (w ROWS BETWEEN 89 PRECEDING AND CURRENT ROW) AS rain_90d,
               sum(et0_mm) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS et0_30d,
               CASE WHEN precip_mm IS NOT NULL THEN sum(precip_mm) OVER w END AS rain_cum,
               CASE WHEN et0_mm IS NOT NULL THEN sum(et0_mm) OVER w END AS et0_cum,
               coalesce(date - max(CASE WHEN precip_mm >= 2.5 THEN date END) OVER w, 999) AS days_since_last_rain,
               CASE WHEN precip_mm IS NOT NULL THEN sum(precip_mm) OVER
                   (PARTITION BY cell_id, year(date) - CASE WHEN month(date) < 6 THEN 1 ELSE 0 END ORDER BY date) END AS cum_monsoon_rainfall
        FROM fx_weather WINDOW w AS (PARTITION BY cell_id ORDER BY date)""",
    "fx_month_means": """
        SELECT well_id, CASE m WHEN 1 THEN 15 WHEN 2 THEN 46 WHEN 3 THEN 74 WHEN 4 THEN 105 WHEN 5 THEN 135 WHEN 6 THEN 166
               WHEN 7 THEN 196 WHEN 8 THEN 227 WHEN 9 THEN 258 WHEN 10 THEN 288 WHEN 11 THEN 319 ELSE 349 END AS d, v
        FROM (SELECT well_id, month(obs_date) m, avg(level_mbgl) v FROM fx_obs GROUP BY 1,2)""",
    "fx_ring": """
        SELECT well_id, CAST(doy AS INTEGER) AS doy, v + coalesce((nv-v)/nullif(nd-d,0),0)*(doy-d) AS clim
        FROM (SELECT well_id, d, v, lead(d) OVER w AS nd, lead(v) OVER w AS nv
              FROM (SELECT well_id, d, v FROM fx_month_means
                    UNION ALL SELECT well_id, max(d)-366, max_by(v,d) FROM fx_month_means GROUP BY 1
                    UNION ALL SELECT well_id, min(d)+366, min_by(v,d) FROM fx_month_means GROUP BY 1)
              WINDOW w AS (PARTITION BY well_id ORDER BY d)) s
        JOIN (SELECT unnest(generate_series(1,366)) AS doy) ON doy >= d AND doy < nd""",
    "fx_daily": f"""
        SELECT well_id, date, level_mbgl, is_observed, confidence FROM (
          SELECT a.well_id, CAST(obs_date + CAST(i AS INTEGER) AS DATE) AS date,
                 CASE WHEN i = 0 THEN level_mbgl ELSE {r('greatest(0.05e0, CASE WHEN well_depth > 0.05 THEN least(well_depth, c.clim + anomaly + coalesce((next_anomaly-anomaly)/gap,0)*i) ELSE c.clim + anomaly + coalesce((next_anomaly-anomaly)/gap,0)*i END)', 4)} END AS level_mbgl,
                 i = 0 AS is_observed,
                 {r('exp(-least(i, coalesce(gap-i, i))/45e0)', 4)} AS confidence
          FROM (SELECT o.*, unnest(generate_series(0, coalesce(gap-1, 0))) AS i
                FROM (SELECT o.well_id, o.obs_date, o.level_mbgl, o.level_mbgl - g.clim AS anomaly, well_depth,
                             lead(o.obs_date) OVER w - o.obs_date AS gap, lead(o.level_mbgl - g.clim) OVER w AS next_anomaly,
                             count(*) OVER (PARTITION BY o.well_id) AS n
                      FROM fx_obs o JOIN fx_ring g ON g.well_id = o.well_id AND g.doy = dayofyear(o.obs_date)
                      LEFT JOIN fx_wells x ON x.well_id = o.well_id
                      WINDOW w AS (PARTITION BY o.well_id ORDER BY o.obs_date)) o WHERE n >= 4) a
          JOIN fx_ring c ON c.well_id = a.well_id AND c.doy = dayofyear(obs_date + CAST(i AS INTEGER)))""",
    "fx_systems": """
        SELECT * FROM (VALUES ('1-URGENT','Urgent system','North',1447363,4100e0), ('2-HIGH','High system','North',825660,1395e0),
               ('3-MEDIUM','Medium system','South',1066930,1900e0), ('4-NOT SPECIFIED','Unspecified system','South',363130,700e0),
               ('5-LOW','Low system','East',227047,NULL)) t(reservoir_id, name, city, capacity_ml, draw_mld)""",
    "fx_anchors": f"""
        SELECT reservoir_id, date, pct AS live_storage_pct, {r('pct/100e0*capacity_ml/1000e0', 3)} AS storage_mcm, 'manual' AS source
        FROM (SELECT o_orderpriority AS reservoir_id, CAST(o_orderdate AS DATE) - CAST((CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 5 AS INTEGER) AS date,
                     CAST(sum(CAST(round_even(o_totalprice*100,0) AS BIGINT)) % 10000 AS BIGINT)/100e0 AS pct
              FROM orders GROUP BY 1,2)
        JOIN fx_systems USING (reservoir_id)""",
    "fx_reservoir": f"""
        SELECT * FROM fx_anchors UNION ALL
        SELECT reservoir_id, date, pct, {r('pct/100e0*capacity_ml/1000e0', 3)}, 'interpolated'
        FROM (SELECT reservoir_id, CAST(date + CAST(i AS INTEGER) AS DATE) AS date, {r('v + (nv-v)/gap*i', 2)} AS pct
              FROM (SELECT reservoir_id, date, v, nv, gap, unnest(generate_series(1, gap-1)) AS i
                    FROM (SELECT reservoir_id, date, live_storage_pct v, lead(live_storage_pct) OVER w nv, lead(date) OVER w - date AS gap
                          FROM fx_anchors WINDOW w AS (PARTITION BY reservoir_id ORDER BY date)) WHERE gap > 1))
        JOIN fx_systems USING (reservoir_id)""",
    "fx_lookback": """
        SELECT a.*, CASE WHEN win >= 7 THEN win END AS trend_window_d,
               CASE WHEN win >= 7 THEN (live_storage_pct - ref_pct)/win END AS trend_raw,
               CASE WHEN win >= 7 THEN ref_source END AS reference_source
        FROM (SELECT x.*, x.date - coalesce(e.date, x.prev_date) AS win,
                     coalesce(e.live_storage_pct, x.prev_pct) AS ref_pct, coalesce(e.source, x.prev_source) AS ref_source
              FROM (SELECT r.*, d.draw_mld, lag(r.date) OVER w prev_date, lag(live_storage_pct) OVER w prev_pct, lag(source) OVER w prev_source
                    FROM fx_reservoir r JOIN fx_systems d ON d.reservoir_id = r.reservoir_id AND d.draw_mld IS NOT NULL
                    WINDOW w AS (PARTITION BY r.reservoir_id ORDER BY r.date)) x
              ASOF LEFT JOIN fx_reservoir e ON e.reservoir_id = x.reservoir_id AND x.date - 30 >= e.date) a""",
    "fx_urban": f"""
        SELECT reservoir_id AS entity_id, date,
               CAST(round_even(least(100e0, greatest(0e0, lv+tr+rw)),0) AS INTEGER) AS score,
               CASE WHEN lv+tr+rw <= 40 THEN 'SAFE' WHEN lv+tr+rw <= 70 THEN 'MONITOR' ELSE 'ACT NOW' END AS band,
               {r('lv',2)} AS s_level, {r('tr',2)} AS s_trend, {r('rw',2)} AS s_runway, live_storage_pct,
               {r('trend_raw',4)} AS trend_pp_per_day, CAST(trend_window_d AS INTEGER) AS trend_window_d,
               {r('days',1)} AS days_of_supply,
               CASE WHEN source = 'interpolated' OR reference_source = 'interpolated' THEN 'interpolated' ELSE source END AS inputs_source,
               'urban-stress-1.0' AS method_version
        FROM (SELECT *, CASE WHEN live_storage_pct >= 80 THEN 0e0 WHEN live_storage_pct >= 30 THEN (80e0-live_storage_pct)/50e0*30e0
                        WHEN live_storage_pct >= 10 THEN 30e0+(30e0-live_storage_pct)/20e0*18e0
                        ELSE least(60e0, 48e0+(10e0-greatest(live_storage_pct,0e0))/10e0*12e0) END AS lv,
                     CASE WHEN trend_raw < 0 THEN least(25e0, abs(trend_raw)/0.30e0*25e0) ELSE 0e0 END AS tr,
                     CASE WHEN days IS NULL OR days >= 90 THEN 0e0 WHEN days <= 15 THEN 15e0 ELSE (90e0-days)/75e0*15e0 END AS rw
              FROM (SELECT *, storage_mcm*1000e0/draw_mld AS days FROM fx_lookback))""",
    "fx_reports": """
        SELECT 'rep'||event_id AS report_id, ts AS created_at, event_type AS source,
               '+9190000'||lpad(CAST(user_id AS VARCHAR),5,'0') AS phone, 'W'||user_id AS well_id,
               value/10e0 AS level_mbgl, CAST(ts AS DATE) AS reported_for FROM events""",
    "fx_users": """
        SELECT 'U'||well_no AS user_id, well_no AS user_no,
               CASE well_no % 4 WHEN 0 THEN 'farmer' WHEN 1 THEN 'society-manager' WHEN 2 THEN 'society-resident' ELSE 'government' END AS role,
               CASE well_no % 3 WHEN 0 THEN 'mr' WHEN 1 THEN 'hi' ELSE 'en' END AS lang, village AS name,
               CASE well_no % 5 WHEN 0 THEN d WHEN 1 THEN '+91 '||substr(d,1,5)||' '||substr(d,6,5) WHEN 2 THEN '0'||d
                    WHEN 3 THEN '091-'||d ELSE substr(d,1,8) END AS phone_raw,
               CASE WHEN well_no % 5 <> 4 THEN '+91'||d END AS phone,
               'taluka' AS entity_type, CASE WHEN well_no % 11 <> 0 THEN taluka END AS entity_id,
               CASE WHEN well_no % 11 <> 0 THEN taluka||' Taluka' END AS entity_label, district AS place_raw, well_id,
               well_no % 3 = 0 AS verified, well_no % 7 <> 0 AS has_password,
               TIMESTAMP '2024-01-01' + to_hours(CAST(well_no % 2000 AS INTEGER)) + to_minutes(CAST(well_no % 60 AS INTEGER)) AS created_at
        FROM (SELECT *, '9'||lpad(CAST(well_no AS VARCHAR),9,'0') AS d FROM fx_wells)""",
    "fx_alerts": """
        SELECT o_orderkey AS alert_id, 'U'||o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus AS status FROM orders""",
    "fx_pred": """
        SELECT 'length' AS forecaster, CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'val' END AS split,
               CASE WHEN quality = 1 THEN 85e0 ELSE 20e0 + doc_id % 50 END AS true_score, (n_chars % 1010)/10e0 AS pred_score
        FROM documents JOIN labels USING (doc_id)""",
    "fx_qualified": """
        SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY well_id) AS n FROM fx_obs WHERE obs_date <= DATE '2001-08-31') WHERE n >= 8""",
    "fx_history": """
        SELECT well_id, obs_date AS last_obs_date, level_mbgl AS last_obs_level, lag(level_mbgl) OVER w AS prev_obs_level,
               lag(obs_date) OVER w AS prev_obs_date FROM fx_qualified WINDOW w AS (PARTITION BY well_id ORDER BY obs_date)""",
    "fx_causal": f"""
        SELECT t.well_id, t.origin_date, t.target_date, t.horizon_d, t.last_obs_level,
               CAST(t.origin_date - t.last_obs_date AS INTEGER) AS days_since_obs, t.prev_obs_level,
               CAST(t.last_obs_date - t.prev_obs_date AS INTEGER) AS prev_obs_gap_d,
               (t.last_obs_level - t.prev_obs_level)/nullif(t.last_obs_date - t.prev_obs_date, 0) AS obs_trend_m_per_day,
               t.last_obs_level - cw.m AS last_obs_anomaly,
               a.rain_cum - b.rain_cum AS rain_since_obs, a.et0_cum - b.et0_cum AS et0_since_obs,
               a.rain_7d, a.rain_30d, a.rain_90d, a.et0_30d, CAST(a.days_since_last_rain AS INTEGER) AS days_since_last_rain,
               a.cum_monsoon_rainfall, a.temp_max,
               CAST(month(t.target_date) AS INTEGER) AS month, CAST(dayofyear(t.target_date) AS INTEGER) AS doy,
               {season('month(t.target_date)')} AS season, w.specific_yield, w.well_depth, w.lat, w.lon,
               coalesce(cs.m, cw.m) AS clim_season, cw.m AS clim_well, t.target_level, {split('t.target_date')} AS split
        FROM (SELECT o.well_id, o.obs_date AS target_date, o.level_mbgl AS target_level, o.horizon_d, o.origin_date,
                     x.last_obs_date, x.last_obs_level, x.prev_obs_level, x.prev_obs_date
              FROM (SELECT q.*, h.horizon_d, CAST(q.obs_date - h.horizon_d AS DATE) AS origin_date
                    FROM fx_qualified q CROSS JOIN (VALUES (7),(15),(30)) h(horizon_d)) o
              ASOF JOIN fx_history x ON x.well_id = o.well_id AND o.origin_date >= x.last_obs_date) t
        LEFT JOIN fx_cells c ON c.well_id = t.well_id
        LEFT JOIN fx_weather_features a ON a.cell_id = c.cell_id AND a.date = t.origin_date
        LEFT JOIN fx_weather_features b ON b.cell_id = c.cell_id AND b.date = t.last_obs_date
        LEFT JOIN fx_registry w ON w.well_id = t.well_id
        LEFT JOIN (SELECT well_id, season, avg(level_mbgl) m FROM fx_qualified WHERE obs_date <= DATE '1999-06-30' GROUP BY 1,2) cs
               ON cs.well_id = t.well_id AND cs.season = {season('month(t.target_date)')}
        LEFT JOIN (SELECT well_id, avg(level_mbgl) m FROM fx_qualified WHERE obs_date <= DATE '1999-06-30' GROUP BY 1) cw ON cw.well_id = t.well_id
        WHERE t.last_obs_date < t.target_date""",
    "fx_reference": """
        SELECT well_id, min(level_mbgl) AS shallow, quantile_cont(level_mbgl, 0.9) AS crisis, count(*) AS n_train_obs
        FROM fx_obs WHERE obs_date <= DATE '1999-06-30' GROUP BY 1 HAVING count(*) >= 4""",
    "fx_scored": f"""
        SELECT well_id, origin_date, horizon_d, split, target_level AS y_true, {level_score('target_level')} AS true_score,
               forecaster, y_pred, {level_score('y_pred')} AS pred_score
        FROM (SELECT f.*, shallow, crisis, 'climatology' AS forecaster, coalesce(clim_season, clim_well) AS y_pred FROM fx_causal f JOIN fx_reference USING (well_id)
              UNION ALL
              SELECT f.*, shallow, crisis, 'last_reading', last_obs_level FROM fx_causal f JOIN fx_reference USING (well_id))""",
    "fx_area_origin": """
        SELECT taluka AS entity_id, count(*) AS n_wells, max(last_obs) AS data_through, min(first_obs) AS first_obs
        FROM fx_registry GROUP BY 1""",
    "fx_well_scores": f"""
        SELECT taluka, well_id, forecast, shallow, crisis, trend, last_level, last_date, origin, target,
               {r('sd',2)} AS s_depth, {r('st',2)} AS s_trend, {r('sh',2)} AS s_headroom,
               CAST(round_even(sd+st+sh,0) AS INTEGER) AS score, {r('forecast',2)} AS forecast_level,
               CASE WHEN trend > 0 AND crisis - last_level > 0 THEN CAST(floor((crisis-last_level)/trend) AS BIGINT) END AS days_to_crisis
        FROM (SELECT *, least(60e0, greatest(0e0, (forecast-shallow)/greatest(crisis-shallow,0.5e0)*60e0)) AS sd,
                     CASE WHEN trend > 0 THEN least(25e0, trend/0.05e0*25e0) ELSE 0e0 END AS st,
                     CASE WHEN well_depth > 0 THEN least(15e0, greatest(0e0, (forecast/well_depth-0.6e0)/0.4e0*15e0)) ELSE 0e0 END AS sh
              FROM (SELECT well_id, any_value(taluka) AS taluka, any_value(well_depth) AS well_depth, any_value(origin) AS origin, any_value(target) AS target,
                           {r('coalesce(avg(level_mbgl) FILTER (season = tseason), avg(level_mbgl))', 9)} AS forecast, min(level_mbgl) AS shallow,
                           max(level_mbgl) FILTER (rk = least(n-1, CAST(floor(0.9e0*n) AS BIGINT)) + 1) AS crisis,
                           max_by(level_mbgl, obs_date) AS last_level, max(obs_date) AS last_date,
                           (max_by(level_mbgl, obs_date) - max_by(pl, obs_date))/greatest(max(obs_date) - max_by(pd, obs_date), 1) AS trend
                    FROM (SELECT o.*, taluka, well_depth, data_through AS origin, CAST(data_through + 30 AS DATE) AS target, {season('month(data_through + 30)')} AS tseason,
                                 count(*) OVER (PARTITION BY o.well_id) AS n,
                                 row_number() OVER (PARTITION BY o.well_id ORDER BY level_mbgl, obs_date) AS rk,
                                 lag(level_mbgl) OVER (PARTITION BY o.well_id ORDER BY obs_date) AS pl,
                                 lag(obs_date) OVER (PARTITION BY o.well_id ORDER BY obs_date) AS pd
                          FROM fx_obs o JOIN fx_wells w ON w.well_id = o.well_id JOIN fx_area_origin a ON a.entity_id = w.taluka)
                    WHERE n >= 4 GROUP BY well_id))""",
    "fx_area_cards": f"""
        SELECT a.entity_id, CASE WHEN s.score IS NULL THEN 'no_data' ELSE 'ok' END AS status,
               CASE WHEN data_through IS NULL THEN 'no readings for this entity' WHEN s.score IS NULL THEN 'fewer than 4 readings per well' END AS reason,
               n_wells, CASE WHEN s.score IS NOT NULL THEN data_through END AS date,
               CASE WHEN s.score IS NOT NULL THEN CAST(data_through + 30 AS DATE) END AS target_date,
               s.score, {band('s.score')} AS band, d2c AS days_to_crisis, s.forecast_level, s.s_depth, s.s_trend, s.s_headroom,
               s.well_id AS driving_well, s.last_level AS last_obs_level, s.last_date AS last_obs_date, wells_scored,
               coalesce(scored_through, data_through) AS data_through
        FROM fx_area_origin a
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY taluka ORDER BY score DESC, well_id) AS k,
                          min(days_to_crisis) OVER (PARTITION BY taluka) AS d2c, count(*) OVER (PARTITION BY taluka) AS wells_scored,
                          max(last_date) OVER (PARTITION BY taluka) AS scored_through
                   FROM fx_well_scores) s ON s.taluka = a.entity_id AND k = 1""",
}


def compose(sql: str) -> str:
    """``sql`` with the views it needs in front, in dependency order."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name not in ordered:
                need(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    need(sql)
    if not ordered:
        return sql.strip()
    head = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in ordered)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"
