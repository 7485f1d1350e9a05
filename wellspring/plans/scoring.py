"""Queries: urban and rural scores, timelines, views, places, audiences, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions import stress, text
from wellspring.functions.numeric import half_even
from wellspring.operators import audience as au
from wellspring.operators import places as pl
from wellspring.operators import quality as dq
from wellspring.operators import reports as rp
from wellspring.operators import score as sc
from wellspring.operators import views as vw
from wellspring.plans import timeseries as ts
from wellspring.plans.registry import query
from wellspring.plans.sql_views import VIEWS, band, r, season

AS_OF = "2001-12-01"


# --------------------------------------------------------------------- urban
@query("SR-5 WN-16 SC-3 SC-4 SC-5 SC-6 SC-10", "SELECT * FROM fx_urban")
def urban_stress(fx):
    return sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings)


@query(
    "SR-6",
    """SELECT entity_id, date, score, band, inputs_source, component, reading, points, out_of FROM (
         SELECT *, 'depletion' AS component, live_storage_pct AS reading, s_level AS points, 60 AS out_of FROM fx_urban
         UNION ALL SELECT *, 'rate_of_decline', trend_pp_per_day, s_trend, 25 FROM fx_urban
         UNION ALL SELECT *, 'runway', days_of_supply, s_runway, 15 FROM fx_urban)""",
)
def explained_scores(fx):
    return sc.explain(sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings))


def _events(fx):
    """Dated events: the first order day of each month per priority, noted by status."""
    o = fx.table("orders", "o_orderpriority", "o_orderdate", "o_orderstatus")
    day = F.col("o_orderdate").cast("date")
    return o.groupBy(F.col("o_orderpriority").alias("entity_id"), F.trunc(day, "month").alias("_m")).agg(
        F.min(day).alias("date"), F.min("o_orderstatus").alias("note")
    ).drop("_m")


@query(
    "SR-6",
    """SELECT e.entity_id, e.date, e.note, live_storage_pct, score, band, s_level, s_trend, s_runway, score IS NULL AS no_anchor,
              score IS NOT NULL AND trend_window_d IS NULL AS blind_trend
       FROM (SELECT o_orderpriority AS entity_id, min(CAST(o_orderdate AS DATE)) AS date, min(o_orderstatus) AS note FROM orders GROUP BY 1, date_trunc('month', o_orderdate)) e
       LEFT JOIN fx_urban u USING (entity_id, date)""",
)
def calibrated_events(fx):
    return sc.calibrate(sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings), _events(fx))


_CARDS = """SELECT u.*, name, city, coalesce(name, entity_id) AS entity_label, CASE band WHEN 'SAFE' THEN 'GREEN' WHEN 'MONITOR' THEN 'AMBER' ELSE 'RED' END AS colour,
       CASE band WHEN 'SAFE' THEN 'सुरक्षित' WHEN 'MONITOR' THEN 'निगरानी रखें' ELSE 'तुरंत कार्रवाई' END AS band_label, CAST(floor(days_of_supply) AS BIGINT) AS days_to_crisis
     FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY date DESC) AS k FROM fx_urban) WHERE k = 1) u
     LEFT JOIN fx_systems s ON s.reservoir_id = u.entity_id"""


@query("WN-17 JN-14 SC-17", f"SELECT * EXCLUDE (k) FROM ({_CARDS})")
def latest_urban_cards(fx):
    scores = sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings)
    return sc.urban_cards(sc.latest_urban(scores), fx.systems, F.lit("hi"))


@query(
    "WN-21",
    """WITH p AS (SELECT entity_id, unnest([max_by(date, (score, -(date - DATE '1970-01-01'))), min(date), min_by(date, (score, date)), max(date)]) AS date,
                   unnest(['most_stressed','earliest','least_stressed','latest']) AS note, unnest([0,1,2,3]) AS ord FROM fx_urban GROUP BY 1)
       SELECT entity_id, date, min_by(note, ord) AS note, any_value(score) AS score, any_value(live_storage_pct) AS live_storage_pct FROM p JOIN fx_urban USING (entity_id, date) GROUP BY 1,2""",
)
def notable_dates(fx):
    return sc.notable_dates(sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings))


# --------------------------------------------------------------------- rural
_AREA = """entity_id, status, reason, n_wells, date, target_date, score, band, days_to_crisis, forecast_level, s_depth, s_trend, s_headroom,
   driving_well, last_obs_level, last_obs_date, wells_scored, data_through"""


@query("SR-4 SC-7 SC-8 WN-18 TK-2", f"SELECT {_AREA} FROM fx_area_cards")
def rural_area_scores(fx):
    cards = sc.rural_score(fx.readings, fx.base_wells, settings=fx.settings)
    return cards.select(*[c.strip() for c in _AREA.split(",")])


@query(
    "SR-4",
    f"""SELECT taluka AS entity_id, well_id, score, s_depth, s_trend, s_headroom, forecast_level, days_to_crisis FROM
        ({VIEWS['fx_well_scores'].replace('fx_area_origin a ON a.entity_id = w.taluka', '(SELECT well_id AS e, max(obs_date) AS data_through FROM fx_obs GROUP BY 1) a ON a.e = w.well_id')})""",
)
def rural_well_scores(fx):
    """Every well on its own, scored at its own last reading."""
    last = fx.readings.groupBy("well_id").agg(F.max("obs_date").alias("origin_date"))
    per_well = fx.base_wells.select("well_id", "taluka", "well_depth").join(last, "well_id").withColumn(
        "target_date", F.date_add("origin_date", fx.settings.horizon_days)
    )
    history = fx.readings.join(per_well.drop("taluka"), "well_id")
    scored = sc.well_scores(history, fx.settings)
    return scored.join(fx.base_wells.select("well_id", F.col("taluka").alias("entity_id")), "well_id").select(
        "entity_id", "well_id", "score", "s_depth", "s_trend", "s_headroom", "forecast_level", "days_to_crisis"
    )


_TIMELINE = f"""SELECT well_id, date, score, {band('score')} AS band, {r('forecast',2)} AS forecast_level,
      CASE WHEN trend > 0 AND crisis - last_level > 0 THEN CAST(floor((crisis-last_level)/trend) AS BIGINT) END AS days_to_crisis
   FROM (SELECT *, CAST(round_even(least(60e0, greatest(0e0, (forecast-shallow)/greatest(crisis-shallow,0.5e0)*60e0))
              + CASE WHEN trend > 0 THEN least(25e0, trend/0.05e0*25e0) ELSE 0e0 END
              + CASE WHEN well_depth > 0 THEN least(15e0, greatest(0e0, (forecast/well_depth-0.6e0)/0.4e0*15e0)) ELSE 0e0 END, 0) AS INTEGER) AS score
         FROM (SELECT a.well_id, a.obs_date AS date, any_value(w.well_depth) AS well_depth, count(*) AS n, min(h.level_mbgl) AS shallow,
                      list_sort(list(h.level_mbgl))[least(count(*)-1, CAST(floor(0.9e0*count(*)) AS BIGINT)) + 1] AS crisis,
                      {r('coalesce(avg(h.level_mbgl) FILTER (h.season = ' + season('month(a.obs_date + 30)') + '), avg(h.level_mbgl))', 9)} AS forecast,
                      any_value(a.level_mbgl) AS last_level, any_value(a.slope) AS trend
               FROM (SELECT *, (level_mbgl - lag(level_mbgl) OVER w)/greatest(obs_date - lag(obs_date) OVER w, 1) AS slope FROM fx_obs WINDOW w AS (PARTITION BY well_id ORDER BY obs_date)) a
               JOIN fx_obs h ON h.well_id = a.well_id AND h.obs_date <= a.obs_date JOIN fx_wells w ON w.well_id = a.well_id
               GROUP BY 1, 2) WHERE n >= 4)"""


@query("VW-2 JN-13", _TIMELINE)
def well_timeline(fx):
    return sc.well_timeline(fx.readings, fx.base_wells, fx.settings)


_AREA_TIMELINE = f"""WITH q AS (SELECT DISTINCT taluka, obs_date AS date FROM fx_obs JOIN fx_wells USING (well_id)),
    pairs AS (SELECT q.taluka, q.date, w.well_id, w.well_depth FROM q JOIN fx_wells w ON w.taluka = q.taluka),
    hist AS (SELECT p.taluka, p.date, p.well_id, any_value(p.well_depth) AS well_depth, count(*) AS n, min(h.level_mbgl) AS shallow,
         list_sort(list(h.level_mbgl))[least(count(*)-1, CAST(floor(0.9e0*count(*)) AS BIGINT)) + 1] AS crisis,
         {r('coalesce(avg(h.level_mbgl) FILTER (h.season = ' + season('month(p.date + 30)') + '), avg(h.level_mbgl))', 9)} AS forecast,
         max_by(h.level_mbgl, h.obs_date) AS last_level, max_by(h.slope, h.obs_date) AS trend
         FROM pairs p JOIN (SELECT *, (level_mbgl - lag(level_mbgl) OVER w)/greatest(obs_date - lag(obs_date) OVER w, 1) AS slope FROM fx_obs WINDOW w AS (PARTITION BY well_id ORDER BY obs_date)) h
         ON h.well_id = p.well_id AND h.obs_date <= p.date GROUP BY 1,2,3 HAVING count(*) >= 4),
    s AS (SELECT *, CAST(round_even(least(60e0, greatest(0e0, (forecast-shallow)/greatest(crisis-shallow,0.5e0)*60e0))
              + CASE WHEN trend > 0 THEN least(25e0, trend/0.05e0*25e0) ELSE 0e0 END
              + CASE WHEN well_depth > 0 THEN least(15e0, greatest(0e0, (forecast/well_depth-0.6e0)/0.4e0*15e0)) ELSE 0e0 END, 0) AS INTEGER) AS score,
            CASE WHEN trend > 0 AND crisis - last_level > 0 THEN CAST(floor((crisis-last_level)/trend) AS BIGINT) END AS d2c FROM hist)
    SELECT taluka AS entity_id, date, max(score) AS score, {band('max(score)')} AS band, {r('max_by(forecast, (score, well_rank))',2)} AS forecast_level, min(d2c) AS days_to_crisis
    FROM (SELECT *, -row_number() OVER (PARTITION BY taluka, date ORDER BY well_id) AS well_rank FROM s) GROUP BY 1, 2"""


@query("VW-2 JN-13", _AREA_TIMELINE)
def area_timeline(fx):
    return sc.area_timeline(fx.readings, fx.base_wells, fx.settings)


# ---------------------------------------------------------------------- views
_OVERVIEW = f"""SELECT *, CASE WHEN days_stale IS NULL THEN '' WHEN days_stale <= 1 THEN 'today' WHEN days_stale < 60 THEN days_stale||' days ago'
            WHEN days_stale < 730 THEN CAST(CAST(round_even(days_stale/30.4e0,0) AS INTEGER) AS VARCHAR)||' months ago' ELSE printf('%.1f', days_stale/365.25e0)||' years ago' END AS age,
          CASE WHEN score IS NULL THEN 'unscorable' WHEN band = 'ACT NOW' THEN 'act_now' WHEN band = 'MONITOR' THEN 'monitor' ELSE 'safe' END AS bucket
     FROM (SELECT *, CASE WHEN score IS NOT NULL THEN CAST(DATE '{AS_OF}' - date AS INTEGER) END AS days_stale FROM (
        SELECT 'rural' AS track, 'taluka' AS entity_type, a.entity_id, a.entity_id||' Taluka, '||split_part(a.entity_id,'-',1) AS label, split_part(a.entity_id,'-',1) AS district,
               score, band, CASE band WHEN 'SAFE' THEN 'GREEN' WHEN 'MONITOR' THEN 'AMBER' WHEN 'ACT NOW' THEN 'RED' END AS colour, coalesce(date, data_through) AS date, days_to_crisis, forecast_level AS headline, reason
        FROM fx_area_cards a
        UNION ALL SELECT 'urban', 'reservoir', entity_id, entity_label, city, score, band, colour, date, days_to_crisis, live_storage_pct, NULL FROM ({_CARDS})))"""


def _overview(fx):
    areas = fx.base_wells.groupBy(F.col("taluka").alias("entity_id")).agg(F.min("district").alias("district"))
    rural = sc.rural_score(fx.readings, fx.base_wells, settings=fx.settings)
    urban = sc.urban_cards(sc.latest_urban(sc.urban_score(fx.reservoir_daily, fx.draws, fx.settings)), fx.systems)
    return vw.overview_rows(rural, urban, areas, F.lit(AS_OF).cast("date"))


@query("VW-1 TK-1 SC-16", _OVERVIEW)
def statewide_overview(fx):
    return vw.worst_first(_overview(fx))


_PEOPLE = "SELECT * FROM fx_users WHERE entity_id IS NOT NULL AND user_id <> 'U3'"


def _people(fx):
    return au.government_audience(fx.users, "U3")


@query(
    "JN-16 VW-1",
    f"""SELECT o.entity_id, o.label, o.score, coalesce(n, 0) AS subscribers FROM ({_OVERVIEW}) o LEFT JOIN (SELECT entity_id, count(*) n FROM ({_PEOPLE}) GROUP BY 1) USING (entity_id)""",
)
def overview_with_subscribers(fx):
    rows = vw.with_subscribers(_overview(fx), au.subscriber_counts(_people(fx)))
    return rows.select("entity_id", "label", "score", "subscribers")


@query(
    "AG-20",
    f"""SELECT b AS bucket, count(o.entity_id) AS n_entities, CAST(coalesce(sum(n),0) AS BIGINT) AS reach FROM (VALUES ('act_now'),('monitor'),('safe'),('unscorable')) v(b)
        LEFT JOIN ({_OVERVIEW}) o ON o.bucket = b LEFT JOIN (SELECT entity_id, count(*) n FROM ({_PEOPLE}) GROUP BY 1) s ON s.entity_id = o.entity_id GROUP BY 1""",
)
def bucket_counts(fx):
    return vw.bucket_counts(vw.with_subscribers(_overview(fx), au.subscriber_counts(_people(fx))))


@query(
    "TK-6",
    f"""SELECT entity_id, label, score, bucket FROM ({_OVERVIEW}) WHERE bucket = 'monitor' AND contains(lower(label||' '||coalesce(district,'')||' '||entity_id), 'nation_1') ORDER BY score DESC NULLS LAST, label, entity_id LIMIT 120""",
)
def filtered_table_page(fx):
    return vw.table_page(_overview(fx), "monitor", " Nation_1").select("entity_id", "label", "score", "bucket")


@query("AG-15 VW-4", f"SELECT count(*) AS n_daily_rows, count(*) FILTER (is_observed) AS n_observed, {r('1e2*count(*) FILTER (is_observed)/count(*)',2)} AS pct_observed FROM fx_daily")
def observed_ratio(fx):
    return vw.observed_ratio(fx.daily)


@query("AG-15 VW-4", "SELECT well_id, district, taluka, first_obs, last_obs, CAST(n_observations AS BIGINT) AS n_obs FROM fx_registry")
def well_coverage(fx):
    return vw.coverage(fx.base_wells, fx.readings)


@query("AG-16", "SELECT taluka, count(*) AS n_wells, max(last_obs) AS last_obs FROM fx_registry GROUP BY 1 HAVING count(*) >= 10")
def area_rollup(fx):
    return vw.area_rollup(fx.wells, "taluka", 10)


@query("AG-17 VW-3 VW-4", "SELECT source, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM fx_reservoir GROUP BY 1")
def provenance_counts(fx):
    return vw.provenance_counts(fx.reservoir_daily)


#: Two anchors of the given tables that have a name of their own.
_NAMED = {"1-URGENT|1995-01-05": "urgent_first_week", "5-LOW|1998-03-05": "low_spring"}
_KIND = "CASE WHEN day(date) % 3 = 0 THEN 'primary' WHEN day(date) % 3 = 1 THEN 'reported' ELSE 'secondhand' END"
_NAME = "CASE " + " ".join(f"WHEN entity_id || '|' || strftime(date, '%Y-%m-%d') = '{k}' THEN '{v}'" for k, v in _NAMED.items()) + " END"


def _confidence():
    return F.element_at(F.array(F.lit("primary"), F.lit("reported"), F.lit("secondhand")), F.dayofmonth("date") % 3 + 1)


@query(
    "AG-17 VW-3",
    f"""SELECT entity_id, date, value, confidence, confidence IN ('primary','reported') AS verified, {_NAME} AS figure
       FROM (SELECT reservoir_id AS entity_id, date, live_storage_pct AS value, {_KIND} AS confidence FROM fx_anchors)""",
)
def anchor_figures(fx):
    return vw.figures(fx.anchors.withColumnRenamed("reservoir_id", "entity_id").withColumn("confidence", _confidence()), _NAMED)


_ON = "1998-01-01"
#: A first version the day after; a corrected one on every fourth day of a month; some are taken back.
_LEDGER = f"""
WITH b AS (SELECT reservoir_id AS entity_id, date, live_storage_pct AS v, {_KIND} AS confidence FROM fx_anchors),
 x AS (SELECT entity_id, date, v, confidence, date + 1 AS on_ FROM b UNION ALL SELECT entity_id, date, v + 1, 'primary', date + 10 FROM b WHERE day(date) % 4 = 0),
 t AS (SELECT entity_id, date, date + CASE WHEN day(date) % 2 = 0 THEN 20 ELSE 5 END AS off_, 'wrong ' || CASE WHEN day(date) % 2 = 0 THEN 'value' ELSE 'date' END AS reason FROM b WHERE day(date) % 7 = 0),
 n AS (SELECT *, lead(on_) OVER (PARTITION BY entity_id, date ORDER BY on_) AS next_ FROM x),
 l AS (SELECT n.entity_id, n.date, v AS live_storage_pct, confidence, on_ AS valid_from, coalesce(off_, next_) AS valid_to, reason
       FROM n LEFT JOIN t ON t.entity_id = n.entity_id AND t.date = n.date AND off_ >= on_ AND (next_ IS NULL OR off_ < next_)),
 s AS (SELECT * FROM l WHERE valid_from <= DATE '{_ON}' AND (valid_to IS NULL OR valid_to > DATE '{_ON}'))
"""


def _ledger(fx):
    base = fx.anchors.select(F.col("reservoir_id").alias("entity_id"), "date", "live_storage_pct", _confidence().alias("confidence"))
    day = F.dayofmonth("date")
    first = base.withColumn("recorded_on", F.date_add("date", 1))
    better = base.where(day % 4 == 0).withColumns(
        {"live_storage_pct": F.col("live_storage_pct") + 1, "confidence": F.lit("primary"), "recorded_on": F.date_add("date", 10)}
    )
    even = day % 2 == 0
    back = base.where(day % 7 == 0).select(
        "entity_id", "date", F.date_add("date", F.when(even, 20).otherwise(5)).alias("retracted_on"),
        F.concat(F.lit("wrong "), F.when(even, "value").otherwise("date")).alias("reason"),
    )
    return vw.anchor_ledger(first.unionByName(better), back)


@query("VW-3 AG-17", f"{_LEDGER} SELECT entity_id, date, live_storage_pct AS value, confidence, confidence IN ('primary','reported') AS verified, {_NAME} AS figure FROM s")
def figures_as_of(fx):
    """The figures as they stood on a day: corrected values, and none that had been taken back."""
    return vw.figures(vw.anchors_as_of(_ledger(fx), _ON), _NAMED)


@query("AG-17 VW-3", f"{_LEDGER} SELECT coalesce(confidence, 'total') AS confidence, count(*) AS n, count(*) FILTER (confidence IN ('primary','reported')) AS n_verified FROM s GROUP BY ROLLUP (confidence)".replace("coalesce(confidence, 'total')", "CASE WHEN grouping(confidence) = 1 THEN 'total' ELSE confidence END"))
def figure_summary(fx):
    return vw.figure_summary(vw.figures(vw.anchors_as_of(_ledger(fx), _ON), _NAMED))


@query("AG-17 VW-3", f"{_LEDGER} SELECT entity_id, date, live_storage_pct AS value FROM s WHERE confidence = 'secondhand'")
def unverified_figures(fx):
    return vw.figures(vw.anchors_as_of(_ledger(fx), _ON), _NAMED).where(~F.col("verified")).select("entity_id", "date", "value")


@query("VW-3", f"{_LEDGER} SELECT entity_id, date, live_storage_pct AS value, valid_to AS retracted_on, reason FROM l WHERE reason IS NOT NULL AND valid_to <= DATE '{_ON}'")
def retracted_figures(fx):
    return vw.retracted(_ledger(fx), _ON)


@query(
    "VW-4",
    """WITH c AS (SELECT 'district ' || district AS scope, n FROM (SELECT well_id, count(*) AS n FROM fx_obs GROUP BY 1) JOIN fx_wells USING (well_id)),
            b AS (SELECT * FROM c UNION ALL SELECT 'all', n FROM c)
       SELECT scope, count(*) AS n_wells, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM b GROUP BY 1""",
)
def reading_spread(fx):
    return vw.reading_spread(fx.base_wells, fx.readings)


@query(
    "VW-4",
    f"""WITH u AS (SELECT 'well' AS entity_type, split, entity_id, date FROM ({ts.RURAL_FEATURES}) UNION ALL SELECT 'reservoir', split, entity_id, date FROM ({ts.URBAN_FEATURES})),
            b AS (SELECT * FROM u WHERE split IS NOT NULL UNION ALL SELECT entity_type, 'all', entity_id, date FROM u)
       SELECT entity_type, split, count(*) AS n, min(date) AS first_date, max(date) AS last_date, count(DISTINCT entity_id) AS n_entities FROM b GROUP BY 1, 2""",
)
def split_coverage(fx):
    return vw.split_coverage(ts.rural_features(fx), ts.urban_features(fx))


@query("VW-4", "SELECT min(date) AS first_date, max(date) AS last_date, count(DISTINCT cell_id) AS n_entities, count(*) AS n FROM fx_weather")
def weather_span(fx):
    return vw.weather_span(fx.weather)


# --------------------------------------------------------------------- places
@query(
    "PL-1",
    """SELECT 'taluka' AS entity_type, taluka AS entity_id, taluka||' Taluka, '||district AS label, count(*) AS n_wells, trim(regexp_replace(lower(taluka), '[^a-z0-9]+', ' ', 'g')) AS key FROM fx_wells GROUP BY taluka, district
       UNION ALL SELECT 'well', well_id, village||', '||taluka||' Taluka, '||district, 1, trim(regexp_replace(lower(village), '[^a-z0-9]+', ' ', 'g')) FROM fx_wells""",
)
def gazetteer(fx):
    return pl.gazetteer(fx.base_wells).select("entity_type", "entity_id", "label", "n_wells", "key")


def _place_registry(fx):
    """Wells whose areas and villages are words, so that word matching has work."""
    return fx.base_wells.select(
        "well_id",
        F.lower("aquifer_type").alias("taluka"),
        F.lower(F.translate("district", "_", "")).alias("district"),
        F.concat(F.lit("v"), F.col("well_no")).alias("village"),
        F.lit(0).alias("n_observations"),
    )


def _place_requests(fx):
    k = F.col("user_no")
    text_of = (
        F.when(k % 6 == 0, F.concat(F.lit("Near "), F.initcap(F.lower("aquifer_type")), F.lit(" taluka")))
        .when(k % 6 == 1, F.concat(F.lit("village V"), k))
        .when(k % 6 == 2, F.concat(F.lit("Púne, ward "), k))
        .when(k % 6 == 3, F.concat(F.lit("xv"), k, F.lit("y")))
        .when(k % 6 == 4, F.lit("achin"))
        .otherwise(F.lit("nowhere at all"))
    )
    joined = fx.users.join(fx.base_wells.select("well_id", "aquifer_type"), "well_id")
    return joined.select(F.col("user_id").alias("request_id"), text_of.alias("place"), "role")


_PLACE_SQL = """
WITH g AS (SELECT 0 AS ko, 'taluka' AS entity_type, t AS entity_id, t AS key, t||'|'||d AS lo FROM (SELECT DISTINCT lower(aquifer_type) t, lower(replace(district,'_','')) d FROM fx_wells)
           UNION ALL SELECT 1, 'well', well_id, 'v'||well_no, well_id FROM fx_wells),
 q AS (SELECT user_id AS request_id, role, CASE user_no % 6 WHEN 0 THEN 'near '||lower(aquifer_type) WHEN 1 THEN 'v'||user_no WHEN 2 THEN 'pune ward '||user_no
         WHEN 3 THEN 'xv'||user_no||'y' WHEN 4 THEN 'achin' ELSE 'nowhere at all' END AS key
       FROM fx_users JOIN (SELECT well_id, aquifer_type FROM fx_wells) USING (well_id)),
 k AS (SELECT DISTINCT key FROM q),
 w AS (SELECT key, unnest(string_split(key,' ')) AS tok FROM k),
 city AS (SELECT DISTINCT key FROM w WHERE tok = 'pune'),
 hit AS (SELECT w.key, arg_min(g.entity_type, (ko, lo)) AS et, arg_min(g.entity_id, (ko, lo)) AS ei FROM w JOIN g ON g.key = w.tok GROUP BY 1),
 open AS (SELECT key FROM k WHERE key NOT IN (SELECT key FROM city) AND key NOT IN (SELECT key FROM hit)),
 fz AS (SELECT o.key, count(*) AS n, list(g.entity_id ORDER BY ko, lo, g.entity_id) AS ids, any_value(g.entity_type) AS et FROM open o JOIN g ON contains(o.key, g.key) OR contains(g.key, o.key) GROUP BY 1)
SELECT request_id, CASE WHEN c.key IS NOT NULL OR h.key IS NOT NULL OR fz.n = 1 THEN 'ok' WHEN fz.n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status,
       CASE WHEN c.key IS NOT NULL AND role LIKE 'society%' THEN 'reservoir' WHEN h.key IS NOT NULL THEN h.et WHEN c.key IS NOT NULL THEN 'reservoir' WHEN fz.n = 1 THEN fz.et END AS entity_type,
       CASE WHEN c.key IS NOT NULL AND role LIKE 'society%' THEN 'PUN_KHW' WHEN h.key IS NOT NULL THEN h.ei WHEN c.key IS NOT NULL THEN 'PUN_KHW' WHEN fz.n = 1 THEN fz.ids[1] END AS entity_id,
       CASE WHEN c.key IS NULL AND h.key IS NULL AND fz.n > 1 THEN array_to_string(fz.ids[1:8], ',') ELSE '' END AS candidates
FROM q LEFT JOIN city c USING (key) LEFT JOIN hit h USING (key) LEFT JOIN fz USING (key)"""


@query("PL-2 JN-17 SC-15", _PLACE_SQL)
def resolved_places(fx):
    gaz = pl.gazetteer(_place_registry(fx))
    out = pl.resolve_places(_place_requests(fx), gaz)
    return out.select("request_id", "status", "entity_type", "entity_id", F.array_join("candidates", ",").alias("candidates"))


@query(
    "TK-4",
    """WITH g AS (SELECT 'taluka' AS entity_type, taluka AS entity_id, trim(regexp_replace(lower(taluka),'[^a-z0-9]+',' ','g')) AS key, taluka||'|'||district AS lo FROM (SELECT DISTINCT taluka, district FROM fx_wells)),
            v AS (SELECT 'well' AS entity_type, well_id AS entity_id, trim(regexp_replace(lower(village),'[^a-z0-9]+',' ','g')) AS key, well_id AS lo FROM fx_wells),
            q AS (SELECT DISTINCT lower(substr(n_name, 3, 7)) AS query, trim(regexp_replace(lower(substr(n_name,3,7)),'[^a-z0-9]+',' ','g')) AS qk FROM nation UNION ALL SELECT 'custo', 'custo' UNION ALL SELECT 'pu', 'pu'),
            m AS (SELECT query, entity_type, entity_id, CASE WHEN starts_with(key, qk) THEN 0 ELSE 1 END AS rk, lo FROM q JOIN g ON contains(key, qk)
                  UNION ALL SELECT query, entity_type, entity_id, 2, lo FROM q JOIN v ON starts_with(key, qk)
                  UNION ALL SELECT query, 'reservoir', 'PUN_KHW', 3, 'pune' FROM q WHERE qk = 'pu')
       SELECT query, CAST(p AS INTEGER) AS position, entity_type, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rk, lo, entity_id) AS p FROM m) WHERE p <= 10""",
)
def typeahead(fx):
    n = fx.table("nation", "n_name").select(F.lower(F.substring("n_name", 3, 7)).alias("query")).distinct()
    fixed = fx.spark.createDataFrame([("custo",), ("pu",)], "query string")
    hits = pl.typeahead(n.unionByName(fixed), pl.gazetteer(fx.base_wells))
    return hits.select("query", "position", "entity_type", "entity_id")


# ------------------------------------------------------------------- audience
@query(
    "AU-1",
    """SELECT s.user_id AS sender_id, u.user_id FROM fx_users s JOIN fx_users u ON u.entity_id = s.entity_id AND u.user_id <> s.user_id WHERE s.role = 'society-manager' AND s.verified""",
)
def manager_audiences(fx):
    senders = fx.users.where(F.col("role") == "society-manager")
    return au.audience(fx.users, senders).select("sender_id", "user_id")


@query(
    "AU-1",
    """SELECT user_id AS sender_id, role, CASE WHEN role = 'society-manager' AND NOT verified THEN 0 WHEN role = 'government' THEN (SELECT count(*) FROM fx_users WHERE entity_id IS NOT NULL) - CASE WHEN entity_id IS NOT NULL THEN 1 ELSE 0 END
              ELSE coalesce(n - 1, 0) END AS audience
       FROM fx_users LEFT JOIN (SELECT entity_id, count(*) AS n FROM fx_users WHERE entity_id IS NOT NULL GROUP BY 1) USING (entity_id) WHERE role IN ('government', 'society-manager')""",
)
def audience_sizes(fx):
    return au.reach(fx.users, fx.users.where(F.col("role").isin("government", "society-manager")))


@query(
    "AU-1",
    """SELECT user_id AS sender_id, CASE WHEN role = 'government' THEN 'all' ELSE 'entity' END AS segment, CASE WHEN role <> 'government' THEN entity_id END AS entity_id,
              CASE WHEN role = 'government' THEN (SELECT count(*) FROM fx_users WHERE entity_id IS NOT NULL) ELSE (SELECT count(*) FROM fx_users x WHERE x.entity_id = s.entity_id) END AS members
       FROM fx_users s WHERE role = 'government' OR (role = 'society-manager' AND verified AND entity_id IS NOT NULL)""",
)
def audience_segments(fx):
    """The segment that each sender points at, and how many people it holds."""
    pointers = au.audience_pointers(fx.users)
    sizes = au.segment_sizes(fx.users).withColumnsRenamed({"segment": "_segment", "entity_id": "_entity"})
    met = (F.col("segment") == F.col("_segment")) & F.col("entity_id").eqNullSafe(F.col("_entity"))
    return pointers.join(sizes, met).drop("_segment", "_entity")


def _cards(fx):
    c = sc.rural_score(fx.readings, fx.base_wells, settings=fx.settings)
    return c.withColumn("headline", F.concat(F.col("forecast_level").cast("string"), F.lit(" m")))


_TEMPLATES = "(VALUES " + ", ".join(
    "('{}','{}','{}','{}')".format(*[v.replace("'", "''") for v in row]) for row in au.DEFAULT_TEMPLATES
) + ") t(grp, tband, tlang, template)"
_PLAN = f"""SELECT u.user_id, u.entity_id, u.role, u.lang, c.score, c.band,
     CASE WHEN c.status = 'ok' AND c.band IN ('ACT NOW','MONITOR') THEN 'planned' ELSE 'skipped' END AS action,
     CASE WHEN coalesce(c.status,'x') <> 'ok' THEN coalesce(c.reason,'no score') WHEN c.band = 'SAFE' THEN 'band not in bucket' END AS reason,
     CASE WHEN c.status = 'ok' AND c.band = 'ACT NOW' THEN 'caution' WHEN c.status = 'ok' AND c.band = 'MONITOR' THEN 'notice' END AS alert_type,
     CASE WHEN c.status = 'ok' AND c.band IN ('ACT NOW','MONITOR') THEN replace(replace(replace(replace(template, '{{place}}', coalesce(entity_label,'—')), '{{score}}', coalesce(CAST(score AS VARCHAR),'—')),
          '{{days}}', coalesce(CAST(days_to_crisis AS VARCHAR),'—')), '{{level}}', coalesce(CAST(forecast_level AS VARCHAR)||' m','—')) END AS body
   FROM ({_PEOPLE}) u LEFT JOIN fx_area_cards c ON c.entity_id = u.entity_id
   LEFT JOIN {_TEMPLATES} ON grp = CASE WHEN u.role = 'farmer' THEN 'farmer' ELSE 'society' END AND tband = coalesce(c.band,'SAFE') AND tlang = u.lang"""


@query("AU-2 SC-18", _PLAN)
def alert_plan(fx):
    return au.plan_alerts(_people(fx), _cards(fx), au.template_table(fx.spark), "all")


@query(
    "SC-18",
    """SELECT user_id, coalesce(name, '') || ' @ ' || coalesce(CASE WHEN user_no % 2 = 0 THEN entity_label END, place_raw, '') || ' # ' || coalesce(CAST(score AS VARCHAR), '—') AS body
       FROM (SELECT user_no, u.user_id, CASE WHEN user_no % 5 <> 0 THEN u.name END AS name, u.entity_label, u.place_raw, c.score, c.status FROM fx_users u JOIN fx_area_cards c ON c.entity_id = u.entity_id) WHERE status = 'ok'""",
)
def named_messages(fx):
    """A template of one's own with a name, and the typed place where there is no label."""
    k = F.col("user_no")
    people = fx.users.withColumns({"name": F.when(k % 5 != 0, F.col("name")), "entity_label": F.when(k % 2 == 0, F.col("entity_label"))})
    own = [(g, b, lang, "{name} @ {place} # {score}") for g in ("farmer", "society") for b in ("SAFE", "MONITOR", "ACT NOW") for lang in ("mr", "hi", "en")]
    templates = fx.spark.createDataFrame(own, "grp string, band string, lang string, template string")
    return au.plan_alerts(people, _cards(fx), templates, "all", force=True).where(F.col("action") == "planned").select("user_id", "body")


@query(
    "AU-2",
    f"SELECT count(*) AS audience, count(*) FILTER (action='planned') AS planned, count(*) FILTER (alert_type='caution') AS caution, count(*) FILTER (alert_type='notice') AS notice, count(*) FILTER (action='skipped') AS skipped FROM ({_PLAN})",
)
def alert_plan_counts(fx):
    return au.plan_counts(au.plan_alerts(_people(fx), _cards(fx), au.template_table(fx.spark), "all"))


@query(
    "AU-3",
    """SELECT 'users' AS table_name, count(*) AS n_rows, 0 AS n_detached FROM fx_users WHERE user_no % 9 <> 0
       UNION ALL SELECT 'alerts', count(*), count(*) FILTER (CAST(substr(user_id,2) AS BIGINT) % 9 = 0) FROM fx_alerts
       UNION ALL SELECT 'alerts_purged', count(*), 0 FROM fx_alerts WHERE CAST(substr(user_id,2) AS BIGINT) % 9 <> 0""",
)
def erased_users(fx):
    gone = fx.users.where(F.col("user_no") % 9 == 0)
    left, kept = au.erase_users(fx.users, fx.alerts, gone)
    _, purged = au.erase_users(fx.users, fx.alerts, gone, purge_alerts=True)

    def row(df, name):
        return df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("user_id").isNull()).alias("n_detached"))

    return dq.stack([row(left, "users"), row(kept, "alerts"), row(purged, "alerts_purged")])


@query(
    "AU-4 JN-15 SC-13 SC-14 SC-16",
    """SELECT user_id, strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS registered_ist, strftime(created_at, '%Y-%m-%d %H:%M') AS registered_utc, role, name,
              CASE WHEN phone IS NULL THEN '—' ELSE '+91 XXXXX '||right(phone,4) END AS phone, lang, coalesce(entity_label, place_raw) AS place, CASE WHEN verified THEN 'yes' ELSE 'NO' END AS verified,
              CASE WHEN has_password THEN 'signup' ELSE 'auto' END AS origin, coalesce(n,0) AS alerts
       FROM fx_users LEFT JOIN (SELECT user_id, count(*) n FROM fx_alerts GROUP BY 1) USING (user_id) WHERE role = 'farmer' AND created_at >= TIMESTAMP '2024-01-10'""",
)
def user_listing(fx):
    return au.user_listing(fx.users, fx.alerts, role="farmer", since="2024-01-10")


@query("JN-15", "SELECT user_id, coalesce(n,0) AS alerts FROM fx_users LEFT JOIN (SELECT user_id, count(*) n FROM fx_alerts GROUP BY 1) USING (user_id)")
def user_alert_counts(fx):
    return au.alert_counts(fx.users, fx.alerts).select("user_id", "alerts")


@query(
    "SC-13 SC-14",
    """SELECT user_id, phone_raw, phone, CASE WHEN phone IS NULL THEN '—' ELSE '+91 XXXXX '||right(phone,4) END AS masked,
              CASE WHEN phone IS NOT NULL THEN substr(phone,1,3)||' '||substr(phone,4,5)||' '||substr(phone,9) END AS pretty FROM fx_users""",
)
def phone_numbers(fx):
    p = text.phone_e164(F.col("phone_raw"))
    return fx.users.select("user_id", "phone_raw", p.alias("phone"), text.mask_phone(p).alias("masked"), text.pretty_phone(p).alias("pretty"))


@query(
    "AG-21",
    """SELECT 'role' AS facet, role AS value, count(*) AS n FROM fx_users GROUP BY 2 UNION ALL SELECT 'lang', lang, count(*) FROM fx_users GROUP BY 2
       UNION ALL SELECT 'day', strftime(created_at + INTERVAL 330 MINUTE, '%Y-%m-%d'), count(*) FROM fx_users GROUP BY 2
       UNION ALL SELECT 'origin', CASE WHEN has_password THEN 'signup' ELSE 'auto' END, count(*) FROM fx_users GROUP BY 2""",
)
def user_tallies(fx):
    return au.user_tallies(fx.users)


# -------------------------------------------------------------------- reports
_CR1 = f"""
WITH p AS (SELECT x.report_id, any_value(x.level_mbgl) AS y, any_value(w.well_depth) AS depth,
          count(o.level_mbgl) AS na, avg(o.level_mbgl) AS ma, var_samp(o.level_mbgl) AS va,
          count(o.level_mbgl) FILTER (o.season = {season('month(x.reported_for)')}) AS ns, avg(o.level_mbgl) FILTER (o.season = {season('month(x.reported_for)')}) AS ms,
          var_samp(o.level_mbgl) FILTER (o.season = {season('month(x.reported_for)')}) AS vs
   FROM fx_reports x LEFT JOIN fx_obs o ON o.well_id = x.well_id AND o.obs_date <= x.reported_for LEFT JOIN fx_wells w ON w.well_id = x.well_id GROUP BY 1),
 c AS (SELECT report_id, y, depth, CASE WHEN ns >= 3 THEN ns ELSE na END AS n, CASE WHEN ns >= 3 THEN ms ELSE ma END AS mu, greatest(sqrt(CASE WHEN ns >= 3 THEN vs ELSE va END), 0.25e0) AS sd FROM p),
 v AS (SELECT *, CASE WHEN y < 0 THEN 'negative' WHEN y > 200 THEN 'implausible_depth' WHEN depth > 0 AND y > depth*1.05e0 THEN 'deeper_than_well' WHEN n < 2 THEN 'no_history'
          WHEN abs((y-mu)/sd) <= 2 THEN 'within_history' WHEN abs((y-mu)/sd) <= 3.5 THEN 'unusual' ELSE 'outlier' END AS reason FROM c)
SELECT report_id, CASE reason WHEN 'within_history' THEN 'accepted' WHEN 'no_history' THEN 'flagged' WHEN 'unusual' THEN 'flagged' ELSE 'rejected' END AS status, reason,
  CASE WHEN ok THEN {r('mu',5)} END AS prior_mean, CASE WHEN ok THEN {r('sd',5)} END AS prior_sd, CASE WHEN ok THEN {r('(y-mu)/sd',5)} END AS z_score,
  CASE WHEN ok THEN {r('(mu + y*sd*sd)/(sd*sd+1)',5)} END AS post_mean, CASE WHEN ok THEN {r('sqrt(sd*sd/(sd*sd+1))',5)} END AS post_sd,
  CASE WHEN reason IN ('negative','implausible_depth') THEN 0 ELSE n END AS n_prior_obs
FROM (SELECT *, reason IN ('within_history','unusual','outlier') AS ok FROM v)"""
_ROUND = ("prior_mean", "prior_sd", "z_score", "post_mean", "post_sd")


@query("CR-1 SC-11", _CR1)
def validated_reports(fx):
    out = rp.validate_reports(fx.reports, fx.readings, fx.base_wells, fx.settings)
    return out.select("report_id", *rp.VERDICT_COLUMNS).withColumns({c: half_even(F.col(c), 5) for c in _ROUND})


@query("TK-5", "SELECT report_id, created_at, well_id FROM fx_reports ORDER BY created_at DESC, report_id LIMIT 50")
def report_history(fx):
    return rp.report_history(fx.reports, 50).select("report_id", "created_at", "well_id")


@query(
    "TK-3",
    """SELECT taluka, well_id, n_observations FROM (SELECT *, row_number() OVER (PARTITION BY taluka ORDER BY n_observations DESC, well_id) k FROM fx_registry) WHERE k = 1""",
)
def longest_record_wells(fx):
    return rp.longest_record_well(fx.wells)


@query(
    "CR-1",
    """WITH b AS (SELECT taluka, well_id FROM (SELECT *, row_number() OVER (PARTITION BY taluka ORDER BY n_observations DESC, well_id) k FROM fx_registry) WHERE k = 1)
       SELECT q.request_no, CASE WHEN q.well_id IS NULL THEN b.well_id WHEN w.well_id IS NOT NULL THEN q.well_id END AS resolved_well
       FROM (SELECT well_no AS request_no, taluka, CASE well_no % 3 WHEN 0 THEN well_id WHEN 1 THEN 'unknown' END AS well_id FROM fx_wells) q
       LEFT JOIN b USING (taluka) LEFT JOIN fx_wells w ON w.well_id = q.well_id""",
)
def resolved_wells(fx):
    """Requests that name a well, one that is not known, or only their area."""
    k = F.col("well_no") % 3
    named = F.when(k == 0, F.col("well_id")).when(k == 1, F.lit("unknown"))
    asked = fx.base_wells.select(F.col("well_no").alias("request_no"), "taluka", named.alias("well_id"))
    return rp.resolve_wells(asked, fx.wells).select("request_no", "resolved_well")


@query(
    "SC-12",
    """SELECT event_id, message, CASE WHEN regexp_full_match(lower(message), '\\s*(depth\\s*[:=]?\\s*)?\\d+([.,]\\d+)?\\s*(m|mtr|mtrs|meter|meters|metre|metres|मीटर|मी)?\\s*')
         THEN CAST(replace(regexp_extract(message, '\\d+([.,]\\d+)?'), ',', '.') AS DOUBLE) END AS depth
       FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN v WHEN 1 THEN 'Depth: '||replace(v,'.',',')||' m' WHEN 2 THEN v||' मीटर' WHEN 3 THEN 'Ward '||event_id||' '||event_type WHEN 4 THEN ' '||v||'METRES ' ELSE v||' feet' END AS message
             FROM (SELECT *, CAST(value AS VARCHAR) AS v FROM events))""",
)
def parsed_depths(fx):
    e = fx.table("events", "event_id", "event_type", "value")
    k, v = F.col("event_id"), F.col("value").cast("string")
    message = (
        F.when(k % 6 == 0, v)
        .when(k % 6 == 1, F.concat(F.lit("Depth: "), F.replace(v, F.lit("."), F.lit(",")), F.lit(" m")))
        .when(k % 6 == 2, F.concat(v, F.lit(" मीटर")))
        .when(k % 6 == 3, F.concat(F.lit("Ward "), k, F.lit(" "), F.col("event_type")))
        .when(k % 6 == 4, F.concat(F.lit(" "), v, F.lit("METRES ")))
        .otherwise(F.concat(v, F.lit(" feet")))
    )
    return e.select("event_id", message.alias("message"), text.parse_depth(message).alias("depth"))
