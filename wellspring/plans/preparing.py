"""Queries: sources, reshapes, registry preparation and keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wellspring.functions import calendar as cal
from wellspring.functions import geo
from wellspring.functions.numeric import half_even, to_double
from wellspring.functions.text import clean_name, plain
from wellspring.operators import features as ft
from wellspring.operators import ordering as order
from wellspring.operators import prepare as prep
from wellspring.operators import quality as dq
from wellspring.operators import views as vw
from wellspring.plans.registry import query
from wellspring.plans.sql_views import haversine, r, season, split
from wellspring.sources import readers, writers

BOX = dict(lat_min=16.5, lat_max=21.0, lon_min=73.0, lon_max=80.0)


@query(
    "SRC-3",
    """SELECT o_orderpriority AS priority, count(*) AS n, min(CAST(o_orderdate AS DATE)) AS first_day
       FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def pruned_parquet_read(fx):
    o = readers.read_columns(fx.spark, f"{fx.dir}/orders.parquet", ["o_orderpriority", "o_orderdate", "o_orderstatus"])
    return o.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("o_orderdate").cast("date")).alias("first_day")
    )


@query(
    "SRC-4",
    f"""SELECT cell_id, date, precip_mm, {r('et0_mm',6)} AS et0_mm, {r('temp_max',6)} AS temp_max FROM fx_weather
        ORDER BY 1,2""",
)
def weather_from_array_payloads(fx):
    """Each cell's series packed as one JSON payload, then read back from the text."""
    names = {v: k for k, v in readers.ARRAY_DAILY.items()}
    day = F.struct(F.col("date").cast("string").alias("time"), *[F.col(c).alias(n) for c, n in names.items()])
    packed = fx.weather.groupBy("cell_id").agg(F.sort_array(F.collect_list(day)).alias("d"))
    payload = F.to_json(
        F.struct(F.struct(F.col("d.time").alias("time"), *[F.col(f"d.{n}").alias(n) for n in names.values()]).alias("daily")),
        {"ignoreNullFields": "false"},
    )
    rows = readers.weather_from_arrays(packed.select("cell_id", payload.alias("payload")))
    return rows.select(
        "cell_id", "date", "precip_mm", half_even(F.col("et0_mm"), 6).alias("et0_mm"),
        half_even(F.col("temp_max"), 6).alias("temp_max"),
    )


@query(
    "SRC-5 SC-2",
    f"""SELECT cell_id, date, precip_mm, temp_max,
          {r('''CASE WHEN temp_max IS NOT NULL THEN greatest(0e0, 0.0023e0*(temp_max-5e0+17.8e0)*sqrt(greatest(0e0,10e0))*0.408e0
             *(24*60/pi()*0.0820e0)*(1+0.033e0*cos(2*pi()*doy/365e0))
             *(ws*sin(phi)*sin(dec)+cos(phi)*cos(dec)*sin(ws))) END''',6)} AS et0_mm
        FROM (SELECT *, acos(least(1e0,greatest(-1e0,-tan(phi)*tan(dec)))) AS ws
              FROM (SELECT *, radians(18e0 + CAST(cell_id AS INTEGER) % 5) AS phi, 0.409e0*sin(2*pi()*doy/365e0-1.39e0) AS dec
                    FROM (SELECT *, dayofyear(date) AS doy FROM fx_weather)))""",
)
def weather_from_map_payloads(fx):
    """Date-keyed JSON maps with a fill value, ET0 derived from temperatures."""
    fill = lambda c: F.coalesce(c, F.lit(readers.MAP_FILL))
    tmax = F.col("temp_max")
    series = {
        "PRECTOTCORR": F.col("precip_mm"), "T2M_MAX": tmax, "T2M_MIN": tmax - 10, "T2M": tmax - 5, "RH2M": F.lit(None).cast("double"),
    }
    day = F.date_format("date", "yyyyMMdd")
    packed = fx.weather.groupBy("cell_id").agg(
        *[F.map_from_entries(F.collect_list(F.struct(day, fill(c)))).alias(n) for n, c in series.items()]
    )
    payload = F.to_json(F.struct(F.struct(F.struct(*series).alias("parameter")).alias("properties")))
    lat = F.lit(18.0) + F.col("cell_id").cast("int") % 5
    rows = readers.weather_from_maps(packed.select("cell_id", lat.alias("lat"), payload.alias("payload")))
    return rows.select("cell_id", "date", "precip_mm", "temp_max", half_even(F.col("et0_mm"), 6).alias("et0_mm"))


_WORDS = ("the", "and", "les", "des", "que", "tion", "eau", "ent")
# A name ends in a letter, so its word ends where another kind of character follows.
_WORD_PERCENTS = " UNION ALL ".join(
    rf"SELECT page_id, '{w.upper()}' AS reservoir_id, regexp_extract(t, '(?i){w}[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}].{{0,399}}?(\p{{Nd}}{{1,3}}(?:\.\p{{Nd}}+)?) *%', 1) AS pct FROM flat"
    for w in _WORDS
)


@query(
    "SRC-6",
    rf"""WITH flat AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]+>', '|', 'g'), '[\t-\r\x{{85}}\p{{Z}}]+', ' ', 'g') AS t FROM pages)
        SELECT page_id, reservoir_id, CAST(pct AS DOUBLE) AS live_storage_pct FROM ({_WORD_PERCENTS}) WHERE pct <> ''""",
)
def percents_in_pages(fx):
    """Aliases are the commonest words of the pages, so that some occur."""
    return readers.percents_from_pages(fx.table("pages", "page_id", "html"), {w: w.upper() for w in _WORDS})


def _pages_with_dams(fx):
    """All pages with two storage figures added, in tags and with odd spaces, one of them late."""
    figure = F.concat(
        F.lit("<p>Khadak\u00a0\n <b>Dam</b></p> storage of "), (F.col("page_id") % 100).cast("string"),
        F.lit(".5 % of 90 %"), F.when(F.col("page_id") % 2 == 1, F.lit("<td>UPPER DAM<td>77%")).otherwise(F.lit("<td>Upper Dam<td>none")),
    )
    return fx.table("pages", "page_id", "html").withColumn("html", F.concat(F.coalesce("html", F.lit("")), figure))


_DAMS = {"Khadak |Dam": "KHADAK", "Upper Dam": "UPPER"}
_PERCENTS = """SELECT page_id, 'KHADAK' AS reservoir_id, page_id % 100 + 0.5e0 AS live_storage_pct FROM pages
       UNION ALL SELECT page_id, 'UPPER', 77e0 FROM pages WHERE page_id % 2 = 1"""


@query("SRC-6", _PERCENTS)
def scraped_percents(fx):
    """Figures behind names that tags and spaces interrupt."""
    return readers.percents_from_pages(_pages_with_dams(fx), _DAMS)


@query("SRC-6", f"SELECT reservoir_id, min(page_id) AS page_id, arg_min(live_storage_pct, page_id) AS live_storage_pct FROM ({_PERCENTS}) GROUP BY 1")
def first_scraped_percents(fx):
    """One figure per reservoir over all pages."""
    return readers.first_percents(readers.percents_from_pages(_pages_with_dams(fx), _DAMS))


def _target_and_batch(fx):
    base = fx.readings.select("well_id", "obs_date", "level_mbgl", "season")
    target = base.where(F.col("obs_date") < F.lit("1999-01-01").cast("date"))
    batch = base.where(F.col("obs_date") >= F.lit("1998-01-01").cast("date")).withColumn("level_mbgl", F.col("level_mbgl") + 1)
    return target, batch


@query(
    "SNK-1",
    """SELECT well_id, obs_date, CASE WHEN obs_date >= DATE '1998-01-01' THEN level_mbgl + 1 ELSE level_mbgl END AS level_mbgl, CASE WHEN obs_date < DATE '1999-01-01' THEN season END AS season FROM fx_obs""",
)
def keyed_upsert(fx):
    """A batch with every key twice and without the season, which the stored rows keep."""
    target, batch = _target_and_batch(fx)
    batch = batch.drop("season")
    doubled = batch.withColumn("_seq", F.lit(2)).unionByName(
        batch.withColumn("level_mbgl", F.lit(-1.0)).withColumn("_seq", F.lit(1))
    )
    return writers.upsert(target, doubled, ["well_id", "obs_date"], F.col("_seq"))


@query(
    "SNK-2",
    """SELECT well_id, obs_date, CASE WHEN obs_date >= DATE '1999-01-01' THEN level_mbgl + 1 ELSE level_mbgl END AS level_mbgl, CASE WHEN obs_date < DATE '1999-01-01' THEN season END AS season FROM fx_obs""",
)
def keyed_insert_ignore(fx):
    """A batch with every key twice, of which the first counts, and without the season."""
    target, batch = _target_and_batch(fx)
    doubled = batch.withColumn("_seq", F.lit(1)).unionByName(
        batch.withColumn("level_mbgl", F.lit(-1.0)).withColumn("_seq", F.lit(2))
    )
    return writers.insert_ignore(target, doubled.drop("season"), ["well_id", "obs_date"], F.col("_seq"))


@query(
    "SNK-1 SNK-3",
    """SELECT well_id, obs_date, CASE WHEN season = 'monsoon' AND obs_date >= DATE '1998-01-01' THEN level_mbgl + 1 ELSE level_mbgl END AS level_mbgl, season FROM fx_obs""",
)
def upserted_partitions(fx):
    """A stored table of which the batch touches one season's partition."""
    path = fx.fresh_dir("seasons")
    rows = fx.readings.select("well_id", "obs_date", "level_mbgl", "season")
    writers.replace_table(rows, path, ["season"])
    batch = rows.where((F.col("season") == "monsoon") & (F.col("obs_date") >= F.lit("1998-01-01").cast("date")))
    batch = batch.withColumn("level_mbgl", F.col("level_mbgl") + 1)
    writers.upsert_partitions(path, batch, ["well_id", "obs_date", "season"], F.col("level_mbgl"), ["season"])
    return fx.spark.read.parquet(path).select(*rows.columns)


@query(
    "PR-1",
    f"""SELECT well_id, 'ST'||substr(md5(CAST({r('lat',4)} AS VARCHAR)||'|'||CAST({r('lon',4)} AS VARCHAR)||'|'||lower(trim(village))),1,10) AS station_id
        FROM fx_wells""",
)
def station_ids(fx):
    from wellspring.functions.text import station_id

    return fx.base_wells.select("well_id", station_id(F.col("lat"), F.col("lon"), F.col("village"), "ST").alias("station_id"))


@query("PR-2", "SELECT well_id, district FROM fx_wells WHERE lower(trim(district)) = 'nation_3'")
def wells_in_state(fx):
    return prep.in_state(fx.base_wells, "district", " Nation_3 ").select("well_id", "district")


@query(
    "PR-3",
    """SELECT p_partkey, nullif(nullif(nullif(list_aggregate(list_transform(regexp_extract_all(lower(regexp_replace(trim(t), '\\s+', ' ', 'g')), '[a-z]+|[^a-z]+'),
              lambda x: upper(x[1])||x[2:]), 'string_agg', ''), 'Nan'), '-'), '') AS name
       FROM (SELECT p_partkey, p_name||'  '||p_brand||'-'||p_type AS t FROM part)""",
)
def cleaned_names(fx):
    p = fx.table("part", "p_partkey", "p_name", "p_brand", "p_type")
    text = F.concat(F.col("p_name"), F.lit("  "), F.col("p_brand"), F.lit("-"), F.col("p_type"))
    return p.select("p_partkey", clean_name(text).alias("name"))


@query(
    "PR-4 PR-5 PR-6 SRC-2",
    f"SELECT well_id, obs_date, {r('level_mbgl',6)} AS level_mbgl, season, source, is_last_5y FROM fx_long",
)
def unpivoted_periods(fx):
    long = prep.unpivot_periods(fx.wide, ["well_id"], "wide", fx.settings)
    return long.withColumn("level_mbgl", half_even(F.col("level_mbgl"), 6))


@query(
    "SRC-2 PR-4",
    f"SELECT well_id, obs_date, {r('level_mbgl',6)} AS level_mbgl, season, source, is_last_5y FROM fx_long",
)
def wide_file_periods(fx):
    """The wide table written as a CSV file and read by the station file reader."""
    path = fx.fresh_dir("wide")
    kept = [f for f in fx.wide.schema.fields if f.name not in ("well_no", "nation_no")]
    attributes = {f.name: f.dataType.simpleString() for f in kept if "-" not in f.name}
    periods = [f.name for f in kept if "-" in f.name]
    writers.export_csv(fx.wide, path, [*attributes, *periods])
    wide = readers.read_wide_stations(fx.spark, path, attributes, periods)
    long = prep.unpivot_periods(wide, ["well_id"], "wide", fx.settings)
    return long.withColumn("level_mbgl", half_even(F.col("level_mbgl"), 6))


@query(
    "PR-7 PR-5",
    f"""SELECT well_id, obs_date, {season('month(obs_date)')} AS season, {split('obs_date')} AS split
        FROM fx_obs WHERE {split('obs_date')} IS NOT NULL""",
)
def chronological_split(fx):
    d = F.col("obs_date")
    return fx.readings.select(
        "well_id", "obs_date", cal.season_of(d, fx.settings).alias("season"), cal.split_of(d, fx.settings).alias("split")
    ).where(F.col("split").isNotNull())


@query(
    "PR-8",
    """SELECT district, count(*) FILTER (lat BETWEEN 16.5e0 AND 21e0 AND lon BETWEEN 73e0 AND 80e0) AS kept,
              count(*) FILTER (NOT (lat BETWEEN 16.5e0 AND 21e0 AND lon BETWEEN 73e0 AND 80e0)) AS dropped FROM fx_wells GROUP BY 1""",
)
def bounding_box(fx):
    inside = prep.box_condition(fx.settings.with_(**BOX))
    return fx.base_wells.groupBy("district").agg(F.count_if(inside).alias("kept"), F.count_if(~inside).alias("dropped"))


@query(
    "PR-9",
    "SELECT well_id, round_even(round_even(lat/0.25e0,0)*0.25e0*1e4,0)/1e4 AS grid_lat, round_even(round_even(lon/0.25e0,0)*0.25e0*1e4,0)/1e4 AS grid_lon FROM fx_wells",
)
def grid_snap(fx):
    return prep.with_cells(fx.base_wells, 0.25).select("well_id", "grid_lat", "grid_lon")


_WINDOWS = """SELECT well_id, CAST(greatest(coalesce(first_obs, DATE '1997-01-01') - 120, DATE '1995-01-01') AS DATE) AS start,
              CAST(least(coalesce(last_obs + 60, DATE '2001-11-04'), DATE '2001-11-04') AS DATE) AS "end" FROM fx_registry"""


@query("PR-10", _WINDOWS)
def fetch_windows(fx):
    return prep.fetch_windows(fx.wells, fx.settings).select("well_id", "start", "end")


@query(
    "PR-11",
    """SELECT event_id, try_cast(substr(props, 7, 2) AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS kind FROM events""",
)
def numeric_coercion(fx):
    e = fx.table("events", "event_id", "event_type", "props")
    return e.select("event_id", to_double(F.substring("props", 7, 2)).alias("k"), to_double(F.col("event_type")).alias("kind"))


@query("PR-12 AG-17", "SELECT reservoir_id, date, live_storage_pct, storage_mcm, source FROM fx_anchors")
def storage_volume(fx):
    return fx.anchors


_NULLS = ["last_obs_level", "prev_obs_level", "rain_7d", "rain_since_obs", "well_depth", "clim_season", "rh_mean"]


@query(
    "PR-13",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {r(f'1e0 - count({c})/count(*)', 6)} AS null_share, count({c}) = 0 AS all_null, "
        f"count({c}) > 0 AND 1e0 - count({c})/count(*) > 0.2 AS sparse FROM (SELECT *, CAST(NULL AS DOUBLE) AS rh_mean FROM fx_causal)"
        for c in _NULLS
    ),
)
def feature_null_rates(fx):
    rates = ft.null_rates(fx.causal, _NULLS)
    return rates.withColumn("null_share", half_even(F.col("null_share"), 6))


@query(
    "PR-14",
    """SELECT user_id, role, name, lang, entity_type, entity_id, entity_label, verified,
              role = 'government' OR (role = 'society-manager' AND verified) AS can_send FROM fx_users""",
)
def public_profiles(fx):
    return vw.public_profile(fx.users)


@query(
    "JN-6 SC-1",
    f"""SELECT w.well_id, arg_min(d.well_id, (km, d.well_id)) AS donor_id, {r('min(km)',6)} AS donor_km
        FROM (SELECT w.well_id, w.lat, w.lon, d.well_id AS dw, d.lat AS dlat, d.lon AS dlon, {haversine('w','d')} AS km
              FROM fx_wells w CROSS JOIN fx_donors d) x JOIN fx_wells w ON w.well_id = x.well_id JOIN fx_donors d ON d.well_id = x.dw
        GROUP BY 1""",
)
def nearest_donors(fx):
    out = prep.nearest_donor(fx.base_wells.select("well_id", "lat", "lon"), fx.donors, "reference_sy")
    return out.select("well_id", "donor_id", half_even(F.col("donor_km"), 6).alias("donor_km"))


@query(
    "JN-7",
    """SELECT 'reading_without_donor' AS kind, count(*) AS n FROM fx_obs WHERE well_id NOT IN (SELECT well_id FROM fx_donors)
       UNION ALL SELECT 'cell_without_weather', count(*) FROM (SELECT DISTINCT cell_id FROM fx_cells) WHERE cell_id NOT IN (SELECT cell_id FROM fx_weather_raw)
       UNION ALL SELECT 'reading_day_without_weather', count(*) FROM fx_obs JOIN fx_cells USING (well_id)
                 WHERE NOT EXISTS (SELECT 1 FROM fx_weather_raw w WHERE w.cell_id = fx_cells.cell_id AND w.date = fx_obs.obs_date)""",
)
def missing_partners(fx):
    def count(df, kind):
        return df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))

    wet = fx.weather.where(F.col("precip_mm").isNotNull()).select("cell_id", "date")
    days = fx.readings.join(fx.cells, "well_id").withColumnRenamed("obs_date", "date")
    return dq.stack(
        [
            count(fx.readings.join(fx.donors.select("well_id"), "well_id", "left_anti"), "reading_without_donor"),
            count(fx.cells.select("cell_id").distinct().join(wet, "cell_id", "left_anti"), "cell_without_weather"),
            count(days.join(wet, ["cell_id", "date"], "left_anti"), "reading_day_without_weather"),
        ]
    )


_QC = f"""SELECT well_id, CAST(sum(n) AS BIGINT) AS n_obs, CAST(max(y)-min(y)+1 AS INTEGER) AS yrs_span, min(lo) AS min_lvl, max(hi) AS max_lvl,
            any_value(max_run) AS max_run, count(*) FILTER (n >= 2)/(max(y)-min(y)+1) AS yr_cov
     FROM (SELECT well_id, year(obs_date) y, count(*) n, min(level_mbgl) lo, max(level_mbgl) hi FROM fx_long GROUP BY 1,2)
     JOIN (SELECT well_id, max(c) AS max_run FROM (SELECT well_id, isl, count(*) c FROM
              (SELECT *, sum(ch) OVER (PARTITION BY well_id ORDER BY obs_date) isl FROM
                 (SELECT *, CASE WHEN level_mbgl = lag(level_mbgl) OVER (PARTITION BY well_id ORDER BY obs_date) THEN 0 ELSE 1 END ch FROM fx_long)) GROUP BY 1,2) GROUP BY 1) USING (well_id)
     GROUP BY well_id"""
_QC_FLAGS = f"""SELECT *, n_obs < 8 AS fail_readings, yr_cov < 0.3 AS fail_yr_cov, max_run >= 2 AS fail_repeat,
                  min_lvl <= 0 OR max_lvl > 100 AS fail_range,
                  NOT (n_obs < 8 OR yr_cov < 0.3 OR max_run >= 2 OR min_lvl <= 0 OR max_lvl > 100) AS keep FROM ({_QC})"""


@query(
    "AG-1 WN-11",
    f"SELECT well_id, n_obs, yrs_span, {r('yr_cov',6)} AS yr_cov, max_run, {r('min_lvl',6)} AS min_lvl, {r('max_lvl',6)} AS max_lvl, fail_readings, fail_yr_cov, fail_repeat, fail_range, keep FROM ({_QC_FLAGS})",
)
def quality_profile(fx):
    long = prep.unpivot_periods(fx.wide, ["well_id"], "wide", fx.settings)
    p = prep.qc_profile(long, fx.settings).drop("first_obs", "last_obs")
    return p.withColumns({c: half_even(F.col(c), 6) for c in ("yr_cov", "min_lvl", "max_lvl")})


@query(
    "JN-8",
    f"SELECT taluka, count(*) AS n_readings, {r('sum(level_mbgl)',4)} AS total_level FROM fx_long JOIN ({_QC_FLAGS}) q USING (well_id) JOIN fx_wells USING (well_id) WHERE keep GROUP BY 1",
)
def readings_of_kept_wells(fx):
    long = prep.unpivot_periods(fx.wide, ["well_id"], "wide", fx.settings)
    kept = long.join(prep.qc_profile(long, fx.settings).where("keep"), "well_id", "left_semi")
    return kept.join(fx.base_wells.select("well_id", "taluka"), "well_id").groupBy("taluka").agg(
        F.count(F.lit(1)).alias("n_readings"), half_even(F.sum("level_mbgl"), 4).alias("total_level")
    )


_MODAL = """SELECT district, reference_sy AS modal FROM (SELECT district, reference_sy, row_number() OVER (PARTITION BY district ORDER BY count(*) DESC, reference_sy) k
            FROM fx_donors GROUP BY 1,2) WHERE k = 1"""


@query("AG-2", _MODAL)
def modal_yield(fx):
    return prep.modal_value(fx.donors, "district", "reference_sy")


@query("AG-3", "SELECT well_id, CAST(count(*) AS INTEGER) AS n_observations, min(obs_date) AS first_obs, max(obs_date) AS last_obs FROM fx_obs GROUP BY 1")
def registry_stats(fx):
    return prep.registry_stats(fx.readings)


@query(
    "AG-3",
    f"""SELECT w.*, o.*, 'orders' AS file, {r('observations/greatest(wells,1)',1)} AS obs_per_well,
          CASE WHEN wells >= 150 THEN 'GREEN' WHEN wells >= 50 THEN 'AMBER' WHEN wells >= 1 THEN 'RED' ELSE 'STOP' END AS verdict
        FROM (SELECT count(*) AS wells, count(DISTINCT district) AS districts, count(DISTINCT taluka) AS tehsils,
                     count(*) FILTER (lower(trim(taluka)) = 'nation_1-machinery') AS focus_wells FROM fx_wells) w,
             (SELECT count(*) AS observations, min(obs_date) AS first_obs, max(obs_date) AS last_obs, count(*) FILTER (is_last_5y) AS last5y_obs FROM fx_obs) o""",
)
def station_file_summary(fx):
    return prep.file_summary(fx.base_wells, fx.readings, "orders", "NATION_1-MACHINERY")


@query(
    "AG-4",
    """SELECT district, count(DISTINCT reference_sy) AS n_distinct, count(*) AS n_rows, min(reference_sy) AS min_value, max(reference_sy) AS max_value FROM fx_donors GROUP BY 1""",
)
def yield_by_district(fx):
    return prep.distinct_value_diagnosis(fx.donors, "district", "reference_sy")


@query(
    "AG-5",
    f"""SELECT {r("avg(level_mbgl) FILTER (season='pre_monsoon')",6)} AS pre_monsoon_mean, {r("avg(level_mbgl) FILTER (season='monsoon')",6)} AS monsoon_mean,
        avg(level_mbgl) FILTER (season='pre_monsoon') > avg(level_mbgl) FILTER (season='monsoon') AS sign_ok FROM fx_obs""",
)
def sign_convention(fx):
    g = prep.sign_gate(fx.readings)
    return g.withColumns({c: half_even(F.col(c), 6) for c in ("pre_monsoon_mean", "monsoon_mean")})


_SR1 = f"""SELECT g.well_id, g.lat, g.lon, coalesce(d.reference_sy, m.modal, nb.sy) AS specific_yield,
         CASE WHEN d.reference_sy IS NOT NULL THEN 'measured' WHEN m.modal IS NOT NULL THEN 'district_modal' ELSE 'nearest_well' END AS sy_source,
         CASE WHEN d.reference_sy IS NOT NULL THEN 0e0 WHEN m.modal IS NOT NULL THEN NULL ELSE {r('nb.km',1)} END AS sy_donor_km,
         s.n_observations, s.first_obs, s.last_obs
   FROM fx_wells g JOIN ({_QC_FLAGS}) q ON q.well_id = g.well_id AND q.keep
   LEFT JOIN fx_donors d ON d.well_id = g.well_id
   LEFT JOIN ({_MODAL}) m ON m.district = g.district
   LEFT JOIN (SELECT well_id, arg_min(sy, (km, dw)) AS sy, min(km) AS km FROM (
        SELECT w.well_id, d.well_id AS dw, d.reference_sy AS sy, {haversine('w','d')} AS km FROM fx_wells w CROSS JOIN fx_donors d) GROUP BY 1) nb ON nb.well_id = g.well_id
   JOIN (SELECT well_id, CAST(count(*) AS INTEGER) AS n_observations, min(obs_date) AS first_obs, max(obs_date) AS last_obs FROM fx_long GROUP BY 1) s ON s.well_id = g.well_id"""


@query("SR-1", _SR1)
def prepared_registry(fx):
    registry, _ = prep.prepare_wells(fx.wide, fx.donors, "wide", fx.settings)
    return registry.select(
        "well_id", "lat", "lon", "specific_yield", "sy_source", "sy_donor_km", "n_observations", "first_obs", "last_obs"
    )


@query(
    "SR-1",
    f"""SELECT sy_source, count(*) AS wells, {r('quantile_cont(sy_donor_km, 0.5)',6)} AS median_donor_km FROM ({_SR1}) GROUP BY 1""",
)
def yield_provenance(fx):
    registry, _ = prep.prepare_wells(fx.wide, fx.donors, "wide", fx.settings)
    return prep.yield_provenance(registry).withColumn("median_donor_km", half_even(F.col("median_donor_km"), 6))


@query(
    "AG-1",
    f"""SELECT count(*) AS wells_in, count(*) FILTER (fail_readings) AS fail_readings, count(*) FILTER (fail_yr_cov) AS fail_yr_cov,
          count(*) FILTER (fail_repeat) AS fail_repeat, count(*) FILTER (fail_range) AS fail_range, count(*) FILTER (keep) AS wells_kept FROM ({_QC_FLAGS})""",
)
def quality_summary(fx):
    """Wells that each rule drops, and wells kept."""
    long = prep.unpivot_periods(fx.wide, ["well_id"], "wide", fx.settings)
    return prep.qc_summary(prep.qc_profile(long, fx.settings))


@query(
    "JN-10 SO-3",
    f"""SELECT a AS n_a, b AS n_b, ab AS n_both, {r('ab/greatest(a,1)',4)} AS share_of_a FROM
        (SELECT count(*) FILTER (x) a, count(*) FILTER (y) b, count(*) FILTER (x AND y) ab FROM
          (SELECT id, bool_or(x) x, bool_or(y) y FROM (SELECT well_id id, true x, false y FROM fx_donors UNION ALL SELECT well_id, false, true FROM fx_obs) GROUP BY 1))""",
)
def id_overlap(fx):
    return prep.id_overlap(fx.donors, fx.readings.select("well_id").distinct(), "well_id")


@query("SO-3 JN-10", "SELECT district, 'no_donor' AS side FROM (SELECT district FROM fx_wells EXCEPT SELECT district FROM fx_donors)")
def districts_without_donor(fx):
    return prep.only_in(fx.base_wells, fx.donors, "district").withColumn("side", F.lit("no_donor"))


@query(
    "SO-3 JN-10",
    """WITH d AS (SELECT n_name AS district FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'Elsewhere')
       SELECT district, 'only_a' AS side FROM (SELECT district FROM fx_wells EXCEPT SELECT district FROM d)
       UNION ALL SELECT district, 'only_b' FROM (SELECT district FROM d EXCEPT SELECT district FROM fx_wells)""",
)
def district_differences(fx):
    """Districts that only one of two lists has, both ways."""
    some = fx.table("nation", "n_nationkey", "n_name").where(F.col("n_nationkey") % 3 != 0).select(F.col("n_name").alias("district"))
    other = some.unionByName(fx.spark.createDataFrame([("Elsewhere",)], "district string"))
    return prep.differences(fx.base_wells, other, "district")


@query(
    "JN-11",
    f"""SELECT round_even(round_even(lat/0.25e0,0)*0.25e0*1e4,0)/1e4 AS grid_lat, round_even(round_even(lon/0.25e0,0)*0.25e0*1e4,0)/1e4 AS grid_lon,
          count(*) AS n_members, min(well_id) AS first_member, min(start) AS start, max("end") AS "end"
        FROM fx_wells JOIN ({_WINDOWS}) USING (well_id) GROUP BY 1,2""",
)
def weather_cells(fx):
    return prep.cell_plan(prep.fetch_windows(fx.wells, fx.settings), 0.25)


@query(
    "JN-12",
    f"""SELECT cell_id, min(start) AS start, max("end") AS "end", any_value(held_start) AS held_start, any_value(held_end) AS held_end,
          coalesce(any_value(held_start) <= min(start) AND any_value(held_end) >= max("end"), false) AS covered
        FROM fx_cells JOIN ({_WINDOWS}) USING (well_id)
        LEFT JOIN (SELECT cell_id, min(date) AS held_start, max(date) AS held_end FROM fx_weather_raw GROUP BY 1) USING (cell_id) GROUP BY 1""",
)
def cell_coverage(fx):
    needed = prep.fetch_windows(fx.wells, fx.settings).join(fx.cells, "well_id").groupBy("cell_id").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return prep.cell_coverage(needed, fx.weather)


@query(
    "AG-22",
    """SELECT 'A-'||s_nationkey AS aggregate_id, CAST(sum(c) + CASE WHEN s_nationkey % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS stated_ml, count(*) AS n_members, CAST(sum(c) AS BIGINT) AS members_ml
       FROM (SELECT s_nationkey, CAST(floor(s_acctbal) AS BIGINT) AS c FROM supplier) GROUP BY s_nationkey HAVING s_nationkey % 3 = 0""",
)
def aggregate_capacity_mismatch(fx):
    """Suppliers as bodies, nations as aggregates; every third total is off by one."""
    s = fx.table("supplier", "s_suppkey", "s_nationkey", "s_acctbal").select(
        F.col("s_suppkey").cast("string").alias("reservoir_id"),
        F.concat(F.lit("A-"), F.col("s_nationkey")).alias("aggregate_id"),
        "s_nationkey", F.floor("s_acctbal").cast("long").alias("capacity_ml"),
    )
    off = F.when(F.max("s_nationkey") % 3 == 0, 1).otherwise(0)
    stated = s.groupBy("aggregate_id").agg((F.sum("capacity_ml") + off).alias("capacity_ml")).withColumnRenamed(
        "aggregate_id", "reservoir_id"
    )
    members = s.select("aggregate_id", F.col("reservoir_id").alias("member_id"))
    return prep.aggregate_mismatches(stated, members, s)


@query(
    "SO-2",
    "SELECT o_custkey AS customer, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1",
)
def deduplicated_first(fx):
    o = fx.table("orders", "o_custkey", "o_orderkey", "o_orderdate").withColumnRenamed("o_custkey", "customer")
    return writers.first_per_key(o, ["customer"], F.struct("o_orderdate", "o_orderkey"))


@query(
    "SO-1",
    """SELECT track, count(*) AS n, min(date) AS first_day FROM (SELECT 'rural' AS track, date FROM fx_daily UNION ALL SELECT 'urban', date FROM fx_reservoir) GROUP BY 1""",
)
def union_of_tracks(fx):
    rural = ft.rural_levels(fx.daily).withColumn("track", F.lit("rural"))
    urban = ft.urban_levels(fx.reservoir_daily).withColumn("track", F.lit("urban"))
    return rural.unionByName(urban).groupBy("track").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"))


@query(
    "WN-20",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderdate, o_orderkey) - 1 AS rn, count(*) OVER () AS t FROM orders)
       SELECT o_orderkey FROM o JOIN (SELECT DISTINCT CAST(floor(i * (SELECT greatest(max(t)/800e0, 1e0) FROM o)) AS BIGINT) AS pick FROM range(800) v(i)) p ON p.pick = o.rn""",
)
def stride_sample(fx):
    o = fx.table("orders", "o_orderkey", "o_custkey", "o_orderdate")
    return order.stride_sample(o, ["o_custkey", "o_orderdate", "o_orderkey"], 800).select("o_orderkey")


@query(
    "SC-19",
    """SELECT doc_id, CASE WHEN regexp_full_match(t, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(t AS DATE) END AS valid_date, h BETWEEN 1 AND 365 AS horizon_ok
       FROM (SELECT doc_id, '2023-'||lpad(CAST(doc_id % 14 AS VARCHAR),2,'0')||'-'||CASE WHEN doc_id % 5 = 0 THEN '7' ELSE lpad(CAST(doc_id % 33 AS VARCHAR),2,'0') END AS t, CAST(n_chars % 400 AS INTEGER) AS h FROM documents)""",
)
def request_validation(fx):
    d = fx.table("documents", "doc_id", "n_chars")
    k = F.col("doc_id")
    day = F.when(k % 5 == 0, "7").otherwise(F.lpad((k % 33).cast("string"), 2, "0"))
    text = F.concat(F.lit("2023-"), F.lpad((k % 14).cast("string"), 2, "0"), F.lit("-"), day)
    return d.select(
        "doc_id", cal.strict_date(text).alias("valid_date"), (F.col("n_chars") % 400).between(1, 365).alias("horizon_ok")
    )


@query(
    "AG-18 DQ-2",
    """SELECT 'wells' AS table_name, count(*) AS n_rows, count(DISTINCT well_id) AS n_keys, 0 AS n_duplicate_keys, 0 AS n_null_keys FROM fx_wells
       UNION ALL SELECT 'readings', count(*), count(*), 0, 0 FROM fx_obs
       UNION ALL SELECT 'orders_by_customer_day', count(*), (SELECT count(*) FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders)),
           (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)), 0 FROM orders""",
)
def table_profiles(fx):
    return dq.table_profile(
        {
            "wells": (fx.base_wells, ["well_id"]),
            "readings": (fx.readings, ["well_id", "obs_date"]),
            "orders_by_customer_day": (fx.table("orders", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate"]),
        }
    )


@query(
    "DQ-2",
    """SELECT * FROM (SELECT 'wells' AS table_name, (SELECT count(*) FROM customer) AS expected, (SELECT count(*) FROM fx_wells) AS n_rows, (SELECT count(*) FROM fx_wells) = (SELECT count(*) FROM customer) AS ok
       UNION ALL SELECT 'readings', (SELECT count(*) + 1 FROM orders), (SELECT count(*) FROM fx_obs), (SELECT count(*) FROM fx_obs) = (SELECT count(*) + 1 FROM orders)
       UNION ALL SELECT 'absent', 1, NULL, false)""",
)
def expected_row_counts(fx):
    profile = dq.table_profile({"wells": (fx.base_wells, ["well_id"]), "readings": (fx.readings, ["well_id", "obs_date"])})
    # Customers are wells; more readings than orders cannot be, so that one fails.
    wells = fx.table("customer").agg(F.lit("wells").alias("table_name"), F.count(F.lit(1)).alias("expected"))
    orders = fx.table("orders").agg(F.lit("readings").alias("table_name"), (F.count(F.lit(1)) + 1).alias("expected"))
    absent = fx.spark.createDataFrame([("absent", 1)], "table_name string, expected long")
    expected = wells.unionByName(orders).unionByName(absent)
    return dq.expected_rows(profile, expected)
