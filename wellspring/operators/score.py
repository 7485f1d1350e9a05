"""Stress scores for wells, areas and reservoirs."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.functions import stress
from wellspring.functions.numeric import half_even
from wellspring.operators.lineage import cut_lineage
from wellspring.operators.ordering import by_day, by_day_number, number_rows, running

URBAN_METHOD = "urban-stress-1.0"
RURAL_METHOD = "rural-stress-1.0/climatology"
RURAL_MODEL_METHOD = "rural-stress-1.0/model"
MOST = 100

# Municipal draw in million litres per day.
DAILY_DRAW_MLD = {"MUM_ALL": 4100.0, "PUN_KHW": 1395.0, "PUN_ALL": 1900.0}


def lookback(reservoir_daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Reference row for the trend of each day.

    The last row at or before 30 days earlier; with none, the immediately
    previous row. A window under a week gives no trend.
    """
    w = by_day_number("reservoir_id", "date")
    early = w.rangeBetween(Window.unboundedPreceding, -settings.trend_lookback_days)
    row = F.struct(F.col("date"), F.col("live_storage_pct"), F.col("source"))
    reference = F.coalesce(F.last(row).over(early), F.lag(row).over(w))
    out = reservoir_daily.where(F.col("live_storage_pct").isNotNull()).withColumn("_ref", reference)
    window = F.date_diff("date", "_ref.date")
    usable = window >= settings.trend_min_window_days
    return out.withColumns(
        {
            "trend_window_d": F.when(usable, window),
            "trend_raw": F.when(usable, (F.col("live_storage_pct") - F.col("_ref.live_storage_pct")) / window),
            "reference_source": F.when(usable, F.col("_ref.source")),
        }
    ).drop("_ref")


def urban_score(reservoir_daily: DataFrame, draws: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Explainable daily score of each reservoir system with a municipal draw."""
    drawn = reservoir_daily.join(draws.select("reservoir_id", "draw_mld"), "reservoir_id")
    df = lookback(drawn, settings).withColumn("_days", F.col("storage_mcm") * 1000.0 / F.col("draw_mld"))
    df = df.withColumns(
        {
            "_level": stress.depletion(F.col("live_storage_pct")),
            "_trend": stress.decline(F.col("trend_raw")),
            "_runway": stress.runway(F.col("_days")),
        }
    ).withColumn("_total", F.col("_level") + F.col("_trend") + F.col("_runway"))
    bounded = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_total")))
    return df.select(
        F.col("reservoir_id").alias("entity_id"),
        "date",
        half_even(bounded).cast("int").alias("score"),
        stress.band(F.col("_total")).alias("band"),
        half_even(F.col("_level"), 2).alias("s_level"),
        half_even(F.col("_trend"), 2).alias("s_trend"),
        half_even(F.col("_runway"), 2).alias("s_runway"),
        "live_storage_pct",
        half_even(F.col("trend_raw"), 4).alias("trend_pp_per_day"),
        "trend_window_d",
        half_even(F.col("_days"), 1).alias("days_of_supply"),
        stress.worst_source(F.col("source"), F.col("reference_source")).alias("inputs_source"),
        F.lit(URBAN_METHOD).alias("method_version"),
    )


def explain(scores: DataFrame) -> DataFrame:
    """One row per score term: what it saw and how many points it gave."""
    def term(name: str, reading: Column, points: str, out_of: int) -> Column:
        return F.struct(
            F.lit(name).alias("component"),
            reading.cast("double").alias("reading"),
            F.col(points).alias("points"),
            F.lit(out_of).alias("out_of"),
        )

    terms = F.array(
        term("depletion", F.col("live_storage_pct"), "s_level", 60),
        term("rate_of_decline", F.col("trend_pp_per_day"), "s_trend", 25),
        term("runway", F.col("days_of_supply"), "s_runway", 15),
    )
    return scores.select(
        "entity_id", "date", "score", "band", "inputs_source", F.explode(terms).alias("t")
    ).select("entity_id", "date", "score", "band", "inputs_source", "t.*")


def calibrate(scores: DataFrame, events: DataFrame) -> DataFrame:
    """Dated events beside the score of that day; missing days stay, blind trends are marked."""
    out = events.join(scores, ["entity_id", "date"], "left")
    return out.select(
        "entity_id", "date", "note", "live_storage_pct", "score", "band", "s_level", "s_trend", "s_runway",
        F.col("score").isNull().alias("no_anchor"),
        (F.col("score").isNotNull() & F.col("trend_window_d").isNull()).alias("blind_trend"),
    )


def latest_urban(scores: DataFrame) -> DataFrame:
    """Latest score row per entity."""
    rest = [c for c in scores.columns if c != "entity_id"]
    latest = scores.groupBy("entity_id").agg(F.max_by(F.struct(*rest), "date").alias("r"))
    return latest.select("entity_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def urban_cards(latest: DataFrame, registry: DataFrame, lang: Column | None = None) -> DataFrame:
    """Latest urban rows with names, colours and the band in a language."""
    named = latest.join(
        registry.select(F.col("reservoir_id").alias("entity_id"), "name", "city"), "entity_id", "left"
    )
    return named.withColumns(
        {
            "entity_label": F.coalesce("name", "entity_id"),
            "colour": stress.colour(F.col("band")),
            "band_label": stress.band_label(F.col("band"), lang if lang is not None else F.lit("en")),
            "days_to_crisis": F.floor("days_of_supply").cast("long"),
        }
    )


# --------------------------------------------------------------------- rural
def settled(level: Column) -> Column:
    """A mean level without the last bits that depend on the order of summing,
    so that a retried task cannot turn a rounded score over."""
    return half_even(level, 9)


def _seasonal_mean(target_season: Column) -> Column:
    return F.avg(F.when(F.col("season") == target_season, F.col("level_mbgl")))


def well_scores(history: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One scored row per well from readings at or before its origin.

    ``history``: well_id, obs_date, level_mbgl, season, origin_date,
    target_date, well_depth and, when a model ran, ``model_level``. Wells with
    fewer than four readings are not scored.
    """
    by_level = Window.partitionBy("well_id").orderBy("level_mbgl", "obs_date")
    whole = Window.partitionBy("well_id")
    w = by_day("well_id", "obs_date")
    ranked = history.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_rank": F.row_number().over(by_level),
            "_prev": F.lag(F.struct("obs_date", "level_mbgl")).over(w),
        }
    ).where(F.col("_n") >= settings.min_readings_to_rebuild)
    nearest_rank = F.least(F.col("_n") - 1, F.floor(F.lit(settings.crisis_share) * F.col("_n"))) + 1
    model = F.col("model_level") if "model_level" in history.columns else F.lit(None).cast("double")
    season = cal.season_of(F.col("target_date"), settings)
    per_well = ranked.groupBy("well_id").agg(
        F.first("origin_date").alias("origin_date"),
        F.first("target_date").alias("target_date"),
        F.first("well_depth").alias("well_depth"),
        F.first(model).alias("_model"),
        F.min("level_mbgl").alias("shallow"),
        F.max(F.when(F.col("_rank") == nearest_rank, F.col("level_mbgl"))).alias("crisis"),
        _seasonal_mean(season).alias("_season_mean"),
        F.avg("level_mbgl").alias("_mean"),
        F.max_by(F.struct("obs_date", "level_mbgl", "_prev"), "obs_date").alias("_last"),
    )
    last, prev = F.col("_last"), F.col("_last._prev")
    gap = F.date_diff(last["obs_date"], prev["obs_date"])
    scored = per_well.withColumns(
        {
            "used_model": F.col("_model").isNotNull(),
            "forecast": settled(F.coalesce("_model", "_season_mean", "_mean")),
            "last_obs_date": last["obs_date"],
            "last_obs_level": last["level_mbgl"],
            "trend": (last["level_mbgl"] - prev["level_mbgl"]) / F.greatest(gap, F.lit(1)),
        }
    )
    return _score_terms(scored).drop("_model", "_season_mean", "_mean", "_last")


def _points(forecast: Column) -> tuple[Column, Column, Column]:
    """Points for depth, trend and headroom, ``MOST`` together at most."""
    return (
        stress.depth_score(forecast, F.col("shallow"), F.col("crisis")),
        stress.deepening_score(F.col("trend")),
        stress.headroom_score(forecast, F.col("well_depth")),
    )


def _score(forecast: Column) -> Column:
    depth, trend, room = _points(forecast)
    return half_even(depth + trend + room).cast("int")


def _score_terms(df: DataFrame) -> DataFrame:
    """Score columns from forecast, shallow, crisis, trend, well_depth, last_obs_level."""
    depth, trend, room = _points(F.col("forecast"))
    return df.withColumns(
        {
            "score": _score(F.col("forecast")),
            "s_depth": half_even(depth, 2),
            "s_trend": half_even(trend, 2),
            "s_headroom": half_even(room, 2),
            "forecast_level": half_even(F.col("forecast"), 2),
            "trend_m_per_day": half_even(F.col("trend"), 5),
            "days_to_crisis": stress.days_to_crisis(F.col("crisis"), F.col("last_obs_level"), F.col("trend")),
        }
    )


WELL_CARD = ("well_id", "score", "s_depth", "s_trend", "s_headroom", "forecast_level", "days_to_crisis", "last_obs_level", "last_obs_date")


def rural_score(
    readings: DataFrame,
    wells: DataFrame,
    area: str = "taluka",
    origins: DataFrame | None = None,
    model: DataFrame | None = None,
    settings: Settings = DEFAULTS,
    listed: int = 0,
) -> DataFrame:
    """One card per area (or per well), worst well first; unscorable areas keep a reason.

    ``origins`` (area, origin_date) asks for a date; without it every area is
    scored at its own last reading. Areas asked for after their last reading
    get no score. ``model`` (well_id, model_level) overrides the seasonal mean.
    With ``listed`` a card also holds its worst wells in order, so many at most
    (``wells_scored`` counts them all): ``row_number`` is cut down before the shuffle,
    and no more than that is ever collected for an area.
    """
    registry = wells.select("well_id", F.col(area).alias("entity_id"), "well_depth").where(
        F.col("entity_id").isNotNull()
    )
    last_seen = readings.groupBy("well_id").agg(F.max("obs_date").alias("_last"), F.min("obs_date").alias("_first"))
    areas = registry.join(last_seen, "well_id", "left").groupBy("entity_id").agg(
        F.max("_last").alias("data_through"), F.min("_first").alias("_first"), F.count(F.lit(1)).alias("n_wells")
    )
    if origins is not None:
        asked = origins.select(F.col(area).alias("entity_id"), F.col("origin_date").alias("_asked"))
        areas = areas.join(asked, "entity_id", "right")
    else:
        areas = areas.withColumn("_asked", F.lit(None).cast("date"))
    areas = areas.withColumn("origin_date", F.coalesce("_asked", "data_through")).withColumn(
        "target_date", F.date_add("origin_date", settings.horizon_days)
    )
    # The origin is first given to wells (one row each), so the join that the
    # readings take part in is on well_id whatever the size of an area.
    scorable = areas.where(F.col("origin_date") <= F.col("data_through"))
    per_well = registry.join(scorable.select("entity_id", "origin_date", "target_date"), "entity_id")
    history = readings.join(per_well.drop("entity_id"), "well_id").where(
        F.col("obs_date") <= F.col("origin_date")
    )
    if model is not None:
        history = history.join(model.select("well_id", "model_level"), "well_id", "left")
    cards = registry.select("well_id", "entity_id").join(well_scores(history, settings), "well_id")
    worst = F.struct(
        (-F.col("score")).alias("_neg"), "well_id", "score", "s_depth", "s_trend", "s_headroom",
        "forecast_level", "last_obs_level", "last_obs_date",
    )
    listing = []
    if listed:
        order = Window.partitionBy("entity_id").orderBy(F.desc("score"), "well_id")
        cards = cut_lineage(cards)
        top = cards.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= listed)
        entry = F.struct("_place", *WELL_CARD)
        top = top.groupBy("entity_id").agg(F.sort_array(F.collect_list(entry)).alias("_wells"))
        listing = [F.transform(F.coalesce("_wells", F.array()), lambda w: F.struct(*(w[c].alias(c) for c in WELL_CARD))).alias("wells")]
    best = cards.groupBy("entity_id").agg(
        F.min(worst).alias("w"),
        F.min("days_to_crisis").alias("days_to_crisis"),
        F.count(F.lit(1)).alias("wells_scored"),
        F.max("last_obs_date").alias("scored_through"),
        F.max("used_model").alias("used_model"),
    )
    out = areas.join(best, "entity_id", "left")
    if listed:
        out = out.join(top, "entity_id", "left")
    reason = (
        F.when(F.col("n_wells").isNull(), "no wells found")
        .when(F.col("data_through").isNull(), "no readings for this entity")
        .when(F.col("origin_date") > F.col("data_through"), "origin is after the last reading")
        .when(F.col("origin_date") < F.col("_first"), "no readings at or before the origin")
        .when(F.col("w").isNull(), "fewer than 4 readings per well")
    )
    band = stress.band(F.col("w.score"), settings)
    return out.select(
        "entity_id",
        F.when(reason.isNull(), "ok").otherwise("no_data").alias("status"),
        reason.alias("reason"),
        "n_wells",
        F.when(F.col("w").isNotNull(), F.col("origin_date")).alias("date"),
        F.when(F.col("w").isNotNull(), F.col("target_date")).alias("target_date"),
        F.col("w.score").alias("score"),
        band.alias("band"),
        stress.colour(band).alias("colour"),
        "days_to_crisis",
        F.col("w.forecast_level").alias("forecast_level"),
        F.col("w.s_depth").alias("s_depth"),
        F.col("w.s_trend").alias("s_trend"),
        F.col("w.s_headroom").alias("s_headroom"),
        F.col("w.well_id").alias("driving_well"),
        F.col("w.last_obs_level").alias("last_obs_level"),
        F.col("w.last_obs_date").alias("last_obs_date"),
        F.date_diff("origin_date", "w.last_obs_date").alias("days_since_last_reading"),
        "wells_scored",
        F.when(F.col("w").isNotNull(), F.when(F.col("used_model"), RURAL_MODEL_METHOD).otherwise(RURAL_METHOD)).alias("method"),
        F.coalesce("scored_through", "data_through").alias("data_through"),
        *listing,
    )


def nested_cards(cards: DataFrame, intervals: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cards as they are served: components, detail, headline, interval and bands as structs.

    ``cards`` are those of ``rural_score(..., listed=n)``; ``intervals`` (method,
    horizon_d, p50, p80, p95, n) gives the measured error of the method that made the
    forecast, and the interval is null where none was measured. Cards without a score
    keep their reason, and their structs are null.
    """
    horizon = F.lit(settings.horizon_days)
    known = intervals.select(
        F.col("method").alias("_method"), F.struct(F.col("p80").alias("plus_minus_m"), "p50", "p95", "n").alias("interval")
    ).where(F.col("horizon_d") == horizon)
    met = cards.join(known, F.col("method") == F.col("_method"), "left")
    scored = F.col("status") == "ok"
    return met.select(
        "entity_id", F.lit("rural").alias("track"), "status", "reason", "date", "target_date", horizon.alias("horizon_d"),
        "score", "band", "colour", "days_to_crisis", "method", "data_through", "n_wells", "wells",
        F.when(scored, F.struct(F.col("s_depth").alias("depth"), F.col("s_trend").alias("trend"), F.col("s_headroom").alias("headroom"))).alias("components"),
        F.when(scored, F.struct("driving_well", "last_obs_level", "last_obs_date", "days_since_last_reading", "wells_scored")).alias("detail"),
        F.when(scored, F.struct(F.lit("forecast level").alias("label"), F.col("forecast_level").alias("value"), F.lit("m below ground").alias("unit"))).alias("headline"),
        F.when(scored, F.col("interval")).alias("interval"),
        F.struct(F.lit(settings.monitor_above).alias("monitor_above"), F.lit(settings.act_now_above).alias("act_now_above")).alias("bands"),
    )


def _running_nearest_rank(share: float):
    """Per array of levels in date order: the nearest-rank percentile so far."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def ranks(series: pd.Series) -> pd.Series:
        out = []
        for levels in series:
            ordered, so_far = [], []
            for n, level in enumerate(levels, start=1):
                bisect.insort(ordered, level)
                so_far.append(ordered[min(n - 1, int(share * n))])
            out.append(so_far)
        return pd.Series(out)

    return ranks


def well_states(readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Everything a score needs after each reading of each well, as running windows.

    Each reading is one state, valid until the next reading. Running seasonal
    means are kept for all seasons because later origins may target any of
    them. The running nearest-rank percentile has no Spark window form that is
    not quadratic; a sorted list per well gives it, in Arrow batches of wells (a
    well has at most one reading per day, which bounds its array).
    """
    upto, w = running("well_id", "obs_date"), by_day("well_id", "obs_date")
    prev = F.lag(F.struct("obs_date", "level_mbgl")).over(w)
    states = readings.select("well_id", "obs_date", "level_mbgl", "season").withColumns(
        {
            "n_readings": F.count(F.lit(1)).over(upto),
            "shallow": F.min("level_mbgl").over(upto),
            "_mean": F.avg("level_mbgl").over(upto),
            "_by_season": F.array(
                *[
                    F.avg(F.when(F.col("season") == s, F.col("level_mbgl"))).over(upto)
                    for s in cal.SEASON_CODES
                ]
            ),
            "_prev": prev,
            "valid_to": F.date_sub(F.lead("obs_date").over(w), 1),
        }
    )
    in_order = readings.groupBy("well_id").agg(
        F.sort_array(F.collect_list(F.struct("obs_date", "level_mbgl"))).alias("_r")
    )
    ranked = in_order.withColumn("_c", _running_nearest_rank(settings.crisis_share)(F.col("_r.level_mbgl")))
    crisis = ranked.select(
        "well_id",
        F.inline(F.arrays_zip(F.col("_r.obs_date").alias("obs_date"), F.col("_c").alias("crisis"))),
    )
    gap = F.date_diff("obs_date", "_prev.obs_date")
    return (
        states.join(crisis, ["well_id", "obs_date"])
        .join(wells.select("well_id", "well_depth", "taluka"), "well_id")
        .withColumn("trend", (F.col("level_mbgl") - F.col("_prev.level_mbgl")) / F.greatest(gap, F.lit(1)))
        .where(F.col("n_readings") >= settings.min_readings_to_rebuild)
    )


def _target_code(origin: str, settings: Settings) -> Column:
    """Code of the season that a forecast made on a day is for."""
    return cal.season_code(cal.season_of(F.date_add(origin, settings.horizon_days), settings))


def _state_forecast(code: Column) -> Column:
    """Running mean of a season, or of all readings where that season has none."""
    return settled(F.coalesce(F.element_at("_by_season", code + 1), "_mean"))


def _state_score(code: Column) -> Column:
    return _score(_state_forecast(code))


def _score_states(states: DataFrame, origin: str, settings: Settings) -> DataFrame:
    forecast = _state_forecast(_target_code(origin, settings))
    return _score_terms(states.withColumns({"forecast": forecast, "last_obs_level": F.col("level_mbgl")}))


def well_timeline(readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """One score per well and real reading date."""
    scored = _score_states(well_states(readings, wells, settings), "obs_date", settings)
    band = stress.band(F.col("score"), settings)
    return scored.select(
        "well_id", F.col("obs_date").alias("date"), "score", band.alias("band"),
        "forecast_level", "days_to_crisis",
    )


def area_timeline(readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Worst-well score per area at each of the area's reading dates.

    A well's state holds from its reading to the day before its next one. Its
    score changes only with the season, so a state is scored once per season
    and laid out on its own days (the size of the daily table) only to enter a
    hash aggregate: score and place in the order of wells make one number, the
    least of which is the worst well. Days are never shuffled or sorted.
    """
    states = well_states(readings, wells, settings).where(F.col("taluka").isNotNull())
    dates = (
        readings.join(wells.select("well_id", "taluka"), "well_id")
        .select("taluka", F.col("obs_date").alias("date"))
        .distinct()
    )
    ends = dates.groupBy("taluka").agg(F.max("date").alias("_end"))
    # By well: an area with many readings would be one hot key.
    last_day = wells.join(ends, "taluka").select("well_id", "_end").distinct()
    order = number_rows(wells.select("well_id").where(F.col("well_id").isNotNull()).distinct(), ["well_id"])
    per_season = F.array(*[_state_score(F.lit(code)) for code in cal.SEASON_CODES.values()])
    spans = states.join(last_day, "well_id").join(order, "well_id").select(
        "taluka", "row_no", "obs_date", F.least(F.coalesce("valid_to", "_end"), "_end").alias("_to"), per_season.alias("_scores"),
        "_by_season", "_mean", stress.days_to_crisis(F.col("crisis"), F.col("level_mbgl"), F.col("trend")).alias("days_to_crisis"),
    )
    spans = cut_lineage(spans.where(F.col("obs_date") <= F.col("_to")))  # laid out on days, then asked for the worst wells
    days = spans.select("taluka", "row_no", "_scores", "days_to_crisis", F.explode(F.sequence("obs_date", "_to")).alias("date"))
    # A state without a score counts as the worst.
    code = F.coalesce(F.lit(MOST + 1) - F.element_at("_scores", _target_code("date", settings) + 1), F.lit(0)).cast("long")
    worst = F.min(F.shiftleft(code, 40) + F.col("row_no"))
    rows = days.groupBy("taluka", "date").agg(worst.alias("_worst"), F.min("days_to_crisis").alias("days_to_crisis"))
    rows = rows.join(dates, ["taluka", "date"], "left_semi").withColumns(
        {"row_no": F.col("_worst") % F.lit(1 << 40), "_code": F.shiftright("_worst", 40)}
    )
    asked = rows.withColumn("score", F.when(F.col("_code") > 0, MOST + 1 - F.col("_code")).cast("int"))
    held = spans.select("taluka", "row_no", "obs_date", "_to", "_scores", "_by_season", "_mean")
    met = asked.join(held, ["taluka", "row_no"]).where(
        F.col("date").between(F.col("obs_date"), F.col("_to"))
        & F.element_at("_scores", _target_code("date", settings) + 1).eqNullSafe(F.col("score"))
    )
    level = half_even(_state_forecast(_target_code("date", settings)), 2)
    picked = met.groupBy("taluka", "date", "score").agg(F.min(level).alias("forecast_level"), F.min("days_to_crisis").alias("days_to_crisis"))
    return picked.select(
        F.col("taluka").alias("entity_id"), "date", "score", stress.band(F.col("score"), settings).alias("band"),
        "forecast_level", "days_to_crisis",
    )


def notable_dates(scores: DataFrame) -> DataFrame:
    """Worst, earliest, best and latest day per entity, each date once."""
    point = F.struct("date", "score", "live_storage_pct")
    picks = scores.groupBy("entity_id").agg(
        F.max_by(point, F.struct(F.col("score"), -F.unix_date("date"))).alias("most_stressed"),
        F.min_by(point, "date").alias("earliest"),
        F.min_by(point, F.struct("score", "date")).alias("least_stressed"),
        F.max_by(point, "date").alias("latest"),
    )
    names = ("most_stressed", "earliest", "least_stressed", "latest")
    listed = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("note"), F.col(n).alias("p")) for i, n in enumerate(names)])
    rows = picks.select("entity_id", F.explode(listed).alias("x"))
    first = rows.groupBy("entity_id", F.col("x.p.date").alias("date")).agg(
        F.min_by(F.struct("x.note", "x.p.score", "x.p.live_storage_pct"), "x.ord").alias("r")
    )
    return first.select("entity_id", "date", "r.note", "r.score", "r.live_storage_pct")
