"""Daily feature rows and leakage-free point-in-time feature rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.operators import days as dy
from wellspring.operators.ordering import add_previous, asof_backward, by_day
from wellspring.operators.series import densify
from wellspring.operators.weather import SCRATCH, rain_memory, rolling_sums, weather_features

WEATHER_COLUMNS = ["precip_mm", "et0_mm", "soil_moist_0_7", "soil_moist_7_28", "temp_max", "rh_mean"]

# Columns built on reconstructed levels, never to be trained on.
LEAKY_COLUMNS = (
    "level", "level_lag_7", "level_lag_15", "level_lag_30", "level_lag_60", "level_lag_90",
    "level_change_7d", "level_change_30d", "target_level_t30",
)
ROW_LABELS = ("well_id", "origin_date", "target_date", "split", "target_level")

# Feature order of one serving row.
FEATURE_ORDER = (
    "horizon_d", "last_obs_level", "days_since_obs", "prev_obs_level", "prev_obs_gap_d",
    "obs_trend_m_per_day", "last_obs_anomaly", "rain_since_obs", "et0_since_obs", "rain_7d",
    "rain_30d", "rain_90d", "et0_30d", "days_since_last_rain", "cum_monsoon_rainfall", "temp_max",
    "rh_mean", "month", "doy", "season", "specific_yield", "well_depth", "lat", "lon",
    "clim_season", "clim_well",
)


def with_weather(
    daily: DataFrame | dy.Days, weather: DataFrame, cells: DataFrame, entity: str = "entity_id"
) -> DataFrame | dy.Days:
    """Left join of daily rows to their cell's weather on (cell, date).

    Daily rows that lie by ``cell_id`` (``reconstruct_daily`` given the cells) stay
    there: a cell's days, one row each, meet them as one array by their place in it.
    """
    if isinstance(daily, dy.Days):
        return daily.beside(weather, WEATHER_COLUMNS).then(_meet_weather)
    if "cell_id" in daily.columns:
        return _with_cell_weather(daily, weather)
    mapped = daily.join(cells.select(F.col("well_id").alias(entity), "cell_id"), entity, "left")
    return mapped.join(weather.select("cell_id", "date", *WEATHER_COLUMNS), ["cell_id", "date"], "left")


def _days_of_cells(weather: DataFrame, columns: list[str]) -> DataFrame:
    """Per cell its first date and an array of all days up to its last one."""
    dense = densify(weather, "cell_id", "date", columns).where(F.col("cell_id").isNotNull() & F.col("date").isNotNull())
    return dense.groupBy("cell_id").agg(
        F.min("date").alias("_first"), F.sort_array(F.collect_list(F.struct("date", *columns))).alias("_days")
    )


def _with_cell_weather(daily: DataFrame, weather: DataFrame) -> DataFrame:
    met = daily.join(_days_of_cells(weather, WEATHER_COLUMNS).hint("shuffle_hash"), "cell_id", "left")
    here = met.withColumn("_at", F.get("_days", F.date_diff("date", "_first")))
    return here.select(*daily.columns, *[F.col(f"_at.{c}").alias(c) for c in WEATHER_COLUMNS])


def _meet_weather(b: dy.Block) -> None:
    b.made |= {c: lambda b, c=c: b.weather(c) for c in WEATHER_COLUMNS}


def rural_levels(daily: DataFrame | dy.Days) -> DataFrame | dy.Days:
    if isinstance(daily, dy.Days):
        return daily.then(lambda b: b.made.update(level=lambda b: b["level_mbgl"]))
    return daily.select(
        *[c for c in daily.columns if c == "cell_id"], F.col("well_id").alias("entity_id"), "date", F.col("level_mbgl").alias("level"),
        "is_observed", "confidence",
    )


def urban_levels(reservoir_daily: DataFrame) -> DataFrame:
    real = F.col("source").isin("wrd_pravah", "manual")
    return reservoir_daily.select(
        F.col("reservoir_id").alias("entity_id"), "date", F.col("live_storage_pct").alias("level"),
        real.alias("is_observed"), F.when(real, 1.0).otherwise(0.6).alias("confidence"),
    )


def _trailing(b: dy.Block, column: str, days: int, least: int) -> np.ndarray:
    """Trailing sum as a difference of running totals, where it has enough values (``rolling_sums``)."""

    def since(total: np.ndarray) -> np.ndarray:
        out = total.copy()
        out[days:] -= total[:-days]
        out[b.head(days)] = total[b.head(days)]
        return out

    return np.where(since(b[f"_n_{column}"]) >= least, since(b[f"_sum_{column}"]), np.nan)


def _since_rain(b: dy.Block, wet_mm: float) -> np.ndarray:
    last = np.maximum.accumulate(np.where(b["precip_mm"] >= wet_mm, b["_at"], -1))
    return np.where(last >= b["_begin"], b["_at"] - last, np.nan)


def _season_rain(b: dy.Block, start_month: int) -> np.ndarray:
    """Running total less what it was before the last start of the water year."""
    total, rain = b["_sum_precip_mm"], b["precip_mm"]
    starts = (b["month"] == start_month) & (b["dom"] == 1)
    last = np.maximum.accumulate(np.where(starts, b["_at"], -1))
    return total - np.where(last >= b["_begin"], (total - np.where(rain == rain, rain, 0.0))[last], 0.0)


def _features_of_days(track: str, settings: Settings, keep_warmup: bool) -> dy.Step:
    """Columns of ``daily_features`` for a block of series."""
    ends = [(dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days for d in (settings.train_end, settings.val_end, settings.test_end)]
    rolled = [("precip_mm", n, max(1, n // 2), f"rain_{n}d") for n in settings.rolling_days] + [("et0_mm", 30, 15, "et0_30d")]
    totals = sorted({c for c, *_ in rolled})

    def split(b: dy.Block) -> np.ndarray:
        if track != "rural":
            return np.full(b.size, SPLIT_ORDER["test"], np.int8)
        val, test, none = ((b["date"] > d).astype(np.int8) for d in ends)
        return np.where(val == 0, 0, np.where(test == 0, 1, 2 + none)).astype(np.int8)

    made: dict[str, Callable[[dy.Block], np.ndarray]] = {
        **{f"_sum_{c}": lambda b, c=c: b.running(np.where(b[c] == b[c], b[c], 0.0)) for c in totals},
        **{f"_n_{c}": lambda b, c=c: b.running((b[c] == b[c]).astype(np.int64)) for c in totals},
        **{name: lambda b, a=(c, n, least): _trailing(b, *a) for c, n, least, name in rolled},
        **{f"level_lag_{n}": lambda b, n=n: b.lagged(b["level"], n) for n in settings.lags},
        "days_since_last_rain": lambda b: _since_rain(b, settings.rain_day_mm),
        "cum_monsoon_rainfall": lambda b: _season_rain(b, settings.monsoon_start_month),
        "level_change_7d": lambda b: b["level"] - b.lagged(b["level"], 7),
        "level_change_30d": lambda b: b["level"] - b.lagged(b["level"], 30),
        "target_level_t30": lambda b: b.lagged(b["level"], -settings.horizon_days),
        "split": split,
    }
    needed = ["target_level_t30"] + ([] if keep_warmup else ["level_lag_30", "rain_30d"])

    def add(b: dy.Block) -> None:
        b.made |= made
        b.entity_type = "well" if track == "rural" else "reservoir"
        b.kept = b["split"] < len(SPLIT_ORDER)
        for c in needed:
            b.kept &= b[c] == b[c]

    return add


def daily_features(
    levels: DataFrame | dy.Days,
    weather: DataFrame,
    cells: DataFrame,
    track: str,
    settings: Settings = DEFAULTS,
    keep_warmup: bool = False,
) -> DataFrame | dy.Days:
    """Lag, rolling, calendar and target columns on a gapless calendar.

    ``track`` is ``rural`` (chronological split) or ``urban`` (always test).
    All windows share one entity partitioning and one order; levels that lie by
    ``cell_id`` stay there and keep that column. ``Days`` stay arrays; their split is its
    place in ``SPLIT_ORDER``.
    """
    joined = with_weather(levels, weather, cells)
    if isinstance(joined, dy.Days):
        return joined.then(_features_of_days(track, settings, keep_warmup))
    by_cell = "cell_id" in levels.columns
    key = ["cell_id", "entity_id"] if by_cell else "entity_id"
    columns = ["level", "is_observed", "confidence", *WEATHER_COLUMNS]
    dense = densify(joined, key, "date", columns, partitions=0 if by_cell else None)
    w = by_day(key, "date")
    level, day = F.col("level"), F.col("date")
    least = {n: max(1, n // 2) for n in settings.rolling_days}
    rolled, totals = rolling_sums(
        dense, key, "date",
        [("precip_mm", n, least[n], f"rain_{n}d") for n in settings.rolling_days] + [("et0_mm", 30, 15, "et0_30d")],
    )
    dense = rain_memory(totals, key, "date", settings)
    cols = {**rolled, **{f"level_lag_{n}": F.lag(level, n).over(w) for n in settings.lags}}
    cols["level_change_7d"] = level - F.lag(level, 7).over(w)
    cols["level_change_30d"] = level - F.lag(level, 30).over(w)
    cols["target_level_t30"] = F.lead(level, settings.horizon_days).over(w)
    cols["month"] = F.month(day)
    cols["doy"] = F.dayofyear(day)
    cols["season"] = cal.season_of(day, settings)
    cols["is_last_5y"] = cal.is_recent(day, settings)
    cols["entity_type"] = F.lit("well" if track == "rural" else "reservoir")
    cols["split"] = cal.split_of(day, settings) if track == "rural" else F.lit("test")
    out = dense.withColumns(cols).drop(*SCRATCH).where(F.col("split").isNotNull() & F.col("target_level_t30").isNotNull())
    if keep_warmup:
        return out
    return out.where(F.col("level_lag_30").isNotNull() & F.col("rain_30d").isNotNull())


def climatology(readings: DataFrame, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """Seasonal and overall mean level per well, train readings only."""
    train = readings.where(F.col("obs_date") <= F.lit(settings.train_end).cast("date"))
    season = train.groupBy("well_id", "season").agg(F.avg("level_mbgl").alias("clim_season"))
    well = train.groupBy("well_id").agg(F.avg("level_mbgl").alias("clim_well"))
    return season, well


def reading_history(readings: DataFrame) -> DataFrame:
    """Each reading with the one before it, named for point-in-time use."""
    return add_previous(
        readings.select("well_id", "obs_date", "level_mbgl"), "well_id", "obs_date", "level_mbgl"
    ).select(
        "well_id",
        F.col("obs_date").alias("last_obs_date"),
        F.col("level_mbgl").alias("last_obs_level"),
        F.col("lag_1").alias("prev_obs_level"),
        F.col("lag_date_1").alias("prev_obs_date"),
    )


def qualified_readings(readings: DataFrame, min_obs: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Readings inside the split windows, of wells that have enough of them."""
    inside = readings.where(cal.split_of(F.col("obs_date"), settings).isNotNull())
    n = F.count(F.lit(1)).over(Window.partitionBy("well_id"))
    return inside.withColumn("_n", n).where(F.col("_n") >= min_obs).drop("_n")


def target_spine(readings: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """(well, origin, horizon) rows whose label is a real reading."""
    return readings.select(
        "well_id",
        F.col("obs_date").alias("target_date"),
        F.col("level_mbgl").alias("target_level"),
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_d"),
    ).withColumn("origin_date", F.date_sub("target_date", F.col("horizon_d")))


def weather_since_reading(df: DataFrame, features: DataFrame) -> DataFrame:
    """Weather at the origin and accumulated since the last reading.

    Accumulation is a difference of running totals looked up at two dates. It is
    NULL when either date has no weather. A cell's days meet its rows as one array,
    by their place in it: the rows, which are wide, move once for both lookups.
    """
    names = [c for c in features.columns if c not in ("cell_id", "date")]
    met = df.join(_days_of_cells(features, names).hint("shuffle_hash"), "cell_id", "left")
    at = lambda date: F.get("_days", F.date_diff(date, "_first"))
    out = met.withColumns({"_here": at("origin_date"), "_then": at("last_obs_date")}).select(
        "*", *[F.col(f"_here.{c}").alias(c) for c in names], F.col("_then.rain_cum").alias("_rain_then"), F.col("_then.et0_cum").alias("_et0_then")
    ).drop("_here", "_then", "_first", "_days")
    return out.withColumns(
        {
            "rain_since_obs": F.col("rain_cum") - F.col("_rain_then"),
            "et0_since_obs": F.col("et0_cum") - F.col("_et0_then"),
        }
    ).drop("rain_cum", "et0_cum", "_rain_then", "_et0_then")


def attach_climatology(df: DataFrame, season: DataFrame, well: DataFrame) -> DataFrame:
    """Climatology of the target season (well mean where missing) and the anomaly."""
    per_season = season.where(F.col("season").isNotNull()).groupBy("well_id").agg(
        F.map_from_entries(F.collect_list(F.struct("season", "clim_season"))).alias("_seasons")
    )
    out = df.join(per_season, "well_id", "left").join(well, "well_id", "left")
    out = out.withColumn("clim_season", F.when(F.col("season").isNotNull(), F.try_element_at("_seasons", F.col("season")))).drop("_seasons")
    return out.withColumns(
        {
            "clim_season": F.coalesce("clim_season", "clim_well"),
            "last_obs_anomaly": F.col("last_obs_level") - F.col("clim_well"),
        }
    )


def point_features(
    spine: DataFrame,
    history: DataFrame,
    weather: DataFrame,
    cells: DataFrame,
    wells: DataFrame,
    season: DataFrame,
    well: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Everything knowable at the origin of each (well, origin, target) row."""
    df = asof_backward(
        spine, history, "well_id", "origin_date", "last_obs_date",
        ["last_obs_level", "prev_obs_level", "prev_obs_date"],
    )
    gap = F.date_diff("last_obs_date", "prev_obs_date")
    df = df.withColumns(
        {
            "days_since_obs": F.date_diff("origin_date", "last_obs_date"),
            "prev_obs_gap_d": gap,
            "obs_trend_m_per_day": (F.col("last_obs_level") - F.col("prev_obs_level")) / F.nullif(gap, F.lit(0)),
            "month": F.month("target_date"),
            "doy": F.dayofyear("target_date"),
            "season": cal.season_of(F.col("target_date"), settings),
        }
    )
    df = df.join(cells.select("well_id", "cell_id"), "well_id", "left")
    # All that is kept per well is met while the rows lie by well, weather last.
    df = df.join(wells.select("well_id", "lat", "lon", "specific_yield", "well_depth"), "well_id", "left")
    df = attach_climatology(df, season, well)
    return weather_since_reading(df, weather_features(weather, settings))


def _placed_readings(readings: DataFrame, cells: DataFrame, wells: DataFrame) -> DataFrame:
    """Readings beside what is known of their well, lying by its cell: once for each cell the well has.

    ``_wells`` holds one entry for each row that cells and wells join to. Readings, which
    are narrow, move here; nothing that is made of them has to move again for the weather.
    """
    known = wells.groupBy("well_id").agg(F.collect_list(F.struct("lat", "lon", "specific_yield", "well_depth")).alias("_known"))
    lying = cells.groupBy("well_id").agg(F.collect_list(F.struct("cell_id")).alias("_cells"))
    met = readings.where(F.col("well_id").isNotNull()).join(known, "well_id", "left").join(lying, "well_id", "left")
    empty = F.array(F.lit(None).cast(known.schema["_known"].dataType.elementType))
    each = met.withColumn("_cell", F.explode_outer(F.array_distinct("_cells")))
    copies = F.when(F.col("_cells").isNull(), F.lit(1)).otherwise(F.size(F.filter("_cells", lambda c: c.eqNullSafe(F.col("_cell")))))
    placed = each.withColumn("_wells", F.flatten(F.array_repeat(F.coalesce("_known", empty), copies)))
    tasks = 2 * int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select(*readings.columns, F.col("_cell.cell_id").alias("cell_id"), "_wells").repartition(tasks, "cell_id")


def causal_features(
    readings: DataFrame,
    weather: DataFrame,
    cells: DataFrame,
    wells: DataFrame,
    horizons: tuple[int, ...] = (7, 15, 30),
    min_obs: int = 20,
    require_weather: bool = False,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Point-in-time training rows: one per (well, origin, horizon).

    The same values as ``point_features`` of ``target_spine``, but labels are readings
    themselves: counts, means and the last reading before each origin are windows over a
    well's readings, which share one sort, and rows are made where its weather lies.
    Readings must be one per (well, day).
    """
    target = F.col("obs_date")
    inside = readings.where(cal.split_of(target, settings).isNotNull()).select("well_id", "obs_date", "level_mbgl", "season")
    rows = _placed_readings(inside, cells, wells).withColumn("_day", cal.day_number(target))
    well = Window.partitionBy("cell_id", "well_id")
    w = well.orderBy("_day")
    level = F.col("level_mbgl")
    trained = F.when(target <= F.lit(settings.train_end).cast("date"), level)
    rows = rows.withColumns(
        {
            "_prev_level": F.lag(level).over(w),
            "_prev_date": F.lag(target).over(w),
            "_n": F.count(F.lit(1)).over(well),
            "clim_well": F.avg(trained).over(well),
            **{f"_clim_{name}": F.avg(F.when(F.col("season") == name, trained)).over(well) for name in settings.seasons},
        }
    ).where(F.col("_n") >= min_obs)
    hit = F.struct(
        target.alias("last_obs_date"), level.alias("last_obs_level"), F.col("_prev_level").alias("prev_obs_level"),
        F.col("_prev_date").alias("prev_obs_date"),
    )
    rows = rows.withColumns({f"_hit_{h}": F.last(hit).over(w.rangeBetween(Window.unboundedPreceding, -h)) for h in horizons})
    season = cal.season_of(target, settings)
    seasonal = F.coalesce(*(F.when(season == name, F.col(f"_clim_{name}")) for name in settings.seasons), F.col("clim_well"))
    each = F.array(*(F.struct(F.lit(h).alias("horizon_d"), F.col(f"_hit_{h}").alias("hit")) for h in horizons))
    spine = rows.select(
        "cell_id", "well_id", target.alias("target_date"), level.alias("target_level"), season.alias("season"), "clim_well",
        seasonal.alias("clim_season"), "_wells", F.explode(each).alias("_e"),
    )
    df = spine.select(*[c for c in spine.columns if c not in ("_wells", "_e")], "_e.horizon_d", "_e.hit.*", F.inline("_wells"))
    df = df.where(F.col("last_obs_date") < F.col("target_date")).withColumn("origin_date", F.date_sub("target_date", F.col("horizon_d")))
    gap = F.date_diff("last_obs_date", "prev_obs_date")
    df = df.withColumns(
        {
            "days_since_obs": F.date_diff("origin_date", "last_obs_date"),
            "prev_obs_gap_d": gap,
            "obs_trend_m_per_day": (F.col("last_obs_level") - F.col("prev_obs_level")) / F.nullif(gap, F.lit(0)),
            "last_obs_anomaly": F.col("last_obs_level") - F.col("clim_well"),
            "month": F.month("target_date"),
            "doy": F.dayofyear("target_date"),
            "split": cal.split_of(F.col("target_date"), settings),
        }
    )
    df = weather_since_reading(df, weather_features(weather, settings))
    if require_weather:
        df = df.where(F.col("rain_30d").isNotNull())
    return df.where(F.col("target_level").isNotNull()).select(
        "well_id", "origin_date", "target_date",
        *[c for c in FEATURE_ORDER if c != "season"],
        "season", "soil_moist_0_7", "soil_moist_7_28", "target_level", "split",
    )


def features_as_of(
    points: DataFrame,
    readings: DataFrame,
    weather: DataFrame,
    cells: DataFrame,
    wells: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """The same features for any (well_id, origin_date, horizon_d) rows.

    Points without a reading at or before their origin drop out; season is
    given as its model code.
    """
    season, well = climatology(readings, settings)
    spine = points.select(
        "well_id", "origin_date", "horizon_d", F.date_add("origin_date", F.col("horizon_d")).alias("target_date")
    )
    df = point_features(spine, reading_history(readings), weather, cells, wells, season, well, settings)
    df = df.where(F.col("last_obs_date").isNotNull()).withColumn("season", cal.season_code(F.col("season")))
    return df.select("well_id", "origin_date", "target_date", "last_obs_date", *FEATURE_ORDER)


SPLIT_ORDER = {"train": 0, "val": 1, "test": 2}


def leakage_audit(features: DataFrame, readings: DataFrame) -> DataFrame:
    """Named counts that must be zero, one row per check; one pass over the features, one row per split."""
    labels = readings.select("well_id", F.col("obs_date").alias("target_date"), F.lit(True).alias("_real")).distinct()
    shifted = F.date_sub("target_date", F.col("horizon_d"))
    bad = {
        "origin_not_before_target": F.col("origin_date") >= F.col("target_date"),
        "horizon_mismatch": shifted != F.col("origin_date"),
        "label_not_a_reading": F.col("_real").isNull(),
    }
    per_split = (
        features.join(labels, ["well_id", "target_date"], "left")
        .groupBy("split")
        .agg(
            F.min("target_date").alias("_first"), F.max("target_date").alias("_last"),
            *[F.count_if(c).alias(name) for name, c in bad.items()],
        )
    )
    before = F.lag("_last").over(Window.orderBy(cal.lookup(SPLIT_ORDER, F.col("split"))))
    overlap = F.coalesce(F.col("_first") <= before, F.lit(False))
    names = [*bad, "split_overlap"]
    total = per_split.withColumn("_overlap", overlap).agg(
        *[F.sum(name).alias(name) for name in bad], F.count_if("_overlap").alias("split_overlap")
    )
    return total.unpivot([], names, "check_name", "n_bad")


def split_name(place: Column) -> Column:
    """The split at a place of ``SPLIT_ORDER``; NULL past the last."""
    return F.get(F.array(*(F.lit(name) for name in SPLIT_ORDER)), place)


def split_rank(split: Column) -> Column:
    """Place of a split in time."""
    return cal.lookup(SPLIT_ORDER, split)


def split_ranges(df: DataFrame, date: str, groups: list[str] | None = None) -> DataFrame:
    """Rows and dates per split, flagged where a split starts before the one ahead ends."""
    groups = groups or []
    w = Window.partitionBy(*groups).orderBy(split_rank(F.col("split")))
    return (
        df.groupBy(*groups, "split")
        .agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))
        .withColumn("overlaps", F.coalesce(F.col("first_date") <= F.lag("last_date").over(w), F.lit(False)))
    )


def skew_check(a: DataFrame, b: DataFrame, keys: list[str], features: tuple[str, ...], tolerance: float = 1e-6) -> DataFrame:
    """Per feature: rows compared and rows that differ (NULL equals NULL)."""
    left = a.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_a"))
    right = b.select(*keys, F.struct(*[F.col(f).cast("double").alias(f) for f in features]).alias("_b"))
    both = left.join(right, keys)

    def differs(name: str) -> Column:
        x, y = F.col(f"_a.{name}"), F.col(f"_b.{name}")
        near = F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
        return ~F.coalesce(near, x.isNull() & y.isNull())

    counts = both.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(differs(f)).alias(f) for f in features])
    return counts.unpivot(["n_rows"], list(features), "feature", "n_differs")


def skew_examples(a: DataFrame, b: DataFrame, keys: list[str], feature: str, n: int = 3, tolerance: float = 1e-6) -> DataFrame:
    """Up to ``n`` differing rows of one feature, in key order."""
    x, y = F.col("_a"), F.col("_b")
    both = a.select(*keys, F.col(feature).cast("double").alias("_a")).join(
        b.select(*keys, F.col(feature).cast("double").alias("_b")), keys
    )
    near = F.abs(x - y) <= F.lit(tolerance) * F.greatest(F.lit(1.0), F.abs(x), F.abs(y))
    return both.where(~F.coalesce(near, x.isNull() & y.isNull())).orderBy(*keys).limit(n)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of NULLs per column from one aggregate."""
    total = F.count(F.lit(1))
    shares = df.agg(*[((total - F.count(c)) / total).alias(c) for c in columns])
    return shares.unpivot([], columns, "column_name", "null_share").withColumns(
        {"all_null": F.col("null_share") == 1.0, "sparse": (F.col("null_share") > 0.2) & (F.col("null_share") < 1.0)}
    )


def model_matrix(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """Feature columns fit to train on: labels and all-NULL columns dropped,
    season as a code; refuses columns that carry reconstructed levels."""
    leaky = [c for c in features.columns if c in LEAKY_COLUMNS]
    if leaky:
        raise ValueError(f"leaky columns present: {leaky}")
    names = [c for c in features.columns if c not in ROW_LABELS]
    counts = features.agg(*[F.count(c).alias(c) for c in names]).first()
    kept = [c for c in names if counts[c] > 0]
    out = features.withColumn("season", cal.season_code(F.col("season")))
    return out.select(*[F.col(c).cast("double").alias(c) if c in kept else F.col(c) for c in [*ROW_LABELS, *kept]]), kept
