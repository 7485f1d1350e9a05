"""Dense daily series from sparse readings."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.functions.numeric import half_even
from wellspring.operators import days as dy
from wellspring.operators.ordering import by_day, keys_of
from wellspring.operators.prepare import storage_mcm

# Day of year of the 15th of each month in a common year.
DAYS_PER_TASK = 1 << 19
MID_MONTH_DOY = (15, 46, 74, 105, 135, 166, 196, 227, 258, 288, 319, 349)


def tasks_for_days(readings: DataFrame, key: str, date: str, start: str | None = None) -> int:
    """Partitions that hold about ``DAYS_PER_TASK`` days each, twice the session's at least.

    Daily rows are then sorted in the memory of a task however many there are.
    """
    first = F.greatest(F.min(date), F.lit(start).cast("date")) if start else F.min(date)
    spans = readings.groupBy(key).agg((F.date_diff(F.max(date), first) + 1).alias("_days"))
    days = spans.where(F.col("_days") > 0).agg(F.sum("_days").alias("_days")).first()["_days"] or 0
    least = 2 * int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-days // DAYS_PER_TASK))


def expand_days(
    readings: DataFrame,
    key: str | list[str],
    date: str,
    carry: dict[str, Column],
    keep: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """One row per calendar day from the first to the last reading of each key.

    Each reading owns the days until the next one, so the calendar comes from
    ``lead`` and ``explode(sequence)``: one shuffle, no calendar table, no join
    and no unbounded-following frame. ``offset`` is the day inside the
    interval and ``gap`` its length (NULL after the last reading). ``carry``
    columns come with their next value, ``keep`` columns alone.

    Rows grow many times here, so the shuffle before it names its partition
    count (twice the session's, which also keeps it from being merged with an
    earlier shuffle): left to itself adaptive execution sizes partitions by the
    few bytes that go in and not by what comes out. ``partitions`` is another
    count, 0 leaves the rows where they are. Of a list of keys the first places
    the rows.
    """
    w = by_day(key, date)
    if partitions is None:
        partitions = 2 * int(readings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    following = F.lead(date).over(w)
    placed = readings.repartition(partitions, keys_of(key)[0]) if partitions else readings
    owned = placed.select(
        *keys_of(key),
        F.col(date).alias("_from"),
        F.date_diff(following, F.col(date)).alias("gap"),
        *[c.alias(n) for n, c in carry.items()],
        *[F.lead(c).over(w).alias(f"next_{n}") for n, c in carry.items()],
        *(keep or []),
    )
    last_offset = F.coalesce(F.col("gap") - 1, F.lit(0))
    rows = owned.withColumn("offset", F.explode(F.sequence(F.lit(0), last_offset)))
    return rows.withColumn(date, F.date_add("_from", F.col("offset"))).drop("_from")


def densify(
    df: DataFrame, key: str | list[str], date: str, columns: list[str], partitions: int | None = None
) -> DataFrame:
    """Gapless daily calendar; days without a row hold NULL."""
    days = expand_days(df, key, date, {c: F.col(c) for c in columns}, partitions=partitions)
    here = F.col("offset") == 0
    return days.select(*keys_of(key), date, *[F.when(here, F.col(c)).alias(c) for c in columns])


def days_to_reading() -> Column:
    """Distance to the nearest reading, on rows made by ``expand_days``."""
    return F.least(F.col("offset"), F.coalesce(F.col("gap") - F.col("offset"), F.col("offset")))


def between(name: str) -> Column:
    """Value on the line from a reading to the next one (``expand_days`` rows)."""
    step = F.coalesce((F.col(f"next_{name}") - F.col(name)) / F.col("gap"), F.lit(0.0))
    return F.col(name) + step * F.col("offset")


def interpolate_linear(readings: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Linear in time between readings, with the distance to the nearest one."""
    days = expand_days(readings, key, date, {value: F.col(value)})
    return days.select(
        key,
        date,
        between(value).alias(value),
        (F.col("offset") == 0).alias("is_observed"),
        days_to_reading().alias("days_from_reading"),
    )


def month_knots(readings: DataFrame) -> DataFrame:
    """Twelve mid-month levels per well; months without readings lie on the
    line between their neighbours around the year, so the curve through all
    twelve equals the curve through the measured ones.
    """
    month = F.month("obs_date")
    means = readings.groupBy("well_id").agg(
        F.array(*[F.avg(F.when(month == m, F.col("level_mbgl"))) for m in range(1, 13)]).alias("_means")
    )
    seen = F.filter(
        F.arrays_zip(F.array(*[F.lit(d) for d in MID_MONTH_DOY]).alias("doy"), F.col("_means").alias("v")),
        lambda k: k["v"].isNotNull(),
    )
    first, last = F.element_at("_seen", 1), F.element_at("_seen", -1)
    ring = F.concat(
        F.array(F.struct((last["doy"] - 366).alias("doy"), last["v"].alias("v"))),
        F.col("_seen"),
        F.array(F.struct((first["doy"] + 366).alias("doy"), first["v"].alias("v"))),
    )

    def at(doy: int) -> Column:
        lo = F.element_at(F.filter("_ring", lambda k: k["doy"] <= doy), -1)
        hi = F.element_at(F.filter("_ring", lambda k: k["doy"] >= doy), 1)
        share = F.lit(float(doy)) - lo["doy"]
        rise = F.when(hi["doy"] > lo["doy"], (hi["v"] - lo["v"]) / (hi["doy"] - lo["doy"]))
        return lo["v"] + F.coalesce(rise, F.lit(0.0)) * share

    return (
        means.withColumn("_seen", seen)
        .withColumn("_ring", ring)
        .select("well_id", F.array(*[at(d) for d in MID_MONTH_DOY]).alias("knots"))
    )


def with_seasonal(df: DataFrame, date: str, out: str = "seasonal") -> DataFrame:
    """Add the seasonal level of a date, read off the twelve-knot ring.

    Built in small steps: one expression for all of it would be repeated in
    every place its parts are used and outgrow generated code.
    """
    start_of = F.array(*[F.lit(d) for d in MID_MONTH_DOY])
    ends = [*MID_MONTH_DOY[1:], MID_MONTH_DOY[0] + 366]
    span_of = F.array(*[F.lit(float(b - a)) for a, b in zip(MID_MONTH_DOY, ends)])
    # A date before the first knot continues the segment that starts at the last.
    steps = df.withColumns({"_doy": F.dayofyear(date), "_slot": F.month(date)})
    steps = steps.withColumn("_slot", F.when(F.col("_doy") >= F.element_at(start_of, F.col("_slot")), F.col("_slot")).otherwise(F.col("_slot") - 1))
    steps = steps.withColumns(
        {
            "_doy": F.when(F.col("_slot") == 0, F.col("_doy") + 366).otherwise(F.col("_doy")),
            "_slot": F.when(F.col("_slot") == 0, 12).otherwise(F.col("_slot")),
        }
    )
    steps = steps.withColumns(
        {
            "_into": (F.col("_doy") - F.element_at(start_of, F.col("_slot"))) / F.element_at(span_of, F.col("_slot")),
            "_here": F.element_at("knots", F.col("_slot")),
            "_then": F.element_at("knots", F.col("_slot") % 12 + 1),
        }
    )
    level = F.col("_here") + (F.col("_then") - F.col("_here")) * F.col("_into")
    return steps.withColumn(out, level).drop("_doy", "_slot", "_into", "_here", "_then")


def clip_level(level: Column, well_depth: Column, settings: Settings = DEFAULTS) -> Column:
    capped = F.when(well_depth > settings.min_level_m, F.least(level, well_depth)).otherwise(level)
    return F.greatest(capped, F.lit(settings.min_level_m))


def _with_anomaly(readings: DataFrame, knots: DataFrame, depths: DataFrame) -> DataFrame:
    base = readings.join(knots, "well_id").join(depths.select("well_id", "well_depth"), "well_id", "left")
    return with_seasonal(base, "obs_date").withColumn("anomaly", F.col("level_mbgl") - F.col("seasonal"))


def _based(readings: DataFrame, wells: DataFrame, settings: Settings) -> DataFrame:
    """Readings of wells that have enough of them, with knots, depth and anomaly."""
    counted = readings.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("well_id"))).where(
        F.col("_n") >= settings.min_readings_to_rebuild
    )
    return _with_anomaly(counted.drop("_n"), month_knots(readings), wells)


def _modelled(days: DataFrame, settings: Settings, mode: str) -> DataFrame:
    """Modelled level of days that know their interval (``expand_days`` columns)."""
    if mode == "linear":
        days = days.withColumn("_model", between("level_mbgl"))
    else:
        carried = between("anomaly") if mode == "full" else F.lit(0.0)
        days = with_seasonal(days, "date").withColumn("_model", F.col("seasonal") + carried)
    return days.withColumns(
        {
            "is_observed": F.col("offset") == 0,
            "_model": half_even(clip_level(F.col("_model"), F.col("well_depth"), settings), 4),
            "_distance": days_to_reading(),
        }
    )


def reconstruct_daily(
    readings: DataFrame,
    wells: DataFrame,
    settings: Settings = DEFAULTS,
    mode: str = "full",
    cells: DataFrame | None = None,
    rows: bool = True,
) -> DataFrame | dy.Days:
    """Daily level = the well's own seasonal curve + linearly carried anomaly.

    Readings must be one per (well, day). Real readings come back exactly;
    other days are clipped to the well and rounded. ``mode`` may also be
    ``climatology`` (no anomaly) or ``linear`` (no seasonal curve). Given
    ``cells`` (well_id, cell_id), rows carry ``cell_id`` and lie by it, once for
    each row that their well has there: what is kept per cell meets them without
    a shuffle of days. Without ``rows`` the days stay arrays of their series
    (``Days``), for what is asked of a series as a whole.
    """
    if not rows:
        return _series_of(readings, wells, settings, cells).then(_rebuild(settings, mode))
    based = _based(readings, wells, settings)
    key, placed = "well_id", []
    if cells is not None:
        key, placed = ["cell_id", "well_id"], ["_copies"]
        based = based.join(cells.groupBy("well_id", "cell_id").agg(F.count(F.lit(1)).alias("_copies")), "well_id", "left")
    days = expand_days(
        based.withColumnRenamed("obs_date", "date"),
        key,
        "date",
        {c: F.col(c) for c in ("level_mbgl", "anomaly")},
        keep=["knots", "well_depth", *placed],
        partitions=tasks_for_days(readings, "well_id", "obs_date", settings.daily_start),
    ).where(F.col("date") >= F.lit(settings.daily_start).cast("date"))
    days = _modelled(days, settings, mode)
    if placed:
        days = days.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("_copies", F.lit(1)))))
    return days.select(
        *keys_of(key),
        "date",
        F.when(F.col("is_observed"), F.col("level_mbgl")).otherwise(F.col("_model")).alias("level_mbgl"),
        "is_observed",
        half_even(F.exp(-F.col("_distance") / F.lit(settings.confidence_tau_days)), 4).alias("confidence"),
    )


def _series_of(readings: DataFrame, wells: DataFrame, settings: Settings, cells: DataFrame | None) -> dy.Days:
    """A row per well that has enough readings, or per cell that the well lies in, with its readings in order."""
    reading = F.when(F.col("obs_date").isNotNull(), F.struct(F.unix_date("obs_date").alias("d"), F.col("level_mbgl").cast("double").alias("v")))
    own = readings.where(F.col("well_id").isNotNull()).groupBy("well_id").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list(reading)).alias("_readings")
    ).where(F.col("_n") >= settings.min_readings_to_rebuild)
    own = own.join(wells.groupBy("well_id").agg(F.max("well_depth").cast("double").alias("depth")), "well_id", "left")
    if cells is None:
        placed = own.withColumns({"cell_id": F.lit(None).cast("string"), "copies": F.lit(1).cast("long")})
    else:
        lying = cells.groupBy("well_id", "cell_id").agg(F.count(F.lit(1)).alias("copies"))
        placed = own.join(lying, "well_id", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    return dy.Days(placed.select("cell_id", "well_id", "copies", "depth", "_readings"))


_DOY = np.arange(367)
_SLOT = (np.searchsorted(MID_MONTH_DOY, _DOY, "right") - 1) % 12
_SPAN = np.diff([*MID_MONTH_DOY, MID_MONTH_DOY[0] + 366])
# How far a day of year is from the knot before it to the next; days before the first knot follow the last.
_INTO = (np.where(_DOY < MID_MONTH_DOY[0], _DOY + 366, _DOY) - np.array(MID_MONTH_DOY)[_SLOT]) / _SPAN[_SLOT].astype(float)


def _knots_of(series: np.ndarray, n: int, days: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """``month_knots`` of ``n`` series: a row of twelve levels for each, from the readings of all."""
    real = levels == levels
    at = (series * 12 + dy.calendar_of(days, "month") - 1)[real]
    count = np.bincount(at, minlength=12 * n)
    mean = np.bincount(at, weights=levels[real], minlength=12 * n) / np.where(count, count, np.nan)
    if (count > 0).all():
        return mean.reshape(n, 12)
    ring = np.tile(mean.reshape(n, 12), 3)
    doy = np.concatenate([np.array(MID_MONTH_DOY) + turn for turn in (-366, 0, 366)])
    place = np.where(ring == ring, np.arange(36), -1)
    before = np.maximum.accumulate(place, axis=1)[:, 12:24]
    after = np.minimum.accumulate(np.where(place < 0, 36, place)[:, ::-1], axis=1)[:, ::-1][:, 12:24]
    # A series without any level has no knots.
    before, after = np.maximum(before, 0), np.minimum(after, 35)
    low, high = np.take_along_axis(ring, before, 1), np.take_along_axis(ring, after, 1)
    rise = np.where(after > before, (high - low) / np.maximum(doy[after] - doy[before], 1), 0.0)
    return low + rise * (doy[12:24] - doy[before])


def _rebuild(settings: Settings, mode: str) -> dy.Step:
    """Columns of ``reconstruct_daily`` for a block of series. Of readings of one day the last owns it."""
    start = (dt.date.fromisoformat(settings.daily_start) - dt.date(1970, 1, 1)).days
    tau, least = float(settings.confidence_tau_days), float(settings.min_level_m)

    def rebuild(b: dy.Block) -> None:
        series = [s for s in b.series if s.days[-1] >= start]
        if not series:
            return
        k = len(series)
        own = np.repeat(np.arange(k), [len(s.days) for s in series])
        days, levels = np.concatenate([s.days for s in series]).astype(np.int64), np.concatenate([s.levels for s in series])
        # A reading owns the days until the next one of its series; days before the start are left out.
        same = own[1:] == own[:-1]
        owns = np.append(~(same & ((days[1:] == days[:-1]) | (days[1:] <= start))), True)
        of, from_, value = own[owns], days[owns], levels[owns]
        opens = np.flatnonzero(np.diff(of, prepend=-1))
        first = np.maximum(from_[opens], start)
        b.span(series, first, np.array([int(s.days[-1]) for s in series]) + 1 - first)
        gap = np.append(np.where(of[1:] == of[:-1], np.diff(from_), 1), 1)
        count = gap.copy()
        count[opens] -= first - from_[opens]
        place = from_ - first[of] + b.starts[of]

        def spread(x: np.ndarray) -> np.ndarray:
            return np.repeat(x, count)

        def between(x: np.ndarray) -> np.ndarray:
            step = np.append(np.diff(x) / gap[:-1], 0.0)
            step[np.append(of[1:] != of[:-1], True) | (step != step)] = 0.0
            return spread(x) + spread(step) * b["_offset"]

        def model() -> np.ndarray:
            if mode == "linear":
                return between(value)
            here = (knots := _knots_of(own, k, days, levels))[:, _SLOT]
            year = (here + (knots[:, (_SLOT + 1) % 12] - here) * _INTO).ravel()
            seasonal = year[b["doy"] + b.per_day(np.arange(k) * 367)]
            if mode != "full":
                return seasonal
            return seasonal + between(value - year[dy.calendar_of(from_, "doy") + of * 367])

        def level(_: dy.Block) -> np.ndarray:
            depth = np.array([s.depth for s in series])
            out = np.fmin(model(), b.per_day(np.where(depth > least, depth, np.nan)))
            out = dy.half_even(np.fmax(out, least), 4)
            inside = from_ >= first[of]
            out[place[inside]] = value[inside]
            return out

        def confidence(_: dy.Block) -> np.ndarray:
            away = np.minimum(b["_offset"], spread(gap) - b["_offset"])
            return dy.half_even(np.exp(-away / tau), 4)

        b.made |= {
            "_offset": lambda b: b["_at"] - spread(place), "level_mbgl": level, "is_observed": lambda b: b["_offset"] == 0,
            "confidence": confidence,
        }

    return rebuild


def daily_at(asks: DataFrame, readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS, mode: str = "full") -> DataFrame:
    """Rows of (well_id, date) with that day's level of ``reconstruct_daily``; rows without one drop out.

    Only the asked days are computed, each from the reading interval that holds
    it: the daily table is not made.
    """
    w = by_day("well_id", "obs_date")
    carried = ("level_mbgl", "anomaly")
    span = F.struct(
        F.col("obs_date").alias("_from"), F.date_diff(F.lead("obs_date").over(w), F.col("obs_date")).alias("gap"), "well_depth",
        *carried, *[F.lead(c).over(w).alias(f"next_{c}") for c in carried],
    )
    spans = _based(readings, wells, settings).select("well_id", F.col("obs_date").alias("date"), F.lit(0).alias("_side"), span.alias("_hit"))
    days = asks.select("well_id", "date").where(F.col("date") >= F.lit(settings.daily_start).cast("date")).distinct()
    upto = Window.partitionBy("well_id").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = spans.unionByName(days.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    held = met.withColumn("_hit", F.last("_hit", ignorenulls=True).over(upto)).where("_side = 1").select("well_id", "date", "_hit.*")
    held = held.withColumn("offset", F.date_diff("date", "_from")).where((F.col("offset") == 0) | (F.col("offset") < F.col("gap")))
    modelled = _modelled(held.join(month_knots(readings), "well_id"), settings, mode)
    level = F.when(F.col("is_observed"), F.col("level_mbgl")).otherwise(F.col("_model"))
    return asks.join(modelled.select("well_id", "date", level.alias("level_mbgl")), ["well_id", "date"])


def mark_holdout(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Every fourth reading of wells with enough of them is held out."""
    w = by_day("well_id", "obs_date")
    whole = Window.partitionBy("well_id")
    out = readings.withColumns(
        {"_no": F.row_number().over(w), "_n": F.count(F.lit(1)).over(whole)}
    )
    kept = F.col("_n") - F.floor(F.col("_n") / 4)
    usable = (F.col("_n") >= 8) & (kept >= settings.min_readings_to_rebuild)
    return out.where(usable).withColumn("held_out", F.col("_no") % 4 == 0).drop("_no", "_n")


def holdout_errors(readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Held-out readings rebuilt without them: truth, prediction, error.

    The neighbours of a held-out reading are always kept ones, so one ``lag``
    and one ``lead`` give its interval; no daily series is made. A held-out
    reading after the last kept one lies outside the rebuilt range and drops.
    """
    marked = mark_holdout(readings, settings)
    knots = month_knots(marked.where(~F.col("held_out")))
    w = by_day("well_id", "obs_date")
    rows = _with_anomaly(marked, knots, wells).withColumns(
        {
            "_before": F.lag(F.struct("obs_date", "anomaly")).over(w),
            "_after": F.lead(F.struct("obs_date", "anomaly")).over(w),
        }
    )
    held = rows.drop("anomaly").where(F.col("held_out") & F.col("_after").isNotNull())
    gap = F.date_diff("_after.obs_date", "_before.obs_date")
    carried = F.col("_before.anomaly") + (F.col("_after.anomaly") - F.col("_before.anomaly")) / gap * F.date_diff(
        "obs_date", "_before.obs_date"
    )
    rebuilt = half_even(
        clip_level(F.col("seasonal") + carried, F.col("well_depth"), settings), 4
    )
    return held.select(
        "well_id", "obs_date", F.col("level_mbgl").alias("y_true"), rebuilt.alias("y_pred")
    ).withColumn("error", F.col("y_pred") - F.col("y_true"))


def interpolate_anchors(
    anchors: DataFrame, capacity: DataFrame, kinds: tuple[str, ...] = ("manual", "wrd_pravah")
) -> DataFrame:
    """Real storage rows plus flagged linear fills between them.

    Reads ``reservoir_id, date, live_storage_pct, storage_mcm, source``; only
    rows of the given kinds anchor the line and every given row is kept, so a
    fill never replaces anything.
    """
    real = anchors.where(F.col("source").isin(*kinds))
    days = expand_days(real, "reservoir_id", "date", {"live_storage_pct": F.col("live_storage_pct")})
    fills = (
        days.where(F.col("offset") > 0)
        .withColumn("live_storage_pct", half_even(between("live_storage_pct"), 2))
        .join(capacity.select("reservoir_id", "capacity_ml"), "reservoir_id", "left")
        .select(
            "reservoir_id",
            "date",
            "live_storage_pct",
            storage_mcm(F.col("live_storage_pct"), F.col("capacity_ml")).alias("storage_mcm"),
            F.lit("interpolated").alias("source"),
        )
    )
    kept = anchors.select("reservoir_id", "date", "live_storage_pct", "storage_mcm", "source")
    return kept.unionByName(fills.join(kept, ["reservoir_id", "date"], "left_anti"))


def _year_rings(daily: DataFrame, settings: Settings) -> DataFrame:
    """Per well the mean of the train period and 366 day means, laid out three times so that a window wraps."""
    train = daily.where(cal.split_of(F.col("date"), settings) == "train")
    per_day = train.groupBy("well_id", F.dayofyear("date").alias("doy")).agg(
        F.avg("level_mbgl").alias("_v"), F.sum("level_mbgl").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    known = per_day.groupBy("well_id").agg(
        (F.sum("_s") / F.sum("_n")).alias("well_mean"), F.sort_array(F.collect_list(F.struct("doy", "_v"))).alias("_days")
    )
    looked = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.try_element_at(F.map_from_entries("_days"), d))
    year = F.when(F.size("_days") == 366, F.col("_days._v")).otherwise(looked)
    return known.select("well_id", "well_mean", year.alias("_year")).select("well_id", "well_mean", F.concat("_year", "_year", "_year").alias("_ring"))


def _ring_mean(doy: Column, settings: Settings) -> Column:
    """Mean of the known days around a day of year; the well's mean where there are none."""
    half = settings.ring_halfwidth_days
    near = F.filter(F.slice("_ring", doy + (366 - half), F.lit(2 * half + 1)), lambda v: v.isNotNull())
    total = F.aggregate(near, F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(near) > 0, total / F.size(near)).otherwise(F.col("well_mean"))


def ring_at(asks: DataFrame, daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows of (well_id, doy) with ``clim`` and ``well_mean`` of ``ring_climatology`` (NULL for other wells)."""
    met = asks.join(_year_rings(daily, settings), "well_id", "left")
    clim = F.when(F.col("doy").isNotNull(), _ring_mean(F.col("doy"), settings))
    return met.withColumns({"clim": clim, "well_mean": F.when(F.col("doy").isNotNull(), F.col("well_mean"))}).drop("_ring")


def _ring_of(b: dy.Block, train_end: int, half: int) -> dy.Answer:
    """``ring_climatology`` of a block of series."""
    k, level, n = len(b.series), b["level_mbgl"], np.clip(train_end + 1 - b.first, 0, b.n)
    real = (b["_place"] < b.per_day(n)) & (level == level)
    at = (b["doy"] - 1 + b.per_day(np.arange(k) * 366))[real]
    known = np.bincount(at, minlength=366 * k).reshape(k, 366)
    total = np.bincount(at, weights=level[real], minlength=366 * k).reshape(k, 366)
    well_mean = np.where(known.any(axis=1), total.sum(axis=1), np.nan) / np.maximum(n, 1)
    mean = np.divide(total, known, out=np.zeros((k, 366)), where=known > 0)

    def around(x: np.ndarray) -> np.ndarray:
        turned = np.hstack([x[:, -half:], x, x[:, :half]]) if half else x
        return np.lib.stride_tricks.sliding_window_view(turned, 2 * half + 1, axis=1).sum(axis=2)

    near = around((known > 0).astype(float))
    clim = np.where(near > 0, around(mean) / np.maximum(near, 1), well_mean[:, None])
    seen = np.flatnonzero(n > 0)
    return {"key": seen, "clim": clim[seen], "well_mean": well_mean[seen]}


def ring_climatology(daily: DataFrame | dy.Days, settings: Settings = DEFAULTS) -> DataFrame:
    """Per well and day of year: mean of the train period within +/-15 days.

    Days are averaged first (at most 366 per well) and lie in one array per well,
    three times, so the window wraps. Every well gets all 366 days; a day with
    nothing near it falls back to the well mean.
    """
    if isinstance(daily, dy.Days):
        end = (dt.date.fromisoformat(settings.train_end) - dt.date(1970, 1, 1)).days
        half = settings.ring_halfwidth_days
        rings = daily.partial(lambda b: _ring_of(b, end, half), "key string, clim array<double>, well_mean double")
        each = rings.select(F.col("key").alias("well_id"), "well_mean", F.posexplode("clim").alias("_at", "clim"))
        return each.select("well_id", (F.col("_at") + 1).alias("doy"), "clim", "well_mean")
    each = F.transform(F.sequence(F.lit(1), F.lit(366)), lambda d: F.struct(d.alias("doy"), _ring_mean(d, settings).alias("clim")))
    rings = _year_rings(daily, settings).select("well_id", "well_mean", F.inline(each))
    return rings.select("well_id", "doy", "clim", "well_mean")
