"""Daily rows that stay where they are made: the same values without a shuffle or sort of days."""

import datetime as dt

from pyspark.sql import functions as F
from wellspring.config import Settings
from wellspring.operators import evaluate as ev
from wellspring.operators import features as ft
from wellspring.operators import score as sc
from wellspring.operators import series as ser

SETTINGS = Settings(
    train_end="1999-06-30", val_end="2000-06-30", test_end="2001-08-31", daily_start="1998-01-01", history_floor="1998-01-01", min_readings=4,
)
WELLS = [("A", 30.0, "north"), ("B", 12.0, "north"), ("C", None, "south")]


def tables(spark):
    start = dt.date(1998, 1, 3)
    rows = [
        (w, start + dt.timedelta(days=step * i + k), float((7 * i + 3 * k) % 11) + 0.25)
        for k, (w, _, _) in enumerate(WELLS)
        for step, i in [(37 + 9 * k, i) for i in range(24)]
    ]
    readings = spark.createDataFrame(rows, "well_id string, obs_date date, level_mbgl double").withColumn(
        "season", F.when(F.month("obs_date") < 6, "pre_monsoon").when(F.month("obs_date") < 10, "monsoon").otherwise("rabi")
    )
    wells = spark.createDataFrame(WELLS, "well_id string, well_depth double, taluka string")
    cells = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "2")], "well_id string, cell_id string")
    days = [("1", start + dt.timedelta(days=i), float(i % 5)) for i in range(900) if i % 17]
    weather = spark.createDataFrame(days, "cell_id string, date date, precip_mm double").withColumns(
        {"et0_mm": F.col("precip_mm") / 2, **{c: F.lit(None).cast("double") for c in ("soil_moist_0_7", "soil_moist_7_28", "temp_max", "rh_mean")}}
    )
    return readings, wells, cells, weather


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def sorted_rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def test_features_of_days_that_lie_by_cell(spark):
    readings, wells, cells, weather = tables(spark)
    apart = ft.rural_levels(ser.reconstruct_daily(readings, wells, SETTINGS))
    placed = ft.rural_levels(ser.reconstruct_daily(readings, wells, SETTINGS, cells=cells))
    one = ft.daily_features(apart, weather, cells, "rural", SETTINGS)
    two = ft.daily_features(placed, weather, cells, "rural", SETTINGS)
    assert "cell_id" in two.columns
    found = sorted_rows(two.drop("cell_id"))
    assert found == sorted_rows(one) and len(found) > 500
    # Nothing is exchanged or sorted for a join once days are laid out.
    above = plan(two).split("Generate")[0]
    assert "SortMergeJoin" not in above


def test_weather_of_days_that_lie_by_cell(spark):
    readings, wells, cells, weather = tables(spark)
    apart = ser.reconstruct_daily(readings, wells, SETTINGS)
    placed = ser.reconstruct_daily(readings, wells, SETTINGS, cells=cells)
    one = ft.with_weather(ft.rural_levels(apart), weather, cells)
    two = ft.with_weather(ft.rural_levels(placed), weather, cells)
    assert sorted_rows(one) == sorted_rows(two)


def test_days_per_task_are_bounded(spark):
    readings, *_ = tables(spark)
    n = 3 * ser.DAYS_PER_TASK
    long = spark.createDataFrame([("A", dt.date(1, 1, 1)), ("A", dt.date(1, 1, 1) + dt.timedelta(days=n - 1))], "well_id string, obs_date date")
    least = ser.tasks_for_days(readings, "well_id", "obs_date")
    assert least == 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ser.tasks_for_days(long.withColumn("k", F.lit(1)), "k", "obs_date") == max(least, 3)


def test_asked_days_equal_the_daily_table(spark):
    readings, wells, *_ = tables(spark)
    daily = ser.reconstruct_daily(readings, wells, SETTINGS).select("well_id", "date", "level_mbgl")
    asks = daily.select("well_id", "date").union(
        spark.createDataFrame([("A", dt.date(1997, 1, 1)), ("A", dt.date(2030, 1, 1)), ("X", dt.date(1999, 1, 1)), (None, None)], "well_id string, date date")
    )
    assert sorted_rows(ser.daily_at(asks, readings, wells, SETTINGS)) == sorted_rows(daily)


def test_ring_means_by_hand(spark):
    readings, wells, *_ = tables(spark)
    daily = ser.reconstruct_daily(readings, wells, SETTINGS).cache()
    days = daily.where(F.col("date") <= F.lit(SETTINGS.train_end).cast("date")).select("well_id", F.dayofyear("date").alias("doy"), "level_mbgl").collect()
    per_day = {}
    for w, d, v in days:
        per_day.setdefault((w, d), []).append(v)
    mean = {k: sum(v) / len(v) for k, v in per_day.items()}
    ring = {(r.well_id, r.doy): r.clim for r in ser.ring_climatology(daily, SETTINGS).collect()}
    assert len(ring) == 3 * 366
    for (w, d), clim in ring.items():
        near = [mean[w, (d + k - 1) % 366 + 1] for k in range(-15, 16) if (w, (d + k - 1) % 366 + 1) in mean]
        assert abs(clim - sum(near) / len(near)) < 1e-9
    asked = ser.ring_at(daily.select("well_id", F.dayofyear("date").alias("doy")).distinct(), daily, SETTINGS)
    assert all(r.clim == ring[r.well_id, r.doy] for r in asked.collect())


def test_baselines_without_meeting_the_daily_table(spark):
    readings, wells, *_ = tables(spark)
    daily = ser.reconstruct_daily(readings, wells, SETTINGS)
    met = ev.baseline_predictions(daily, readings, settings=SETTINGS)
    asked = ev.baseline_predictions(daily, readings, settings=SETTINGS, wells=wells)
    assert sorted_rows(met) == sorted_rows(asked) and met.count() > 0


def test_area_timeline_keeps_days_in_a_hash_aggregate(spark):
    readings, wells, *_ = tables(spark)
    out = sc.area_timeline(readings, wells, SETTINGS)
    assert "SortAggregate" not in plan(out).split("Generate")[0]
    states = sc.well_states(readings, wells, SETTINGS).collect()
    dates = {(w.taluka, r.obs_date) for r in readings.collect() for w in wells.collect() if w.well_id == r.well_id}
    own = {(r.well_id, r.date): r.score for r in sc.well_timeline(readings, wells, SETTINGS).collect()}
    got = {(r.entity_id, r.date): r for r in out.collect()}
    scored_areas = {(t, d) for t, d in dates if any(s.taluka == t and s.obs_date <= d and (s.valid_to is None or d <= s.valid_to) for s in states)}
    assert set(got) == scored_areas
    # On its own reading date a well cannot score above its area.
    taluka = {w.well_id: w.taluka for w in wells.collect()}
    assert all(got[taluka[w], d].score >= s for (w, d), s in own.items())
    south = {d: s for (w, d), s in own.items() if w == "C"}
    assert south and all(got["south", d].score == s for d, s in south.items())
