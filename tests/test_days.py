"""Days as arrays of their series give what the rows of days give, and no row of a day leaves them."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from wellspring.config import Settings
from wellspring.operators import evaluate as ev
from wellspring.operators import features as ft
from wellspring.operators import quality as dq
from wellspring.operators import series as ser
from wellspring.operators import views as vw
from wellspring.plans import timeseries as ts

SETTINGS = Settings(
    train_end="1999-06-30", val_end="2000-06-30", test_end="2001-08-31", daily_start="1998-01-01", history_floor="1998-01-01", min_readings=4,
)
START = dt.date(1998, 1, 3)
# Well, depth, cell, step between readings, readings, day of the first one: clipped, of unknown depth, in a cell without
# weather, in no cell, with too few readings, begun before the daily table, over before it, of one month, of each day.
WELLS = [
    ("A", 30.0, "1", 37, 24, 0), ("B", 4.0, "1", 46, 24, 5), ("C", None, "2", 55, 20, 0), ("D", 30.0, None, 29, 30, 9), ("E", 30.0, "1", 99, 3, 0),
    ("F", 0.0, "1", 61, 30, -500), ("G", 30.0, "1", 20, 9, -900), ("H", 30.0, "3", 365, 4, 20), ("I", 30.0, "3", 1, 200, 300),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (w, START + dt.timedelta(days=step * i + first), None if (w, i) in (("A", 7), ("I", 199)) else float((7 * i + 3 * k) % 11) + 0.25)
        for k, (w, _, _, step, n, first) in enumerate(WELLS)
        for i in range(n)
    ]
    rows += [("A", None, 5.0), (None, START, 5.0), (None, START + dt.timedelta(days=1), 5.0)]
    readings = spark.createDataFrame(rows, "well_id string, obs_date date, level_mbgl double")
    wells = spark.createDataFrame([(w, depth) for w, depth, *_ in WELLS] + [(None, 3.0)], "well_id string, well_depth double")
    cells = spark.createDataFrame([(w, c) for w, _, c, *_ in WELLS if c], "well_id string, cell_id string")
    days = [
        (c, START + dt.timedelta(days=i + first), None if i % 13 == 5 else float(i % 5))
        for c, first, n in (("1", 40, 900), ("3", -50, 700), ("9", 0, 20))
        for i in range(n) if i % 17
    ]
    days += [(None, START, 3.0), ("1", None, 3.0)]
    weather = spark.createDataFrame(days, "cell_id string, date date, precip_mm double").withColumns(
        {"et0_mm": F.col("precip_mm") / 3, **{c: F.lit(None).cast("double") for c in ("soil_moist_0_7", "soil_moist_7_28", "temp_max", "rh_mean")}}
    )
    return [df.cache() for df in (readings, wells, cells, weather)]


def rebuilt(tables, rows, mode="full"):
    readings, wells, cells, _ = tables
    return ser.reconstruct_daily(readings, wells, SETTINGS, mode, cells=cells, rows=rows)


def featured(tables, rows):
    _, _, cells, weather = tables
    return ft.daily_features(ft.rural_levels(rebuilt(tables, rows)), weather, cells, "rural", SETTINGS)


def found(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: repr(r[:2]))


def same(one, two):
    assert len(one) == len(two)
    for a, b in zip(one, two):
        assert a[:2] == b[:2]
        assert [x is None for x in a] == [x is None for x in b], (a, b)
        assert all(x == y or isinstance(x, float) and abs(x - y) < 1e-9 for x, y in zip(a, b) if x is not None), (a, b)


def spread(days, columns):
    """The days as rows, to compare them."""
    schema = "key string, date int, " + ", ".join(f"{c} double" for c in columns)

    def ask(b):
        of = b.per_day(np.arange(len(b.series)))[b.kept]
        return {"key": of, "date": b["date"][b.kept], **{c: b[c][b.kept].astype(float) for c in columns}}

    return days.partial(ask, schema).withColumns({"entity_id": F.col("key"), "date": F.date_from_unix_date("date")})


def test_rebuilt_days_are_those_of_rows(tables):
    columns = ["level_mbgl", "is_observed", "confidence"]
    for mode in ("full", "climatology", "linear"):
        rows = rebuilt(tables, True, mode).withColumns({"entity_id": F.col("well_id"), "is_observed": F.col("is_observed").cast("double")})
        one, two = (found(df, ["entity_id", "date", *columns]) for df in (rows, spread(rebuilt(tables, False, mode), columns)))
        same(one, two)
        assert {r[0] for r in one} == set("ABCDFHI")


def test_features_of_days_are_those_of_rows(tables):
    columns = [*ts._FT1, "precip_mm", "et0_mm", "temp_max", "month"]
    rows = featured(tables, True).withColumns({c: F.col(c).cast("double") for c in columns})
    one, two = (found(df, ["entity_id", "date", *columns]) for df in (rows, spread(featured(tables, False), columns)))
    same(one, two)
    assert len(one) > 1500 and {r[0] for r in one} == set("ABFHI")


def test_blocks_of_days_do_not_matter(tables):
    columns = ["level", "rain_90d", "cum_monsoon_rainfall", "target_level_t30"]
    whole = found(spread(featured(tables, False), columns), ["entity_id", "date", *columns])
    steps = featured(tables, False)
    alone = [found(spread(steps.__class__(steps.series.where(F.col("well_id") == w), steps.steps, steps.weather, steps.names), columns), ["entity_id", "date", *columns]) for w in "ABFHI"]
    same(whole, sorted((r for part in alone for r in part), key=lambda r: repr(r[:2])))


def test_split_coverage_of_days(tables):
    names = ["entity_type", "split", "n", "first_date", "last_date", "n_entities"]
    urban = featured(tables, True).withColumn("entity_type", F.lit("reservoir"))
    one = found(vw.split_coverage(featured(tables, True), urban), names)
    assert one == found(vw.split_coverage(featured(tables, False), urban), names)
    assert {(r[0], r[1]) for r in one} == {(t, s) for t in ("well", "reservoir") for s in ("all", "train", "val", "test")}
    # Spans of a series' splits leave the arrays, days do not.
    assert vw._spans(featured(tables, False)).count() <= 3 * len(WELLS)


def test_ring_climatology_of_days(tables):
    readings, wells, *_ = tables
    names = ["well_id", "doy", "clim", "well_mean"]
    one, two = (found(ser.ring_climatology(ser.reconstruct_daily(readings, wells, SETTINGS, rows=r), SETTINGS), names) for r in (True, False))
    same(one, two)
    assert len(one) == 7 * 366 and {r[0] for r in one} == set("ABCDFHI")


def test_quality_of_days(tables):
    readings, wells, cells, weather = tables
    names = ["table_name", "check_name", "status", "measured"]
    parts = ("daily", "features")
    chosen = [c.name for c in dq.CHECKS if c.table in parts and c.name != "populated"] + ["every_well_day_has_weather"]

    def checks(rows):
        daily = ser.reconstruct_daily(readings, wells, SETTINGS, rows=rows)
        given = {"daily": daily, "daily_by_cell": rebuilt(tables, rows), "weather": weather, "cells": cells, "features": featured(tables, rows)}
        return found(dq.run_checks(given, "", SETTINGS, chosen), names)

    one, two = checks(True), checks(False)
    same(one, two)
    measured = {r[1]: r[3] for r in two}
    assert measured["every_well_day_has_weather"] > 0 and measured["no_nulls_precip_mm"] > 0 and measured["no_nulls_level"] > 0


def test_counting_checks_see_wells_that_lie_twice_in_a_cell(tables):
    readings, wells, cells, weather = tables
    chosen = ("no_duplicate_keys", "no_nulls_precip_mm")

    def measured(cells):
        days = ser.reconstruct_daily(readings, wells, SETTINGS, cells=cells, rows=False)
        given = {"features": ft.daily_features(ft.rural_levels(days), weather, cells, "rural", SETTINGS)}
        return {r.check_name: r.measured for r in dq.run_checks(given, "", SETTINGS, chosen).collect()}

    once, twice = measured(cells), measured(cells.unionByName(cells.where("well_id = 'A'")))
    keys = featured(tables, True).where("entity_id = 'A'").count()
    assert once["no_duplicate_keys"] == 0 and twice["no_duplicate_keys"] == keys
    assert twice["no_nulls_precip_mm"] > once["no_nulls_precip_mm"]


def test_years_of_days(tables):
    columns = ts._FT1
    names = ["entity_id", "year", "n_rows", *[f"{kind}_{c}" for c in columns for kind in ("n", "sum")]]
    one, two = (found(ts.yearly(featured(tables, rows), "entity_id", "date", columns), names) for rows in (True, False))
    same(one, two)
    assert len(one) > 10


def test_wells_listed_twice_count_once(tables):
    readings, wells, cells, weather = tables
    twice = readings, wells.unionByName(wells.where("well_id = 'A'")), cells, weather
    names = ["entity_id", "year", "n_rows", "sum_level"]
    one, two = (found(ts.yearly(featured(t, False), "entity_id", "date", ["level"]), names) for t in (tables, twice))
    same(one, two)


def test_target_correlation_of_days(tables):
    names = ["entity_type", "entity_type", "corr_level", "corr_lag_30"]
    rows = featured(tables, True)
    urban = rows.where("entity_id = 'A'").withColumn("entity_type", F.lit("reservoir"))
    want = rows.groupBy("entity_type").agg(F.corr("level", "target_level_t30").alias("corr_level"), F.corr("level_lag_30", "target_level_t30").alias("corr_lag_30"))
    same(found(want, names), found(ev.target_correlation(featured(tables, False)), names))
    # A track in two parts, of rows and of days, is merged.
    parts = [featured(tables, False), rows.where("entity_id = 'A'"), urban]
    both = rows.unionByName(rows.where("entity_id = 'A'")).unionByName(urban)
    want = both.groupBy("entity_type").agg(F.corr("level", "target_level_t30").alias("corr_level"), F.corr("level_lag_30", "target_level_t30").alias("corr_lag_30"))
    same(found(want, names), found(ev.target_correlation(*parts), names))
