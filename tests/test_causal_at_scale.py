"""Point-in-time rows made where their weather lies: the same values as the joins, and few moves."""

import datetime as dt

from pyspark.sql import functions as F
from test_daily_at_scale import SETTINGS, plan, sorted_rows, tables
from wellspring.functions import calendar as cal
from wellspring.operators import evaluate as ev
from wellspring.operators import features as ft

HORIZONS = (7, 40, 75)


def odd_tables(spark):
    """Wells listed twice, in two cells, in none, and unknown; readings without a well or a level."""
    readings, wells, cells, weather = tables(spark)
    names = ("lat", "lon", "specific_yield")
    wells = wells.select("well_id", "well_depth", *[(F.ascii("well_id") + k).cast("double").alias(n) for k, n in enumerate(names)])
    wells = wells.unionByName(wells.where("well_id = 'B'").withColumn("well_depth", F.lit(13.0)))
    cells = cells.where("well_id <> 'C'").unionByName(
        spark.createDataFrame([("A", "1"), ("A", "2"), ("Z", "2"), ("B", None)], "well_id string, cell_id string")
    )
    more = [("U", dt.date(1998, 3, 1) + dt.timedelta(days=31 * i), 5.0 + i if i % 4 else None, "rabi") for i in range(12)]
    lost = [(None, dt.date(1998, 3, 1) + dt.timedelta(days=9 * i), 5.0, "rabi") for i in range(12)]
    few = [("F", dt.date(1999, 1, 1), 4.0, None)]
    extra = spark.createDataFrame(more + lost + few, "well_id string, obs_date date, level_mbgl double, season string")
    return readings.unionByName(extra), wells, cells, weather


def joined(readings, weather, cells, wells):
    """The same rows by an as-of join and a join per table."""
    kept = ft.qualified_readings(readings, 4, SETTINGS)
    season, well = ft.climatology(kept, SETTINGS)
    df = ft.point_features(ft.target_spine(kept, HORIZONS), ft.reading_history(kept), weather, cells, wells, season, well, SETTINGS)
    df = df.where(F.col("last_obs_date") < F.col("target_date")).withColumn("split", cal.split_of(F.col("target_date"), SETTINGS))
    return df.where(F.col("split").isNotNull() & F.col("target_level").isNotNull())


def test_causal_rows_equal_those_of_the_joins(spark):
    readings, wells, cells, weather = odd_tables(spark)
    got = ft.causal_features(readings, weather, cells, wells, HORIZONS, 4, settings=SETTINGS)
    floats = [f.name for f in got.schema.fields if f.dataType.typeName() == "double"]
    rounded = {c: F.round(c, 9) for c in floats}
    want = joined(readings, weather, cells, wells).select(got.columns)
    found = sorted_rows(got.withColumns(rounded))
    assert found == sorted_rows(want.withColumns(rounded)) and len(found) > 200
    assert {"A", "B", "C", "U"} == {r.well_id for r in got.select("well_id").distinct().collect()}


def test_rows_made_do_not_move(spark):
    readings, wells, cells, weather = odd_tables(spark)
    text = plan(ft.causal_features(readings, weather, cells, wells, HORIZONS, 4, settings=SETTINGS))
    # Neither shuffled nor sorted after a reading became a row per horizon.
    above = text.split("Generate explode(array(struct(horizon_d")[0]
    assert "horizon_d" in above and "Exchange" not in above and "SortMergeJoin" not in above


def test_scores_of_a_model_column_equal_those_of_a_joined_table(spark):
    readings, wells, cells, weather = odd_tables(spark)
    causal = ft.causal_features(readings, weather, cells, wells, HORIZONS, 4, settings=SETTINGS)
    model = F.when(F.col("last_obs_level") > 3, F.col("last_obs_level") + 1)
    table = causal.where("last_obs_level > 3").select("well_id", "origin_date", "horizon_d", model.alias("model_level"))
    reference = ev.reference_levels(readings, SETTINGS)
    one = ev.forecaster_scores(causal, reference, model)
    found = sorted_rows(one)
    assert found == sorted_rows(ev.forecaster_scores(causal, reference, table)) and len(found) > 200
    # The features are read once and met with the reference alone.
    text = plan(one.where("forecaster = 'model'"))
    assert text.count("Generate inline(_wells") == 1
