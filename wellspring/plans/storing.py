"""Queries: what writers leave behind, read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wellspring.functions.numeric import half_even
from wellspring.operators import quality as dq
from wellspring.plans.registry import query
from wellspring.plans.sql_views import r
from wellspring.schemas import ANCHORS, conform
from wellspring.sources import readers, writers


@query("SRC-1 SNK-4", "SELECT reservoir_id AS entity_id, date, live_storage_pct, 'primary' AS confidence FROM fx_anchors")
def anchors_through_csv(fx):
    """Anchors exported as CSV and read again by the anchor reader."""
    path = fx.fresh_dir("anchors")
    a = fx.anchors.withColumnRenamed("reservoir_id", "entity_id").withColumn("confidence", F.lit("primary"))
    writers.export_csv(conform(a, ANCHORS), path, ANCHORS.fieldNames())
    return readers.read_anchors(fx.spark, path).select("entity_id", "date", "live_storage_pct", "confidence")


@query(
    "SNK-3",
    "SELECT well_id, obs_date, season, CASE WHEN season = 'monsoon' THEN level_mbgl + 1 ELSE level_mbgl END AS level_mbgl FROM fx_obs",
)
def replaced_partitions(fx):
    """A table written whole, then one season of it replaced."""
    path = fx.fresh_dir("readings")
    rows = fx.readings.select("well_id", "obs_date", "season", "level_mbgl")
    writers.replace_table(rows, path, ["season"])
    wet = rows.where(F.col("season") == "monsoon").withColumn("level_mbgl", F.col("level_mbgl") + 1)
    writers.replace_partitions(wet, path, ["season"])
    return fx.spark.read.parquet(path).select("well_id", "obs_date", "season", "level_mbgl")


@query(
    "SNK-4",
    f"SELECT cell_id, date, precip_mm, {r('et0_mm',6)} AS et0_mm, {r('temp_max',6)} AS temp_max FROM fx_weather",
)
def exported_weather(fx):
    """All-NULL columns (soil, humidity) are not exported."""
    path = fx.fresh_dir("weather")
    writers.export_parquet(fx.weather, path)
    back = fx.spark.read.parquet(path)
    return back.withColumns({c: half_even(F.col(c), 6) for c in ("et0_mm", "temp_max")})


@query("SNK-5", "SELECT well_id, obs_date, level_mbgl FROM fx_obs")
def published_readings(fx):
    """A snapshot published behind checks that pass, after one that is refused."""
    root = fx.fresh_dir("published")
    rows = fx.readings.select("well_id", "obs_date", "level_mbgl")
    plausible = dq.run_checks({"readings": fx.readings, "wells": fx.base_wells}, "", fx.settings, ("levels_plausible",))
    refused = plausible.withColumn("status", F.lit("FAIL"))
    if writers.publish(rows, refused, root, "1") or not writers.publish(rows, plausible, root, "2"):
        raise RuntimeError("the gate did not hold")
    return fx.spark.read.parquet(f"{root}/version=2")


@query("SNK-6", "SELECT 'readings' AS script, 'ok' AS status, count(*) AS rows_out FROM fx_obs")
def run_log(fx):
    root = fx.fresh_dir("runs")
    writers.logged_run(fx.spark, "readings", f"{root}/log", lambda: fx.readings, lambda d: writers.replace_table(d, f"{root}/table"))
    return fx.spark.read.parquet(f"{root}/log").select("script", "status", "rows_out")


@query(
    "SNK-7",
    f"SELECT season, count(*) AS n, {r('avg(level_mbgl)',6)} AS mean_level FROM fx_obs GROUP BY 1",
)
def written_report(fx):
    path = fx.fresh_dir("report")
    metrics = fx.readings.groupBy("season").agg(
        F.count(F.lit(1)).alias("n"), half_even(F.avg("level_mbgl"), 6).alias("mean_level")
    )
    writers.write_report(metrics, path)
    return fx.spark.read.schema("season string, n long, mean_level double").json(path)
