"""From wide station files to a quality-checked registry with readings."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.functions import geo
from wellspring.functions.numeric import half_even, to_double
from wellspring.functions.text import clean_name, plain, station_id
from wellspring.operators.lineage import cut_lineage
from wellspring.operators.ordering import exact_quantiles, with_run

# Fixed value: the shape of a period column name.
PERIOD_COLUMN = re.compile(r"^(Jan|May|Aug|Nov)-(\d{2})$")

# Station counts that decide how to go on, and what is said.
STATION_VERDICTS = ((150, "GREEN"), (50, "AMBER"), (1, "RED"), (0, "STOP"))


def with_station_ids(
    df: DataFrame, lat: str = "lat", lon: str = "lon", name: str = "station_name", prefix: str = "MH"
) -> DataFrame:
    return df.withColumn("well_id", station_id(F.col(lat), F.col(lon), F.col(name), prefix))


def in_state(df: DataFrame, column: str, state: str) -> DataFrame:
    return df.where(plain(F.col(column)) == state.strip().lower())


def period_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if PERIOD_COLUMN.match(c)]


def unpivot_periods(
    wide: DataFrame, ids: list[str], source: str, settings: Settings = DEFAULTS
) -> DataFrame:
    """One row per (station, period) that holds a level, dated to mid-month."""
    long = wide.unpivot(ids, period_columns(wide), "period", "level_mbgl")
    dated = long.where(F.col("level_mbgl").isNotNull()).withColumn(
        "obs_date", cal.period_to_date(F.col("period"))
    )
    return dated.select(
        *ids,
        "obs_date",
        F.col("level_mbgl").cast("double").alias("level_mbgl"),
        cal.lookup(cal.ROUND_SEASONS, F.month("obs_date")).alias("season"),
        F.lit(source).alias("source"),
        cal.is_recent(F.col("obs_date"), settings).alias("is_last_5y"),
    )


def qc_profile(readings: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Counts, year coverage, repeat run, range and first and last day per well, with four fail flags.

    Rows are shuffled once, by well; years and runs are counted where they land.
    """
    rows = with_run(readings, "well_id", "obs_date", "level_mbgl")
    per_year = rows.groupBy("well_id", F.year("obs_date").alias("_y")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("level_mbgl").alias("_lo"),
        F.max("level_mbgl").alias("_hi"),
        F.max("run").alias("_run"),
        F.min("obs_date").alias("_first"),
        F.max("obs_date").alias("_last"),
    )
    profile = per_year.groupBy("well_id").agg(
        F.sum("_n").alias("n_obs"),
        (F.max("_y") - F.min("_y") + 1).alias("yrs_span"),
        F.count_if(F.col("_n") >= 2).alias("_full_years"),
        F.min("_lo").alias("min_lvl"),
        F.max("_hi").alias("max_lvl"),
        F.max("_run").cast("long").alias("max_run"),
        F.min("_first").alias("first_obs"),
        F.max("_last").alias("last_obs"),
    )
    out = profile.withColumn("yr_cov", F.col("_full_years") / F.col("yrs_span"))
    out = out.withColumns(
        {
            "fail_readings": F.col("n_obs") < settings.min_readings,
            "fail_yr_cov": F.col("yr_cov") < settings.min_year_coverage,
            "fail_repeat": F.col("max_run") >= settings.max_repeat_run,
            "fail_range": (F.col("min_lvl") <= 0) | (F.col("max_lvl") > settings.max_plausible_m),
        }
    )
    failed = F.col("fail_readings") | F.col("fail_yr_cov") | F.col("fail_repeat") | F.col("fail_range")
    return out.withColumn("keep", ~failed).drop("_full_years")


def qc_summary(profile: DataFrame) -> DataFrame:
    """How many wells each rule drops, and how many stay."""
    return profile.agg(
        F.count(F.lit(1)).alias("wells_in"),
        *[
            F.count_if(F.col(c)).alias(c)
            for c in ("fail_readings", "fail_yr_cov", "fail_repeat", "fail_range")
        ],
        F.count_if("keep").alias("wells_kept"),
    )


def modal_value(df: DataFrame, group: str, value: str) -> DataFrame:
    """Most frequent value per group, the lowest on a tie.

    Values are counted first, so a large group arrives as one row per value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(
        F.max_by(value, F.struct(F.col("_n"), -F.col(value))).alias("modal")
    )


# Cell sizes double from level to level, from about a metre to all of the earth.
_LEVELS = 27
_BASE_DEGREES = 0.01 / 1024
_LEVELS_AT_ONCE = 7


def _cell(coord: Column, level: Column) -> Column:
    return F.floor(coord / (F.lit(_BASE_DEGREES) * F.pow(F.lit(2.0), level))).cast("long")


def nearest_donor(
    points: DataFrame, donors: DataFrame, value: str, planar: bool = False
) -> DataFrame:
    """Nearest donor for each point, ties to the lowest donor id.

    Hash joins on grid cells of doubling size, no cross join. Distinct donor
    positions are known per level as a set of occupied cells. Levels are tried
    a few at a time from the finest on, and only points without a donor so far
    go on to coarser ones; cells of a metre keep a dense town from becoming
    one cell of all its points and donors. A point finds the finest level where its 3x3 block is occupied: with cells of s degrees
    some donor is then less than 2*sqrt(2)*s away. The nearest one can differ
    from the point by that much in latitude and by that much over the cosine
    of the latitude in longitude, so the point looks again in the 3x3 block of
    the first level whose cells are at least as wide, which is exact. (Points
    are not matched across the antimeridian.)
    """
    spots = cut_lineage(
        donors.groupBy(F.col("lat").alias("d_lat"), F.col("lon").alias("d_lon")).agg(
            F.min(F.struct(F.col("well_id").alias("donor_id"), F.col(value).alias("donor_value"))).alias("d")
        )
    )
    leveled = spots.withColumn("_l", F.explode(F.sequence(F.lit(0), F.lit(_LEVELS)))).withColumns(
        {"_y": _cell(F.col("d_lat"), F.col("_l")), "_x": _cell(F.col("d_lon"), F.col("_l"))}
    )
    occupied = leveled.select("_l", "_y", "_x").distinct()
    places = cut_lineage(points.select("lat", "lon").distinct())
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))

    def block(df: DataFrame) -> DataFrame:
        cells = df.withColumns(
            {"_y": _cell(F.col("lat"), F.col("_l")), "_x": _cell(F.col("lon"), F.col("_l"))}
        )
        rows = cells.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
        return rows.withColumns({"_y": F.col("_y") + F.col("_dy"), "_x": F.col("_x") + F.col("_dx")}).drop(
            "_dy", "_dx"
        )

    finest, left = None, places
    for low in range(0, _LEVELS + 1, _LEVELS_AT_ONCE):
        high = min(low + _LEVELS_AT_ONCE - 1, _LEVELS)
        probe = block(left.withColumn("_l", F.explode(F.sequence(F.lit(low), F.lit(high)))))
        some = occupied.where(F.col("_l").between(low, high))
        found = cut_lineage(
            probe.join(some, ["_l", "_y", "_x"]).groupBy("lat", "lon").agg(F.min("_l").alias("_first"))
        )
        finest = found if finest is None else finest.unionByName(found)
        left = left.join(found, ["lat", "lon"], "left_anti")
        if left.isEmpty():
            break
    reach = F.lit(2 * math.sqrt(2)) * F.lit(_BASE_DEGREES) * F.pow(F.lit(2.0), F.col("_first"))
    latitude = F.least(F.abs("lat") + reach, F.lit(89.9))
    shrink = F.lit(1.0) if planar else F.cos(F.radians(latitude))
    extra = F.ceil(F.log2(F.lit(2 * math.sqrt(2)) / shrink)).cast("int")
    chosen = finest.withColumn("_l", F.least(F.col("_first") + extra, F.lit(_LEVELS)))
    measure = geo.planar_km if planar else geo.haversine_km
    best = (
        block(chosen.drop("_first"))
        .join(leveled, ["_l", "_y", "_x"])
        .withColumn("km", measure(F.col("lat"), F.col("lon"), F.col("d_lat"), F.col("d_lon")))
        .groupBy("lat", "lon")
        .agg(F.min(F.struct("km", "d.donor_id", "d.donor_value")).alias("b"))
    )
    return points.join(best, ["lat", "lon"]).select(
        *points.columns,
        F.col("b.donor_id").alias("donor_id"),
        F.col("b.donor_value").alias("donor_value"),
        F.col("b.km").alias("donor_km"),
    )


def attach_specific_yield(registry: DataFrame, donors: DataFrame) -> DataFrame:
    """Measured, else the district's modal value, else the nearest donor's."""
    own = donors.select("well_id", F.col("reference_sy").alias("_own"))
    modal = modal_value(donors, "district", "reference_sy").withColumnRenamed("modal", "_modal")
    base = registry.drop("specific_yield").join(own, "well_id", "left").join(modal, "district", "left")
    missing = base.where(F.col("_own").isNull() & F.col("_modal").isNull())
    near = nearest_donor(missing.select("well_id", "lat", "lon"), donors, "reference_sy").select(
        "well_id", F.col("donor_value").alias("_near"), F.col("donor_km").alias("_km")
    )
    out = base.join(near, "well_id", "left")
    return out.withColumns(
        {
            "specific_yield": F.coalesce("_own", "_modal", "_near"),
            "sy_source": F.when(F.col("_own").isNotNull(), "measured")
            .when(F.col("_modal").isNotNull(), "district_modal")
            .when(F.col("_near").isNotNull(), "nearest_well"),
            "sy_donor_km": F.when(F.col("_own").isNotNull(), F.lit(0.0)).otherwise(
                half_even(F.col("_km"), 1)
            ),
        }
    ).drop("_own", "_modal", "_near", "_km")


def registry_stats(readings: DataFrame) -> DataFrame:
    return readings.groupBy("well_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_observations"),
        F.min("obs_date").alias("first_obs"),
        F.max("obs_date").alias("last_obs"),
    )


def clean_registry(wide: DataFrame) -> DataFrame:
    """Attributes of a wide station file under their registry names."""
    return wide.select(
        "well_id",
        F.col("lat").cast("double").alias("lat"),
        F.col("lon").cast("double").alias("lon"),
        clean_name(F.col("district")).alias("district"),
        clean_name(F.col("taluka")).alias("taluka"),
        clean_name(F.col("village")).alias("village"),
        F.col("aquifer_type") if "aquifer_type" in wide.columns else F.lit(None).cast("string").alias("aquifer_type"),
        to_double(F.col("well_depth")).alias("well_depth"),
    )


def prepare_wells(
    wide: DataFrame, donors: DataFrame, source: str, settings: Settings = DEFAULTS
) -> tuple[DataFrame, DataFrame]:
    """Registry and readings of the wells that pass quality control."""
    long = unpivot_periods(wide, ["well_id"], source, settings)
    kept = qc_profile(long, settings).where("keep").select(
        "well_id", F.col("n_obs").cast("int").alias("n_observations"), "first_obs", "last_obs"
    )
    # One row per well, read for the donors of some wells and for the result.
    registry = cut_lineage(clean_registry(wide).join(kept, "well_id"))
    readings = long.join(registry.select("well_id"), "well_id", "left_semi")
    named = donors.withColumn("district", clean_name(F.col("district")))
    return attach_specific_yield(registry, named), readings


def yield_provenance(registry: DataFrame) -> DataFrame:
    """Wells and median distance to the donor per source of the specific yield."""
    counts = registry.groupBy("sy_source").agg(F.count(F.lit(1)).alias("wells"))
    near = registry.where(F.col("sy_donor_km").isNotNull())
    return counts.join(exact_quantiles(near, ["sy_source"], "sy_donor_km", {"median_donor_km": 0.5}), "sy_source", "left")


def file_summary(wide: DataFrame, readings: DataFrame, label: str, focus: str) -> DataFrame:
    """One row describing a station file, with the go / no-go verdict."""
    stations = wide.agg(
        F.count(F.lit(1)).alias("wells"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("taluka").alias("tehsils"),
        F.count_if(plain(F.col("taluka")) == focus.lower()).alias("focus_wells"),
    )
    counts = readings.agg(
        F.count(F.lit(1)).alias("observations"),
        F.min("obs_date").alias("first_obs"),
        F.max("obs_date").alias("last_obs"),
        F.count_if("is_last_5y").alias("last5y_obs"),
    )
    verdict = None
    for least, word in STATION_VERDICTS:
        cond = F.col("wells") >= least
        verdict = F.when(cond, word) if verdict is None else verdict.when(cond, word)
    one = stations.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.withColumns(
        {
            "file": F.lit(label),
            "obs_per_well": half_even(F.col("observations") / F.greatest("wells", F.lit(1)), 1),
            "verdict": verdict,
        }
    )


def distinct_value_diagnosis(df: DataFrame, group: str, value: str) -> DataFrame:
    """Is a value a zone lookup? One distinct value per group says yes."""
    return df.groupBy(group).agg(
        F.countDistinct(value).alias("n_distinct"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )


def id_overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Ids in a, in b, in both, and the share of a that b covers."""
    tagged = (
        a.select(column, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
        .unionByName(b.select(column, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
        .groupBy(column)
        .agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    )
    return tagged.agg(
        F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"), F.sum(F.col("_a") * F.col("_b")).alias("n_both")
    ).withColumn("share_of_a", half_even(F.col("n_both") / F.greatest("n_a", F.lit(1)), 4))


def only_in(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).subtract(b.select(column))


def differences(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Values that only one of two tables has, with the side that has them."""
    left = only_in(a, b, column).withColumn("side", F.lit("only_a"))
    return left.unionByName(only_in(b, a, column).withColumn("side", F.lit("only_b")))


def sign_gate(readings: DataFrame) -> DataFrame:
    """Seasonal means and whether pre-monsoon is deeper than monsoon."""
    level = F.col("level_mbgl")
    means = readings.agg(
        F.avg(F.when(F.col("season") == "pre_monsoon", level)).alias("pre_monsoon_mean"),
        F.avg(F.when(F.col("season") == "monsoon", level)).alias("monsoon_mean"),
    )
    return means.withColumn("sign_ok", F.col("pre_monsoon_mean") > F.col("monsoon_mean"))


def inside_box(points: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    return points.where(box_condition(settings))


def box_condition(settings: Settings = DEFAULTS) -> Column:
    return F.col("lat").between(settings.lat_min, settings.lat_max) & F.col("lon").between(
        settings.lon_min, settings.lon_max
    )


def fetch_windows(points: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """The span of weather each point can ever use."""
    first = F.coalesce(F.col("first_obs"), F.lit(settings.last5_start).cast("date"))
    tail = settings.horizon_days + settings.fetch_tail_days
    hard_end = F.lit(settings.end_date).cast("date")
    return points.withColumns(
        {
            "start": F.greatest(
                F.date_sub(first, settings.fetch_lead_days), F.lit(settings.history_floor).cast("date")
            ),
            "end": F.least(F.coalesce(F.date_add("last_obs", tail), hard_end), hard_end),
        }
    )


def with_cells(points: DataFrame, degrees: float) -> DataFrame:
    return points.withColumns(
        {"grid_lat": geo.snap(F.col("lat"), degrees), "grid_lon": geo.snap(F.col("lon"), degrees)}
    )


def cell_plan(points: DataFrame, degrees: float) -> DataFrame:
    """One row per occupied cell: members and the span they need.

    Membership stays a long table (``with_cells``): a cell that holds a third
    of all points never becomes one array.
    """
    return (
        with_cells(points, degrees)
        .groupBy("grid_lat", "grid_lon")
        .agg(
            F.count(F.lit(1)).alias("n_members"),
            F.min("well_id").alias("first_member"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
    )


def cell_coverage(needed: DataFrame, held: DataFrame, key: str = "cell_id") -> DataFrame:
    """Needed span against held span per cell; rows not covered are to be fetched."""
    spans = held.groupBy(key).agg(F.min("date").alias("held_start"), F.max("date").alias("held_end"))
    out = needed.join(spans, key, "left")
    ok = (F.col("held_start") <= F.col("start")) & (F.col("held_end") >= F.col("end"))
    return out.withColumn("covered", F.coalesce(ok, F.lit(False)))


def storage_mcm(pct: Column, capacity_ml: Column) -> Column:
    return half_even(pct / F.lit(100.0) * capacity_ml / F.lit(1000.0), 3)


def aggregate_mismatches(aggregates: DataFrame, members: DataFrame, bodies: DataFrame) -> DataFrame:
    """Aggregates whose stated capacity is not the sum of their members."""
    sums = (
        members.join(bodies.select(F.col("reservoir_id").alias("member_id"), "capacity_ml"), "member_id")
        .groupBy("aggregate_id")
        .agg(F.count(F.lit(1)).alias("n_members"), F.sum("capacity_ml").alias("members_ml"))
    )
    stated = aggregates.select(F.col("reservoir_id").alias("aggregate_id"), F.col("capacity_ml").alias("stated_ml"))
    return stated.join(sums, "aggregate_id", "left").where(
        ~F.col("stated_ml").eqNullSafe(F.col("members_ml"))
    )
