"""Data-quality checks as rows: name, status, detail."""

from __future__ import annotations

import re
from collections.abc import Collection
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.operators import days as dy
from wellspring.operators.features import SPLIT_ORDER, WEATHER_COLUMNS, split_name, split_rank
from wellspring.operators.ordering import by_day, exact_quantiles
from wellspring.operators.prepare import box_condition
from wellspring.operators.weather import peak_month


def stack(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def table_profile(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Rows, distinct keys and NULL key parts of each table, one row per table."""
    frames = []
    for name, (df, keys) in tables.items():
        per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        frames.append(
            per_key.agg(
                F.lit(name).alias("table_name"),
                F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
                F.count(F.lit(1)).alias("n_keys"),
                F.count_if(F.col("_n") > 1).alias("n_duplicate_keys"),
                F.count_if(any_null).alias("n_null_keys"),
            )
        )
    return stack(frames)


def expected_rows(profile: DataFrame, expected: DataFrame) -> DataFrame:
    """Post-load counts against an expectation table."""
    return expected.join(profile.select("table_name", "n_rows"), "table_name", "left").withColumn(
        "ok", F.coalesce(F.col("n_rows") == F.col("expected"), F.lit(False))
    )


@dataclass(frozen=True)
class Check:
    """What is measured of a source, when it is right, and whether a failure only warns."""

    table: str
    name: str
    measured: str
    right: str
    warn: bool = False
    source: str | None = None


REQUIRED_FEATURES = ("level", "precip_mm", "rain_30d", "level_lag_30", "target_level_t30", "split")

#: Expressions over the measures of a source (``_SOURCES``); a null verdict is a failure.
CHECKS = [
    Check("wells", "populated", "n", "n > 0"),
    Check("wells", "inside_box", "outside", "outside = 0"),
    Check("wells", "focus_area_has_wells", "focus", "focus > 0"),
    Check("wells", "specific_yield_present", "n_sy", "n_sy > 0", warn=True),
    Check("wells", "specific_yield_plausible", "bad_sy", "bad_sy = 0"),
    Check("readings", "populated", "n", "n > 0"),
    Check("readings", "no_synthetic_rows", "synthetic", "synthetic = 0"),
    Check("readings", "end_matches_config", "off_end", "off_end <= 31"),
    Check("readings", "scenario_not_far_past_data", "stale", "stale <= 400", warn=True),
    Check("readings", "recency_flag_not_constant", "recent / n", "recent > 0 AND recent < n"),
    Check("readings", "levels_plausible", "bad_level", "bad_level = 0"),
    Check("readings", "eight_readings_per_well", "few", "few = 0"),
    Check("readings", "no_orphan_readings", "orphans", "orphans = 0"),
    Check("daily", "populated", "n", "n > 0"),
    Check("daily", "some_rows_observed", "n_real", "n_real > 0"),
    Check("daily", "not_all_observed", "100D * n_real / nullif(n, 0)", "100D * n_real / nullif(n, 0) < 50"),
    Check("daily", "confidence_in_unit_range", "bad_conf", "bad_conf = 0"),
    Check("daily", "observed_rows_more_confident", "coalesce(conf_real - conf_fill, 0D)", "coalesce(conf_real - conf_fill, 0D) >= 0"),
    Check("daily", "no_calendar_gaps", "gap", "coalesce(gap, 1) <= 1"),
    Check("weather", "populated", "n", "n > 0"),
    Check("weather", "no_null_rain", "nulls", "nulls = 0"),
    Check("weather", "peak_in_monsoon", "peak_month", "peak_month BETWEEN 6 AND 9", source="seasons"),
    Check("weather", "annual_rain_plausible", "median", "median BETWEEN 400 AND 3000", source="years"),
    Check("weather", "every_well_day_has_weather", "bare", "bare = 0", source="coverage"),
    Check("reservoir_daily", "populated", "n", "n > 0", warn=True),
    Check("reservoir_daily", "provenance_on_every_row", "no_source", "no_source = 0"),
    Check("reservoir_daily", "scenario_day_present", "on_day", "on_day > 0"),
    Check("features", "populated", "n", "n > 0"),
    *(Check("features", f"no_nulls_{c}", f"null_{c}", f"null_{c} = 0") for c in REQUIRED_FEATURES),
    Check("features", "test_has_real_pre_monsoon", "season_match", "season_match > 0"),
    Check("features", "val_and_test_not_empty", "least(n_val, n_test)", "n_val > 0 AND n_test > 0"),
    Check("features", "test_not_large", "n_test / nullif(n_train, 0)", "n_test / nullif(n_train, 0) <= 0.6", warn=True),
    Check("features", "no_duplicate_keys", "dupes", "dupes = 0"),
    Check("features", "splits_chronological", "overlap", "overlap = 0"),
]


def _wells(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    sy = F.col("specific_yield")
    return t["wells"], {
        "n": F.count(F.lit(1)),
        "outside": F.count_if(~box_condition(settings)),
        "focus": F.count_if(F.lower("taluka") == focus.lower()),
        "bad_sy": F.count_if(sy.isNotNull() & ~sy.between(0.001, 0.35)),
        "n_sy": F.count(sy),
    }


def _readings(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    """Readings are counted per well first; wells without a registry row are the orphans."""
    per_well = t["readings"].groupBy("well_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.max("obs_date").alias("_last"),
        F.count_if(~F.col("level_mbgl").between(0, 100)).alias("_bad"),
        F.count_if("is_last_5y").alias("_recent"),
        F.count_if(F.col("source") == "synthetic").alias("_synthetic"),
    )
    known = t["wells"].select("well_id", F.lit(True).alias("_known"))
    last = F.max("_last")
    return per_well.join(known, "well_id", "left"), {
        "n": F.coalesce(F.sum("_n"), F.lit(0)),
        "off_end": F.abs(F.date_diff(last, F.lit(settings.gw_end).cast("date"))),
        "stale": F.date_diff(F.lit(settings.scenario_date).cast("date"), last),
        "bad_level": F.coalesce(F.sum("_bad"), F.lit(0)),
        "recent": F.sum("_recent"),
        "synthetic": F.coalesce(F.sum("_synthetic"), F.lit(0)),
        "few": F.count_if(F.col("_n") < 8),
        "orphans": F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)),
    }


def _daily_of(b: dy.Block) -> dy.Answer:
    """What the checks count of the days of a block."""
    real, confidence = b["is_observed"], b["confidence"]
    step = np.diff(b["date"])[b["_place"][1:] > 0]
    counted = {
        "_n": b.size, "_real": real.sum(), "_bad": (~((confidence >= 0) & (confidence <= 1))).sum(),
        "_conf_real": confidence[real].sum(), "_conf_fill": confidence[~real].sum(), "_gap": float(step.max()) if len(step) else np.nan,
    }
    return {c: np.array([v]) for c, v in counted.items()}


def _daily(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    if isinstance(t["daily"], dy.Days):
        rows = t["daily"].partial(_daily_of, "_gap double, _n long, _real long, _bad long, _conf_real double, _conf_fill double")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return rows, {
            "n": total("_n"), "n_real": total("_real"), "bad_conf": total("_bad"), "gap": F.max("_gap").cast("int"),
            "conf_real": F.sum("_conf_real") / F.nullif(F.sum("_real"), F.lit(0)),
            "conf_fill": F.sum("_conf_fill") / F.nullif(F.sum("_n") - F.sum("_real"), F.lit(0)),
        }
    step = F.date_diff(F.col("date"), F.lag("date").over(by_day("well_id", "date")))
    real = F.col("is_observed")
    return t["daily"].withColumn("_step", step), {
        "n": F.count(F.lit(1)),
        "n_real": F.count_if(real),
        "bad_conf": F.count_if(~F.col("confidence").between(0, 1)),
        "conf_real": F.avg(F.when(real, F.col("confidence"))),
        "conf_fill": F.avg(F.when(~real, F.col("confidence"))),
        "gap": F.max("_step"),
    }


def _weather(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    return t["weather"], {"n": F.count(F.lit(1)), "nulls": F.count_if(F.col("precip_mm").isNull())}


def _seasons(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    return peak_month(t["weather"]), {"peak_month": F.first("peak_month")}


def _years(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    """Median rain of whole years: the first and the last year of a series are cut off by its ends."""
    yearly = t["weather"].groupBy("cell_id", F.year("date").alias("year")).agg(
        F.sum("precip_mm").alias("annual_mm"), F.min("date").alias("_from"), F.max("date").alias("_to")
    )
    whole = Window.partitionBy("cell_id")
    first, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    full = (first >= F.min("_from").over(whole)) & (last <= F.max("_to").over(whole))
    annual = yearly.withColumn("_full", full).where(F.col("_full") & F.col("annual_mm").isNotNull()).select(F.lit("all").alias("_all"), "annual_mm")
    return exact_quantiles(annual, ["_all"], "annual_mm", {"median": 0.5}), {"median": F.first("median")}


def _coverage(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    """Well-days per cell and date, and those without weather; combined before any join with weather,
    where days lie by cell (``daily_by_cell``) without a shuffle of days."""
    if isinstance(t.get("daily_by_cell"), dy.Days):
        # Beside the same weather as features, so that both read one shuffle.
        placed = t["daily_by_cell"].beside(t["weather"], WEATHER_COLUMNS)
        bare = placed.partial(lambda b: {"_n": np.array([(~b.weather(None)).sum()])}, "_n long")
        return bare, {"bare": F.coalesce(F.sum("_n"), F.lit(0))}
    days = t["daily_by_cell"] if "daily_by_cell" in t else t["daily"].join(t["cells"].select("well_id", "cell_id"), "well_id", "left")
    days = days.groupBy("cell_id", "date").agg(F.count(F.lit(1)).alias("_n"))
    bare = days.join(t["weather"].select("cell_id", "date"), ["cell_id", "date"], "left_anti")
    return bare, {"bare": F.coalesce(F.sum("_n"), F.lit(0))}


def _reservoir(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    on = F.col("date") == F.lit(settings.scenario_date).cast("date")
    return t["reservoir_daily"], {
        "n": F.count(F.lit(1)), "no_source": F.count_if(F.col("source").isNull()), "on_day": F.count_if(on)
    }


def _split_counts_of(b: dy.Block, pre_monsoon: tuple[int, ...]) -> dy.Answer:
    """Counts of the rows of each split of a block; a series that lies twice in its cell repeats each key."""
    split, kept = b["split"], b.kept
    real = kept & (split == SPLIT_ORDER["test"]) & np.isin(b["month"], pre_monsoon) & b["is_observed"]
    counted = {"_n": kept, "_real": real, "_again": kept & b.per_day(np.array([s.again for s in b.series]))}
    counted |= {f"_{c}": kept & (b[c] != b[c]) for c in REQUIRED_FEATURES if c != "split"}
    out = {c: np.bincount(split[x], minlength=len(SPLIT_ORDER)) for c, x in counted.items()}
    some = np.flatnonzero(out["_n"])
    dates = [b["date"][kept & (split == i)] for i in some]
    return {
        "entity_type": np.full(len(some), b.entity_type), "split": some, "_first": np.array([d.min() for d in dates], np.int64),
        "_last": np.array([d.max() for d in dates], np.int64), **{c: n[some] for c, n in out.items()},
    }


def _split_counts(features: dy.Days, settings: Settings) -> DataFrame:
    months = settings.seasons["pre_monsoon"]
    sums = ["_n", *(f"_{c}" for c in REQUIRED_FEATURES if c != "split"), "_real", "_again"]
    schema = "entity_type string, split int, _first int, _last int, " + ", ".join(f"{c} long" for c in sums)
    parts = features.partial(lambda b: _split_counts_of(b, months), schema)
    return parts.groupBy("entity_type", split_name(F.col("split")).alias("split")).agg(
        F.date_from_unix_date(F.min("_first")).alias("_first"), F.date_from_unix_date(F.max("_last")).alias("_last"),
        *[F.sum(c).alias(c) for c in sums],
    )


def _features(t: dict[str, DataFrame], focus: str, settings: Settings) -> tuple[DataFrame, dict[str, Column]]:
    """Counts per split first."""
    per_split = _split_counts(t["features"], settings) if isinstance(t["features"], dy.Days) else _split_counts_of_rows(t["features"])
    ahead = Window.partitionBy("entity_type").orderBy(split_rank(F.col("split")))
    per_split = per_split.withColumn("_overlaps", F.coalesce(F.col("_first") <= F.lag("_last").over(ahead), F.lit(False)))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    of = lambda name: total(F.when(F.col("split") == name, F.col("_n")))
    return per_split, {
        "n": total("_n"),
        **{f"null_{c}": total(f"_{c}") for c in REQUIRED_FEATURES if c != "split"},
        "null_split": total(F.when(F.col("split").isNull(), F.col("_n"))),
        "season_match": total("_real"), "n_train": of("train"), "n_val": of("val"), "n_test": of("test"),
        "dupes": total("_again"), "overlap": F.count_if("_overlaps"),
    }


def _split_counts_of_rows(features: DataFrame) -> DataFrame:
    """The same of rows. A key is double where a row repeats the date before it; such rows
    are seen in the order that the features have been built in, without a shuffle."""
    placed = [c for c in features.columns if c == "cell_id"]
    order = by_day([*placed, "entity_id"], "date")
    one, two = F.lag("date", 1).over(order), F.lag("date", 2).over(order)
    again = (F.col("date") == one) & ~F.coalesce(one == two, F.lit(False))
    real = (F.col("split") == "test") & (F.col("season") == "pre_monsoon") & F.col("is_observed")
    rows = features.select(*placed, "entity_type", "entity_id", "date", "season", "is_observed", *REQUIRED_FEATURES)
    return rows.withColumn("_again", again).groupBy("entity_type", "split").agg(
        F.count(F.lit(1)).alias("_n"), F.min("date").alias("_first"), F.max("date").alias("_last"),
        *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in REQUIRED_FEATURES if c != "split"],
        F.count_if(real).alias("_real"), F.count_if("_again").alias("_again"),
    )


_SOURCES = {
    "wells": _wells, "readings": _readings, "daily": _daily, "weather": _weather, "seasons": _seasons, "years": _years,
    "coverage": _coverage, "reservoir_daily": _reservoir, "features": _features,
}


def run_checks(
    tables: dict[str, DataFrame], focus: str, settings: Settings = DEFAULTS, names: Collection[str] | None = None
) -> DataFrame:
    """Every named check: PASS, WARN or FAIL with the measured value.

    ``tables`` holds wells, readings, daily, weather, cells, reservoir_daily and features;
    ``daily_by_cell`` may hold the days beside their cells. ``daily``, ``daily_by_cell`` and
    ``features`` may be ``Days``.
    The checks of a source become one aggregate over it, of the measures that they name
    and no others; ``names`` builds only those checks and their sources. Weather, which
    several sources read, should be stored.
    """
    chosen = [c for c in CHECKS if names is None or c.name in names]
    by_source: dict[str, list[Check]] = {}
    for c in chosen:
        by_source.setdefault(c.source or c.table, []).append(c)
    frames = []
    for source, checks in by_source.items():
        rows, measures = _SOURCES[source](tables, focus, settings)
        used = {w for c in checks for w in re.findall(r"\w+", f"{c.measured} {c.right}")}
        one = rows.agg(*(m.alias(n) for n, m in measures.items() if n in used))
        verdicts = [
            F.struct(
                F.lit(c.table).alias("table_name"), F.lit(c.name).alias("check_name"),
                F.when(F.coalesce(F.expr(c.right), F.lit(False)), "PASS").otherwise("WARN" if c.warn else "FAIL").alias("status"),
                F.expr(c.measured).cast("double").alias("measured"),
            )
            for c in checks
        ]
        frames.append(one.select(F.inline(F.array(*verdicts))))
    return stack(frames)


def exit_status(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(F.col("status") == "WARN").alias("warnings"),
        F.count_if(F.col("status") == "FAIL").alias("failed"),
    ).withColumn("exit_status", F.when(F.col("failed") > 0, 1).otherwise(0))
