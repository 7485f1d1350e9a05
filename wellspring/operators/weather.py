"""Backward-looking weather aggregates per cell and day.

Weather stays per grid cell; wells reach it through a cell map, so a cell's
series is never copied to its members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal
from wellspring.operators.ordering import by_day, running
from wellspring.operators.series import densify

NO_RAIN_YET = 999
SCRATCH = ("_sum_precip_mm", "_n_precip_mm", "_sum_et0_mm", "_n_et0_mm", "_wet")


def rolling_sums(
    dense: DataFrame, key: str | list[str], date: str, wanted: list[tuple[str, int, int, str]]
) -> tuple[dict[str, Column], DataFrame]:
    """Trailing sums of (column, days, least count, name) on a gapless calendar.

    A sliding frame re-adds its whole window on every row. Running totals cost
    one addition, and a trailing sum is a total minus the total of ``days``
    rows earlier. Returns the columns and the frame that holds the totals.
    """
    upto, w = running(key, date), by_day(key, date)
    names = sorted({c for c, *_ in wanted})
    totals = dense.withColumns(
        {
            **{f"_sum_{c}": F.sum(F.coalesce(F.col(c), F.lit(0.0))).over(upto) for c in names},
            **{f"_n_{c}": F.count(c).over(upto) for c in names},
        }
    )

    def since(total: str, days: int) -> Column:
        return F.col(total) - F.coalesce(F.lag(total, days).over(w), F.lit(0))

    columns = {
        name: F.when(since(f"_n_{c}", days) >= least, since(f"_sum_{c}", days))
        for c, days, least, name in wanted
    }
    return columns, totals


def rain_memory(df: DataFrame, key: str | list[str], date: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``days_since_last_rain`` (NULL before the first) and the season total.

    The season total (NULL rain counts as 0) restarts with the water year; it
    is the running total minus its value at the last day before the restart,
    so it needs no second partitioning.
    """
    upto = running(key, date)
    rain, day = F.col("precip_mm"), F.col(date)
    month, dom = F.month(day), F.dayofmonth(day)
    starts = (month == settings.monsoon_start_month) & (dom == 1)
    before = F.when(starts, F.col("_sum_precip_mm") - F.coalesce(rain, F.lit(0.0)))
    wet_day = F.when(rain >= settings.rain_day_mm, cal.day_number(day))
    return df.withColumns(
        {
            "days_since_last_rain": cal.day_number(day) - F.last(wet_day, ignorenulls=True).over(upto),
            "cum_monsoon_rainfall": F.col("_sum_precip_mm")
            - F.coalesce(F.last(before, ignorenulls=True).over(upto), F.lit(0.0)),
        }
    )


def weather_features(
    weather: DataFrame, settings: Settings = DEFAULTS, key: str = "cell_id"
) -> DataFrame:
    """Rolling, cumulative and since-rain columns; one row per given (cell, day)."""
    value_columns = [c for c in weather.columns if c not in (key, "date")]
    dense = densify(
        weather.withColumn("_given", F.lit(True)), key, "date", [*value_columns, "_given"]
    )
    rolled, totals = rolling_sums(
        dense, key, "date",
        [("precip_mm", n, 1, f"rain_{n}d") for n in settings.rolling_days] + [("et0_mm", 30, 1, "et0_30d")],
    )
    out = rain_memory(totals, key, "date", settings).withColumns(rolled).where("_given")
    rain, et0 = F.col("precip_mm").isNotNull(), F.col("et0_mm").isNotNull()
    return out.withColumns(
        {
            "rain_cum": F.when(rain, F.col("_sum_precip_mm")),
            "et0_cum": F.when(et0, F.col("_sum_et0_mm")),
            "days_since_last_rain": F.coalesce("days_since_last_rain", F.lit(NO_RAIN_YET)),
            "cum_monsoon_rainfall": F.when(rain, F.col("cum_monsoon_rainfall")),
        }
    ).drop("precip_mm", "et0_mm", "_given", *SCRATCH)


def monthly_rain(weather: DataFrame) -> DataFrame:
    return weather.groupBy(F.month("date").alias("month")).agg(
        F.avg("precip_mm").alias("mean_precip"), F.count("precip_mm").alias("n_days")
    )


def peak_month(weather: DataFrame) -> DataFrame:
    """Wettest month, the earlier one on a tie."""
    return monthly_rain(weather).agg(
        F.max_by("month", F.struct(F.col("mean_precip"), -F.col("month"))).alias("peak_month")
    )


def annual_rain(weather: DataFrame, key: str = "cell_id") -> DataFrame:
    return weather.groupBy(key, F.year("date").alias("year")).agg(F.sum("precip_mm").alias("annual_mm"))
