"""Season, split, recency and water-year expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings

SEASON_CODES = {"pre_monsoon": 0, "monsoon": 1, "post_monsoon": 2, "rabi": 3}

# The quarterly survey rounds and the month each one stands for.
ROUND_MONTHS = {"Jan": 1, "May": 5, "Aug": 8, "Nov": 11}
ROUND_SEASONS = {1: "rabi", 5: "pre_monsoon", 8: "monsoon", 11: "post_monsoon"}


def lookup(mapping: dict, key: Column) -> Column:
    """A literal map lookup; missing keys give NULL."""
    pairs = chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items())
    return F.try_element_at(F.create_map(*pairs), key)


def season_of_month(month: Column, settings: Settings = DEFAULTS) -> Column:
    out = None
    for name, months in settings.seasons.items():
        cond = month.isin(*months)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def season_of(date: Column, settings: Settings = DEFAULTS) -> Column:
    return season_of_month(F.month(date), settings)


def season_code(season: Column) -> Column:
    return lookup(SEASON_CODES, season)


def split_of(date: Column, settings: Settings = DEFAULTS) -> Column:
    """Chronological split; NULL outside every window."""
    return (
        F.when(date <= F.lit(settings.train_end).cast("date"), F.lit("train"))
        .when(date <= F.lit(settings.val_end).cast("date"), F.lit("val"))
        .when(date <= F.lit(settings.test_end).cast("date"), F.lit("test"))
    )


def is_recent(date: Column, settings: Settings = DEFAULTS) -> Column:
    return date >= F.lit(settings.last5_start).cast("date")



def day_number(date: Column) -> Column:
    """Days since the epoch: an integer every range frame can order by."""
    return F.unix_date(date)


def period_to_date(period: Column) -> Column:
    """``Jan-07`` to the 15th of that month in 20yy."""
    month = lookup(ROUND_MONTHS, F.substring(period, 1, 3))
    year = F.lit(2000) + F.substring(period, 5, 2).try_cast("int")
    return F.make_date(year, month, F.lit(15))


def strict_date(text: Column) -> Column:
    """ISO dates only; impossible dates become NULL rather than an error."""
    return F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")
    )
