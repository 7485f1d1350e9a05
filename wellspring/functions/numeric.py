"""Rounding and numeric coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(col: Column, places: int = 0) -> Column:
    """Round half to even on the binary value.

    ``rint`` keeps the expression inside generated code; ``F.bround`` goes
    through BigDecimal for every row.
    """
    scale = float(10**places)
    return F.rint(col * F.lit(scale)) / F.lit(scale)


def clip(col: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(col.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), col)))


def to_double(col: Column) -> Column:
    """Numeric coercion: text that is not a number, and NaN, become NULL."""
    number = F.regexp_extract(F.trim(col.cast("string")), r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$", 1)
    return F.nullif(number, F.lit("")).try_cast("double")


def null_if_nan(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def null_if(col: Column, fill: float) -> Column:
    return F.nullif(col, F.lit(fill))
