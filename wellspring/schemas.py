"""Table schemas, and ``conform`` to fit a DataFrame to one of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.numeric import null_if_nan


_TYPES = {
    "string": T.StringType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "date": T.DateType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def _schema(text: str) -> T.StructType:
    """``name type`` pairs to a schema, without needing a running session."""
    pairs = (part.split() for part in text.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


WELLS = _schema(
    "well_id string, lat double, lon double, district string, taluka string, village string,"
    "specific_yield double, sy_source string, aquifer_type string, well_depth double,"
    "n_observations int, first_obs date, last_obs date"
)
READINGS = _schema(
    "well_id string, obs_date date, source string, level_mbgl double, season string, is_last_5y boolean"
)
WEATHER = _schema(
    "cell_id string, date date, precip_mm double, et0_mm double, soil_moist_0_7 double,"
    "soil_moist_7_28 double, temp_max double, rh_mean double"
)
DAILY = _schema(
    "well_id string, date date, level_mbgl double, is_observed boolean, confidence double"
)
RESERVOIRS = _schema(
    "reservoir_id string, name string, city string, lat double, lon double, capacity_mcm double"
)
RESERVOIR_DAILY = _schema(
    "reservoir_id string, date date, live_storage_pct double, storage_mcm double,"
    "pct_same_day_last_yr double, source string"
)
ANCHORS = _schema(
    "entity_id string, date date, live_storage_pct double, confidence string, source_org string,"
    "source_url string, source_note string"
)
RUN_LOG = _schema(
    "run_id string, script string, started_at timestamp, ended_at timestamp, rows_in long,"
    "rows_out long, status string, notes string"
)
REPORTS = _schema(
    "report_id string, created_at timestamp, source string, phone string, well_id string,"
    "level_mbgl double, reported_for date"
)
MESSAGES = _schema("message_id long, phone string, body string, sent_at timestamp")

KEYS = {
    "wells": ("well_id",),
    "readings": ("well_id", "obs_date", "source"),
    "weather": ("cell_id", "date"),
    "daily": ("well_id", "date"),
    "reservoirs": ("reservoir_id",),
    "reservoir_daily": ("reservoir_id", "date"),
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Drop unknown columns, add missing ones as NULL, cast, NaN to NULL."""
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            col = F.lit(None).cast(field.dataType)
        else:
            col = F.col(field.name).cast(field.dataType)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                col = null_if_nan(col)
        out.append(col.alias(field.name))
    return df.select(*out)


def unknown_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    return [c for c in df.columns if c not in schema.fieldNames()]
