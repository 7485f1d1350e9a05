"""CSV, Parquet, weather JSON and fetched-page sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.functions.geo import hargreaves_et0
from wellspring.functions.numeric import null_if
from wellspring.functions.text import ascii_digits
from wellspring.schemas import ANCHORS

# Feed variable names and what they are called here.
ARRAY_DAILY = {
    "precipitation_sum": "precip_mm",
    "et0_fao_evapotranspiration": "et0_mm",
    "temperature_2m_max": "temp_max",
    "relative_humidity_2m_mean": "rh_mean",
}
ARRAY_HOURLY = {
    "soil_moisture_0_to_7cm": "soil_moist_0_7",
    "soil_moisture_7_to_28cm": "soil_moist_7_28",
}
MAP_PARAMETERS = ("PRECTOTCORR", "T2M_MAX", "T2M_MIN", "T2M", "RH2M")
MAP_FILL = -999.0
# Water-body names as pages spell them, and their ids.
PAGE_ALIASES = {
    "upper vaitarna": "UPPER_VAITARNA",
    "modak sagar": "MODAK_SAGAR",
    "tansa": "TANSA",
    "middle vaitarna": "MIDDLE_VAITARNA",
    "bhatsa": "BHATSA",
    "vihar": "VIHAR",
    "vehar": "VIHAR",
    "tulsi": "TULSI",
    "khadakwasla": "KHADAKWASLA",
    "panshet": "PANSHET",
    "varasgaon": "VARASGAON",
    "temghar": "TEMGHAR",
    "pavana": "PAVANA",
}


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    """Hand-checked storage anchors; lines starting with ``#`` are comments."""
    raw = spark.read.csv(path, header=True, comment="#", schema=ANCHORS, enforceSchema=False)
    return raw.where(F.col("entity_id").isNotNull())


def read_wide_stations(
    spark: SparkSession, path: str, attributes: dict[str, str], period_columns: list[str]
) -> DataFrame:
    """Wide station file with a declared schema: attributes plus one column per period."""
    fields = [f"`{name}` {kind}" for name, kind in attributes.items()]
    fields += [f"`{name}` double" for name in period_columns]
    return spark.read.csv(
        path, header=True, schema=T.StructType.fromDDL(", ".join(fields)), enforceSchema=False
    )


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Column-pruned Parquet read."""
    return spark.read.parquet(path).select(*columns)


def weather_from_arrays(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(cell_id, JSON text) with parallel ``daily`` / ``hourly`` arrays to weather rows.

    Hourly soil moisture is averaged per day; an absent variable is NULL.
    """
    daily = T.StructType.fromDDL(
        "time array<string>, " + ", ".join(f"{k} array<double>" for k in ARRAY_DAILY)
    )
    hourly = T.StructType.fromDDL(
        "time array<string>, " + ", ".join(f"{k} array<double>" for k in ARRAY_HOURLY)
    )
    doc = T.StructType().add("daily", daily).add("hourly", hourly)
    parsed = payloads.select("cell_id", F.from_json(payload, doc).alias("j"))

    def rows(block: str, names: dict) -> DataFrame:
        absent = F.array().cast("array<double>")
        zipped = F.arrays_zip(
            F.col(f"j.{block}.time").alias("time"),
            *[F.coalesce(F.col(f"j.{block}.{k}"), absent).alias(v) for k, v in names.items()],
        )
        flat = parsed.select("cell_id", F.explode(zipped).alias("r"))
        return flat.select(
            "cell_id",
            F.to_date(F.substring("r.time", 1, 10)).alias("date"),
            *[F.col(f"r.{v}").alias(v) for v in names.values()],
        )

    soil = (
        rows("hourly", ARRAY_HOURLY)
        .groupBy("cell_id", "date")
        .agg(*[F.avg(v).alias(v) for v in ARRAY_HOURLY.values()])
    )
    return rows("daily", ARRAY_DAILY).join(soil, ["cell_id", "date"], "left")


def weather_from_maps(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """(cell_id, lat, JSON text) with ``yyyymmdd`` keyed maps to weather rows, ET0 derived."""
    maps = ", ".join(f"{p}: map<string,double>" for p in MAP_PARAMETERS)
    doc = f"properties struct<parameter: struct<{maps}>>"
    parsed = payloads.select("cell_id", "lat", F.from_json(payload, doc).alias("j"))
    body = F.col("j.properties.parameter")
    named = F.array(
        *[F.struct(F.lit(p).alias("name"), F.map_entries(body[p]).alias("entries")) for p in MAP_PARAMETERS]
    )
    series = parsed.select("cell_id", "lat", F.inline(named)).select(
        "cell_id", "lat", "name", F.explode("entries").alias("e")
    )
    flat = series.groupBy("cell_id", "lat", F.col("e.key").alias("day")).agg(
        *[F.max(F.when(F.col("name") == p, null_if(F.col("e.value"), MAP_FILL))).alias(p) for p in MAP_PARAMETERS]
    )
    value = F.col
    date = F.to_date("day", "yyyyMMdd")
    return flat.select(
        "cell_id",
        date.alias("date"),
        value("PRECTOTCORR").alias("precip_mm"),
        hargreaves_et0(
            F.col("lat"), F.dayofyear(date), value("T2M_MAX"), value("T2M_MIN"), value("T2M")
        ).alias("et0_mm"),
        F.lit(None).cast("double").alias("soil_moist_0_7"),
        F.lit(None).cast("double").alias("soil_moist_7_28"),
        value("T2M_MAX").alias("temp_max"),
        value("RH2M").alias("rh_mean"),
    )


def page_text(html: Column) -> Column:
    """Tags to ``|``, white space collapsed."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", "|"), r"(?U)\s+", " ")


def percents_from_pages(
    pages: DataFrame, aliases: dict[str, str] = PAGE_ALIASES, html: str = "html"
) -> DataFrame:
    """First percentage within 400 characters after each known name, per page.

    The alias list is a fixed literal, so every page is scanned once with one
    expression per alias; no join and no shuffle until ids are deduplicated.
    Where two spellings of one id occur, the first in the list wins.
    """
    text = pages.select("page_id", page_text(F.col(html)).alias("text"))
    found = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(rid).alias("reservoir_id"),
                F.regexp_extract(
                    "text", rf"(?iU)\Q{name}\E\b.{{0,400}}?(\d{{1,3}}(?:\.\d+)?)\s*%", 1
                ).alias("pct"),
            )
            for i, (name, rid) in enumerate(aliases.items())
        ]
    )
    hits = text.select("page_id", F.explode(found).alias("h")).where(F.col("h.pct") != "")
    return hits.groupBy("page_id", "h.reservoir_id").agg(
        ascii_digits(F.min_by(F.col("h.pct"), F.col("h.ord"))).try_cast("double").alias("live_storage_pct")
    )


def first_percents(percents: DataFrame, page_order: str = "page_id") -> DataFrame:
    """One percentage per reservoir over all pages: the first page that names it."""
    return percents.groupBy("reservoir_id").agg(
        F.min(page_order).alias(page_order), F.min_by("live_storage_pct", page_order).alias("live_storage_pct")
    )
