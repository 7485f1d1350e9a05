"""Serving tables: statewide overview, figures and data-card sections."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.numeric import half_even
from wellspring.functions.text import age_words
from wellspring.operators import days as dy
from wellspring.operators.features import split_name
from wellspring.operators.lineage import cut_lineage
from wellspring.operators.ordering import exact_quantiles

TABLE_ROWS_SHOWN = 120

# Anchors quoted by name.
HEADLINE_KEYS = {
    "MUM_ALL|2026-06-29": "mumbai7Lakes_29Jun2026",
    "MUM_ALL|2026-06-30": "mumbai7Lakes_30Jun2026",
    "MUM_ALL|2026-08-03": "mumbai7Lakes_03Aug2026",
    "MUM_ALL|2026-08-07": "mumbai7Lakes_07Aug2026",
    "MUM_ALL|2026-06-16": "mumbai_16Jun2026",
    "MUM_ALL|2026-06-23": "mumbai_23Jun2026",
    "PUN_ALL|2026-08-07": "pune5Dams_07Aug2026",
    "PUN_KHW|2026-07-05": "puneKhadakwasla_05Jul2026",
}
VERIFIED = ("primary", "reported")


def overview_rows(rural: DataFrame, urban: DataFrame, areas: DataFrame, as_of: Column) -> DataFrame:
    """All areas and reservoirs in one shape; unscorable rows keep their reason."""
    named = rural.join(areas, "entity_id", "left")
    a = named.select(
        F.lit("rural").alias("track"), F.lit("taluka").alias("entity_type"), "entity_id",
        F.concat(F.col("entity_id"), F.lit(" Taluka, "), F.coalesce("district", F.lit(""))).alias("label"),
        "district", "score", "band", "colour",
        F.coalesce("date", "data_through").alias("date"), "days_to_crisis",
        F.col("forecast_level").alias("headline"), "reason",
    )
    b = urban.select(
        F.lit("urban").alias("track"), F.lit("reservoir").alias("entity_type"), "entity_id",
        F.col("entity_label").alias("label"), F.col("city").alias("district"), "score", "band", "colour",
        "date", "days_to_crisis", F.col("live_storage_pct").alias("headline"),
        F.lit(None).cast("string").alias("reason"),
    )
    out = a.unionByName(b)
    stale = F.when(F.col("score").isNotNull(), F.date_diff(as_of, "date"))
    return out.withColumns({"days_stale": stale, "age": age_words(stale), "bucket": bucket_of()})


def bucket_of() -> Column:
    return (
        F.when(F.col("score").isNull(), "unscorable")
        .when(F.col("band") == "ACT NOW", "act_now")
        .when(F.col("band") == "MONITOR", "monitor")
        .otherwise("safe")
    )


def with_subscribers(rows: DataFrame, counts: DataFrame) -> DataFrame:
    return rows.join(counts, "entity_id", "left").na.fill(0, ["subscribers"])


def worst_first(rows: DataFrame) -> DataFrame:
    """Highest score first, unscorable last, then by label."""
    return rows.orderBy(F.col("score").desc_nulls_last(), "label", "entity_id")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """Rows and subscriber reach of each severity bucket, empty ones included."""
    sums = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(b).alias("bucket"),
                    F.count_if(F.col("bucket") == b).alias("n_entities"),
                    F.coalesce(F.sum(F.when(F.col("bucket") == b, F.col("subscribers"))), F.lit(0)).alias("reach"),
                )
                for b in ("act_now", "monitor", "safe", "unscorable")
            ]
        ).alias("b")
    )
    return sums.select(F.inline("b"))


def table_page(rows: DataFrame, bucket: str = "all", text: str = "", scope: str | None = None, limit: int = TABLE_ROWS_SHOWN) -> DataFrame:
    """The first rows, worst first, of one bucket that contain a text."""
    df = rows if bucket == "all" else rows.where(F.col("bucket") == bucket)
    if scope is not None:
        df = df.where(F.col("entity_id") == scope)
    if text.strip():
        hay = F.lower(F.concat_ws(" ", "label", F.coalesce("district", F.lit("")), "entity_id"))
        df = df.where(hay.contains(text.strip().lower()))
    return worst_first(df).limit(limit)


def public_profile(users: DataFrame) -> DataFrame:
    """What may be shown of an account."""
    can_send = (F.col("role") == "government") | ((F.col("role") == "society-manager") & F.col("verified"))
    return users.select(
        "user_id", "role", "name", "lang", "entity_type", "entity_id", "entity_label", "verified",
        can_send.alias("can_send"),
    )


def figures(anchors: DataFrame, keys: dict[str, str] = HEADLINE_KEYS) -> DataFrame:
    """Anchors with their headline name, if any, and whether they are verified."""
    from wellspring.functions.calendar import lookup

    key = F.concat_ws("|", "entity_id", F.date_format("date", "yyyy-MM-dd"))
    return anchors.select(
        "entity_id", "date", F.col("live_storage_pct").alias("value"), "confidence",
        F.coalesce(F.col("confidence").isin(*VERIFIED), F.lit(False)).alias("verified"), lookup(keys, key).alias("figure"),
    )


def anchor_ledger(versions: DataFrame, retractions: DataFrame) -> DataFrame:
    """Every version of an anchor with the days on which it held: from ``valid_from`` up to ``valid_to``.

    ``versions``: entity_id, date, live_storage_pct, confidence, recorded_on; a later
    version of an (entity, date) takes the place of an earlier one, the last row of a
    day counts. ``retractions``: entity_id, date, retracted_on, reason; one closes what
    holds on that day, and versions recorded afterwards open the anchor anew. Rows of an
    anchor meet in one window; they are its versions, and there are few.
    """
    key = ["entity_id", "date"]
    kept = versions.groupBy(*key, "recorded_on").agg(
        F.max(F.struct("live_storage_pct", "confidence")).alias("_v")
    ).select(*key, "_v.live_storage_pct", "_v.confidence", F.col("recorded_on").alias("valid_from"))
    order = Window.partitionBy(*key).orderBy("valid_from")
    kept = kept.withColumn("_next", F.lead("valid_from").over(order))
    closed = retractions.groupBy(*key, "retracted_on").agg(F.min("reason").alias("reason"))
    met = kept.join(closed, key, "left")
    within = (F.col("retracted_on") >= F.col("valid_from")) & (F.col("_next").isNull() | (F.col("retracted_on") < F.col("_next")))
    first = F.min(F.when(within, F.struct("retracted_on", "reason"))).alias("_r")
    whole = met.groupBy(*key, "valid_from", "live_storage_pct", "confidence", "_next").agg(first)
    return whole.select(
        *key, "live_storage_pct", "confidence", "valid_from", F.coalesce("_r.retracted_on", "_next").alias("valid_to"),
        F.col("_r.reason").alias("reason"),
    )


def anchors_as_of(ledger: DataFrame, day: str) -> DataFrame:
    """The anchors that held on a day."""
    on = F.lit(day).cast("date")
    return ledger.where((F.col("valid_from") <= on) & (F.col("valid_to").isNull() | (F.col("valid_to") > on))).drop("valid_from", "valid_to", "reason")


def figure_summary(shown: DataFrame) -> DataFrame:
    """Anchors by confidence, and all of them (confidence NULL), with how many are verified."""
    out = shown.rollup("confidence").agg(
        F.grouping("confidence").alias("_all"), F.count(F.lit(1)).alias("n"), F.count_if("verified").alias("n_verified")
    )
    name = F.when(F.col("_all") == 1, "total").otherwise(F.coalesce("confidence", F.lit("none")))
    return out.select(name.alias("confidence"), "n", "n_verified")


def retracted(ledger: DataFrame, day: str) -> DataFrame:
    """Values that had been taken back by a day, with the reason."""
    out = ledger.where(F.col("reason").isNotNull() & (F.col("valid_to") <= F.lit(day).cast("date")))
    return out.select("entity_id", "date", F.col("live_storage_pct").alias("value"), F.col("valid_to").alias("retracted_on"), "reason")


def reading_spread(wells: DataFrame, readings: DataFrame) -> DataFrame:
    """Least, median and most readings per well, by district and over all (district NULL).

    Readings are counted per well, wells per (district, count); both steps combine
    map-side, and the exact median is taken from those counts.
    """
    per_well = readings.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))
    placed = per_well.join(wells.select("well_id", "district"), "well_id", "left")
    counts = placed.groupingSets([["district", "n"], ["n"]], "district", "n").agg(
        F.grouping("district").alias("_all"), F.count(F.lit(1)).alias("_wells")
    )
    counts = cut_lineage(counts.withColumn("scope", F.when(F.col("_all") == 1, "all").otherwise(F.concat(F.lit("district "), F.coalesce("district", F.lit("?"))))))
    spread = counts.groupBy("scope").agg(F.sum("_wells").alias("n_wells"), F.min("n").alias("least"), F.max("n").alias("most"))
    middle = exact_quantiles(counts, ["scope"], "n", {"median": 0.5}, weight="_wells")
    return spread.join(middle, "scope").select("scope", "n_wells", "least", F.col("median").cast("double").alias("median"), "most")


def _split_spans(b: dy.Block) -> dy.Answer:
    """Rows and dates of each split of each series of a block."""
    begins, of = b.runs(b["split"])
    n = np.add.reduceat(b.kept, begins, dtype=np.int64)
    first = np.minimum.reduceat(np.where(b.kept, b["date"], np.iinfo(np.int32).max), begins)
    last = np.maximum.reduceat(np.where(b.kept, b["date"], np.iinfo(np.int32).min), begins)
    some = n > 0
    return {
        "key": of[some], "entity_type": np.full(int(some.sum()), b.entity_type), "split": b["split"][begins[some]], "_n": n[some],
        "_first": first[some], "_last": last[some],
    }


def _spans(features: DataFrame | dy.Days) -> DataFrame:
    if isinstance(features, dy.Days):
        spans = features.partial(_split_spans, "key string, entity_type string, split int, _n long, _first int, _last int")
        return spans.select(
            "entity_type", split_name(F.col("split")).alias("split"), F.col("key").alias("entity_id"), "_n",
            F.date_from_unix_date("_first").alias("_first"), F.date_from_unix_date("_last").alias("_last"),
        )
    one = F.lit(1).cast("long").alias("_n")
    return features.select("entity_type", "split", "entity_id", one, F.col("date").alias("_first"), F.col("date").alias("_last"))


def split_coverage(*features: DataFrame | dy.Days) -> DataFrame:
    """Rows, dates and entities of each split of each track, and of each track (split NULL).

    Rows are counted per entity first, so entities need no distinct count; splits and whole
    tracks are summed from that one count.
    """
    spans = reduce(DataFrame.unionByName, [_spans(f) for f in features])
    per_entity = spans.groupBy("entity_type", "split", "entity_id").agg(
        F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    tracks = per_entity.groupingSets(
        [["entity_type", "entity_id", "split"], ["entity_type", "entity_id"]], "entity_type", "entity_id", "split"
    ).agg(
        F.grouping("split").alias("_all"), F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.max("_last").alias("_last")
    )
    named = tracks.withColumn("split", F.when(F.col("_all") == 1, "all").otherwise(F.col("split"))).where(F.col("split").isNotNull())
    return named.groupBy("entity_type", "split").agg(
        F.sum("_n").alias("n"), F.min("_first").alias("first_date"), F.max("_last").alias("last_date"), F.count(F.lit(1)).alias("n_entities")
    )


def weather_span(weather: DataFrame, key: str = "cell_id") -> DataFrame:
    """First and last day, and the number of entities with weather."""
    per_entity = weather.groupBy(key).agg(F.min("date").alias("_first"), F.max("date").alias("_last"), F.count(F.lit(1)).alias("_n"))
    return per_entity.agg(
        F.min("_first").alias("first_date"), F.max("_last").alias("last_date"), F.count(F.lit(1)).alias("n_entities"), F.sum("_n").alias("n")
    )


def provenance_counts(df: DataFrame, source: str = "source", date: str = "date") -> DataFrame:
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date")
    )


def observed_ratio(daily: DataFrame) -> DataFrame:
    n, real = F.count(F.lit(1)), F.count_if("is_observed")
    return daily.agg(
        n.alias("n_daily_rows"), real.alias("n_observed"),
        half_even(F.lit(100.0) * real / F.nullif(n, F.lit(0)), 2).alias("pct_observed"),
    )


def coverage(wells: DataFrame, readings: DataFrame) -> DataFrame:
    """First and last reading and count per registered well, empty wells included."""
    seen = readings.groupBy("well_id").agg(
        F.min("obs_date").alias("first_obs"), F.max("obs_date").alias("last_obs"), F.count(F.lit(1)).alias("n_obs")
    )
    return wells.select("well_id", "district", "taluka").join(seen, "well_id", "left").na.fill(0, ["n_obs"])


def area_rollup(wells: DataFrame, area: str, min_wells: int = 1) -> DataFrame:
    return (
        wells.where(F.col(area).isNotNull())
        .groupBy(area)
        .agg(F.count(F.lit(1)).alias("n_wells"), F.max("last_obs").alias("last_obs"))
        .where(F.col("n_wells") >= min_wells)
    )
