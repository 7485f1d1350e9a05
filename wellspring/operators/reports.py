"""Crowd-sourced readings checked against a well's own history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.config import DEFAULTS, Settings
from wellspring.functions import calendar as cal

VERDICT_COLUMNS = (
    "status", "reason", "prior_mean", "prior_sd", "z_score", "post_mean", "post_sd", "n_prior_obs",
)


def prior_moments(readings: DataFrame, asks: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Running count, mean and variance at each asked (well_id, reported_for).

    Readings of the same season up to the day; all seasons when fewer than
    three. Distinct asks stand beside the readings with a NULL level, which
    aggregates skip, so plain running windows give every as-of moment.
    """
    rows = readings.select("well_id", F.col("obs_date").alias("_at"), "level_mbgl").unionByName(
        asks.select("well_id", F.col("reported_for").alias("_at")).distinct().withColumn("_ask", F.lit(True)),
        allowMissingColumns=True,
    )
    rows = rows.withColumn("_season", cal.season_of(F.col("_at"), settings))
    level = F.col("level_mbgl")
    everything = Window.partitionBy("well_id").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seasonal = (
        Window.partitionBy("well_id", "_season").orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    moments = rows.withColumns(
        {
            "_n_s": F.count(level).over(seasonal),
            "_mu_s": F.avg(level).over(seasonal),
            "_var_s": F.var_samp(level).over(seasonal),
            "_n_a": F.count(level).over(everything),
            "_mu_a": F.avg(level).over(everything),
            "_var_a": F.var_samp(level).over(everything),
        }
    ).where("_ask")
    enough = F.col("_n_s") >= 3
    return moments.select(
        "well_id",
        F.col("_at").alias("reported_for"),
        F.when(enough, F.col("_n_s")).otherwise(F.col("_n_a")).alias("n_prior"),
        F.when(enough, F.col("_mu_s")).otherwise(F.col("_mu_a")).alias("mu"),
        F.when(enough, F.col("_var_s")).otherwise(F.col("_var_a")).alias("var"),
    )


def verdict(level: Column, well_depth: Column, settings: Settings = DEFAULTS) -> dict[str, Column]:
    """Verdict columns from ``n_prior``, ``mu`` and ``var``.

    Physically impossible beats statistically unlikely; too little history is
    flagged; then |z| decides. The posterior is the normal-normal update.
    """
    n = F.coalesce(F.col("n_prior"), F.lit(0))
    negative, absurd = level < 0, level > settings.report_max_m
    too_deep = F.coalesce((well_depth > 0) & (level > well_depth * 1.05), F.lit(False))
    checked = ~negative & ~absurd & ~too_deep & (n >= 2)
    sd = F.greatest(F.sqrt("var"), F.lit(settings.prior_sd_floor_m))
    z = (level - F.col("mu")) / sd
    prior, noise = sd * sd, F.lit(settings.report_sd_m**2)
    reason = (
        F.when(negative, "negative")
        .when(absurd, "implausible_depth")
        .when(too_deep, "deeper_than_well")
        .when(n < 2, "no_history")
        .when(F.abs(z) <= settings.z_accept, "within_history")
        .when(F.abs(z) <= settings.z_flag, "unusual")
        .otherwise("outlier")
    )
    status = (
        F.when(reason == "within_history", "accepted")
        .when(reason.isin("no_history", "unusual"), "flagged")
        .otherwise("rejected")
    )
    return {
        "status": status,
        "reason": reason,
        "prior_mean": F.when(checked, F.col("mu")),
        "prior_sd": F.when(checked, sd),
        "z_score": F.when(checked, z),
        "post_mean": F.when(checked, (F.col("mu") * noise + level * prior) / (prior + noise)),
        "post_sd": F.when(checked, F.sqrt(prior * noise / (prior + noise))),
        "n_prior_obs": F.when(negative | absurd, F.lit(0).cast("long")).otherwise(n),
    }


def validate_reports(
    reports: DataFrame, readings: DataFrame, wells: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """Each report with its verdict; every report row is kept."""
    priors = prior_moments(readings, reports, settings)
    depths = wells.select("well_id", "well_depth")
    out = reports.join(priors, ["well_id", "reported_for"], "left").join(depths, "well_id", "left")
    return out.withColumns(verdict(F.col("level_mbgl"), F.col("well_depth"), settings)).drop(
        "n_prior", "mu", "var", "well_depth"
    )


def report_history(reports: DataFrame, limit: int, well_id: str | None = None, phone: str | None = None) -> DataFrame:
    """Newest first, for one well, one reporter, or all."""
    df = reports
    if well_id is not None:
        df = df.where(F.col("well_id") == well_id)
    elif phone is not None:
        df = df.where(F.col("phone") == phone)
    return df.orderBy(F.desc("created_at"), "report_id").limit(limit)


def longest_record_well(wells: DataFrame, area: str = "taluka") -> DataFrame:
    """The most checkable well of each area: longest record, then lowest id."""
    return wells.where(F.col(area).isNotNull()).groupBy(area).agg(
        F.min(F.struct((-F.col("n_observations")).alias("_neg"), "well_id", "n_observations")).alias("w")
    ).select(area, "w.well_id", "w.n_observations")


def resolve_wells(requests: DataFrame, wells: DataFrame) -> DataFrame:
    """A request's well: the one it names, else the longest record of its area."""
    known = wells.select("well_id", F.lit(True).alias("_known"))
    best = longest_record_well(wells).select("taluka", F.col("well_id").alias("_best"))
    out = requests.join(known, "well_id", "left").join(best, "taluka", "left")
    resolved = F.when(F.col("_known"), F.col("well_id")).when(F.col("well_id").isNull(), F.col("_best"))
    return out.withColumn("resolved_well", resolved).drop("_known", "_best")
