"""Keyed upserts, replace, export, gated publish and the run log."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wellspring.operators.lineage import cut_lineage
from wellspring.schemas import RUN_LOG, conform, unknown_columns


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Target after the batch: batch rows win, the last one per key by ``order``.

    One row per key is picked with a map-side combined aggregate, so a key
    repeated many times in the batch never meets in one task. Columns that the
    batch does not bring keep the target's value; columns that the target does
    not have are dropped with a warning.
    """
    aligned = conform(_known_only(last_per_key(batch, keys, order), target), target.schema)
    absent = [c for c in target.columns if c not in batch.columns]
    if absent:
        stored = target.select(*keys, *absent)
        aligned = aligned.drop(*absent).join(stored, keys, "left").select(*target.columns)
    return target.join(aligned.select(*keys), keys, "left_anti").select(*target.columns).unionByName(aligned)


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Target plus the batch rows whose key is new, the first one per key by ``order``."""
    fresh = first_per_key(batch, keys, order).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(conform(_known_only(fresh, target), target.schema))


def upsert_partitions(path: str, batch: DataFrame, keys: list[str], order: Column, partition_by: list[str]) -> None:
    """Upsert into a partitioned table, reading and rewriting only the partitions that the batch touches.

    ``partition_by`` must be part of ``keys``, so that a key never moves.
    """
    if not set(partition_by) <= set(keys):
        raise ValueError(f"partition columns {partition_by} are not part of the keys {keys}")
    stored = batch.sparkSession.read.parquet(path)
    touched = stored.join(batch.select(*partition_by).distinct(), partition_by, "left_semi").select(*stored.columns)
    replace_partitions(cut_lineage(upsert(touched, batch, keys, order)), path, partition_by)


def _known_only(batch: DataFrame, target: DataFrame) -> DataFrame:
    extra = unknown_columns(batch, target.schema)
    if extra:
        warnings.warn(f"columns not in the table are dropped: {', '.join(extra)}", stacklevel=3)
    return batch.drop(*extra)


def last_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


_IN_PLACE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType)


def _pick(df: DataFrame, keys: list[str], order: Column, choose: Callable) -> DataFrame:
    """One row per key by ``order``.

    With fixed-width columns each is picked by an aggregate of its own: these see
    the same rows in the same sequence and so pick the same row, and they can be
    updated in place, which lets Spark hash instead of sorting the raw table.
    """
    rest = [c for c in df.columns if c not in keys]
    kinds = df.select(*rest, order.alias("_order")).schema.fields
    if rest and all(isinstance(f.dataType, _IN_PLACE) for f in kinds):
        return df.groupBy(*keys).agg(*[choose(F.col(c), order).alias(c) for c in rest]).select(*df.columns)
    row = F.struct(*[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(choose(row, order).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest]).select(*df.columns)


def replace_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def all_null_columns(df: DataFrame) -> list[str]:
    """One aggregate over the table; returns the columns that hold nothing."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def export_parquet(df: DataFrame, path: str) -> DataFrame:
    """zstd Parquet without all-NULL columns; returns what was written."""
    once = cut_lineage(df)  # the counts and the write would each run what stands behind df
    kept = once.drop(*all_null_columns(once))
    kept.write.mode("overwrite").parquet(path, compression="zstd")
    return kept


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def publish(df: DataFrame, checks: DataFrame, root: str, version: str, force: bool = False) -> bool:
    """Write ``root/version=...`` only when no check row says FAIL (or when forced)."""
    failed = checks.where(F.col("status") == "FAIL").limit(1).count() > 0
    if failed and not force:
        return False
    df.write.mode("errorifexists").parquet(f"{root}/version={version}")
    return True


def write_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def logged_run(
    spark: SparkSession,
    script: str,
    log_path: str,
    build: Callable[[], DataFrame],
    write: Callable[[DataFrame], None],
    rows_in: int | None = None,
) -> int:
    """Build and write a table, appending one run-log row even when it fails.

    Rows out come from ``DataFrame.observe`` on the written plan: no second
    pass. A log that cannot be written never hides the job's own error.
    """
    started, seen, status, notes = datetime.now(timezone.utc), None, "ok", None
    try:
        watch = Observation(f"rows-{uuid.uuid4()}")
        write(build().observe(watch, F.count(F.lit(1)).alias("rows_out")))
        seen = watch.get["rows_out"]
        return seen
    except Exception as error:
        status, notes = "failed", f"{type(error).__name__}: {str(error).splitlines()[0]}"
        raise
    finally:
        row = (
            uuid.uuid4().hex, script, started, datetime.now(timezone.utc),
            rows_in, seen, status, notes,
        )
        try:
            spark.createDataFrame([row], RUN_LOG).write.mode("append").parquet(log_path)
        except Exception as log_error:  # noqa: BLE001
            print(f"run log not written: {log_error}")
