"""Reports arriving as a stream, validated with the batch rules.

The written table is also the index of the reports it holds: it lies in folders by the
hash of ``report_id``, and in them by the query and the batch that wrote. A batch reads
the ids of the folders that its own reports belong to, and no others, so what it reads
follows its own size and not the length of the stream. The number of folders is a
parameter of the table, kept beside it.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wellspring.config import DEFAULTS, Settings
from wellspring.operators.reports import validate_reports
from wellspring.sources.writers import first_per_key

BUCKETS = 256
PLACED = "bucket int, run string, batch long"
_EMPTY = -1


def bucket_of(report_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(report_id), F.lit(buckets)).cast("int")


def known_ids(spark: SparkSession, path: str, touched: list[int]) -> DataFrame:
    """report_id, run and batch of what the folders ``touched`` hold; nothing else is listed or read."""
    folders = ",".join(str(b) for b in (_EMPTY, *sorted(touched)))
    shape = f"report_id string, {PLACED}"
    return spark.read.schema(shape).option("basePath", path).parquet(f"{path}/bucket={{{folders}}}")


def write_reports(
    stream: DataFrame,
    readings: DataFrame,
    wells: DataFrame,
    path: str,
    checkpoint: str,
    settings: Settings = DEFAULTS,
    available_now: bool = True,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Each report once with its verdict, however late it comes.

    A micro-batch is judged by the batch operator on its distinct (well, day) asks. What
    it writes carries the query's id and its number, so that a repeated batch overwrites
    itself and a query with a new checkpoint overwrites nothing. A ``report_id`` that is
    written already is not written again. There is no watermark, so no report is ever
    dropped for its age. All queries on a table need the same ``buckets``.
    """
    spark = stream.sparkSession
    started, run = threading.Event(), []

    def write_batch(batch: DataFrame, number: int) -> None:
        started.wait()
        once = first_per_key(batch, ["report_id"], F.col("created_at")).withColumn("bucket", bucket_of(F.col("report_id"), buckets))
        once = once.persist()
        touched = [r[0] for r in once.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if touched:
            own = (F.col("run") == run[0]) & (F.col("batch") == number)
            before = known_ids(batch.sparkSession, path, touched).where(~own).select("bucket", "report_id")
            fresh = once.join(before, ["bucket", "report_id"], "left_anti")
            judged = validate_reports(fresh, readings, wells, settings)
            placed = judged.withColumns({"run": F.lit(run[0]), "batch": F.lit(number).cast("long")}).repartition("bucket")
            rows = placed.write.partitionBy("bucket", "run", "batch").mode("overwrite")
            rows.option("partitionOverwriteMode", "dynamic").parquet(path)
        once.unpersist()

    shape = validate_reports(spark.createDataFrame([], stream.schema), readings, wells, settings).schema
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{path}/bucket={_EMPTY}/run=none/batch={_EMPTY}")
    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    run.append(query.id)
    started.set()
    return query
