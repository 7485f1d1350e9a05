"""Time the headline queries and print one JSON line.

Each query is planned and run to the end (``noop`` sink); an untimed read
warms the session first. ``rows_per_sec`` relates each time to the rows the
query has to produce or scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wellspring.plans import catalog
from wellspring.plans.fixtures import Fixtures

HEADLINE = [
    "reconstructed_daily",
    "causal_features",
    "asof_last_reading",
    "weather_features",
    "rural_area_scores",
    "urban_stress",
    "well_timeline",
    "validated_reports",
    "prepared_registry",
    "nearest_donors",
    "error_quantiles",
    "threshold_curve",
    "keyed_upsert",
    "user_listing",
    "daily_features_rural",
    "baseline_metrics",
    "resolved_places",
    "area_timeline",
    "quality_checks",
    "residual_model_metrics",
]
# Once this much time is spent no further query is begun; the line names those left out.
BUDGET_S = float(os.environ.get("BENCH_BUDGET_S", "900"))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    Fixtures(spark, sf_dir).readings.write.format("noop").mode("overwrite").save()
    timed: dict[str, float] = {}
    began = time.perf_counter()
    for name in names:
        if time.perf_counter() - began > BUDGET_S:
            print(f"{name}: not timed, the budget of {BUDGET_S:.0f}s is spent", file=sys.stderr, flush=True)
            continue
        start = time.perf_counter()
        catalog.spark_queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {timed[name]}s", file=sys.stderr, flush=True)
    daily_rows = Fixtures(spark, sf_dir).daily.agg(F.count(F.lit(1))).first()[0] if "reconstructed_daily" in timed else None
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "daily_rows": daily_rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
