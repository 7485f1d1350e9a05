"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from wellspring.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
# A spread over the families; the full set runs at sf0.01 in the driver.
NAMES = [
    "unpivoted_periods", "quality_profile", "prepared_registry", "nearest_donors", "keyed_upsert", "keyed_insert_ignore",
    "reconstructed_daily", "reconstruction_holdout", "weather_features", "daily_features_rural", "asof_last_reading",
    "causal_features", "serving_skew", "leakage_audit", "urban_stress", "rural_area_scores", "well_timeline", "area_timeline",
    "statewide_overview", "error_quantiles", "threshold_curve", "band_accuracy", "validated_reports", "resolved_places",
    "typeahead", "alert_plan", "stride_sample", "quality_checks", "zero_count_checks", "autoregressions", "model_bands", "score_cards",
    "named_messages", "audience_segments", "audience_sizes", "anchor_figures", "figures_as_of", "figure_summary", "retracted_figures",
    "reading_spread", "split_coverage", "seasonal_skill", "streamed_reports", "streamed_intents",
    "residual_targets", "percents_in_pages", "yield_provenance", "ring_climatology", "readings_of_kept_wells",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return float(value)
    text = str(value)
    return text[:-9] if text.endswith(" 00:00:00") else text


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = catalog.spark_queries()[name](spark, SF_DIR)
    cursor = duck.execute(catalog.sql_texts()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_has_a_known_inventory_id():
    ids = {i for q in catalog.QUERIES.values() for i in q.covers}
    assert all("-" in i for i in ids)
    assert len(catalog.QUERIES) == len(set(catalog.QUERIES))
