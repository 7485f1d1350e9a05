"""Boosted trees train on one stored copy of their rows, and give what they gave on copies of their own."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from test_causal_at_scale import odd_tables
from test_daily_at_scale import SETTINGS
from wellspring.operators import evaluate as ev
from wellspring.operators import features as ft
from wellspring.plans import evaluation

HORIZONS = (7, 40)


@pytest.fixture
def fx(spark):
    readings, wells, cells, weather = odd_tables(spark)
    causal = ft.causal_features(readings, weather, cells, wells, HORIZONS, 4, settings=SETTINGS)
    return SimpleNamespace(spark=spark, causal=causal, settings=SETTINGS)


@pytest.fixture
def stored(fx, monkeypatch):
    """The columns of each table that is stored."""
    kind, found = type(fx.causal), []
    write = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda df, *args, **kw: found.append(df.columns) or write(df, *args, **kw))
    return found


def test_trees_of_gains_and_residuals_store_their_rows_once(fx, stored):
    matrix, names = evaluation._matrix(fx)
    model, ready = ev.train_residual_model(matrix, names, rounds=2, depth=2)
    assert stored == [fx.causal.columns]
    # A copy of its own, with the flags, gives the same trees and the same rows.
    again, copy = ev.train_residual_model(matrix.checkpoint(), names, rounds=2, depth=2)
    assert again.stages[-1].toDebugString.split("\n")[1:] == model.stages[-1].toDebugString.split("\n")[1:]
    keys = ["well_id", "target_date", "horizon_d"]
    one, two = (ev.predict_residual(m, rows).orderBy(*keys, "y_pred").collect() for m, rows in ((model, ready), (again, copy)))
    assert one == two and len(one) == fx.causal.count() > 200
    assert sum(r.gain_share for r in ev.gain_importance(fx.spark, model, names).collect()) == pytest.approx(1)


def test_models_of_horizons_share_the_stored_rows(fx, stored):
    matrix, names = evaluation._matrix(fx)
    pred = ev.train_per_horizon(matrix, names, HORIZONS, rounds=2, depth=2)
    assert stored == [fx.causal.columns]
    counts = {r.horizon_d: r["count"] for r in pred.groupBy("horizon_d").count().collect()}
    assert counts == {r.horizon_d: r["count"] for r in fx.causal.groupBy("horizon_d").count().collect()}
    # The model of a horizon is that of its rows alone, stored beside the others.
    part = matrix.where(F.col("horizon_d") == 40).checkpoint()
    model, ready = ev.train_residual_model(part, [n for n in names if n != "horizon_d"], rounds=2, depth=2)
    keys = ["well_id", "target_date", "y_pred"]
    alone = ev.predict_residual(model, ready).orderBy(*keys).collect()
    assert alone == pred.where("horizon_d = 40").orderBy(*keys).collect()
