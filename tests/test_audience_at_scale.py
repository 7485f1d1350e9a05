"""Pairs of one large entity are made in many tasks, each pair once."""

from pyspark.sql import functions as F
from wellspring.operators import audience as au


def test_pairs_of_a_large_entity_are_spread(spark, monkeypatch):
    monkeypatch.setattr(au, "GROUP", 16, raising=False)
    monkeypatch.setattr(au, "PAIRS_PER_TASK", 1000, raising=False)
    rows = [(f"U{i}", "society-manager" if i % 3 == 0 else "farmer", i % 2 == 0, "big" if i % 10 else f"e{i % 4}") for i in range(300)]
    rows += [("U6", "society-manager", True, "big"), ("lone", "society-manager", True, None), (None, "farmer", True, "big"), ("x", "farmer", True, "y")]
    users = spark.createDataFrame(rows, "user_id string, role string, verified boolean, entity_id string")
    senders = users.where(F.col("role") == "society-manager")
    out = au.audience(users, senders)
    assert out.columns == ["entity_id", "user_id", "role", "verified", "sender_id"]
    want = sorted(
        (s[0], p[0]) for s in rows if s[1] == "society-manager" and s[2] and s[3] for p in rows if p[3] == s[3] and p[0] and p[0] != s[0]
    )
    assert sorted((r.sender_id, r.user_id) for r in out.collect()) == want
    per_task = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(want) > 10_000 and max(per_task) < len(want) / 3
