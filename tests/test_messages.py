import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wellspring.operators import places
from wellspring.streaming import messages as ms
from wellspring.streaming import reports as sr

START = datetime(2024, 1, 1)
MESSAGES = "message_id long, phone string, body string, sent_at timestamp"


@pytest.fixture(scope="module")
def tables(spark):
    wells = spark.createDataFrame(
        [("w1", "Baglan", "Nashik", "Vani", 5, 90.0), ("w2", "Baglan", "Nashik", "Mulher Fort", 9, 90.0), ("w3", "Peth", "Nashik", "Az", 2, 90.0)],
        "well_id string, taluka string, district string, village string, n_observations int, well_depth double",
    )
    users = spark.createDataFrame([("+91reg", "w1", "Baglan"), ("+91city", None, "PUN_KHW")], "phone string, well_id string, entity_id string")
    return wells, users, places.gazetteer(wells)


def _run(spark, tables, folder, rows, files=64, size=ms.PACKET, idle_s=None, parts=1):
    wells, users, gaz = tables
    for n, part in enumerate(rows if isinstance(rows[0], list) else [rows]):
        spark.createDataFrame(part, MESSAGES).repartition(parts).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(MESSAGES).parquet(f"{folder}/in")
        ms.write_packets(stream, users, wells, gaz, f"{folder}/packets", f"{folder}/cp1", size=size).awaitTermination()
        ms.write_intents(ms.converse(ms.read_packets(spark, f"{folder}/packets", files), idle_s), f"{folder}/intents", f"{folder}/cp2").awaitTermination()
    return spark.read.parquet(f"{folder}/intents")


def _rows(script):
    return [(i, p, b, START + timedelta(minutes=i)) for i, (p, b) in enumerate(script)]


def test_a_conversation(spark, tables, tmp_path):
    script = [
        ("p1", "BOOK"), ("p1", "1"), ("p2", "12"), ("p2", "Baglan"), ("p2", "17,4 m"), ("+91reg", "9.5"), ("p3", "Ward 12 Baglan"), ("p3", "xyz"),
        ("p3", "help"), ("p4", "the Mulher Fort village"), ("p4", "3"), ("p5", "az"), ("p5", "nowhere"), ("p5", "az"), ("p5", "BOOK"), ("p5", "4.5"),
        ("p6", "SCORE"), ("+91reg", "score"), ("p5", "Score"), ("p1", "Mumbai"), ("+91city", "score"), ("+91city", "5"), (None, "menu"), ("p7", None), ("p8", "stop"),
    ]
    found = _run(spark, tables, str(tmp_path), _rows(script))
    got = {r.message_id: (r.action, r.well_id, r.level_mbgl, r.workshop) for r in found.collect()}
    none = (None, None, None)
    assert got == {
        0: ("book", *none), 1: ("booked", None, None, "1"), 2: ("ask_place", *none), 3: ("ask_depth", "w2", None, None), 4: ("report", "w2", 17.4, None),
        5: ("report", "w1", 9.5, None), 6: ("ask_depth", "w2", None, None), 7: ("help", *none), 8: ("help", *none), 9: ("ask_depth", "w2", None, None),
        10: ("report", "w2", 3.0, None), 11: ("ask_place", *none), 12: ("retry_place", *none), 13: ("ask_depth", "w3", None, None), 14: ("book", *none),
        15: ("report", "w3", 4.5, None), 16: ("ask_place", *none), 17: ("score", "w1", None, None), 18: ("score", "w3", None, None),
        19: ("ask_place", *none), 20: ("score", *none), 21: ("ask_place", *none), 22: ("help", *none), 23: ("ask_place", *none), 24: ("stop", *none),
    }
    wells, users, _ = tables
    scores = spark.createDataFrame([("Baglan", 40, "SAFE")], "entity_id string, score int, band string")
    shown = {r.message_id: r.action for r in ms.with_scores(found, users, scores).collect()}
    assert shown == {i: x[0] for i, x in got.items()} | {18: "no_score", 20: "no_score"}


def test_the_table_covers_every_case():
    kinds = ("help", "stop", "book", "my_score", "score", *ms.NUMBERS, *ms.TEXTS)
    assert set(ms.NEXT) == {(s, k, w) for s in ms.STEPS for k in kinds for w in (True, False)}
    assert {then for then, _ in ms.NEXT.values()} == set(ms.STEPS)


def _script(seed, phones, n):
    draw = random.Random(seed)
    bodies = ["BOOK", "1", "2", "17.4", "depth 9 m", "Baglan", "near Mulher Fort", "az", "xyz", "SCORE", "help", "stop", "?", ""]
    return _rows([(f"q{draw.randrange(phones)}", draw.choice(bodies)) for _ in range(n)])


def test_long_backlogs_in_small_packets_are_one_conversation(spark, tables, tmp_path):
    rows = _script(3, 2, 900)
    whole = _run(spark, tables, f"{tmp_path}/a", rows)
    pieces = _run(spark, tables, f"{tmp_path}/b", rows, files=1, size=40, parts=3)
    assert sorted(map(str, whole.collect())) == sorted(map(str, pieces.collect())) and whole.count() == len(rows)
    sizes = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/b/packets").select(F.size("messages").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == 40


def test_several_batches_equal_one(spark, tables, tmp_path):
    rows = _script(4, 5, 200)
    whole = _run(spark, tables, f"{tmp_path}/a", rows)
    later = _run(spark, tables, f"{tmp_path}/b", [rows[:70], rows[70:75], rows[75:]], size=7)
    assert sorted(map(str, whole.collect())) == sorted(map(str, later.collect()))


def test_a_session_ends_after_a_pause(spark, tables, tmp_path):
    day = timedelta(days=1)
    rows = [(0, "p", "BOOK", START), (1, "p", "1", START + day), (2, "q", "BOOK", START), (3, "q", "1", START + timedelta(hours=1))]
    got = {r.message_id: r.action for r in _run(spark, tables, str(tmp_path), rows, idle_s=7200.0).collect()}
    assert got == {0: "book", 1: "ask_place", 2: "book", 3: "booked"}


def test_a_timer_removes_an_idle_session(spark, tables, tmp_path):
    import time

    wells, users, gaz = tables
    folder = str(tmp_path)
    spark.createDataFrame(_rows([("p", "BOOK")]), MESSAGES).write.parquet(f"{folder}/in")
    ms.write_packets(spark.readStream.schema(MESSAGES).parquet(f"{folder}/in"), users, wells, gaz, f"{folder}/packets", f"{folder}/cp1").awaitTermination()
    packets = ms.read_packets(spark, f"{folder}/packets")
    query = ms.write_intents(ms.converse(packets, idle_s=1.0, timers=True), f"{folder}/intents", f"{folder}/cp2", available_now=False)
    seen, until = set(), time.time() + 60
    while time.time() < until and not any(removed for _, removed in seen):
        for p in query.recentProgress:
            for o in p.stateOperators:
                seen.add((o.numRowsTotal, o.customMetrics.get("numExpiredTimers", 0) or o.numRowsRemoved))
        time.sleep(0.5)
    query.stop()
    assert any(removed for _, removed in seen), seen


def test_readings_become_validated_reports(spark, tables, tmp_path):
    wells, _, _ = tables
    rows = _rows([("p", "Vani"), ("p", "10.5"), ("p", "400"), ("p", "12")])
    _run(spark, tables, str(tmp_path), rows)
    readings = spark.createDataFrame([("w1", START.date() - timedelta(days=30 * i), 10.0 + i % 3) for i in range(1, 9)], "well_id string, obs_date date, level_mbgl double")
    stream = spark.readStream.schema(ms.INTENTS).parquet(f"{tmp_path}/intents")
    ms.submit_reports(stream, readings, wells, f"{tmp_path}/reports", f"{tmp_path}/cp3").awaitTermination()
    got = {r.report_id: (r.well_id, r.level_mbgl, r.status) for r in spark.read.parquet(f"{tmp_path}/reports").collect()}
    assert got == {"msg1": ("w1", 10.5, "accepted"), "msg2": ("w1", 400.0, "rejected"), "msg3": ("w1", 12.0, "accepted")}


def _reports(ids, minute):
    return [(f"r{i}", START + timedelta(minutes=minute), "w1", 10.0, START.date()) for i in ids]


REPORTS = "report_id string, created_at timestamp, well_id string, level_mbgl double, reported_for date"


def _write(spark, tables, folder, ids, minute, checkpoint="cp", buckets=256):
    wells, _, _ = tables
    spark.createDataFrame(_reports(ids, minute), REPORTS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    readings = spark.createDataFrame([], "well_id string, obs_date date, level_mbgl double")
    stream = spark.readStream.schema(REPORTS).parquet(f"{folder}/in")
    sr.write_reports(stream, readings, wells, f"{folder}/out", f"{folder}/{checkpoint}", buckets=buckets).awaitTermination()


def test_a_batch_reads_the_folders_of_its_own_reports(spark, tables, tmp_path):
    folder, read = str(tmp_path), []
    for n in range(20):
        ids = [*range(3), *range(10 * n, 10 * n + 10)]
        touched = [r[0] for r in spark.createDataFrame([(f"r{i}",) for i in ids], "report_id string").select(sr.bucket_of(F.col("report_id"), 256)).collect()]
        if n:
            files = sr.known_ids(spark, f"{folder}/out", touched).inputFiles()
            read.append(sum(Path(f.removeprefix("file://")).stat().st_size for f in files))
        _write(spark, tables, folder, ids, n)
    got = spark.read.parquet(f"{folder}/out")
    assert sorted(r.report_id for r in got.collect()) == sorted(f"r{i}" for i in range(200))
    whole = sum(f.stat().st_size for f in Path(folder, "out").rglob("*.parquet"))
    assert max(read[-5:]) < 0.2 * whole and max(read[-5:]) < 3 * max(read[:5]), (read, whole)


def test_a_new_checkpoint_overwrites_nothing(spark, tables, tmp_path):
    folder = str(tmp_path)
    _write(spark, tables, folder, range(5), 0)
    _write(spark, tables, folder, range(3, 9), 1, checkpoint="other")
    got = spark.read.parquet(f"{folder}/out").where("bucket >= 0")
    assert sorted(r.report_id for r in got.collect()) == [f"r{i}" for i in range(9)]
    first = {r.report_id: r.created_at for r in got.collect()}
    assert first["r4"] == START and got.select("run").distinct().count() == 2
