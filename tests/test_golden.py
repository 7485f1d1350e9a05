"""Golden values and edge cases."""

from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wellspring.functions import text
from wellspring.functions.calendar import strict_date
from wellspring.operators import evaluate, ordering, places, prepare, reports, score, series
from wellspring.sources import readers, writers

ANCHORS = str(Path(__file__).parent / "data" / "anchors.csv")
CAPACITY = [("MUM_ALL", 1447363), ("PUN_KHW", 825660), ("PUN_ALL", 1066930)]


def readings(spark, rows):
    df = spark.createDataFrame([(w, date.fromisoformat(d), float(v)) for w, d, v in rows], "well_id string, obs_date date, level_mbgl double")
    from wellspring.functions.calendar import season_of

    return df.withColumn("season", season_of(F.col("obs_date"))).withColumn("source", F.lit("t"))


@pytest.fixture(scope="module")
def urban(spark):
    a = readers.read_anchors(spark, ANCHORS)
    cap = spark.createDataFrame(CAPACITY, "reservoir_id string, capacity_ml long")
    real = a.withColumnRenamed("entity_id", "reservoir_id").join(cap, "reservoir_id").select(
        "reservoir_id", "date", "live_storage_pct",
        prepare.storage_mcm(F.col("live_storage_pct"), F.col("capacity_ml")).alias("storage_mcm"), F.lit("manual").alias("source"),
    )
    draws = spark.createDataFrame(list(score.DAILY_DRAW_MLD.items()), "reservoir_id string, draw_mld double")
    return score.urban_score(series.interpolate_anchors(real, cap), draws).toPandas()


def test_urban_rows(urban):
    assert len(urban) == 121
    assert urban.groupby("entity_id").size().to_dict() == {"MUM_ALL": 85, "PUN_KHW": 35, "PUN_ALL": 1}
    assert (urban.inputs_source == "interpolated").sum() == 114


@pytest.mark.parametrize(
    "day,expected",
    [
        ("2026-05-15", (38, "SAFE", 36.30, 0.0, 1.76)),
        ("2026-06-13", (56, "MONITOR", 46.61, 0.0, 9.85)),
        ("2026-06-14", (82, "ACT NOW", 46.97, 25.0, 10.13)),
        ("2026-06-16", (83, "ACT NOW", 47.69, 25.0, 10.69)),
        ("2026-06-29", (90, "ACT NOW", 51.68, 25.0, 13.11)),
        ("2026-07-21", (13, "SAFE", 13.35, 0.0, 0.0)),
        ("2026-08-03", (0, "SAFE", 0.0, 0.0, 0.0)),
    ],
)
def test_urban_golden(urban, day, expected):
    r = urban[(urban.entity_id == "MUM_ALL") & (urban.date == date.fromisoformat(day))].iloc[0]
    assert (r.score, r.band) == expected[:2]
    assert (r.s_level, r.s_trend, r.s_runway) == pytest.approx(expected[2:], abs=0.011)


def test_single_anchor_is_not_interpolated(urban):
    assert list(urban[urban.entity_id == "PUN_ALL"].date) == [date(2026, 8, 7)]


def test_reconstruction_meets_every_reading_even_below_the_well(spark):
    obs = readings(spark, [("a", "2015-01-15", 5.0), ("a", "2015-05-15", 30.123456), ("a", "2015-08-15", 3.0), ("a", "2015-11-15", 4.0), ("b", "2015-01-15", 1.0)])
    wells = spark.createDataFrame([("a", 20.0), ("b", 10.0)], "well_id string, well_depth double")
    daily = series.reconstruct_daily(obs, wells).toPandas()
    assert set(daily.well_id) == {"a"}
    assert len(daily) == (date(2015, 11, 15) - date(2015, 1, 15)).days + 1
    real = daily[daily.is_observed].set_index("date").level_mbgl
    assert real[date(2015, 5, 15)] == 30.123456
    assert daily[~daily.is_observed].level_mbgl.max() <= 20.0
    assert (daily[daily.is_observed].confidence == 1.0).all()


def test_asof_takes_the_same_day_and_never_looks_ahead(spark):
    right = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("a", date(2020, 2, 1), 2.0)], "k string, d date, v double")
    left = spark.createDataFrame([("a", date(2020, 2, 1)), ("a", date(2020, 1, 31)), ("a", date(2019, 1, 1)), ("b", date(2020, 1, 1))], "k string, at date")
    got = {(r.k, r.at): r.v for r in ordering.asof_backward(left, right, "k", "at", "d", ["v"]).collect()}
    assert got == {("a", date(2020, 2, 1)): 2.0, ("a", date(2020, 1, 31)): 1.0, ("a", date(2019, 1, 1)): None, ("b", date(2020, 1, 1)): None}
    strict = {(r.k, r.at): r.v for r in ordering.asof_backward(left, right, "k", "at", "d", ["v"], strict=True).collect()}
    assert strict[("a", date(2020, 2, 1))] == 1.0


def test_exact_quantiles_equal_the_plain_ones_under_skew(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("g"),
        F.when(F.col("id") % 2 == 0, F.lit(7.0)).otherwise((F.col("id") * 7919 % 4001) / 13.0).alias("v"),
    )
    got = ordering.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9, "top": 1.0}, small=10).toPandas().set_index("g")
    want = df.toPandas().groupby("g").v
    for name, share in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("top", 1.0)):
        for g in ("small", "hot"):
            assert got.loc[g, name] == pytest.approx(want.quantile(share)[g])


def test_longest_run(spark):
    obs = readings(spark, [("a", f"2015-0{m}-15", v) for m, v in zip(range(1, 8), (1, 2, 2, 2, 2, 3, 3))])
    assert ordering.longest_run(obs, "well_id", "obs_date", "level_mbgl").first().max_run == 4


def test_upsert_twice_is_the_same_table(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    batch = spark.createDataFrame([("b", 3, "extra"), ("c", 4, "x")], "k string, v int, junk string")
    once = writers.upsert(target, batch, ["k"], F.col("v"))
    twice = writers.upsert(once, batch, ["k"], F.col("v"))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    kept = writers.insert_ignore(target, batch.select("k", "v"), ["k"], F.col("v"))
    assert sorted(map(tuple, kept.collect())) == [("a", 1), ("b", 2), ("c", 4)]


def test_keyed_writes_hold_one_row_per_key_and_keep_absent_columns(spark):
    target = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "k string, v int, w int")
    batch = spark.createDataFrame([("b", 3), ("b", 4), ("c", 6), ("c", 5)], "k string, v int")
    after = writers.upsert(target, batch, ["k"], F.col("v"))
    assert sorted(map(tuple, after.collect())) == [("a", 1, 10), ("b", 4, 20), ("c", 6, None)]
    added = writers.insert_ignore(target, batch, ["k"], F.col("v"))
    assert sorted(map(tuple, added.collect())) == [("a", 1, 10), ("b", 2, 20), ("c", 5, None)]
    with pytest.warns(UserWarning, match="junk"):
        writers.upsert(target, batch.withColumn("junk", F.lit(1)), ["k"], F.col("v"))


@pytest.mark.parametrize(
    "raw,expected",
    [("9123456780", "+919123456780"), ("+91 91234 56780", "+919123456780"), ("09123456780", "+919123456780"), ("0919123456780", "+919123456780"), ("12345", None), ("5123456780", None)],
)
def test_phones(spark, raw, expected):
    assert spark.range(1).select(text.phone_e164(F.lit(raw)).alias("p")).first().p == expected


@pytest.mark.parametrize(
    "raw,expected",
    [("17.4", 17.4), ("depth: 17,4 m", 17.4), ("12 मीटर", 12.0), ("Ward 12 Baglan", None), ("", None), ("7 feet", None), (" 9METRES ", 9.0)],
)
def test_depth_text(spark, raw, expected):
    assert spark.range(1).select(text.parse_depth(F.lit(raw)).alias("d")).first().d == expected


def test_names_places_dates_and_ages(spark):
    row = spark.range(1).select(
        text.clean_name(F.lit("  o'NEIL   nagar-2a ")).alias("a"), text.clean_name(F.lit("nan")).alias("b"),
        text.place_key(F.lit("Nāśik Taluka, Co-operative Society")).alias("c"),
        strict_date(F.lit("2023-02-30")).alias("d"), strict_date(F.lit("2023-02-28")).alias("e"),
        text.age_words(F.lit(1183)).alias("f"), text.age_words(F.lit(90)).alias("g"),
        text.mask_phone(F.lit("+919123456780")).alias("h"), text.pretty_phone(F.lit("+919123456780")).alias("i"),
    ).first()
    assert tuple(row) == ("O'Neil Nagar-2A", None, "nasik", None, date(2023, 2, 28), "3.2 years ago", "3 months ago", "+91 XXXXX 6780", "+91 91234 56780")


def test_report_verdicts(spark):
    obs = readings(spark, [("a", f"{y}-05-15", 10 + 0.1 * (y % 3)) for y in range(2010, 2020)])
    wells = spark.createDataFrame([("a", 40.0), ("n", None)], "well_id string, well_depth double")
    asked = spark.createDataFrame(
        [(str(i), w, v, date(2021, 5, 1)) for i, (w, v) in enumerate([("a", 10.2), ("a", 10.8), ("a", 39.0), ("a", 450.0), ("a", 45.0), ("a", -1.0), ("n", 5.0)])],
        "report_id string, well_id string, level_mbgl double, reported_for date",
    )
    got = {r.report_id: (r.status, r.reason) for r in reports.validate_reports(asked, obs, wells).collect()}
    assert got == {
        "0": ("accepted", "within_history"), "1": ("flagged", "unusual"), "2": ("rejected", "outlier"), "3": ("rejected", "implausible_depth"),
        "4": ("rejected", "deeper_than_well"), "5": ("rejected", "negative"), "6": ("flagged", "no_history"),
    }


def test_areas_that_cannot_be_scored_keep_a_reason(spark):
    obs = readings(spark, [("a", f"201{y}-05-15", 10 + y) for y in range(5)] + [("b", "2012-05-15", 4.0)])
    wells = spark.createDataFrame([("a", "A", 40.0), ("b", "B", 40.0), ("c", "C", 40.0)], "well_id string, taluka string, well_depth double")
    cards = {r.entity_id: r for r in score.rural_score(obs, wells).collect()}
    assert cards["A"].status == "ok" and cards["A"].driving_well == "a"
    assert cards["B"].reason == "fewer than 4 readings per well" and cards["B"].score is None
    assert cards["C"].reason == "no readings for this entity"
    late = spark.createDataFrame([("A", date(2030, 1, 1)), ("Z", date(2012, 1, 1))], "taluka string, origin_date date")
    asked = {r.entity_id: r.reason for r in score.rural_score(obs, wells, origins=late).collect()}
    assert asked == {"A": "origin is after the last reading", "Z": "no wells found"}


def test_aggregate_off_by_one_is_reported(spark):
    bodies = spark.createDataFrame([("x", 10), ("y", 20)], "reservoir_id string, capacity_ml long")
    members = spark.createDataFrame([("XY", "x"), ("XY", "y"), ("BAD", "x")], "aggregate_id string, member_id string")
    agg = spark.createDataFrame([("XY", 30), ("BAD", 11)], "reservoir_id string, capacity_ml long")
    assert [r.aggregate_id for r in prepare.aggregate_mismatches(agg, members, bodies).collect()] == ["BAD"]


def test_pages_and_weather_payloads(spark):
    pages = spark.createDataFrame([(1, "<td>Upper Vaitarna</td> <td>88.5 %</td> vehar 7%"), (2, "nothing 50%")], "page_id long, html string")
    got = {(r.page_id, r.reservoir_id): r.live_storage_pct for r in readers.percents_from_pages(pages).collect()}
    assert got == {(1, "UPPER_VAITARNA"): 88.5, (1, "VIHAR"): 7.0}
    pages = spark.createDataFrame([(1, "Tansa full ٤٠ %"), (2, "Tansa ८.५%"), (3, "Tansa 12२ %")], "page_id long, html string")
    assert {r.page_id: r.live_storage_pct for r in readers.percents_from_pages(pages).collect()} == {1: 40.0, 2: 8.5, 3: 122.0}
    doc = '{"daily":{"time":["2020-01-01","2020-01-02"],"precipitation_sum":[1.0,null]},"hourly":{"time":["2020-01-01T00:00","2020-01-01T01:00"],"soil_moisture_0_to_7cm":[0.2,0.4]}}'
    rows = readers.weather_from_arrays(spark.createDataFrame([("c", doc)], "cell_id string, payload string")).orderBy("date").collect()
    assert rows[0].precip_mm == 1.0 and rows[0].soil_moist_0_7 == pytest.approx(0.3) and rows[0].temp_max is None
    assert rows[1].precip_mm is None and rows[1].soil_moist_0_7 is None
    doc = '{"properties":{"parameter":{"PRECTOTCORR":{"20200101":-999,"20200102":2.5},"T2M_MAX":{"20200101":30,"20200102":31},"T2M_MIN":{"20200101":20,"20200102":-999},"T2M":{"20200101":25,"20200102":26},"RH2M":{}}}}'
    rows = readers.weather_from_maps(spark.createDataFrame([("c", 18.5, doc)], "cell_id string, lat double, payload string")).orderBy("date").collect()
    assert rows[0].precip_mm is None and 3.0 < rows[0].et0_mm < 5.0 and rows[1].precip_mm == 2.5 and rows[1].et0_mm is None


def test_place_resolution_order(spark):
    wells = spark.createDataFrame(
        [("w1", "Baglan", "Nashik", "Pune Gaon", 5), ("w2", "Baglan", "Nashik", "Vani", 9), ("w3", "Dindori", "Nashik", "Nalegaon", 1)],
        "well_id string, taluka string, district string, village string, n_observations int",
    )
    asked = spark.createDataFrame(
        [("1", "Baglan tal.", "farmer"), ("2", "near vani", "farmer"), ("3", "Pune Baglan", "society-manager"), ("4", "Mumbai", "farmer"), ("5", "nale", "farmer"), ("6", "a", "farmer"), ("7", "zzz", "farmer"), ("8", "!!", "farmer")],
        "request_id string, place string, role string",
    )
    got = {r.request_id: (r.status, r.entity_id) for r in places.resolve_places(asked, places.gazetteer(wells)).collect()}
    assert got == {"1": ("ok", "Baglan"), "2": ("ok", "w2"), "3": ("ok", "PUN_KHW"), "4": ("ok", "MUM_ALL"), "5": ("ok", "w3"), "6": ("ambiguous", None), "7": ("unresolved", None), "8": ("unresolved", None)}


def test_gated_publish_and_run_log(spark, tmp_path):
    df = spark.range(3)
    bad = spark.createDataFrame([("t", "FAIL")], "check_name string, status string")
    assert not writers.publish(df, bad, str(tmp_path / "p"), "1")
    assert writers.publish(df, bad, str(tmp_path / "p"), "1", force=True)
    log = str(tmp_path / "log")
    assert writers.logged_run(spark, "job", log, lambda: df, lambda d: writers.replace_table(d, str(tmp_path / "t"))) == 3
    with pytest.raises(ZeroDivisionError):
        writers.logged_run(spark, "job", log, lambda: df, lambda d: 1 / 0)
    assert sorted((r.status, r.rows_out) for r in spark.read.parquet(log).collect()) == [("failed", None), ("ok", 3)]


def test_nearest_donor_in_a_dense_town(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    points, donors = 18.52 + rng.random((3000, 2)) * 0.009, 18.52 + rng.random((2000, 2)) * 0.009
    p = spark.createDataFrame([(f"p{i}", float(a), float(b) + 55) for i, (a, b) in enumerate(points)], "well_id string, lat double, lon double")
    d = spark.createDataFrame(
        [(f"d{i}", float(a), float(b) + 55, 0.1) for i, (a, b) in enumerate(donors)], "well_id string, lat double, lon double, sy double"
    )
    got = {r.well_id: r.donor_id for r in prepare.nearest_donor(p, d, "sy").collect()}
    scale = np.cos(np.radians(18.5245))
    for i in rng.integers(0, 3000, 200):
        gap = np.hypot(donors[:, 0] - points[i, 0], (donors[:, 1] - points[i, 1]) * scale)
        near = int(got[f"p{i}"][1:])
        assert gap[near] <= gap.min() * 1.0001


def test_quantiles_of_ten_million_distinct_values(spark):
    """Two rounds of cutting leave a few thousand values of the one large group."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("g").alias("g"), ((F.col("id") * 7919) % n).cast("double").alias("v"), F.lit(1).cast("long").alias("w"))
    few = spark.createDataFrame([("h", 1.0, 2), ("h", 4.0, 1)], "g string, v double, w long")
    got = {r.g: r for r in ordering.exact_quantiles(rows.unionByName(few), ["g"], "v", {"p10": 0.1, "p50": 0.5, "top": 1.0}, weight="w", small=4096).collect()}
    assert (got["g"].p10, got["g"].p50, got["g"].top) == (pytest.approx((n - 1) * 0.1), (n - 1) / 2, n - 1.0)
    assert (got["h"].p50, got["h"].top) == (1.0, 4.0)


def test_one_matrix_of_sums_serves_all_variants(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(20, 4, (400, 3))
    y = 2.5 + x @ [0.5, -0.2, 0.1] + rng.normal(0, 0.1, 400)
    rows = [(*map(float, a), float(b), "train" if i < 300 else "test") for i, (a, b) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, "a double, b double, c double, level_mbgl double, split string")
    variants = {"one": ["a"], "all": ["a", "b", "c"], "twice": ["b", "c", "a"]}
    fits, table = evaluate.autoregressions(frame, variants)
    for name, xs in variants.items():
        design = np.column_stack([np.ones(300), *(x[:300, "abc".index(c)] for c in xs)])
        want = np.linalg.lstsq(design, y[:300], rcond=None)[0]
        assert np.allclose(list(fits[name].values()), want, rtol=1e-6)
        test = np.column_stack([np.ones(100), *(x[300:, "abc".index(c)] for c in xs)])
        [mae] = {r.mae for r in table.where(F.col("variant") == name).collect()}
        assert mae == pytest.approx(np.abs(test @ want - y[300:]).mean(), rel=1e-6)
    same = frame.withColumn("b", F.col("a"))
    fits, _ = evaluate.autoregressions(same, {"v": ["a", "b"]})
    assert fits["v"]["a"] + fits["v"]["b"] == pytest.approx(evaluate.autoregressions(same, {"v": ["a"]})[0]["v"]["a"], rel=1e-6)


def test_ledger_of_corrected_and_retracted_values(spark):
    from wellspring.operators import views

    day = lambda d: date(2026, 6, d)
    versions = spark.createDataFrame(
        [("A", day(1), 10.0, "secondhand", day(2)), ("A", day(1), 11.0, "primary", day(5)), ("B", day(1), 20.0, "primary", day(2)),
         ("C", day(1), 30.0, None, day(2)), ("C", day(1), 31.0, "reported", day(9))],
        "entity_id string, date date, live_storage_pct double, confidence string, recorded_on date",
    )
    back = spark.createDataFrame([("B", day(1), day(6), "wrong date"), ("C", day(1), day(4), "wrong value"), ("D", day(1), day(4), "never was")], "entity_id string, date date, retracted_on date, reason string")
    ledger = views.anchor_ledger(versions, back)

    def held(d):
        return {r.entity_id: r.live_storage_pct for r in views.anchors_as_of(ledger, f"2026-06-{d:02d}").collect()}

    assert held(1) == {} and held(2) == {"A": 10.0, "B": 20.0, "C": 30.0} and held(4) == {"A": 10.0, "B": 20.0}
    assert held(5) == {"A": 11.0, "B": 20.0} and held(6) == {"A": 11.0} and held(9) == {"A": 11.0, "C": 31.0}
    assert {(r.entity_id, r.reason) for r in views.retracted(ledger, "2026-06-05").collect()} == {("C", "wrong value")}
    shown = views.figures(views.anchors_as_of(ledger, "2026-06-02"), {"A|2026-06-01": "a_first"})
    assert {r.entity_id: (r.verified, r.figure) for r in shown.collect()} == {"A": (False, "a_first"), "B": (True, None), "C": (False, None)}
    assert {r.confidence: (r.n, r.n_verified) for r in views.figure_summary(shown).collect()} == {"secondhand": (1, 0), "primary": (1, 1), "none": (1, 0), "total": (3, 1)}


def test_nobody_is_reached_by_who_may_not_send(spark):
    from wellspring.operators import audience

    people = [("g", "government", None, False), ("h", "government", "X", False), ("m", "society-manager", "X", True), ("n", "society-manager", "X", False), ("o", "society-manager", None, True), ("f", "farmer", "X", True), ("z", "farmer", "Y", None)]
    users = spark.createDataFrame(people, "user_id string, role string, entity_id string, verified boolean")
    got = {r.sender_id: r.audience for r in audience.reach(users, users).collect()}
    assert got == {"g": 5, "h": 4, "m": 3, "n": 0, "o": 0, "f": 0, "z": 0}
    assert {(r.sender_id, r.segment, r.entity_id) for r in audience.audience_pointers(users).collect()} == {("g", "all", None), ("h", "all", None), ("m", "entity", "X")}
    pairs = {(r.sender_id, r.user_id) for r in audience.audience(users, users).collect()}
    assert pairs == {("m", "h"), ("m", "n"), ("m", "f")}


def test_a_run_ends_at_nulls_and_begins_at_the_first_row(spark):
    rows = [("a", 1, None), ("a", 2, None), ("a", 3, 5.0), ("a", 4, 5.0), ("a", 5, 5.0), ("a", 6, 4.0), ("b", 1, 5.0)]
    got = ordering.with_run(spark.createDataFrame(rows, "k string, t int, v double"), "k", "t", "v")
    assert [r.run for r in got.orderBy("k", "t").collect()] == [1, 2, 1, 2, 3, 1, 1]
    longest = {r.k: r.max_run for r in ordering.longest_run(got.drop("run"), "k", "t", "v").collect()}
    assert longest == {"a": 3, "b": 1}
