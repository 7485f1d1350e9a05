import random

import pytest

from wellspring.operators import places

LIST = "list_order"


def _brute(key, urban, gaz):
    """Answers by the written order of rules, over plain lists (entries in listing order)."""
    words = key.split(" ")
    cities = [places.CITY_KEYWORDS[w][0] for w in words if w in places.CITY_KEYWORDS]
    if urban and cities:
        return "ok", cities[0], []
    for kind in (0, 1):
        for e in gaz:
            if e.kind_order == kind and e.key in words:
                return "ok", e.entity_id, []
    if cities:
        return "ok", cities[0], []
    found = [e.entity_id for e in gaz if key and (e.key in key or key in e.key)]
    if len(found) == 1:
        return "ok", found[0], []
    return ("ambiguous", None, found[:8]) if found else ("unresolved", None, [])


def _listed(key, gaz):
    out = []
    for kind, test in ((0, lambda k: k.startswith(key)), (0, lambda k: key in k and not k.startswith(key)), (1, lambda k: k.startswith(key))):
        out += [(e.entity_type, e.entity_id) for e in gaz if e.kind_order == kind and test(e.key)]
    out += [("reservoir", eid) for name, (eid, _) in places.CITY_KEYWORDS.items() if name.startswith(key)]
    return list(dict.fromkeys(out))[:10]


@pytest.fixture(scope="module")
def gazetteer(spark):
    draw = random.Random(4)
    name = lambda n: "".join(draw.choice("abp u") for _ in range(n)).strip() or "a"
    wells = [(f"w{i}", f"Taluka {name(3)}", f"d{i % 7}", name(draw.randrange(1, 9)), i) for i in range(300)]
    wells += [("x1", None, "d", "Vani", 1), ("x2", "Pune Vani", "d", None, 1), ("x3", "!!", "d", "village", 1)]
    wells += [(f"h{i}", f"Hot{i % 12}", "d", "Machinery", 1) for i in range(400)]
    gaz = places.gazetteer(spark.createDataFrame(wells, "well_id string, taluka string, district string, village string, n_observations int"))
    rows = sorted(gaz.collect(), key=lambda e: (e.kind_order, e.list_order, e.entity_id))
    return gaz, rows


def _requests(rows):
    draw = random.Random(9)
    texts = ["", "!!", "achin", "vani", "Pune Vani", "near pune", "mumbai a", "zzz", "machinery hot1", "hot", "a", "b", "u", "xvaniy", "Púne", "machinery"]
    for e in draw.sample(rows, 60):
        at = draw.randrange(len(e.key))
        texts += [e.key[at:], f"q{e.key}", e.key[: at + 1] + " b"]
    return texts


def test_resolution_matches_plain_lists(spark, gazetteer, monkeypatch):
    monkeypatch.setattr(places, "HELD", 50)
    gaz, rows = gazetteer
    asked = [(f"{i}-{role}", t, role) for i, t in enumerate(_requests(rows)) for role in ("farmer", "society-resident", None)]
    frame = spark.createDataFrame([*asked, ("null", None, "farmer")], "request_id string, place string, role string")
    keys = {r.request_id: r.key for r in frame.select("request_id", places.place_key(frame["place"]).alias("key")).collect()}
    got = {r.request_id: (r.status, r.entity_id, r.candidates) for r in places.resolve_places(frame, gaz.repartition(5)).collect()}
    assert got == {i: _brute(keys[i] or "", role == "society-resident", rows) for i, _, role in [*asked, ("null", None, "farmer")]}


def test_typeahead_matches_plain_lists(spark, gazetteer):
    gaz, rows = gazetteer
    texts = sorted(set(_requests(rows)) | {"pu", "pi", "ta", "ho", "mu", "ac"})
    frame = spark.createDataFrame([(t,) for t in texts], "query string")
    keys = {r.query: r.key for r in frame.select("query", places.place_key(frame["query"]).alias("key")).collect()}
    got = {}
    for r in places.typeahead(frame, gaz).orderBy("position").collect():
        got.setdefault(r.query, []).append((r.entity_type, r.entity_id))
    assert got == {t: want for t in texts if len(keys[t]) >= 2 and (want := _listed(keys[t], rows))}


def test_an_index_row_is_exact_and_bounded(spark, gazetteer):
    gaz, rows = gazetteer
    index = places.place_index(gaz.repartition(7), range(1, 12)).collect()
    for r in index:
        holds = {places.WHOLE: lambda k, t=r.text: k == t, places.STARTS: lambda k, t=r.text: k.startswith(t) and k != t, places.INSIDE: lambda k, t=r.text: t in k and not k.startswith(t)}
        some = [e for e in rows if e.kind_order == r.kind_order and holds[r.how](e.key)]
        assert r.n == len(some)
        assert [h.entity_id for h in r.hits] == [e.entity_id for e in some[:8]]
        assert [h.entity_id for h in r.leads] == list(dict.fromkeys(e.entity_id for e in some))[:10]
    assert {(r.text, r.kind_order, r.how) for r in index} and len({(r.text, r.kind_order, r.how) for r in index}) == len(index)


def test_an_index_of_all_lengths_answers_later_requests(spark, gazetteer):
    gaz, rows = gazetteer
    index = places.place_index(gaz, range(1, 40)).cache()
    frame = spark.createDataFrame([("1", "achin", "farmer"), ("2", "vani", "farmer")], "request_id string, place string, role string")
    got = {r.request_id: r.status for r in places.resolve_places(frame, gaz, index=index).collect()}
    assert got == {"1": "ambiguous", "2": "ok"}


def test_empty_tables(spark, gazetteer):
    gaz, _ = gazetteer
    asked = spark.createDataFrame([("1", "pune", "farmer"), ("2", "vani", "farmer")], "request_id string, place string, role string")
    got = {r.request_id: r.status for r in places.resolve_places(asked, gaz.limit(0)).collect()}
    assert got == {"1": "ok", "2": "unresolved"}
    assert places.resolve_places(asked.limit(0), gaz).count() == 0
    assert places.typeahead(asked.selectExpr("place AS query").limit(0), gaz).count() == 0


def test_index_of_asked_texts_leaves_the_others_out(spark):
    wells = spark.createDataFrame(
        [(f"W{i}", "T", "D", f"Village number {i:05d}") for i in range(400)] + [("Wé", "T", "D", "पाणी गाव")],
        "well_id string, taluka string, district string, village string",
    )
    gaz = places.gazetteer(wells)
    keys = spark.createDataFrame([("number 0001",), ("village num",), ("0039",), ("पाणी",), ("00123",), ("nowhere",)], "key string")
    whole = places.place_index(gaz, places.lengths_of(keys, "key"))
    short = places.place_index(gaz, places.lengths_of(keys, "key"), keys)
    kept = lambda index: sorted(map(repr, index.join(keys.withColumnRenamed("key", "text"), "text").collect()))
    assert kept(short) == kept(whole) and len(kept(short)) >= 3
    names = lambda index: {r.text for r in index.where(f"how = {places.WHOLE}").select("text").collect()}
    assert names(short) == names(whole)
    assert short.count() < 450 < 2_000 < whole.count()
