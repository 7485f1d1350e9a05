"""Gazetteer, free-text place resolution and typeahead over a bounded index.

Substring matching never compares every request with every place, and never lists the
entries of a common substring. The index has one row per text (a key or a substring of
keys): the exact number of entries that hold it and the first few of them. Requests
then meet one row per text they ask for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.text import CITY_KEYWORDS, place_key
from wellspring.operators.lineage import cut_lineage

CANDIDATES_SHOWN = SHOWN = 8
LISTED = 10
URBAN_ROLES = ("society-manager", "society-resident")

WHOLE, STARTS, INSIDE = 0, 1, 2
HELD = 100_000
MARKS = 1 << 22
SALTS = 16
HIT = "struct<kind_order:int,list_order:string,entity_id:string,entity_type:string,label:string,n_wells:bigint>"

_HIT = pa.struct(
    [("kind_order", pa.int32()), ("list_order", pa.string()), ("entity_id", pa.string()),
     ("entity_type", pa.string()), ("label", pa.string()), ("n_wells", pa.int64())]
)
_ANSWER = "struct<entity_type:string,entity_id:string,label:string,n_wells:bigint>"
_LISTED = ("list_order", "entity_id", "entity_type", "label", "n_wells")


def gazetteer(wells: DataFrame) -> DataFrame:
    """Areas and villages with wells behind them, with key and listing order."""
    areas = (
        wells.where(F.col("taluka").isNotNull())
        .groupBy("taluka", "district")
        .agg(F.count(F.lit(1)).alias("n_wells"))
        .select(
            F.lit(0).alias("kind_order"),
            F.lit("taluka").alias("entity_type"),
            F.col("taluka").alias("entity_id"),
            F.concat(F.col("taluka"), F.lit(" Taluka, "), F.coalesce("district", F.lit(""))).alias("label"),
            "n_wells",
            F.concat_ws("|", "taluka", "district").alias("list_order"),
            F.col("taluka").alias("_name"),
        )
    )
    villages = wells.where(F.col("village").isNotNull()).select(
        F.lit(1).alias("kind_order"),
        F.lit("well").alias("entity_type"),
        F.col("well_id").alias("entity_id"),
        F.concat_ws(", ", F.col("village"), F.concat(F.col("taluka"), F.lit(" Taluka")), "district").alias("label"),
        F.lit(1).cast("long").alias("n_wells"),
        F.col("well_id").alias("list_order"),
        F.col("village").alias("_name"),
    )
    both = areas.unionByName(villages)
    return both.withColumn("key", place_key(F.col("_name"))).drop("_name").where(F.col("key") != "")


def _piece_cells(lengths: frozenset[int], marks: bytes | None = None):
    """Texts of an entry's key and how the key holds each: whole, from its start, or further in.

    Given ``marks`` (``asked_marks``), parts of the key that nobody asks for are left out.
    """

    def wanted(text: str) -> bool:
        at = zlib.crc32(text.encode()) % MARKS
        return marks is None or bool(marks[at >> 3] >> (at & 7) & 1)

    def pieces(key: str) -> dict[str, int]:
        found = {t: INSIDE for n in lengths if n < len(key) for i in range(1, len(key) - n + 1) if wanted(t := key[i : i + n])}
        found |= {t: STARTS for n in lengths if n < len(key) and wanted(t := key[:n])}
        return found | {key: WHOLE}

    return pieces


def asked_marks(keys: DataFrame) -> bytes:
    """One bit for each hash of a (key), ``MARKS`` in all: a filter of fixed size that passes every key."""
    at = F.crc32(F.encode("key", "UTF-8")) % MARKS
    words = keys.select(F.floor(at / 32).alias("_word"), (at % 32).cast("int").alias("_bit")).groupBy("_word")
    set_ = words.agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits")).collect()
    marks = bytearray(MARKS // 8)
    for word, bits in set_:
        marks[4 * word : 4 * word + 4] = bits.to_bytes(4, "little")
    return bytes(marks)


def _combined(lengths: frozenset[int], marks: bytes | None = None):
    """Partial index of a task: count and first hits per cell, given out whenever ``HELD`` cells are full."""
    pieces = _piece_cells(lengths, marks)

    def rows(cells: dict) -> pa.RecordBatch:
        keys = list(cells)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.int32()),
                pa.array([c[0] for c in cells.values()], pa.int64()),
                pa.array([[h[1] for h in sorted(c[1])[:SHOWN]] for c in cells.values()], pa.list_(_HIT)),
                pa.array([[h[1] for h in sorted(c[2])[:LISTED]] for c in cells.values()], pa.list_(_HIT)),
            ],
            names=["text", "kind_order", "how", "n", "hits", "leads"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[tuple[str, int, int], list] = {}
        for batch in batches:
            for key, lead, hit in zip(batch["key"].to_pylist(), batch["lead"].to_pylist(), batch["hit"].to_pylist(), strict=True):
                ordered = ((hit["list_order"], hit["entity_id"], hit["label"]), hit)
                for text, how in pieces(key).items():
                    cell = cells.setdefault((text, hit["kind_order"], how), [0, [], []])
                    cell[0] += 1
                    for kept, most, counts in ((cell[1], SHOWN, True), (cell[2], LISTED, lead)):
                        if counts:
                            kept.append(ordered)
                            if len(kept) >= 8 * most:
                                kept.sort()
                                del kept[most:]
                if len(cells) >= HELD:
                    yield rows(cells)
                    cells = {}
        if cells:
            yield rows(cells)

    return run


def first_of(lists: str, n: int) -> Column:
    """The first ``n`` hits of the lists that are aggregated."""
    return F.slice(F.sort_array(F.flatten(F.collect_list(lists))), 1, n).alias(lists)


def place_index(gaz: DataFrame, lengths: Iterable[int], asked: DataFrame | None = None) -> DataFrame:
    """text, kind_order, how, n, hits, leads: what the gazetteer holds of each text.

    A text is a key or a substring of one with one of ``lengths``. Each entry counts
    once per text, as ``WHOLE`` key, ``STARTS`` or ``INSIDE``. ``n`` is the exact number
    of entries, ``hits`` their first ``SHOWN``, ``leads`` the first ``LISTED`` different
    entities. Tasks combine their entries into bounded cells before the shuffle, and
    those of a common text meet in ``SALTS`` parts first, so that no cell ever gathers
    more than a few hits per task. Given the (key) values ``asked``, texts that are
    neither whole keys nor among these are left out, but for few that hash alike.
    """
    first = Window.partitionBy("entity_type", "entity_id")
    lead = F.when(F.col("kind_order") == 0, F.col("list_order") == F.min("list_order").over(first)).otherwise(True)
    entries = gaz.withColumn("lead", lead).select("key", "lead", _hit().alias("hit"))
    marks = None if asked is None else asked_marks(asked)
    cell = ["text", "kind_order", "how"]
    part = f"text string, kind_order int, how int, n long, hits array<{HIT}>, leads array<{HIT}>"
    partial = entries.mapInArrow(_combined(frozenset(lengths), marks), part)
    merged = [F.sum("n").alias("n"), first_of("hits", SHOWN), first_of("leads", LISTED)]
    salted = partial.withColumn("_salt", F.spark_partition_id() % SALTS).groupBy(*cell, "_salt").agg(*merged)
    return salted.groupBy(*cell).agg(*merged)


def _hit() -> Column:
    return F.struct("kind_order", "list_order", "entity_id", "entity_type", "label", "n_wells")


def lengths_of(df: DataFrame, text: str) -> list[int]:
    """The distinct lengths of a text column: as many numbers as its longest text has letters, at most."""
    return [r[0] for r in df.select(F.length(text)).distinct().collect() if r[0]]


def _city(token: Column, cities: dict[str, tuple[str, str]]) -> Column:
    """The city a word names, or null; ``cities`` is a fixed table."""
    if not cities:
        return F.lit(None).cast(_ANSWER)
    named = F.create_map(*(x for k, (eid, label) in cities.items() for x in (F.lit(k), F.struct(F.lit("reservoir").alias("entity_type"), F.lit(eid).alias("entity_id"), F.lit(label).alias("label"), F.lit(None).cast("long").alias("n_wells")))))
    return F.try_element_at(named, token)


def _answer(hit: Column) -> Column:
    return F.struct(*(hit[c].alias(c) for c in ("entity_type", "entity_id", "label", "n_wells")))


def resolve_keys(keys: DataFrame, index: DataFrame, cities: dict[str, tuple[str, str]] = CITY_KEYWORDS) -> DataFrame:
    """key, area, village, city, n_hits, hits for each distinct (key); null where nothing is found.

    Words of a key meet whole gazetteer keys; only keys without such a word and without a
    city are looked up further: as a text that gazetteer keys hold, and by their own
    substrings that are gazetteer keys. Both are equality joins with one index row, and
    the two sets of entries have none in common, so counts add up and first hits merge.
    """
    whole = index.where(F.col("how") == WHOLE)
    words = keys.select("key", F.posexplode(F.split("key", " ")).alias("_pos", "text")).where(F.col("text") != "")
    spoken = words.join(whole, "text", "left").groupBy("key").agg(
        *(F.min(F.when(F.col("kind_order") == kind, F.col("hits")[0])).alias(name) for kind, name in ((0, "area"), (1, "village"))),
        F.min_by(_city(F.col("text"), cities), F.when(_city(F.col("text"), cities).isNotNull(), F.col("_pos"))).alias("city"),
    )
    spoken = cut_lineage(spoken)
    open_ = spoken.where("area IS NULL AND village IS NULL AND city IS NULL").select("key")
    own = open_.select("key", F.col("key").alias("text"), F.lit(True).alias("_itself"))
    sizes = F.array(*(F.lit(n) for n in lengths_of(whole, "text"))).cast("array<int>")
    fits = F.filter(sizes, lambda n: n < F.length("key"))
    each = F.flatten(F.transform(fits, lambda n: F.transform(F.sequence(F.lit(1), F.length("key") - n + 1), lambda i: F.substring(F.col("key"), i, n))))
    pieces = open_.select("key", F.explode(F.array_distinct(each)).alias("text"), F.lit(False).alias("_itself"))
    met = own.unionByName(pieces).join(index, "text").where(F.col("_itself") | (F.col("how") == WHOLE))
    fuzzy = met.groupBy("key").agg(F.sum("n").alias("n_hits"), first_of("hits", CANDIDATES_SHOWN))
    return spoken.join(fuzzy, "key", "left")


def place_keys(requests: DataFrame) -> DataFrame:
    """The different (key) values of a table's ``place`` column."""
    return requests.select(place_key(F.col("place")).alias("key")).where(F.col("key") != "").distinct()


def resolve_places(
    requests: DataFrame, gaz: DataFrame, cities: dict[str, tuple[str, str]] = CITY_KEYWORDS, index: DataFrame | None = None
) -> DataFrame:
    """Resolve a table of (request_id, place, role).

    City keyword first for society roles; then an area whose key is one of the
    words, a village likewise, any city keyword, and substring candidates: one
    is an answer, several are ambiguous (eight shown), none is unresolved.
    Repeated texts are resolved once. ``index`` may be a stored ``place_index`` of the
    gazetteer that holds all substrings.
    """
    asked = requests.withColumns(
        {"key": place_key(F.col("place")), "_urban": F.coalesce(F.col("role").isin(*URBAN_ROLES), F.lit(False))}
    )
    keys = cut_lineage(place_keys(requests))
    if index is None:
        index = cut_lineage(place_index(gaz, lengths_of(keys, "key"), keys))
    found = resolve_keys(keys, index, cities)
    out = asked.join(found, "key", "left")
    answer = (
        F.when(F.col("_urban") & F.col("city").isNotNull(), F.col("city"))
        .when(F.col("area").isNotNull(), _answer(F.col("area")))
        .when(F.col("village").isNotNull(), _answer(F.col("village")))
        .when(F.col("city").isNotNull(), F.col("city"))
        .when(F.col("n_hits") == 1, _answer(F.col("hits")[0]))
    )
    out = out.withColumn("_a", answer)
    several = F.col("_a").isNull() & (F.col("n_hits") > 1)
    status = F.when(F.col("_a").isNotNull(), "ok").when(several, "ambiguous").otherwise("unresolved")
    return out.select(
        *requests.columns, status.alias("status"), F.col("_a.entity_type").alias("entity_type"),
        F.col("_a.entity_id").alias("entity_id"), F.col("_a.label").alias("label"),
        F.when(several, F.col("hits.entity_id")).otherwise(F.array().cast("array<string>")).alias("candidates"),
    )


def typeahead(
    queries: DataFrame, gaz: DataFrame, cities: dict[str, tuple[str, str]] = CITY_KEYWORDS, limit: int = LISTED, index: DataFrame | None = None
) -> DataFrame:
    """Ranked entries for each (query): area prefix, area substring, village prefix, city prefix; at most ``LISTED``."""
    asked = queries.select("query", place_key(F.col("query")).alias("key")).where(F.length("key") >= 2)
    keys = cut_lineage(asked.select("key").distinct())
    if index is None:
        index = place_index(gaz, lengths_of(keys, "key"), keys)
    area = F.col("kind_order") == 0
    rank = F.when(area & (F.col("how") != INSIDE), 0).when(area, 1).when(F.col("how") != INSIDE, 2)
    ranked = lambda h: F.struct(rank.alias("rank"), *(h[c].alias(c) for c in _LISTED))
    listed = keys.join(index.where(rank.isNotNull()), F.col("text") == F.col("key")).select(
        "key", F.transform("leads", ranked).alias("hits")
    )
    rows = [
        F.struct(
            F.lit(3).alias("rank"), F.lit(f"{i:06d}").alias("list_order"), F.lit(eid).alias("entity_id"),
            F.lit("reservoir").alias("entity_type"), F.lit(label).alias("label"), F.lit(None).cast("long").alias("n_wells"),
        )
        for i, (eid, label) in enumerate(cities.values())
    ]
    starting = [F.when(F.lit(name).startswith(F.col("key")), row) for name, row in zip(cities, rows, strict=True)]
    towns = F.array_compact(F.array(*starting)) if starting else F.array()
    ids = F.transform(towns, lambda h: h["entity_id"])
    once = F.filter(towns, lambda h, i: F.array_position(ids, h["entity_id"]) == i + 1)
    kinds = "array<struct<rank:int,list_order:string,entity_id:string,entity_type:string,label:string,n_wells:bigint>>"
    both = listed.select("key", F.col("hits").cast(kinds)).unionByName(keys.select("key", once.cast(kinds).alias("hits")))
    first = both.groupBy("key").agg(first_of("hits", limit)).select("key", F.posexplode("hits").alias("_at", "h"))
    return asked.join(first, "key").select(
        "query", (F.col("_at") + 1).alias("position"), "h.entity_type", "h.entity_id", "h.label", "h.n_wells"
    )
