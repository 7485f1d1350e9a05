"""Exact deduplication by composable polynomial fingerprints.

A text's UTF-8 bytes are 16-bit digits of a polynomial modulo two primes near 2**31.
With H over digits, H(ab) = H(a) * B**len(b) + H(b), so the parts of a huge text are
hashed by separate tasks, each shifted by the digits behind it, and simply added up.
Texts with equal fingerprint and length are then compared with the group's candidate
part by part, as rows of a join, so neither a large group nor a huge text meets in one
task. Where a comparison fails (a collision), the texts that differ form the next
round's groups, until all are settled; the result never rests on the hash alone.

Rows are numbered once, in a stored table. Where texts are read again a row is known by
its doc_id and the SHA-256 of its text, so one doc_id may have several texts.

Edges: null counts as the empty text. A repeated row is a document like any other; of
equal texts the largest doc_id stays, a null doc_id only if there is no other, and of
rows that also share that doc_id one carries ``kept``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm import tables

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003, 998_244_353)
PART = 1 << 16
HUGE = 1 << 22
COMPARED = 1 << 20

_SAME = ["h1", "h2", "n_bytes"]


@cache
def _digit_powers(prime: int, base: int) -> np.ndarray:
    """base**(n-1) .. base**0 for the digits of one part."""
    out, x = np.empty(PART // 2, np.int64), 1
    for i in range(len(out) - 1, -1, -1):
        out[i] = x
        x = x * base % prime
    return out


def fingerprint(data: memoryview, prime: int, base: int) -> int:
    """Polynomial of the bytes as little-endian 16-bit digits, an odd last byte as one digit."""
    total = 0
    for at in range(0, len(data), PART):
        part = data[at : at + PART]
        if len(part) % 2:
            part = bytes(part) + b"\0"
        digits = np.frombuffer(part, "<u2").astype(np.int64)
        part_hash = int((digits * _digit_powers(prime, base)[-len(digits) :]).sum()) % prime
        total = (total * pow(base, len(digits), prime) + part_hash) % prime
    return total


def _hash_parts(primes: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [memoryview(x.as_buffer()) for x in batch["part"]]
            behind = batch["behind"].to_pylist()
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("part", "behind")]
            names = [n for n in batch.schema.names if n not in ("part", "behind")]
            for p, b in zip(primes, BASES, strict=True):
                shift = [fingerprint(v, p, b) * pow(b, (k + 1) // 2, p) % p for v, k in zip(views, behind, strict=True)]
                columns.append(pa.array(shift, pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "h1", "h2"])

    return run


def fingerprints(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """doc_id, h1, h2, n_bytes and text_sha256 of every row; texts over ``huge`` bytes in parts."""
    text = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    ).withColumn("n_bytes", F.octet_length("text").cast("long"))
    sha = F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256")
    whole = text.where(F.col("n_bytes") <= huge).select(
        "doc_id", "n_bytes", sha, F.encode("text", "UTF-8").alias("part"), F.lit(0).cast("long").alias("behind")
    )
    schema = "doc_id long, n_bytes long, text_sha256 string"
    small = whole.mapInArrow(_hash_parts(primes), f"{schema}, h1 long, h2 long")
    data = F.encode("text", "UTF-8")
    begin = F.col("i") * F.lit(huge)
    parts = (
        text.where(F.col("n_bytes") > huge)
        .select("*", sha, F.monotonically_increasing_id().alias("row"))
        .select("*", F.explode(F.sequence(F.lit(0), ((F.col("n_bytes") - 1) / huge).cast("int"))).alias("i"))
        .select(
            "row", "doc_id", "n_bytes", "text_sha256",
            F.substring(data, (begin + 1).cast("int"), F.lit(huge)).alias("part"),
            F.greatest(F.col("n_bytes") - begin - huge, F.lit(0)).cast("long").alias("behind"),
        )
        .repartition("row", "behind")
        .mapInArrow(_hash_parts(primes), f"row long, {schema}, h1 long, h2 long")
        .groupBy("row", "doc_id", "n_bytes", "text_sha256")
        .agg(*(F.pmod(F.sum(h), F.lit(p)).alias(h) for h, p in zip(("h1", "h2"), primes, strict=True)))
    )
    return small.select("doc_id", *_SAME, "text_sha256").unionByName(parts.drop("row"))


def _node(doc_id: Column, digest: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), digest)


def _settle(members: DataFrame, text: DataFrame) -> DataFrame:
    """Nodes of ``members`` (node, class key, keep_node) whose text is not that of their keep_node."""
    asked = members.select("node").unionByName(members.select(F.col("keep_node").alias("node"))).distinct()
    begin = F.col("i") * F.lit(COMPARED)
    parts = (
        text.join(asked, "node", "left_semi")
        .select(
            "node", F.encode("text", "UTF-8").alias("data"),
            F.explode(F.sequence(F.lit(0), (F.octet_length("text") / COMPARED).cast("int"))).alias("i"),
        )
        .groupBy("node", "i")
        .agg(F.first(F.substring("data", (begin + 1).cast("int"), F.lit(COMPARED))).alias("part"))
    )
    parts = tables.stored(parts)
    kept = parts.select(F.col("node").alias("keep_node"), "i", F.col("part").alias("kept_part"))
    return (
        members.join(parts, "node")
        .join(kept, ["keep_node", "i"], "left")
        .where(~F.col("part").eqNullSafe(F.col("kept_part")))
        .select("node")
        .distinct()
    )


def _candidates(known: DataFrame, key: list[str]) -> DataFrame:
    """Size and candidate of each group, stored, so that a join can split a large group's rows."""
    first = F.max(F.struct("doc_id", (-F.col("row")).alias("back"), "node")).alias("keep")
    found = known.groupBy(*key).agg(F.count(F.lit(1)).alias("group_size"), first)
    return tables.stored(
        found.select(*key, "group_size", F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.back")).alias("keep_row"), F.col("keep.node").alias("keep_node"))
    )


def _differing(settled: DataFrame, text: DataFrame) -> DataFrame:
    open_ = settled.where("node != keep_node").select("node", "keep_node").distinct()
    return tables.stored(_settle(open_, text))


def exact_duplicates(docs: DataFrame, primes: tuple[int, int] = PRIMES, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and the fingerprint, one row per document."""
    found = fingerprints(docs, primes, huge)
    known = tables.stored(
        found.withColumns({"row": F.monotonically_increasing_id(), "node": _node(F.col("doc_id"), F.col("text_sha256"))})
    )
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.encode(whole, "UTF-8"), 256)
    text = docs.select(_node(F.col("doc_id").cast("long"), digest).alias("node"), whole.alias("text"))
    settled = known.join(_candidates(known, _SAME), _SAME)
    differ = _differing(settled, text)
    if not differ.isEmpty():
        settled = _split(known, text, differ)
    return settled.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", *_SAME
    )


def _split(known: DataFrame, text: DataFrame, differ: DataFrame) -> DataFrame:
    """Classes where fingerprints collide: who differs from a candidate forms the next round's groups."""
    classes, round_ = None, 0
    todo = known
    while True:
        now = todo.join(differ.withColumn("out", F.lit(True)), "node", "left")
        done = now.where(F.col("out").isNull()).drop("out").withColumn("round", F.lit(round_))
        classes = done if classes is None else classes.unionByName(done)
        todo = tables.stored(now.where("out").drop("out"))
        if todo.isEmpty():
            break
        round_ += 1
        differ = _differing(todo.join(_candidates(todo, _SAME), _SAME), text)
    classes = tables.stored(classes)
    key = [*_SAME, "round"]
    return classes.join(_candidates(classes, key), key)
