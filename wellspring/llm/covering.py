"""Near-duplicates by SimHash fingerprints and covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 values of its three-word
shingles. All pairs of fingerprints within ``RADIUS`` differing bits are linked, without
exception: every bit position has a vector of ``RADIUS + 1`` bits, and the mask of each
nonzero vector holds the positions whose product with it is odd. The vectors of at most
``RADIUS`` differing positions have a common orthogonal vector, whose mask holds none of
them, so the pair is equal under it and meets in that table's bucket.

Only distinct fingerprints enter the tables. A bucket of two is decided by SQL; up to
``BUCKET`` fingerprints are searched inside a task, which gives the links of a spanning
forest and never more than members. Larger buckets are covered anew: their
fingerprints agree under the mask, so masks over the other positions split them with
the same guarantee. Every cover halves the open positions, and after ``COVERS`` of them
a bucket can hold no more than 2 ** 8 fingerprints, so the work grows with the members
of a bucket and not with their pairs. Links are joined to components by contraction.

Edges: null, empty and blank texts have fingerprint zero, which is linked like any
other; under three words the whole sequence is the one shingle; repeated rows and ids
each keep their row; null ids are ignored as the smallest id of a component (null if it
has no other); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.llm.components import components
from wellspring.llm.tables import stored

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 1024
COVERS = 3
PIECE = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, piece by piece of about ``PIECE`` bytes."""
    carry: list[bytes] = []
    at, none = 0, True
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            cut = _SPACE.search(text, to)
            to = cut.start() if cut else len(text)
        words = carry + text[at:to].lower().split()
        if len(words) >= size:
            none = False
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            begins = [0, *ends[: -size].tolist()]
            stops = (ends[size - 1 :] - 1).tolist()
            run = xxhash.xxh64_intdigest
            yield np.array([run(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)], "<u8")
        carry = words[-(size - 1) :]
        at = to
    if none and carry:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], "<u8")


def fingerprint(text: bytes) -> int:
    """Bits that are set in more than half of the shingles' hashes."""
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        for at in range(0, len(hashes), PIECE >> 4):
            part = hashes[at : at + (PIECE >> 4)]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.int64)
            total += len(part)
    most = np.packbits(2 * ones > total, bitorder="little")
    return int(most.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch["data"]]
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch["doc_id"], "fp": np.array(found, np.uint64).view(np.int64)}
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("data"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


def cover(agreed: int = 0, radius: int = RADIUS) -> list[int]:
    """Masks that hold ``agreed`` and cover the other positions."""
    open_ = [b for b in range(BITS) if not agreed >> b & 1]
    vectors = (1 << radius + 1) - 1
    return [
        agreed | sum(1 << b for j, b in enumerate(open_) if ((j % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def covers(depth: int, radius: int = RADIUS) -> list[list[int]]:
    """For each mask of the cover before, in order, its own cover."""
    masks = [0]
    for _ in range(depth):
        masks = [m for before in masks for m in cover(before, radius)]
    return [cover(m, radius) for m in masks]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _cells(rows: DataFrame, depth: int, radius: int) -> DataFrame:
    """path, key, fp: each fingerprint in the buckets of all masks of its path's cover."""
    masks = [[_signed(m) for m in part] for part in covers(depth, radius)]
    table = F.array(*(F.array(*(F.lit(m) for m in part)) for part in masks))
    own = F.element_at(table, F.col("path") + 1)
    each = F.transform(own, lambda m, v: F.struct((F.col("path") * len(masks[0]) + v).alias("path"), m.bitwiseAND(F.col("fp")).alias("key")))
    return rows.select("fp", F.inline(each))


def _differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def forest(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the values within ``radius`` bits of each other."""
    left, a, b = values.view(np.uint64), [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(left ^ x) <= radius
        found, left = left[near], left[~near]
        a.append(np.full(len(found), x))
        b.append(found)
        queue.extend(found)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)


def _searched(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [forest(m.values.to_numpy(), radius) for m in batch["members"]]
            if found:
                yield pa.RecordBatch.from_pydict({k: np.concatenate([f[i] for f in found]) for i, k in enumerate("ab")})

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that join all fingerprints (fp) within ``radius`` bits of each other."""
    rows, found = distinct.select("fp", F.lit(0).alias("path")), []
    for depth in range(COVERS):
        cells = _cells(rows, depth, radius)
        key = ["path", "key"]
        sizes = stored(
            cells.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
        )
        found.append(sizes.where((F.col("n") == 2) & (_differing(F.col("a"), F.col("b")) <= radius)).select("a", "b"))
        crowded = stored(cells.join(sizes.where("n > 2").select(*key, "n"), key))
        last = depth + 1 == COVERS
        few = crowded if last else crowded.where(F.col("n") <= bucket)
        searched = few.groupBy(*key).agg(F.collect_list("fp").alias("members")).select("members")
        found.append(searched.mapInArrow(_searched(radius), "a long, b long"))
        if last:
            break
        rows = crowded.where(F.col("n") > bucket).select("fp", "path")
        if rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) of every row."""
    known = stored(fingerprints(docs))
    first = stored(known.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = stored(components(links(first, radius, bucket)))
    joined = first.join(labels, first["fp"] == labels["node"], "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label")
    )
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = stored(joined.join(least, "label").select(F.col("fp").alias("class_fp"), "component_id"))
    return known.join(classes, known["fp"] == classes["class_fp"]).select("doc_id", "fp", "component_id")
