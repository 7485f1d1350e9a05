"""Removal of repeated passages: fixed-block anchors and maximal exact repeats.

Every text is cut into blocks of ``window // 2`` words, the reference blocks. Any
window of ``window`` words holds a whole block of its text, and the same words
elsewhere hold the same block at any offset; so a window can only repeat if it holds
a block-sized run of words that is a reference block somewhere and occurs elsewhere.

1. *Anchors*: each group of documents sends the hash of every rolling run once, with
   the flags "is a reference block" and "occurs more than once here", as compressed
   byte planes to the task of its hash range. There the runs that are a block and occur
   twice are found and sent back to the groups that hold them.
2. *Extension*: windows that hold an anchor are hashed (96 bits). Each group sends its
   earliest place of each window; the task of the hash range tells all groups but the
   earliest one that the window starts earlier elsewhere. Adjoining repeated windows
   make up the maximal repeats, which are removed.

A group sends each hash once, however often it occurs, so that a passage shared by a
third of all documents costs one entry per group. No pairs of documents are made.
The three passes over the texts read one shuffle of them (a reused exchange).

Edges: a null text has no words; rows of one doc_id are ordered by text, then taken as
they come; null doc_ids come last; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import tables
from wellspring.llm.words import Words, from_planes, planes, rolling, slices, text_bytes, within, words_of

WINDOW = 20
GROUP_BYTES = 4 << 20
RANGE_ENTRIES = 2_000_000
ANCHOR_BITS = 46
LAST = np.iinfo(np.int64).max

REMOVED = "doc_id long, n_words long, n_removed long, repeats array<struct<start:long,end:long>>, kept_text string"


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document its words without those covered by a window seen earlier.

    ``repeats`` are the removed maximal spans of words, ``kept_text`` the other words
    joined by one space. Earlier means a smaller doc_id, or an earlier start in the
    same document.
    """
    spark = docs.sparkSession
    width = tables.shuffle_width(spark)
    size = tables.total_bytes(docs, "text")
    n_groups = max(2 * width, size // GROUP_BYTES)
    range_bits = (max(2, width, size // 5 // RANGE_ENTRIES) - 1).bit_length()
    grouped = docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(n_groups)).alias("g"), F.col("doc_id").cast("long"), F.col("text")
    ).groupBy("g")
    sent = grouped.applyInArrow(lambda t: _send_anchors(t, window // 2, range_bits), "p int, g long, runs binary")
    anchors = sent.groupBy("p").applyInArrow(_find_anchors, "g long, runs binary")
    windows = grouped.cogroup(anchors.groupBy("g")).applyInArrow(
        lambda t, a: _send_windows(t, a, window, range_bits), "p int, g long, hashes binary, checks binary, ids binary"
    )
    later = windows.groupBy("p").applyInArrow(_find_later, "g long, hashes binary")
    return grouped.cogroup(later.groupBy("g")).applyInArrow(lambda t, a: _remove(t, a, window), REMOVED)


def _texts(t: pa.Table) -> tuple[int, np.ndarray, pa.ChunkedArray]:
    """Group, doc_ids and texts in the order that makes a place earlier."""
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = t["doc_id"].fill_null(LAST).to_numpy()
    return t["g"][0].as_py() if len(t) else 0, ids, t["text"]


def _words(texts: pa.ChunkedArray) -> Words:
    """Words of a whole group, hashed slice by slice."""
    data, offsets = text_bytes(texts)
    parts, first, n = [], [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets):
        w = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        parts.append(w.hashes)
        first.append(w.first[1:] + n)
        n += len(w.hashes)
    none = np.empty(0, np.int64)
    return Words(none, none, np.concatenate(parts) if parts else np.empty(0, np.uint64), np.concatenate(first))


def _ranges(sorted_values: np.ndarray, bits: int, range_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges that hold some of the sorted values of ``bits`` bits, and where each begins (and the last ends).

    A range is the leading ``range_bits`` of a value, so the work follows the values and
    not the number of ranges.
    """
    part = sorted_values >> np.uint64(bits - range_bits)
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.empty(0, np.int64)
    return part[begin].astype(np.int32), np.append(begin, len(part))


def _send_anchors(t: pa.Table, block: int, range_bits: int) -> pa.Table:
    g, _, texts = _texts(t)
    w = _words(texts)
    at = np.flatnonzero(within(w, block))
    if not len(at):
        return pa.schema([("p", pa.int32()), ("g", pa.int64()), ("runs", pa.binary())]).empty_table()
    value = rolling(w.hashes, block)[at] >> np.uint64(64 - ANCHOR_BITS)
    is_block = (at - np.repeat(w.first[:-1], np.diff(w.first))[at]) % block == 0
    value = np.sort((value << np.uint64(1)) | is_block.astype(np.uint64))
    runs = value >> np.uint64(1)
    new = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    last = np.append(new[1:], len(runs)) - 1
    flags = (value[last] & np.uint64(1)) | ((last > new).astype(np.uint64) << np.uint64(1))
    runs = runs[new]
    packed = (runs << np.uint64(2)) | flags
    ranges, cuts = _ranges(runs, ANCHOR_BITS, range_bits)
    return pa.table(
        {
            "p": pa.array(ranges),
            "g": pa.array(np.full(len(ranges), g)),
            "runs": pa.array([planes(packed[a:b], 6) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def _find_anchors(t: pa.Table) -> pa.Table:
    blobs = [from_planes(b, 6) for b in t["runs"].to_pylist()]
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) for b in blobs])
    packed = np.concatenate(blobs)
    order = np.argsort(packed, kind="stable")
    packed, owner = packed[order], owner[order]
    runs = packed >> np.uint64(2)
    new = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
    flags = np.bitwise_or.reduceat(packed & np.uint64(3), new)
    count = np.diff(np.append(new, len(runs)))
    hit = np.repeat(((flags & np.uint64(1)) > 0) & ((count > 1) | (flags > 1)), count)
    return _back(t, runs[hit], owner[hit], 6)


def _back(t: pa.Table, values: np.ndarray, owner: np.ndarray, width: int) -> pa.Table:
    """Values for each blob's sender, in ascending order."""
    order = np.argsort(owner, kind="stable")
    values, owner = values[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(t) + 1))
    full = np.flatnonzero(np.diff(cuts))
    blobs = pa.array([planes(values[cuts[i] : cuts[i + 1]], width) for i in full], pa.binary())
    return pa.table({"g": t["g"].take(pa.array(full)), t.column_names[2]: blobs})


def _answers(t: pa.Table, column: str, width: int) -> np.ndarray:
    blobs = [from_planes(b, width) for b in t[column].to_pylist()]
    return np.sort(np.concatenate(blobs)) if blobs else np.empty(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _send_windows(t: pa.Table, answers: pa.Table, window: int, range_bits: int) -> pa.Table:
    empty = {"p": pa.int32(), "g": pa.int64(), "hashes": pa.binary(), "checks": pa.binary(), "ids": pa.binary()}
    known = _answers(answers, "runs", 6)
    if not len(known) or not len(t):
        return pa.schema(empty.items()).empty_table()
    g, ids, texts = _texts(t)
    w = _words(texts)
    block = window // 2
    anchor = _among(rolling(w.hashes, block) >> np.uint64(64 - ANCHOR_BITS), known) & within(w, block)
    total = np.concatenate([[0], np.cumsum(anchor)])
    ok = within(w, window)
    at = np.flatnonzero(ok & (total[window - block + 1 :][: len(ok)] > total[: len(ok)]))
    hashes = rolling(w.hashes, window)[at]
    hashes, where = np.unique(hashes, return_index=True)
    checks = rolling(w.hashes, window, seed=1)[at][where] >> np.uint64(32)
    docs = ids[w.doc()[at][where]].astype(np.int64).view(np.uint64)
    ranges, cuts = _ranges(hashes, 64, range_bits)
    blob = lambda values, width: pa.array([planes(values[a:b], width) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())
    return pa.table(
        {
            "p": pa.array(ranges),
            "g": pa.array(np.full(len(ranges), g)),
            "hashes": blob(hashes, 8),
            "checks": blob(checks, 4),
            "ids": blob(docs, 8),
        }
    )


def _find_later(t: pa.Table) -> pa.Table:
    part = lambda name, width: [from_planes(b, width) for b in t[name].to_pylist()]
    blobs = part("hashes", 8)
    owner = np.repeat(np.arange(len(blobs), dtype=np.int32), [len(b) for b in blobs])
    hashes, checks = np.concatenate(blobs), np.concatenate(part("checks", 4))
    docs = np.concatenate(part("ids", 8)).view(np.int64)
    order = np.lexsort((docs, checks, hashes))
    hashes, checks, owner = hashes[order], checks[order], owner[order]
    later = np.zeros(len(hashes), bool)
    later[1:] = (hashes[1:] == hashes[:-1]) & (checks[1:] == checks[:-1])
    return _back(t.select(["p", "g", "hashes"]), hashes[later], owner[later], 8)


def _remove(t: pa.Table, answers: pa.Table, window: int) -> pa.Table:
    _, _, texts = _texts(t)
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    known = _answers(answers, "hashes", 8)
    w = _words(texts)
    ok = np.flatnonzero(within(w, window))
    hashes = rolling(w.hashes, window)[ok]
    gone = _among(hashes, known)
    order = np.argsort(hashes, kind="stable")
    again = np.zeros(len(order), bool)
    again[1:] = hashes[order][1:] == hashes[order][:-1]
    gone[order] |= again
    edge = np.zeros(len(w.hashes) + 1, np.int64)
    edge[ok[gone]] += 1
    edge[ok[gone] + window] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    n_removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first])
    kept, spans = [], []
    for i, text in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        parts = (text.as_py() or "").encode().split()
        if n_removed[i]:
            cover = covered[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]])))
            spans.append([{"start": int(s), "end": int(e)} for s, e in turn.reshape(-1, 2)])
            parts = [parts[j] for j in np.flatnonzero(~cover)]
        else:
            spans.append([])
        kept.append(b" ".join(parts).decode())
    return pa.table(
        {
            "doc_id": t["doc_id"],
            "n_words": pa.array(np.diff(w.first)),
            "n_removed": pa.array(n_removed),
            "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            "kept_text": pa.array(kept, pa.string()),
        }
    )
