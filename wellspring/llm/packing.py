"""Packing of tokenised documents into sequences of a fixed number of tokens.

Documents are dealt at random (by a hash) into groups of bounded size, each packed on
its own: a document's full stretches of ``capacity`` tokens are sequences by
themselves, and what remains of it is placed first-fit decreasing. A tournament tree
over the open sequences holds the largest free room of each subtree, so the first
sequence with room is found by one walk from the root.

Words repeat far more often than texts, so each distinct word of a group is tokenised
once and its ids are copied. This is exact, as the tokenizer's pieces never cross the
white space that parts words.

Edges: a null or empty text is the end token alone; equal rows are packed one by one;
rows of one doc_id are dealt by their texts too; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import tables
from wellspring.llm.words import slices, text_bytes

CAPACITY = 4096
END_ID = 2
GROUP_BYTES = 2 << 20
KEPT_WORDS = 1_000_000

PIECES = (
    "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class RoomTree:
    """A tournament tree: leaves are sequences, an inner node holds the largest room below it."""

    def __init__(self, leaves: int, capacity: int) -> None:
        self.half = 1 << max(0, (leaves - 1).bit_length())
        self.room = [capacity] * (2 * self.half)

    def place(self, length: int) -> tuple[int, int]:
        """The first leaf with this much room, and the room it had before."""
        room, at = self.room, 1
        while at < self.half:
            at *= 2
            if room[at] < length:
                at += 1
        had = room[at]
        room[at] = had - length
        leaf = at - self.half
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return leaf, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; equal lengths keep their order."""
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    tree = RoomTree(max(1, len(lengths)), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        leaf, had = tree.place(int(lengths[i]))
        sequence[i], offset[i] = leaf, capacity - had
    return sequence, offset


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@cache
def _known(path: str) -> dict[str, bytes]:
    return {"": b""}


def _base(word: str) -> tuple[str, str]:
    """A word in lower case and its last full stop or comma, which the tokenizer parts anyway.

    Words that could hold a special token's name stay as they are.
    """
    if word.isascii() and "<|" not in word:
        word = word.lower()
    if len(word) > 1 and word[-1] in ".," and word[-2].isalnum():
        return word[:-1], word[-1]
    return word, ""


def _ids_of(words: list[str], path: str) -> list[bytes]:
    """Token ids of each word as little-endian 32-bit numbers, from words seen lately where possible."""
    known = _known(path)
    bases = [_base(w) for w in words]
    new = list({w for pair in bases for w in pair if w and w not in known})
    if len(known) + len(new) > KEPT_WORDS:
        known.clear()
        known[""] = b""
        new = list({w for pair in bases for w in pair if w})
    fresh = _tokenizer(path).encode_batch_fast(new, add_special_tokens=False)
    known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, fresh, strict=True))
    return [known[w] + known[tail] if tail else known[w] for w, tail in bases]


def tokenise(texts: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """Ids of each text with the end id, exactly those of the tokenizer over the whole text."""
    _, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.slice(a, b - a), ""))
        per_text = split.value_lengths().to_numpy(zero_copy_only=False)
        coded = split.flatten().dictionary_encode()
        ids = _ids_of(coded.dictionary.to_pylist(), path)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        begin = np.cumsum(size) - size
        word = coded.indices.to_numpy()
        n = size[word]
        to = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.arange(to[-1]) - np.repeat(to[:-1] - begin[word], n)]
        ends = to[np.concatenate([[0], np.cumsum(per_text)])]
        for i in range(b - a):
            yield np.append(out[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")


def _pack_group(t: pa.Table, path: str, capacity: int, end_id: int, with_ids: bool) -> pa.Table:
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    g, n_groups = t["g"][0].as_py(), t["n_groups"][0].as_py()
    rows, blobs, crcs, doc_tokens = [], [], [], []
    for i, ids in enumerate(tokenise(t["text"].combine_chunks(), path, end_id)):
        for start in range(0, len(ids), capacity):
            piece = ids[start : start + capacity]
            rows.append((i, start, len(piece)))
            doc_tokens.append(len(ids))
            crcs.append(zlib.crc32(piece))
            if with_ids:
                blobs.append(piece.tobytes())
    doc, start, length = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    whole = length == capacity
    sequence, offset = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
    sequence[whole] = np.arange(whole.sum())
    sequence[~whole], offset[~whole] = first_fit_decreasing(length[~whole], capacity)
    sequence[~whole] += whole.sum()
    return pa.table(
        {
            "doc_id": t["doc_id"].take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids": pa.array(blobs if with_ids else [None] * len(rows), pa.binary()),
            "ids_crc32": np.array(crcs, np.int64),
            "doc_tokens": np.array(doc_tokens, np.int64),
            "sequence_id": sequence * n_groups + g,
            "offset": offset,
        }
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents with their place: sequence_id and offset; padding fills up each sequence.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers (null without
    ``with_ids``), ``ids_crc32`` their checksum.
    """
    n_groups = 1 + tables.total_bytes(docs, "text") // GROUP_BYTES
    return (
        docs.select(
            F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).alias("g"),
            F.lit(n_groups).cast("long").alias("n_groups"), F.col("doc_id").cast("long"), "text",
        )
        .groupBy("g")
        .applyInArrow(lambda t: _pack_group(t, tokenizer_path, capacity, end_id, with_ids), PIECES)
    )
