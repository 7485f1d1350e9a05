"""Chat formatting: columnar assembly of conversations into one text with a loss mask.

A turn is ``### Role: `` + text + ``</turn>`` and a line feed. Inside texts a
backslash, every ``##`` and every ``</turn>`` get a backslash, so that no text can
fake a header or an end, and the escape can be undone.

Rows are range-partitioned by conversation and turn, so one conversation with a third
of all rows is formatted by many tasks; each run of rows of one conversation becomes a
piece. A piece is made without touching single texts: lengths of all segments, their
running sum and the scatter indices are numpy arrays, and headers and contents are
copied into one preallocated buffer that Arrow takes over.

Edges: null text and null role count as empty; turns are ordered by turn (null first),
then role and text, and equal rows each make a turn; other roles than user, assistant
and system are written escaped behind ``=``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import tables
from wellspring.llm.words import SLICE, slices, text_bytes

END = "</turn>\n"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
TRAINED = "assistant"

PIECE = (
    "conv_id long, first_turn long, last_role string, piece int, n_turns long, formatted string,"
    " loss array<struct<start:long,end:long>>"
)


def escape(texts: pa.Array) -> pa.Array:
    for plain, safe in (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")):
        texts = pc.replace_substring(texts, plain, safe)
    return texts


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _headers(roles: pa.Array) -> pa.Array:
    coded = roles.dictionary_encode()
    other = pc.replace_substring(escape(coded.dictionary), ":", "\\:").to_pylist()
    plain = coded.dictionary.to_pylist()
    label = [NAMES.get(r, f"={o}") for r, o in zip(plain, other, strict=True)]
    return pa.array([f"### {x}: " for x in label], pa.string()).take(coded.indices)


def assemble(headers: pa.Array, contents: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all turns in order, the offset of each turn, and of each content."""
    tail = np.frombuffer(END.encode(), np.uint8)
    parts = [text_bytes(headers), text_bytes(contents), (np.tile(tail, len(headers)), np.arange(len(headers) + 1) * len(tail))]
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], axis=1)
    at = np.concatenate([[0], np.cumsum(lengths.ravel())])
    out = np.empty(at[-1], np.uint8)
    for k, (data, offsets) in enumerate(parts):
        shift = at[:-1].reshape(-1, len(parts))[:, k] - offsets[:-1]
        out[np.arange(len(data)) + np.repeat(shift, lengths[:, k])] = data
    return out, at[:: len(parts)], at[1 :: len(parts)]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows of a partition, which come sorted."""
    piece = 0
    for batch in batches:
        contents = escape(pc.fill_null(batch["text"], ""))
        roles = pc.fill_null(batch["role"], "")
        _, sizes = text_bytes(contents)
        for a, b in slices(sizes, 4 * SLICE):
            rows = slice(a, b)
            n = b - a
            data, turns, starts = assemble(_headers(roles.slice(a, n)), contents.slice(a, n))
            conv = batch["conv_id"].slice(a, n).fill_null(np.iinfo(np.int64).min).to_numpy()
            first = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            to = np.append(first[1:], n)
            trained = pc.equal(roles.slice(a, n), TRAINED).to_numpy(zero_copy_only=False)
            ends = turns[1:] - len(END)
            loss = [
                [{"start": int(starts[i] - turns[f]), "end": int(ends[i] - turns[f])} for i in range(f, t) if trained[i]]
                for f, t in zip(first, to, strict=True)
            ]
            offsets = np.append(turns[first], turns[-1]).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))
            yield pa.RecordBatch.from_pydict(
                {
                    "conv_id": batch["conv_id"].slice(a, n).take(pa.array(first)),
                    "first_turn": batch["turn"].slice(a, n).take(pa.array(first)),
                    "last_role": roles.slice(a, n).take(pa.array(to - 1)),
                    "piece": pa.array(np.arange(piece, piece + len(first)), pa.int32()),
                    "n_turns": to - first,
                    "formatted": text.cast(pa.string()),
                    "loss": pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                }
            )
            piece += len(first)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Formatted pieces of each conversation in order of (part, piece), with the loss mask as byte spans.

    A conversation is one piece unless a partition or batch ends inside it.
    """
    width = tables.shuffle_width(turns.sparkSession)
    key = ["conv_id", "turn", "role", "text"]
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    dealt = rows.repartitionByRange(width, *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(_format, PIECE).withColumn("part", F.spark_partition_id())


def _turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read back from the formatted text."""
    back = {v: k for k, v in NAMES.items()}
    for turn in formatted.split(END)[:-1]:
        label, text = re.match(r"### ((?:\\.|[^\\:])*): (.*)", turn, re.S).groups()
        yield (unescape(label[1:]) if label.startswith("=") else back[label]), unescape(text)


class _Digest:
    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        for role, text in _turns(formatted):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        data = formatted.encode()
        for span in loss:
            text = unescape(data[span["start"] : span["end"]].decode())
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, conv: int | None) -> tuple:
        return conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(zip(names, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True))
    conv, digest = None, None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if digest is None or row["conv_id"] != conv:
                if digest:
                    rows.append(digest.row(conv))
                conv, digest = row["conv_id"], _Digest()
            digest.add(row["formatted"], row["loss"])
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
    if digest:
        yield pa.RecordBatch.from_pylist([dict(zip(names, digest.row(conv), strict=True))], schema)


def digests(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces hold, read back in order; a hash runs along its whole conversation.

    Pieces stream through, so a task never holds a conversation as a whole.
    """
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.select("conv_id", "formatted", "loss").mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
