"""Words of Arrow text columns as numpy arrays: spans, hashes and rolling hashes.

All hashes are 64-bit polynomials modulo 2**64 over mixed values. Work is done on
slices of whole texts of about ``SLICE`` bytes, so that memory stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21
BASE = 0x9E3779B97F4A7C15
ROLL = 0xD6E8FEB86659FD93
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def spaces() -> np.ndarray:
    """Flags of the bytes that separate words: 0x20 and 0x09 to 0x0D."""
    out = np.zeros(256, bool)
    out[[0x20, *range(0x09, 0x0E)]] = True
    return out


@cache
def separators() -> np.ndarray:
    """Flags of all ASCII bytes that are neither letters nor digits."""
    out = np.ones(256, bool)
    out[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return out


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


@cache
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, (int(n) - 1).bit_length())
    return _powers(size, base)[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole texts of about ``size`` bytes; a longer text is a run of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


@dataclass
class Words:
    """Words of a run of texts: byte spans, hashes, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def doc_end(self) -> np.ndarray:
        """For each word the index behind the last word of its text."""
        return np.repeat(self.first[1:], np.diff(self.first))

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def lowered(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII letters and of the two-byte letters U+00C0 to U+00DE."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        second = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][second] += 0x20
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray | None = None) -> Words:
    """Words between bytes flagged in ``apart`` (white space); none crosses two texts.

    Instead of flags ``apart`` may hold a kind for each byte, 0 for none; then a word is
    a run of bytes of one kind.
    """
    apart = spaces() if apart is None else apart
    kind = (~apart).view(np.uint8)[data] if apart.dtype == bool else apart[data]
    inside = kind > 0
    n = len(data)
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    before[1:] = after[:-1] = kind[1:] == kind[:-1]
    full = np.flatnonzero(np.diff(offsets) > 0)
    before[offsets[full]] = False
    after[offsets[full + 1] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, offsets)
    return Words(starts, ends, _hashes(data, inside, starts, ends), first)


def _hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + SLICE, "right")))
        hi = ends[to - 1]
        if to == at + 1 and hi - lo > SLICE:
            out[at] = _long_word(data[lo:hi])
        else:
            value = _byte_values()[data[lo:hi]] * powers(hi - lo, BASE)
            value[~inside[lo:hi]] = 0
            local = starts[at:to] - lo
            out[at:to] = np.add.reduceat(value, local) * powers(hi - lo, inverse(BASE))[local]
        at = to
    return mix(out)


def _long_word(data: np.ndarray) -> int:
    total = 0
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE]
        value = int((_byte_values()[part] * powers(len(part), BASE)).sum(dtype=np.uint64))
        total = (total + value * pow(BASE, at, 1 << 64)) & MASK
    return total


def rolling(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of the k words from each word on; the last k - 1 places have none."""
    n = len(hashes)
    if n < k:
        return np.empty(0, np.uint64)
    values = mix(hashes + np.uint64((seed * 2 + 1) * BASE & MASK)) if seed else hashes
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * powers(n, ROLL), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(n, inverse(ROLL))[: n - k + 1])


def within(words: Words, k: int) -> np.ndarray:
    """For each window of ``rolling`` whether it lies in one text."""
    return (np.arange(len(words.hashes)) + k <= words.doc_end())[: max(0, len(words.hashes) - k + 1)]


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of sorted values, byte by byte: equal high bytes compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(blob: bytes, width: int) -> np.ndarray:
    part = np.frombuffer(blob, np.uint8).reshape(width, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :width] = part.T
    return out.reshape(-1).view("<u8")
