"""Benchmark decontamination by latent semantic retrieval and alignment checks.

1. Inverse document frequencies of hashed words over all documents.
2. Benchmark items are cut into passages; their TF-IDF vectors are the rows of a sparse
   matrix. A randomised SVD (random range, one power step) gives the latent space: the
   products with the matrix are sums over passages, made by the tasks that hold them and
   added up; only matrices of bounded size (words of a part x rank) reach the driver.
   The rank is the least that keeps ``KEPT`` of the norm of each passage, so unrelated
   passages do not crowd each other out and related ones share directions.
3. Every window of every document (overlapping by five sixths, for each passage length in use) is
   projected and compared with all passages. A candidate is a window whose latent cosine is at
   least ``COSINE``, or whose TF-IDF cosine may be: that is at most the product of the
   projections plus the product of what the projections leave over of window and passage.
   What of a window lies on other words than the benchmark's is at right angles to all
   passages, so windows with less than ``COSINE**2`` of their squared weight on benchmark
   words are left out before the projection.
4. A candidate counts if the longest common subsequence of its words with the item,
   searched in the window and its surroundings, covers ``COVERED`` of the item, and if the
   item's answer is found there too to the same degree. The answer is the column
   ``answer``; where that is absent or null it is the item's last sentence, and then a
   place that covers ``SURE`` of the item counts without it.

Documents are never shuffled. Equal items are searched once. Items are dealt by hash into
bins of about ``PASSAGES`` passages, and the passages of a bin are cut into parts of at
most that many: a long item spreads over parts. ``PARTS`` of them make a pass over the
documents, so what is broadcast does not grow with the number of items, only with the
longest one; one more pass counts words. Running sums are held for ``SLAB`` blocks of
words at a time, whatever a text's length, and subsequences for ``STRIP`` words of an item.

Edges: null and empty texts and items never match; each pair of a doc_id and an item_id is
reported once, with its best place, however many rows share them (null ids too); equal
items each report; an item of under ``LEAST_WORDS`` words must occur whole; an empty
benchmark or table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm import tables
from wellspring.llm.words import Words, lowered, separators, slices, text_bytes, words_of

BITS = 18
OVERSAMPLED = 16
PASSAGES = 256
PARTS = 8
KEPT = 0.9
BLOCK = 4
SLAB = 1 << 14
STRIP = 8192
PASSAGE = 48
COSINE = 0.55
COVERED = 0.6
SURE = 0.8
LEAST_WORDS = 8
FOUND = "doc_id long, key string, cosine double, covered double, first_word long, last_word long"
HITS = FOUND.replace("key string", "item_id long")
SCHEMA = pa.schema(
    {"doc_id": pa.int64(), "key": pa.string(), "cosine": pa.float64(), "covered": pa.float64(), "first_word": pa.int64(), "last_word": pa.int64()}
)
NAMES = SCHEMA.names
Span = tuple[tuple[str, int], tuple[str, int]]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    w = words_of(lowered(data), offsets, separators())
    return w, (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(1 << BITS, np.int64), 0
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        n += len(batch)
        for a, b in slices(offsets):
            w, bucket = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            seen = np.sort((w.doc() << BITS) | bucket)
            seen = seen[np.concatenate([[True], seen[1:] != seen[:-1]])] if len(seen) else seen
            total += np.bincount(seen & ((1 << BITS) - 1), minlength=1 << BITS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array(np.append(used, -1).astype(np.int32)), "n": np.append(total[used], n)}
    )


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + documents) / (1 + documents with the word)) + a little, per hash bucket."""
    counts = docs.select("text").mapInArrow(_frequencies, "bucket int, n long")
    counts = counts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts["bucket"].to_numpy(), counts["n"].to_numpy()
    total = int(n[bucket < 0].sum())
    seen = np.zeros(1 << BITS)
    seen[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log((1 + total) / (1 + seen)) + 0.05


def _passages(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item, first word, buckets, weights) of each passage; a weight is the unit-length TF-IDF value."""
    data, offsets = text_bytes(texts)
    w, bucket = _words(data, offsets)
    for i in range(len(texts)):
        a, b = w.first[i], w.first[i + 1]
        for start in range(a, b, PASSAGE):
            start = max(a, min(start, b - PASSAGE))
            x, n = np.unique(bucket[start : min(start + PASSAGE, b)], return_counts=True)
            value = n * idf[x]
            yield i, start - a, x, value / np.linalg.norm(value)


def _n_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        n = np.diff(_words(data, offsets)[0].first)
        yield pa.RecordBatch.from_pydict({"n": pa.array([int((-(-n // PASSAGE)).sum())], pa.int64())})


def _product(idf, row_of, basis, span: Span):
    """A' (A basis) over a task's passages from one (key, first word) to another, as one dense block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(basis.value.shape)
        for batch in batches:
            keys = batch["key"].to_pylist()
            for i, start, x, value in _passages(batch["text"], idf.value):
                if not span[0] <= (keys[i], start) <= span[1]:
                    continue
                rows = row_of.value[x]
                out[rows] += value[:, None] * (value @ basis.value[rows])
        used = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(used.astype(np.int32)), "row": pa.array(list(out[used]), pa.list_(pa.float64()))}
        )

    return run


def latent_basis(items: DataFrame, idf, row_of, n_rows: int, rank: int, span: Span) -> np.ndarray:
    """An orthonormal basis (words x rank) of the passages' main directions: randomised SVD.

    ``row_of`` numbers the hash buckets of the part's words; both are broadcasts.
    A rank of at least the number of passages gives a basis of all of their span.
    """
    context = items.sparkSession.sparkContext
    basis = np.random.default_rng(20).standard_normal((n_rows, rank + OVERSAMPLED))
    for _ in range(2):
        given = context.broadcast(basis)
        parts = items.select("key", "text").mapInArrow(_product(idf, row_of, given, span), "word int, row array<double>")
        cells = parts.select("word", F.posexplode("row").alias("c", "x")).groupBy("word", "c").agg(F.sum("x").alias("x"))
        cells = cells.toArrow()
        got = np.zeros_like(basis)
        got[cells["word"].to_numpy(), cells["c"].to_numpy()] = cells["x"].to_numpy()
        given.unpersist()
        basis, lengths, _ = np.linalg.svd(got, full_matrices=False)
    return basis[:, : min(rank, int((lengths > 1e-9 * lengths.max(initial=1e-300)).sum()))]


@dataclass
class Index:
    """A part of the benchmark's passages in latent space, with the items' words."""

    idf: np.ndarray
    row_of: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    kept: np.ndarray
    item: np.ndarray
    start: np.ndarray
    told: Items
    lengths: list[int]


@dataclass
class Items:
    """Keys, words, answers' words, and whether an answer was given, by item."""

    keys: list
    words: list[np.ndarray]
    answers: list[np.ndarray]
    given: list[bool]


def _told(block: pa.Table) -> Items:
    answers = block["answer"].to_pylist() if "answer" in block.column_names else [None] * len(block)
    keys = block["key" if "key" in block.column_names else "item_id"].to_pylist()
    out = Items(keys, [], [], [bool(x) for x in answers])
    for text, answer in zip(block["text"].to_pylist(), answers, strict=True):
        text = text or ""
        last = answer or text.strip().rstrip(".!?").replace("\n", " ").split(". ")[-1]
        for x, to in ((text, out.words), (last, out.answers)):
            data = np.frombuffer(x.encode(), np.uint8)
            to.append(words_of(lowered(data), np.array([0, len(data)]), separators()).hashes)
    return out


def _projected(found: list, row_of: np.ndarray, basis: np.ndarray) -> np.ndarray:
    return np.array([value @ basis[row_of[x]] for _, _, x, value in found]).reshape(len(found), basis.shape[1])


def least_rank(vectors: np.ndarray, share: float = KEPT) -> int:
    """How many leading directions keep ``share`` of the norm of each unit row; all of them if none do."""
    enough = (np.sqrt(np.cumsum(vectors**2, axis=1)) >= share).all(axis=0)
    return int(np.argmax(enough)) + 1 if enough.any() else vectors.shape[1]


def build_index(
    block: pa.Table, idf: np.ndarray, row_of: np.ndarray, basis: np.ndarray, idf32: np.ndarray,
    found: list | None = None, told: Items | None = None,
) -> Index:
    """Passages (of all items, or those given) in the latent space of ``basis``, which must keep ``KEPT`` of each one's norm."""
    found = list(_passages(block["text"].combine_chunks(), idf)) if found is None else found
    told = told or _told(block)
    vectors = _projected(found, row_of, basis)
    kept = np.linalg.norm(vectors, axis=1, keepdims=True)
    if kept.min(initial=1.0) < KEPT:
        raise ValueError(f"a passage keeps only {kept.min():.2f} of its norm in {basis.shape[1]} directions")
    return Index(
        idf32, row_of, basis.astype(np.float32), (vectors / kept).astype(np.float32).T, np.minimum(kept[:, 0], 1).astype(np.float32),
        np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64),
        told, sorted({min(PASSAGE, len(told.words[f[0]])) for f in found}),
    )


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence.

    A row of the usual table is kept as bits, one where it does not grow, so a step along
    ``b`` is an addition; ``a`` is taken in strips that hand on the addition's carries.
    """
    there, carry, length = b.tolist(), bytearray(len(b)), 0
    for low in range(0, len(a), STRIP):
        part = a[low : low + STRIP].tolist()
        flat = (1 << len(part)) - 1
        places: dict[int, int] = {}
        for i, x in enumerate(part):
            places[x] = places.get(x, 0) | 1 << i
        row = flat
        for j, y in enumerate(there):
            hit = row & places.get(y, 0)
            if hit or carry[j]:
                grown = row + hit + carry[j]
                carry[j] = grown >> len(part)
                row = (grown | (row - hit)) & flat
        length += len(part) - row.bit_count()
    return length


def _sizes(lengths: list[int]) -> list[int]:
    """Window lengths in blocks such that each passage length is at least three quarters of one."""
    out: list[int] = []
    for n in sorted(lengths, reverse=True):
        if not out or n < 0.75 * out[-1] * BLOCK:
            out.append(-(-n // BLOCK))
    return out


def _running(index: Index, weight: np.ndarray, row: np.ndarray, head: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Running sums of the projected words of blocks that begin at ``head``, none beyond the end of its text."""
    sums = np.zeros((len(head) + 1, index.basis.shape[1]), np.float32)
    for j in range(BLOCK):
        word = np.minimum(head + j, len(row) - 1)
        ok = np.flatnonzero((head + j < stop) & (row[word] >= 0))
        sums[ok + 1] += weight[word[ok], None] * index.basis[row[word[ok]]]
    return np.cumsum(sums, axis=0, out=sums)


def _windows(index: Index, w: Words, bucket: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(first word, words, passage, cosine) of candidates, the best ones first; one of each item and place.

    Words are added up in blocks of ``BLOCK``, so each word is projected once at most
    and a window is a difference of running sums.
    """
    if not len(bucket) or not index.vectors.size:
        return
    weight = index.idf[bucket]
    row = index.row_of[bucket]
    n_words = np.diff(w.first)
    n_blocks = -(-n_words // BLOCK)
    begin = np.concatenate([[0], np.cumsum(n_blocks)])
    doc = np.repeat(np.arange(len(n_words)), n_blocks)
    head = w.first[doc] + (np.arange(begin[-1]) - begin[doc]) * BLOCK
    energy = weight.astype(np.float64) ** 2
    total = np.concatenate([[0.0], np.cumsum(np.add.reduceat(energy, head))])
    known = np.concatenate([[0.0], np.cumsum(np.add.reduceat(np.where(row >= 0, energy, 0.0), head))])
    starts, ends = [], []
    for size in _sizes(index.lengths):
        step = max(1, size // 6)
        n = (np.maximum(n_blocks - size, 0) + step - 1) // step + (n_blocks > 0)
        of = np.repeat(np.arange(len(n_blocks)), n)
        first = begin[of] + (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * step
        first = np.maximum(np.minimum(first, begin[of + 1] - size), begin[of])
        last = np.minimum(first + size, begin[of + 1])
        maybe = known[last] - known[first] >= least * least * (total[last] - total[first])
        starts.append(first[maybe])
        ends.append(last[maybe])
    start, end = np.concatenate(starts), np.concatenate(ends)
    if not len(start):
        return
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    found = []
    for at in np.split(np.arange(len(start)), np.flatnonzero(np.diff(start // SLAB)) + 1):
        low, high = int(start[at[0]]), int(end[at].max())
        sums = _running(index, weight, row, head[low:high], w.first[doc[low:high] + 1])
        for k in range(at[0], at[-1] + 1, 4096):
            a, b = start[k : min(k + 4096, at[-1] + 1)], end[k : min(k + 4096, at[-1] + 1)]
            size = np.sqrt(np.maximum(total[b] - total[a], 1e-12)).astype(np.float32)
            here = (sums[b - low] - sums[a - low]) / size[:, None]
            cosine = here @ index.vectors
            share = np.minimum((known[b] - known[a]) / size.astype(np.float64) ** 2, 1)
            over = np.sqrt(np.maximum(share - np.einsum("ij,ij->i", here, here), 0)).astype(np.float32)
            most = cosine * index.kept + over[:, None] * np.sqrt(1 - index.kept**2)
            i, passage = np.nonzero(np.maximum(cosine, most) >= least)
            found.append((cosine[i, passage], head[a[i]], (b - a)[i] * BLOCK, passage, doc[a[i]]))
    value, word, size, passage, of = (np.concatenate(x) for x in zip(*found, strict=True))
    best = np.argsort(-value, kind="stable")
    # Places closer than a sixteenth of the item see the same surroundings: the best one stands for them.
    unit = np.maximum(16, np.array([len(x) for x in index.told.words])[index.item[passage]] // 16)
    near = (word - w.first[of] - index.start[passage]) // unit + (1 << 24)
    _, one = np.unique((of << 42 | near << 12 | index.item[passage])[best], return_index=True)
    for i in best[np.sort(one)]:
        yield int(word[i]), int(size[i]), int(passage[i]), float(value[i])


def _best(index: Index, w: Words, bucket: np.ndarray, least: float, covered: float) -> dict[tuple[int, int], tuple]:
    """Cosine, covered share, first and last word of the best place, by document and item."""
    best: dict[tuple[int, int], tuple] = {}
    for start, size, p, cosine in _windows(index, w, bucket, least):
        doc = int(np.searchsorted(w.first, start, "right")) - 1
        item = int(index.item[p])
        words = index.told.words[item]
        room = max(size, len(words) // 4)
        begin = start - int(index.start[p])
        if best.get((doc, item), (0, 0))[1] == 1.0:
            continue
        a = max(int(w.first[doc]), begin - room)
        b = min(int(w.first[doc + 1]), begin + len(words) + room)
        here = w.hashes[a:b]
        need = 1.0 if len(words) < LEAST_WORDS else covered
        there = set(here.tolist())
        if sum(x in there for x in words.tolist()) < need * len(words) - 1e-9:
            continue
        share = common_subsequence(words, here) / len(words)
        if share < need or best.get((doc, item), (0, -1))[1] >= share:
            continue
        answer = index.told.answers[item]
        sure = not index.told.given[item] and share >= SURE
        if len(answer) and not sure and common_subsequence(answer, here) < need * len(answer) - 1e-9:
            continue
        best[doc, item] = (cosine, share, a - int(w.first[doc]), b - int(w.first[doc]))
    return best


def _search(shared, least: float, covered: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch["text"])
            ids = batch["doc_id"].to_pylist()
            for lo, hi in slices(offsets):
                w, bucket = _words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                best: dict[tuple, tuple] = {}
                for index in shared.value:
                    for (d, i), place in _best(index, w, bucket, least, covered).items():
                        at = (ids[lo + d], index.told.keys[i])
                        best[at] = max(best.get(at, place), place, key=lambda x: x[1::-1])
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(NAMES, (*at, *place), strict=True)) for at, place in best.items()], schema=SCHEMA
                )

    return run


def _parts(items: DataFrame, n_bins: int, shared_idf, idf32: np.ndarray) -> Iterator[Index]:
    """Indexes of at most ``PASSAGES`` passages each, bin by bin."""
    context, idf = items.sparkSession.sparkContext, shared_idf.value
    for n in range(n_bins):
        mine = items.where(F.pmod(F.xxhash64("key"), F.lit(n_bins)) == n)
        block = mine.toArrow().sort_by("key")
        found = list(_passages(block["text"].combine_chunks(), idf)) if len(block) else []
        told = _told(block)
        for at in range(0, len(found), PASSAGES):
            part = found[at : at + PASSAGES]
            span = tuple((told.keys[p[0]], p[1]) for p in (part[0], part[-1]))
            here = mine.where(F.col("key").between(span[0][0], span[1][0]))
            used = np.unique(np.concatenate([x for *_, x, _ in part]))
            row_of = np.full(1 << BITS, -1, np.int32)
            row_of[used] = np.arange(len(used))
            basis = latent_basis(here, shared_idf, context.broadcast(row_of), len(used), len(part), span)
            basis = basis[:, : least_rank(_projected(part, row_of, basis))]
            yield build_index(block, idf, row_of, basis, idf32, part, told)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COSINE, covered: float = COVERED) -> DataFrame:
    """Pairs of a document and a benchmark item it holds, with cosine, covered share and place."""
    spark = docs.sparkSession
    answer = [c for c in ("answer",) if c in benchmark.columns]
    key = F.concat(*(F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256) for c in ("text", *answer)))
    given = benchmark.where("trim(text) <> ''").select(F.col("item_id").cast("long"), "text", *answer, key.alias("key"))
    items = tables.stored(given.select("key", "text", *answer).dropDuplicates(["key"]))
    source = docs.select(F.col("doc_id").cast("long"), "text")
    n_passages = items.select("text").mapInArrow(_n_passages, "n long").agg(F.sum("n").alias("n")).first()["n"]
    n_bins = -(-(n_passages or 0) // PASSAGES)
    if not n_bins:
        return spark.createDataFrame([], HITS)
    idf = inverse_frequencies(source)
    parts, found = _parts(items, n_bins, spark.sparkContext.broadcast(idf), idf.astype(np.float32)), None
    while some := list(islice(parts, PARTS)):
        hits = source.mapInArrow(_search(spark.sparkContext.broadcast(some), least, covered), FOUND)
        found = hits if found is None else found.unionByName(hits)
    pairs = found.join(given.select("key", "item_id").distinct(), "key")
    rest = ("covered", "cosine", "first_word", "last_word")
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct(*rest)).alias("b"))
    return best.select("doc_id", "item_id", "b.cosine", "b.covered", "b.first_word", "b.last_word")
