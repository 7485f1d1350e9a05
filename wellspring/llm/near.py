"""Near-duplicate documents by Order MinHash and banded alignment.

Words are runs of letters and digits in lower case; k-mers are three words, labelled by
their occurrence in the text. A sketch holds the two k-mers with the smallest hash
in the order in which they stand, so it agrees only where the texts share k-mers in the
same order. Documents that agree in one of ``TABLES`` sketches are candidates (texts of
at most ``FEW`` words have ``MORE`` further ones): at an edit similarity of 0.8 a
quarter (evenly spaced edits, the worst case) to two fifths of the k-mers' union is
common, and at least 0.95 of such pairs agree in some sketch. Texts of ``SHORTEST`` to
``SHORT`` words, where one edit can leave no common k-mer, are candidates as well if
they are equal after one word at most is left out of each. A link
is a pair with edit similarity of words (1 - distance / longer length) of at least
``SIMILARITY``, decided by an alignment within the band that this allows. A class is
all that is joined by links. A shared passage links two texts only where it makes up
``SIMILARITY`` of the longer one; shorter ones are left to the substring operator.

Rows with the same words are first taken together; only one per such group takes part
in what follows. No list of the pairs of a bucket is made: all members are compared
with one centre, the member with the most company over all its buckets (the original of
a family of copies, as a rule). Buckets that still hold several classes are searched
inside tasks, block against block, which give only links that join two classes, fewer
than there are members: a pair is tried only in the first group that it shares, only
while its classes differ, and only if word counts in hash bins do not rule it out. The
members of buckets beyond ``LARGE`` blocks are
first split by a prefix filter: two texts at the similarity share one of the rarest
fifth of their words (and one), so they meet in that word's group, while texts that
share only a common passage do not. No link between candidates is lost.

Edges: null and empty texts are the same text without words; under four words only
equal word sequences match; rows are numbered, so that one doc_id (or null) may have
several texts, each in its own class; a class takes the smallest doc_id in it (null if
all are null), and exactly one row of it is ``kept``; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.components import components, joined
from wellspring.llm.tables import stored
from wellspring.llm.words import MASK, ROLL, inverse, lowered, mix, powers, rolling, separators, slices, text_bytes, within, words_of

KMER = 3
SAMPLED = 2
TABLES = 52
FEW, MORE = 40, 40
SIMILARITY = 0.8
SHORTEST, SHORT = 4, 10
BINS = 512
BLOCK = 1024
BLOCK_WORDS = 1 << 21
LARGE = 16
RARITY_BITS = 16

_KEY = ["key1", "key2", "n_words"]


def _word_runs(texts: pa.Array) -> Iterator[tuple[int, int, object]]:
    data, offsets = text_bytes(texts)
    for a, b in slices(offsets):
        yield a, b, words_of(lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], separators())


def _sequence_keys(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the whole word sequence of each text."""
    values = mix(hashes + np.uint64(seed)) * powers(len(hashes) + 1, ROLL)[: len(hashes)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mix((total[first[1:]] - total[first[:-1]]) * powers(len(hashes) + 1, inverse(ROLL))[first[:-1]])


def labelled(kmers: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """K-mer hashes mixed with how often the same k-mer stood before in the same text."""
    salted = kmers ^ mix(doc.astype(np.uint64))
    order = np.argsort(salted, kind="stable")
    sorted_ = salted[order]
    new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    out = np.empty_like(kmers)
    out[order] = kmers[order] + (np.arange(len(new)) - begin).astype(np.uint64) * np.uint64(ROLL)
    return mix(out)


def order_sketches(kmers: np.ndarray, first: np.ndarray, tables: range, sampled: int) -> np.ndarray:
    """(texts, tables) hashes of the ``sampled`` least k-mers in text order; needs texts with k-mers."""
    count = np.diff(first)
    last = np.uint64(MASK)
    out = np.empty((len(count), len(tables)), np.uint64)
    for column, t in enumerate(tables):
        value = kmers ^ np.uint64(((2 * t + 1) * 0x9FB21C651E98DF25) & MASK)
        value *= np.uint64(((2 * t + 1) * 0xD1342543DE82EF95) & MASK | 1)
        value ^= value >> np.uint64(32)
        at = []
        for _ in range(sampled):
            least = np.minimum.reduceat(value, first[:-1])
            where = np.flatnonzero(value == np.repeat(least, count))
            doc = np.searchsorted(first, where, "right") - 1
            one = np.concatenate([[True], doc[1:] != doc[:-1]])  # a tie, or nothing left, counts once
            where = where[one]
            at.append(where)
            value[where] = last
        at = np.sort(np.stack(at), axis=0)
        mixed = np.full(len(count), t + 1, np.uint64)
        for row in at:
            mixed = mix(mixed * np.uint64(ROLL) + kmers[row])
        out[:, column] = mixed
    return out


def _shortened(hashes: np.ndarray) -> np.ndarray:
    """Keys of a short text's words as they are and with each one left out."""
    texts = [hashes, *(np.delete(hashes, i) for i in range(len(hashes)))]
    first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return np.unique(_sequence_keys(np.concatenate(texts), first, 3))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in _word_runs(batch["text"]):
            n = np.diff(w.first)
            keys = [_sequence_keys(w.hashes, w.first, s).view(np.int64) for s in (1, 2)]
            at = np.flatnonzero(within(w, KMER))
            doc = w.doc()[at]
            cells = [np.empty(0, np.uint64)] * (b - a)
            if len(at):
                kmers = labelled(rolling(w.hashes, KMER)[at], doc)
                full, begin = np.unique(doc, return_index=True)
                for i, row in zip(full, order_sketches(kmers, np.append(begin, len(at)), range(TABLES), SAMPLED), strict=True):
                    cells[i] = row
                some = n[doc] <= FEW
                if some.any():
                    full, begin = np.unique(doc[some], return_index=True)
                    more = order_sketches(kmers[some], np.append(begin, some.sum()), range(TABLES, TABLES + MORE), SAMPLED)
                    for i, row in zip(full, more, strict=True):
                        cells[i] = np.concatenate([cells[i], row])
            for i in np.flatnonzero((n >= SHORTEST) & (n <= SHORT)):
                cells[i] = np.concatenate([cells[i], _shortened(w.hashes[w.first[i] : w.first[i + 1]])])
            ends = np.cumsum([0, *(len(x) for x in cells)]).astype(np.int32)
            sketches = np.concatenate([np.empty(0, np.uint64), *cells]).view(np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"].slice(a, b - a),
                    "text_hash": batch["text_hash"].slice(a, b - a),
                    "key1": keys[0],
                    "key2": keys[1],
                    "n_words": n,
                    "sketches": pa.ListArray.from_arrays(ends, sketches),
                }
            )


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, w in _word_runs(batch["text"]):
            part = (w.hashes >> np.uint64(32)).astype("<u4")
            parts = [part[w.first[i] : w.first[i + 1]].tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_pydict({"node": batch["node"].slice(a, b - a), "tokens": pa.array(parts, pa.binary())})


def _words(tokens: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u4") for x in tokens]


def histogram(tokens: np.ndarray) -> np.ndarray:
    """Numbers of words in each of ``BINS`` hash bins."""
    return np.minimum(np.bincount(tokens % BINS, minlength=BINS), 32767).astype("<i2")


def _spread(tokens: np.ndarray) -> np.ndarray:
    """Which of the rarity counts each word belongs to."""
    return (mix(tokens.astype(np.uint64)) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << RARITY_BITS, np.int64)
    for batch in batches:
        for words in _words(batch["tokens"]):
            total += np.bincount(_spread(np.unique(words)), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"at": at, "n": total[at]})


def prefix(tokens: np.ndarray, rarity: np.ndarray, least: float) -> np.ndarray:
    """The rarest words (labelled by occurrence) of which two texts at the similarity share one."""
    if not len(tokens):
        return np.empty(0, np.int64)
    named = labelled(tokens.astype(np.uint64), np.zeros(len(tokens), np.int64))
    order = np.lexsort((named, rarity[_spread(tokens)]))
    return named[order[: len(tokens) - int(np.ceil(least * len(tokens) - 1e-9)) + 1]].view(np.int64)


def _prefixes(rarity: np.ndarray, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix(x, rarity, least) for x in _words(batch["tokens"])]
            ends = np.cumsum([0, *(len(x) for x in found)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *found]))
            yield pa.RecordBatch.from_pydict({"node": batch["node"], "groups": keys})

    return run


def _earlier(groups: pa.ChunkedArray, group: int) -> np.ndarray:
    """Rows of bits, one for each group that comes before this one and holds several of the members."""
    lists = groups.combine_chunks()
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten().to_numpy()
    owner, flat = owner[flat < group], flat[flat < group]
    _, number, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[number] > 1
    owner, number = owner[shared], (np.cumsum(count > 1) - 1)[number[shared]]
    bits = np.zeros((len(lists), int((count > 1).sum() + 63) // 64), np.uint64)
    np.bitwise_or.at(bits, (owner, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    return bits


def _joining(least: float):
    """Links that join classes, between the members of one block or of two blocks of a group.

    Each word that one text has more often in a bin than the other costs an edit, so
    the pairs left out by the bins are certainly below the similarity.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lo, hi, group = (t[c][0].as_py() for c in ("lo", "hi", "grp"))
        ids, n, label, block = (t[c].to_numpy() for c in ("node", "n_words", "label", "block"))
        words = _words(t["tokens"])
        bins = np.stack([histogram(x) for x in words])
        before = _earlier(t["groups"], group)
        class_ = np.unique(label, return_inverse=True)[1]
        a, b = [], []
        right = np.flatnonzero(block == hi)
        for i in np.flatnonzero(block == lo):
            some = right[(class_[right] != class_[i]) & ((lo != hi) | (ids[right] > ids[i]))]
            longer, shorter = np.maximum(n[some], n[i]), np.minimum(n[some], n[i])
            most = ((1 - least) * longer + 1e-9).astype(np.int64)
            fits = (longer - shorter <= most) & ~(before[some] & before[i]).any(1)
            some, most = some[fits], most[fits]
            gap = bins[some].astype(np.int32) - bins[i]
            cost = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))
            for j in some[cost <= most]:
                if class_[i] != class_[j] and similar(words[i], words[j], least):
                    class_[class_ == class_[j]] = class_[i]
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return run


def _increasing(values: np.ndarray) -> np.ndarray:
    """Places of a longest increasing subsequence."""
    if np.all(values[1:] > values[:-1]):
        return np.arange(len(values))
    ends: list[int] = []
    tops: list[int] = []
    before = np.empty(len(values), np.int64)
    for i, v in enumerate(values.tolist()):
        lo, hi = 0, len(tops)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if tops[mid] < v else (lo, mid)
        before[i] = ends[lo - 1] if lo else -1
        if lo == len(tops):
            tops.append(v)
            ends.append(i)
        else:
            tops[lo], ends[lo] = v, i
    out, i = [], ends[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1])


def _anchored(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """An upper bound of the edit distance from common labelled k-mers inside the band."""
    longer = max(len(a), len(b))
    if min(len(a), len(b)) < KMER:
        return longer
    ka = labelled(rolling(a.astype(np.uint64), KMER), np.zeros(len(a) - KMER + 1, np.int64))
    kb = labelled(rolling(b.astype(np.uint64), KMER), np.zeros(len(b) - KMER + 1, np.int64))
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    if not len(i):
        return longer
    order = np.argsort(i)
    i, j = i[order], j[order]
    chain = _increasing(j)
    i, j = i[chain], j[chain]
    di, dj = np.diff(i), np.diff(j)
    inner = np.maximum(di, dj) - np.minimum(KMER, np.minimum(di, dj))
    return int(max(i[0], j[0]) + max(len(a) - i[-1], len(b) - j[-1]) - KMER + inner.sum())


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Distance of two word sequences, or ``most + 1`` if it is more: rows of a band of 2 * most + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    width = 2 * most + 1
    far = len(a) + len(b) + 1
    step = np.arange(width)
    row = np.where((step >= most) & (step - most <= len(b)), step - most, far)
    for i in range(1, len(a) + 1):
        j = step + i - most
        ok = (j >= 0) & (j <= len(b))
        same = np.zeros(width, bool)
        inner = ok & (j >= 1)
        same[inner] = b[j[inner] - 1] == a[i - 1]
        new = row + 1 - same
        new[~inner] = far
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        new[~ok] = far
        row = np.minimum.accumulate(new - step) + step
        row[~ok] = far
        if row.min() > most:
            return most + 1
    return min(int(row[len(b) - len(a) + most]), most + 1)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two word sequences have at least this edit similarity; cheap bounds first."""
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    _, inverse_ = np.unique(np.concatenate([a, b]), return_inverse=True)
    common = np.minimum(
        np.bincount(inverse_[: len(a)], minlength=inverse_.max(initial=0) + 1),
        np.bincount(inverse_[len(a) :], minlength=inverse_.max(initial=0) + 1),
    ).sum()
    if longer - common > most:
        return False
    return _anchored(a, b, most) <= most or edit_distance(a, b, most) <= most


def _align(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                similar(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4"), least)
                for x, y in zip(batch["x"], batch["y"], strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (the smallest doc_id it is linked with), kept and text_hash, a row per document.

    ``kept`` marks one row of each class, with the class id as its doc_id; ``text_hash``
    is the XXH64 of its text, which tells the texts of a repeated doc_id apart.
    """
    source = docs.select(
        F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")
    )
    schema = "doc_id long, text_hash long, key1 long, key2 long, n_words long, sketches array<long>"
    known = stored(source.mapInArrow(_sketch, schema).withColumn("row", F.monotonically_increasing_id()))
    own = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "row")
    same = stored(known.groupBy(*_KEY).agg(F.min("row").alias("rep"), F.min(own).alias("first")))
    reps = known.join(same.select("rep"), known["row"] == F.col("rep")).select(
        F.col("row").alias("node"), "doc_id", "text_hash", "n_words", "sketches"
    )
    members = _buckets(reps)
    tokens = _member_tokens(source, members, reps)
    labels = _classes(members, tokens, least)
    classes = same.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = classes.groupBy("label").agg(F.min("first").alias("best"))
    classes = stored(
        classes.join(first, "label").select(*_KEY, F.col("best.doc_id").alias("class_id"), F.col("best.row").alias("best"))
    )
    return known.join(classes, _KEY).select("doc_id", "class_id", (F.col("row") == F.col("best")).alias("kept"), "text_hash")


def _buckets(reps: DataFrame) -> DataFrame:
    """bucket, node, n_words, support for buckets of two members or more."""
    cells = reps.select(F.explode("sketches").alias("bucket"), "node", "n_words")
    sizes = stored(cells.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = stored(cells.join(sizes, "bucket"))
    support = shared.groupBy("node").agg(F.sum("size").alias("support"))
    return stored(shared.join(support, "node").drop("size"))


def _member_tokens(source: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    wanted = reps.join(members.select("node").distinct(), "node").select(
        "node", F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")
    )
    met = (source["text_hash"] == F.col("wanted_hash")) & source["doc_id"].eqNullSafe(F.col("wanted_id"))
    texts = source.join(wanted.hint("merge"), met).select("node", "text").dropDuplicates(["node"])
    return stored(texts.mapInArrow(_tokens, "node long, tokens binary"))


def _fits(least: float):
    """Lengths that do not rule out the similarity."""
    return F.least("n_words", "other_words") >= F.floor(F.greatest("n_words", "other_words") * least - 1e-6)


def _verified(pairs: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    with_a = pairs.hint("merge").join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a")
    with_b = with_a.hint("merge").join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return stored(with_b.mapInArrow(_align(least), "a long, b long"))


def _star(members: DataFrame, least: float) -> DataFrame:
    """Pairs of each bucket's centre and its other members."""
    rank = F.max(F.struct("support", (-F.col("node")).alias("back"), "n_words"))
    centre = members.groupBy("bucket").agg(rank.alias("c")).select(
        "bucket", (-F.col("c.back")).alias("other"), F.col("c.n_words").alias("other_words")
    )
    pairs = members.join(stored(centre), "bucket").where((F.col("node") != F.col("other")) & _fits(least))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members, with their labels, of buckets that hold several classes."""
    now = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = stored(now)
    open_ = stored(now.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi"))
    return stored(now.join(open_.select("bucket"), "bucket"))


def _groups(left: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """grp, node, n_words, label: open buckets, and the rare words that share out the members of large ones."""
    sizes = stored(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n_words").alias("words")))
    large = (F.col("size") > LARGE * BLOCK) | (F.col("words") > LARGE * BLOCK_WORDS)
    dealt = left.join(sizes, "bucket").select(F.col("bucket").alias("grp"), "node", "n_words", "label", large.alias("large"))
    few = dealt.where(~F.col("large")).drop("large")
    many = stored(dealt.where("large").select("node", "n_words", "label").distinct())
    if many.isEmpty():
        return few
    asked = stored(tokens.join(many.select("node"), "node", "left_semi"))
    rarity = np.zeros(1 << RARITY_BITS, np.int64)
    for r in asked.mapInArrow(_count_words, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        rarity[r["at"]] = r["n"]  # a table of fixed size
    rare = asked.mapInArrow(_prefixes(rarity, least), "node long, groups array<long>")
    cells = stored(rare.select("node", F.explode("groups").alias("grp")).join(many, "node"))
    open_ = stored(cells.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi"))
    return few.unionByName(cells.join(open_.select("grp"), "grp").select(*few.columns))


def _searched(groups: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """Links between the classes of each group, block against block where a group is large."""
    groups = stored(groups)
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n_words") / BLOCK_WORDS))
    sizes = stored(groups.groupBy("grp").agg(need.alias("blocks")))
    own = groups.groupBy("node").agg(F.sort_array(F.collect_list("grp")).alias("groups"))
    carried = stored(own.join(tokens, "node"))
    dealt = (
        groups.join(sizes, "grp")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
        .join(carried, "node")
    )
    return stored(dealt.groupBy("grp", "lo", "hi").applyInArrow(_joining(least), "a long, b long"))


def _classes(members: DataFrame, tokens: DataFrame, least: float) -> DataFrame:
    """(node, label) of all nodes that verified links join."""
    labels = stored(components(_verified(stored(_star(members, least)), tokens, least)))
    left = _open(members, labels)
    if left.isEmpty():
        return labels
    return joined(labels, _searched(_groups(left, tokens, least), tokens, least))
