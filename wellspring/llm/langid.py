"""Language identification of whole texts, with spans for mixed-language text.

Each word gets a score per language: the summed log-odds of its byte trigrams and of
the word itself, from counts of labelled documents in fixed hash tables. The script of
a word narrows the languages to those that use it. A Viterbi path over the words, with
a penalty for each change of language, labels spans; a document's language is the one
that covers most letters, its score the share of letters covered.

The path is found for all texts of a slice at once: words are cut into blocks, every
block's best scores from each entry to each exit language come from one pass over all
blocks together, a second pass joins the blocks of each text, and a third one fills in
the words.

Counts come from a bounded sample of each language (``SAMPLE`` documents, chosen by
hash); the tables have a fixed size, so both the collected counts and the broadcast
model are bounded.

Edges: null, empty and letterless texts are ``und`` with score 0; a word without a
known script may be in any language; with no labelled document every text is ``und``;
ties go to the first language in alphabetical order; equal rows are labelled alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspring.llm.words import Words, lowered, slices, text_bytes, words_of

BITS = 16
SAMPLE = 4000
SWITCH = 12.0
BLOCK = 64
UNKNOWN = "und"
SCRIPTS = 16
SCRIPT_SHARE = 0.01
LABELS = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first_word:long,n_words:long>>"


@dataclass
class Model:
    """Log-odds per hash bucket and language, and which languages use which script."""

    langs: list[str]
    grams: np.ndarray
    words: np.ndarray
    uses: np.ndarray


def _letters() -> np.ndarray:
    """Flags of bytes outside words: all ASCII but letters."""
    out = np.ones(256, bool)
    out[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
    return out


def _script_of_byte() -> np.ndarray:
    """A script number for the first byte of a word; UTF-8 lead bytes tell scripts apart by range."""
    out = np.zeros(256, np.int64)
    ranges = [(0xCD, 0xCF), (0xD0, 0xD4), (0xD5, 0xD7), (0xD8, 0xDD), (0xE0, 0xE0), (0xE1, 0xE1), (0xE2, 0xE2), (0xE3, 0xE3), (0xE4, 0xE9), (0xEA, 0xED), (0xEE, 0xF4)]
    for n, (lo, hi) in enumerate(ranges, 1):
        out[lo : hi + 1] = n
    return out


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their trigram buckets (with the first of each word), word buckets and scripts."""
    apart = _letters()
    data = lowered(data)
    w = words_of(data, offsets, apart)
    wide = np.full(len(data) + 2, 0x20, np.uint32)
    wide[1:-1] = np.where(apart[data], 0x20, data)
    edge = np.zeros(len(data) + 1, bool)
    edge[w.starts] = True
    before = np.where(edge[:-1], 0x20, wide[:-2])
    after = wide[2:].copy()
    after[w.ends - 1] = 0x20
    gram = ((before << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | after) * np.uint32(0x9E3779B1)
    inside = np.flatnonzero(~apart[data])
    gram = (gram[inside] >> np.uint32(32 - BITS)).astype(np.int64)
    first = np.searchsorted(inside, w.starts)
    word = (w.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return w, gram, first, word, _script_of_byte()[data[w.starts]] if len(w.starts) else np.empty(0, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per language, kind (trigram, word, script) and bucket."""
    for batch in batches:
        data, offsets = text_bytes(batch["text"])
        lang = batch["lang"].dictionary_encode()
        code, n_langs = lang.indices.to_numpy(), len(lang.dictionary)
        total = {0: np.zeros((n_langs, 1 << BITS), np.int64), 1: np.zeros((n_langs, 1 << BITS), np.int64), 2: np.zeros((n_langs, SCRIPTS), np.int64)}
        for a, b in slices(offsets):
            w, gram, first, word, script = _features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            of_word = code[a:b][w.doc()]
            of_gram = np.repeat(of_word, np.diff(np.append(first, len(gram))))
            for kind, where, bucket in ((0, of_gram, gram), (1, of_word, word), (2, of_word, script)):
                table = total[kind]
                table += np.bincount(where * table.shape[1] + bucket, minlength=table.size).reshape(table.shape)
        for kind, table in total.items():
            row, bucket = np.nonzero(table)
            yield pa.RecordBatch.from_pydict(
                {
                    "lang": lang.dictionary.take(pa.array(row)),
                    "kind": pa.array(np.full(len(row), kind, np.int32)),
                    "bucket": pa.array(bucket.astype(np.int32)),
                    "n": table[row, bucket],
                }
            )


def train(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts of at most about ``sample`` documents of each language, chosen by hash."""
    known = labelled.where("lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = known.groupBy("lang").agg(F.count("*").alias("size")).collect()  # a row per language, as the model has
    size = F.create_map(*[F.lit(x) for row in sizes for x in row]) if sizes else F.lit(None).cast("map<string,long>")
    share = (F.abs(F.xxhash64("doc_id") % 1_000_003) + 0.5) / 1_000_003
    chosen = known.where(share * F.element_at(size, F.col("lang")) <= sample).select("text", "lang")
    counts = chosen.mapInArrow(_count, "lang string, kind int, bucket int, n long")
    counts = counts.groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(counts["lang"].to_pylist()))
    code = {x: i for i, x in enumerate(langs)}
    row = np.array([code[x] for x in counts["lang"].to_pylist()], np.int64)
    kind, bucket, n = (counts[c].to_numpy() for c in ("kind", "bucket", "n"))

    def table(k: int, size: int) -> np.ndarray:
        out = np.zeros((len(langs), size))
        mine = kind == k
        out[row[mine], bucket[mine]] = n[mine]
        return out

    def odds(seen: np.ndarray) -> np.ndarray:
        if not len(seen):
            return np.zeros((seen.shape[1], 0), np.float32)
        share = (seen + 0.5) / (seen.sum(1, keepdims=True) + 0.5 * seen.shape[1])
        value = np.log(share / share.mean(0, keepdims=True))
        return np.ascontiguousarray(value.T, np.float32)

    script = table(2, SCRIPTS)
    uses = (script >= SCRIPT_SHARE * np.maximum(script.sum(1, keepdims=True), 1)).T
    uses[~uses.any(1)] = True
    return Model(langs, odds(table(0, 1 << BITS)), odds(table(1, 1 << BITS)), uses)


def word_scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    w, gram, first, word, script = _features(data, offsets)
    if not len(word):
        return w, np.empty((0, len(model.langs)), np.float32)
    score = np.add.reduceat(model.grams[gram], first, axis=0) + model.words[word]
    return w, np.where(model.uses[script], score, np.float32(-1e4))


def best_path(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language number of each word: the path of each text with the highest score less switches."""
    n_docs, k = len(first) - 1, scores.shape[1]
    blocks = -(-np.diff(first) // BLOCK)
    begin = np.concatenate([[0], np.cumsum(blocks)])
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    inside = np.arange(len(scores)) - np.repeat(first[:-1], n_words)
    cell = (begin[doc] + inside // BLOCK) * BLOCK + inside % BLOCK
    padded = np.zeros((begin[-1] * BLOCK, k), np.float32)
    padded[cell] = scores
    padded = padded.reshape(-1, BLOCK, k)
    through = np.full((begin[-1], k, k), -1e9, np.float32)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(BLOCK):
        through = np.maximum(through, through.max(2, keepdims=True) - switch) + padded[:, t, None, :]
    order = np.argsort(-blocks, kind="stable")
    sorted_blocks = blocks[order]
    state = np.zeros((n_docs, k), np.float32)
    came = np.zeros((begin[-1], k), np.int64)
    for j in range(int(blocks.max(initial=0))):
        live = order[: np.searchsorted(-sorted_blocks, -j, "left")]
        at = begin[live] + j
        way = state[live][:, :, None] + through[at]
        came[at] = way.argmax(1)
        state[live] = way.max(1)
    exit_ = np.zeros(begin[-1], np.int64)
    now = state.argmax(1)
    for j in range(int(blocks.max(initial=0)) - 1, -1, -1):
        live = order[: np.searchsorted(-sorted_blocks, -j, "left")]
        at = begin[live] + j
        exit_[at] = now[live]
        now[live] = came[at, now[live]]
    entry = came[np.arange(begin[-1]), exit_]
    v = np.full((begin[-1], k), -1e9, np.float32)
    v[np.arange(begin[-1]), entry] = 0
    moved = np.empty((BLOCK, begin[-1], k), bool)
    best = np.empty((BLOCK, begin[-1]), np.int64)
    for t in range(BLOCK):
        best[t] = v.argmax(1)
        jump = v.max(1, keepdims=True) - switch
        moved[t] = jump > v
        v = np.maximum(v, jump) + padded[:, t]
    path = np.empty((begin[-1], BLOCK), np.int64)
    now, every = exit_, np.arange(begin[-1])
    for t in range(BLOCK - 1, -1, -1):
        path[:, t] = now
        now = np.where(moved[t, every, now], best[t], now)
    return path.reshape(-1)[cell]


def _one_text(model: Model, w: Words, path: np.ndarray, i: int) -> tuple[str, float, list[dict]]:
    """Language, score and spans of text ``i`` with at least one word."""
    a, b = w.first[i], w.first[i + 1]
    mine = path[a:b]
    share = np.bincount(mine, w.ends[a:b] - w.starts[a:b], len(model.langs))
    top = int(share.argmax())
    turn = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
    spans = [
        {"lang": model.langs[mine[s]], "first_word": int(s), "n_words": int(e - s)}
        for s, e in zip(turn, np.append(turn[1:], len(mine)), strict=True)
    ]
    return model.langs[top], float(share[top] / share.sum()), spans


def _label(shared):
    spans = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            whole = "document" in batch.schema.names
            texts = batch["document"].field("text") if whole else batch["text"]
            data, offsets = text_bytes(texts)
            for a, b in slices(offsets):
                part = data[offsets[a] : offsets[b]]
                w, scores = word_scores(model, part, offsets[a : b + 1] - offsets[a])
                known = len(model.langs) and len(scores)
                path = best_path(scores, w.first) if known else np.zeros(len(w.starts), np.int64)
                plain = np.concatenate([[0], np.cumsum(~_letters()[part] & (part < 0x80))])[offsets[a : b + 1] - offsets[a]]
                rows = []
                for i in range(b - a):
                    has = known and w.first[i + 1] > w.first[i]
                    if has and plain[i + 1] == plain[i]:
                        has = any(c.isalpha() for c in texts[a + i].as_py())
                    rows.append(_one_text(model, w, path, i) if has else (UNKNOWN, 0.0, []))
                found = {
                    "doc_id": batch["doc_id"].slice(a, b - a),
                    "lang_pred": pa.array([r[0] for r in rows], pa.string()),
                    "score": pa.array([r[1] for r in rows], pa.float64()),
                    "spans": pa.array([r[2] for r in rows], spans),
                }
                yield pa.RecordBatch.from_pydict(found | ({"document": batch["document"].slice(a, b - a)} if whole else {}))

    return run


def identify(docs: DataFrame, model: Model, whole: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and the spans of words by language, one row per document.

    With ``whole`` the struct ``document`` keeps all columns of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if not whole:
        return docs.select(doc_id, "text").mapInArrow(_label(shared), LABELS)
    kept = docs.select(doc_id, F.struct("*").alias("document"))
    return kept.mapInArrow(_label(shared), f"{LABELS}, document {kept.schema['document'].dataType.simpleString()}")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept away from all training."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
