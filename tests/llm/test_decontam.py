import random

import numpy as np
import pyarrow as pa
import pytest

from wellspring.llm import decontam

from .conftest import SMALL


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(40):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontam.common_subsequence(np.array(a, int), np.array(b, int)) == table[-1][-1]


def test_planted_passages_and_paraphrases(spark, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: r.text for r in benchmark.collect()}
    rng = random.Random(2)
    prose = [r.text for r in docs.where("n_chars > 1500").orderBy("doc_id").limit(40).collect()]
    rows, planted = [], set()
    for n, (item, text) in enumerate(sorted(items.items())):
        words = text.split()
        if n % 2:
            words = [f"other{rng.randrange(99)}" if rng.random() < 0.12 else w.upper() for w in words]
        rows.append((n, f"{prose[n % 40][:700]} {' '.join(words)} {prose[(n + 1) % 40][:700]}"))
        planted.add((n, item))
    clean = [(1000 + n, f"{p[:600]} {' '.join(items[n % len(items)].split()[:6])} {p[600:]}") for n, p in enumerate(prose)]
    natural = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame([(1000 + n, p) for n, p in enumerate(prose)], "doc_id long, text string"), benchmark).collect()}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(rows + clean, "doc_id long, text string"), benchmark).collect()}
    assert len(planted - got) <= 0.05 * len(planted)
    assert {p for p in got if p[0] >= 1000} <= natural


def test_each_of_many_unrelated_items_is_found_where_it_stands_verbatim(spark):
    texts = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").orderBy("doc_id")
    rng, cuts, used = random.Random(4), [], set()
    for r in texts.select("text").collect():
        words = (r.text or "").split()
        for at in range(0, len(words) - 60, 60):
            cut = " ".join(words[at : at + rng.randrange(15, 60)])
            if len(cuts) < 2000 and cut[:30] not in used:
                used.add(cut[:30])
                cuts.append(cut)
    assert len(cuts) == 2000
    rng.shuffle(cuts)
    held = [(d, " ".join(cuts[d * 4 : d * 4 + 4])) for d in range(500)]
    benchmark = spark.createDataFrame(list(enumerate(cuts)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(held, "doc_id long, text string"), benchmark).collect()}
    assert not {(i // 4, i) for i in range(2000)} - got


def test_a_basis_that_loses_passages_is_refused():
    idf = np.ones(1 << decontam.BITS)
    block = pa.table({"item_id": [1, 2], "text": ["one two three four", "five six seven eight"]})
    passages = [x for *_, x, _ in decontam._passages(block["text"].combine_chunks(), idf)]
    used = np.unique(np.concatenate(passages))
    row_of = np.full(1 << decontam.BITS, -1, np.int32)
    row_of[used] = np.arange(len(used))
    basis = np.zeros((len(used), 1))
    basis[row_of[passages[0]]] = 0.5
    with pytest.raises(ValueError, match="keeps only 0.00"):
        decontam.build_index(block, idf, row_of, basis, idf.astype(np.float32))


def test_odd_rows(spark, odd, none, docs):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    strange = spark.createDataFrame([(1, None), (2, ""), (3, "..."), (4, "one two three"), (4, "one two three")], "item_id long, text string")
    assert decontam.contaminated(odd, benchmark).count() == 0
    assert decontam.contaminated(none, benchmark).count() == 0
    assert decontam.contaminated(docs, benchmark.limit(0)).count() == 0
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, strange).collect()} == {(4, 4), (5, 4)}


def test_a_rewritten_last_sentence_does_not_hide_a_copy(spark):
    import random

    draw = random.Random(12)
    word = lambda: f"w{draw.randrange(10**6)}"
    body, last = " ".join(word() for _ in range(40)), " ".join(word() for _ in range(5))
    other = " ".join(word() for _ in range(5))
    noise = [" ".join(word() for _ in range(80)) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(noise)] + [(100, f"{noise[0]} {body}. {other}. {noise[1]}"), (101, f"{noise[2]} {body[: len(body) // 2]} {noise[3]}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, f"{body}. {last}.")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()] == [(100, 1)]
    answered = items.selectExpr("item_id", "text", f"'{last}' AS answer")
    assert decontam.contaminated(docs, answered).collect() == []


def test_items_of_any_length_and_equal_items(spark):
    draw = random.Random(13)
    prose = lambda n: " ".join(f"w{draw.randrange(20000)}" for _ in range(n))
    long, short = prose(20_000), prose(45)
    words = long.split()
    edited = [f"new{k}" if k % 9 == 0 else w for k, w in enumerate(words)]
    docs = spark.createDataFrame(
        [(1, f"{prose(50)} {long} {prose(50)}"), (2, " ".join(edited)), (3, " ".join(words[:9000])), (4, f"{prose(30_000)} {short} {prose(90)}"), (4, short), (5, prose(500)), (None, short)],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, long), (2, short), (3, short), (3, short)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in decontam.contaminated(docs, items).collect())
    assert got == [(0, 2), (0, 3), (1, 1), (2, 1), (4, 2), (4, 3)]


def test_strips_and_slabs_do_not_change_results(monkeypatch):
    rng = random.Random(5)
    a, b = ([rng.randrange(9) for _ in range(n)] for n in (300, 400))
    whole = decontam.common_subsequence(np.array(a), np.array(b))
    monkeypatch.setattr(decontam, "STRIP", 7)
    assert decontam.common_subsequence(np.array(a), np.array(b)) == whole
    idf = np.ones(1 << decontam.BITS)
    text = " ".join(f"v{rng.randrange(300)}" for _ in range(4000))
    block = pa.table({"item_id": [1], "text": [" ".join(text.split()[2000:2040])]})
    found = list(decontam._passages(block["text"].combine_chunks(), idf))
    row_of = np.full(1 << decontam.BITS, -1, np.int32)
    row_of[found[0][2]] = np.arange(len(found[0][2]))
    index = decontam.build_index(block, idf, row_of, np.linalg.qr(found[0][3][:, None])[0], idf.astype(np.float32))
    w, bucket = decontam._words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    places = list(decontam._windows(index, w, bucket, 0.5))
    monkeypatch.setattr(decontam, "SLAB", 16)
    assert places and [p[:3] for p in decontam._windows(index, w, bucket, 0.5)] == [p[:3] for p in places]


def test_every_pair_that_covers_an_item_word_by_word_is_found(docs, spark):
    """All documents against all items by the plain table, without any search."""
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()}
    texts = [(r.doc_id, (r.text or "").lower().split()) for r in docs.select("doc_id", "text").collect()]
    wanted = set()
    for item in benchmark.collect():
        words = (item.text or "").lower().split()
        mine = set(words)
        for doc, have in texts:
            near = [k for k, x in enumerate(have) if x in mine]
            if len(near) < 0.9 * len(words):
                continue
            for at in range(0, max(1, len(have) - len(words) + 1)):
                here = have[at : at + len(words)]
                if sum(x == y for x, y in zip(here, words, strict=False)) >= 0.9 * len(words):
                    wanted.add((doc, item.item_id))
                    break
    assert wanted and wanted <= found


def test_the_rank_is_the_least_that_keeps_each_passage():
    vectors = np.array([[0.95, 0.3, 0.08], [0.2, 0.92, 0.34]])
    assert decontam.least_rank(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) == 2
    assert decontam.least_rank(np.eye(3)) == 3
