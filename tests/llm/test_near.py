import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import near
from wellspring.llm.components import components
from wellspring.llm.tables import stored


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distance_and_bounds():
    rng = random.Random(3)
    for _ in range(60):
        a = [rng.randrange(30) for _ in range(rng.randrange(0, 60))]
        b = [x for x in a if rng.random() > 0.1]
        for _ in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(30))
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        true = _distance(a, b)
        for most in (0, 3, 8, 70):
            assert near.edit_distance(x, y, most) == min(true, most + 1)
        assert near._anchored(x, y, 100) >= true
        longer = max(len(a), len(b))
        assert near.similar(x, y, 0.9) == (true <= int(0.1 * longer + 1e-9))


def _family(spark, n_copies, n_words=120, edits=3):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(n_words)]
    rows = [(0, " ".join(base))]
    for d in range(1, n_copies + 1):
        words = list(base)
        for i in rng.sample(range(n_words), edits):
            words[i] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    for d in range(1000, 1040):
        rows.append((d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(n_words))))
    return rows


def test_family_is_one_class_and_others_stay_apart(spark):
    rows = _family(spark, 60)
    shared = " ".join(rows[0][1].split()[:60])
    rows += [(d, f"{shared} " + " ".join(f"z{d}x{i}" for i in range(70))) for d in range(2000, 2020)]
    got = {r.doc_id: r for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[d].class_id for d in range(61)} == {0}
    assert all(r.class_id == d and r.kept for d, r in got.items() if d >= 1000)
    assert sum(r.kept for r in got.values()) == 1 + 40 + 20


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _brute(rows):
    """Class of each row by all pairs: words are compared as numbers, cheap bounds first."""
    seqs = [_words(t) for _, t in rows]
    ids = {w: i for i, w in enumerate(sorted({w for s in seqs for w in s}))}
    coded = [np.array([ids[w] for w in s], np.uint32) for s in seqs]
    counts = [Counter(s) for s in seqs]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = max(len(seqs[i]), len(seqs[j]))
            if root(i) == root(j) or 5 * min(len(seqs[i]), len(seqs[j])) < 4 * n:
                continue
            if 5 * sum((counts[i] & counts[j]).values()) >= 4 * n and near.edit_distance(coded[i], coded[j], n // 5) <= n // 5:
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        classes[root(i)].append(d)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in classes.items()}
    return sorted([(d, least[root(i)]) for i, (d, _) in enumerate(rows)], key=str)


def _check(frame):
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    got = near.near_duplicates(frame).collect()
    assert sorted([(r.doc_id, r.class_id) for r in got], key=str) == _brute(rows)
    kept = [r.class_id for r in got if r.kept]
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    return len(kept)


def test_classes_match_all_pairs(docs):
    _check(docs)


def _crowd(spark):
    """Copies of copies, a passage that many texts share, and a text of another length in the same buckets."""
    rng = random.Random(11)
    rows, base = [], [f"b{rng.randrange(10**6)}" for _ in range(80)]
    for d in range(90):
        words = list(base) if d % 3 else rows[rng.randrange(len(rows))][1].split() if rows else list(base)
        for i in rng.sample(range(len(words)), rng.choice([2, 7, 13])):
            words[i] = f"n{rng.randrange(10**6)}"
        rows.append((d, " ".join(words)))
    passage = " ".join(base[:40])
    rows += [(d, f"{passage} " + " ".join(f"z{d}x{i}" for i in range(40))) for d in range(200, 260)]
    rows += [(d, f"{passage} " + " ".join(f"y{d % 4}x{i + d % 3}" for i in range(30))) for d in range(300, 330)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block, large", [(8, 1), (16, 3), (1024, 16)])
def test_large_buckets_are_shared_out_without_loss(spark, monkeypatch, block, large):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "LARGE", large)
    _check(_crowd(spark))


def test_links_of_a_search_are_fewer_than_members(spark):
    crowd = _crowd(spark)
    source = crowd.select(F.col("doc_id").alias("node"), "text")
    tokens = stored(source.mapInArrow(near._tokens, "node long, tokens binary"))
    sizes = {r.node: len(r.tokens) // 4 for r in tokens.collect()}
    one = spark.createDataFrame([(7, n, k, n) for n, k in sizes.items()], "grp long, node long, n_words long, label long")
    links = near._searched(one, tokens, 0.8).count()
    assert 0 < links < len(sizes)


def test_prefixes_of_close_texts_meet():
    rng, rarity = random.Random(2), np.arange(1 << near.RARITY_BITS)[::-1].copy()
    for _ in range(300):
        a = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(int(0.2 * len(a))):
            b[rng.randrange(len(b))] = rng.randrange(40)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        assert np.intersect1d(near.prefix(x, rarity, 0.8), near.prefix(y, rarity, 0.8)).size


def test_rows_of_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "k l m n o p q"), (5, "a b c d e f x"), (7, "k l m n o p q"), (7, "k l m n o p q"),
            (None, "a b c d e f y"), (None, "u v w"), (None, "u v w"), (9, None), (9, "")]
    assert _check(spark.createDataFrame(rows, "doc_id long, text string")) == 4


@pytest.mark.parametrize("low, high", [(11, 31), (60, 301)])
def test_evenly_spaced_edits_are_linked(spark, low, high):
    rng, rows, pairs = random.Random(high), [], 400
    for d in range(pairs):
        n = rng.randrange(low, high)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        at = rng.randrange(5)
        b = [f"n{rng.randrange(10**6)}" if i % 5 == at and i // 5 < n // 5 else w for i, w in enumerate(a)]
        rows += [(2 * d, " ".join(a)), (2 * d + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * d + 1] == 2 * d for d in range(pairs)) >= 0.95 * pairs


def test_scattered_edits_at_the_given_similarity_are_linked(spark):
    rng, rows, pairs = random.Random(8), [], 300
    for d in range(pairs):
        n = rng.randrange(60, 300)
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for i in rng.sample(range(n), int(rng.uniform(0.15, 0.2) * n)):
            b[i] = f"n{rng.randrange(10**6)}"
        rows += [(2 * d, " ".join(a)), (2 * d + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * d + 1] == 2 * d for d in range(pairs)) >= 0.97 * pairs
    assert all(c // 2 == d // 2 for d, c in got.items())


def test_short_texts_are_linked_over_one_edit_anywhere(spark):
    rows = []
    for n in range(4, 10):
        for i in range(n):
            words = [f"t{n}x{i}w{k}" for k in range(n)]
            d = 100 * (10 * n + i)
            rows += [(d, " ".join(words)), (d + 1, " ".join([*words[:i], "other", *words[i + 1 :]])), (d + 2, " ".join([*words[:i], "more", *words[i:]]))]
    got = {r.doc_id: r.class_id for r in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, c in got.items():
        alone = d // 1000 == 4 and d % 100 == 1  # one of four words is 0.75
        assert c == (d - d % 100 if not alone else c)
    assert sum(c == d for d, c in got.items() if d % 100 == 2) == 0


def test_odd_rows(odd, none):
    got = [(r.doc_id, r.class_id) for r in near.near_duplicates(odd).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 4), (6, 6), (7, 6), (None, None), (8, 8), (9, 9), (10, 10)], key=str
    )
    assert near.near_duplicates(none).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501)], "a long, b long")
    got = {r.node: r.label for r in components(links).collect()}
    assert got == {i: 0 for i in range(101)} | {500: 500, 501: 500}
