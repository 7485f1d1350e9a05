import hashlib
from collections import defaultdict

import pytest

from wellspring.llm import exact


def _brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted(
        (d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for d in ids
    )


def _got(frame):
    return sorted(tuple(r)[:5] for r in frame.collect())


def _rows(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_matches_grouping_by_text(docs):
    assert _got(exact.exact_duplicates(docs)) == _brute(_rows(docs))


def test_collisions_are_told_apart(docs):
    weak = exact.exact_duplicates(docs, primes=(2, 3))
    assert _got(weak) == _brute(_rows(docs))


def test_texts_in_parts_have_the_same_fingerprint(odd):
    key = ["doc_id", "h1", "h2", "n_bytes"]
    whole = sorted(map(tuple, exact.fingerprints(odd.where("doc_id > 0")).select(key).collect()))
    parts = sorted(map(tuple, exact.fingerprints(odd.where("doc_id > 0"), huge=1 << 12).select(key).collect()))
    assert whole == parts


def test_parts_compose():
    data, p, b = bytes(range(256)) * 700 + b"x", *[exact.PRIMES[0], exact.BASES[0]]
    left, right = data[:65536], data[65536:]
    joined = exact.fingerprint(memoryview(left), p, b) * pow(b, (len(right) + 1) // 2, p)
    assert exact.fingerprint(memoryview(data), p, b) == (joined + exact.fingerprint(memoryview(right), p, b)) % p


def test_odd_rows(odd, none):
    assert _got(exact.exact_duplicates(odd.where("doc_id > 0"))) == _brute(_rows(odd.where("doc_id > 0")))
    alone = exact.exact_duplicates(odd).where("doc_id IS NULL").first()
    assert alone.keep_id is None and alone.kept
    assert exact.exact_duplicates(none).count() == 0


def _settled(rows, primes=exact.PRIMES):
    """By text: size, the largest id (null last), and exactly one row kept."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for ids in groups.values():
        best = max((d for d in ids if d is not None), default=None)
        first = True
        for d in sorted(ids, key=lambda d: d != best):
            out.append((d, best, len(ids), first))
            first = False
    return sorted(out, key=str)


ODD = [
    [(1, "a b c"), (1, "zzz"), (5, "a b c")],
    [(1, "x"), (1, "x"), (1, "x"), (1, "y"), (2, "y"), (2, "x")],
    [(None, "x"), (None, "x"), (None, "y"), (3, "y"), (None, None), (4, "")],
    [(None, "n"), (None, "n"), (None, "m")],
]


@pytest.mark.parametrize("rows", ODD)
@pytest.mark.parametrize("primes", [exact.PRIMES, (2, 3)])
def test_repeated_and_null_ids(spark, rows, primes):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r)[:4] for r in exact.exact_duplicates(frame, primes=primes).collect()]
    assert sorted(got, key=str) == _settled(rows)
