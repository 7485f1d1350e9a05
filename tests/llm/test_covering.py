import random
import re

import numpy as np
import pytest
import xxhash

from wellspring.llm import covering


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(fps, ids=None):
    """Smallest id (of a fingerprint's own, or the value itself) reachable over pairs within three bits."""
    values = sorted(set(fps))
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    out = {}
    for v in values:
        out.setdefault(root(v), []).append(v)
    return {v: part for part in out.values() for v in part}


def _brute(rows):
    fps = [(d, _fingerprint(t)) for d, t in rows]
    part = _components([f for _, f in fps])
    least = {}
    for d, f in fps:
        key = part[f][0]
        if d is not None:
            least[key] = min(d, least.get(key, d))
    return sorted(((d, f, least.get(part[f][0])) for d, f in fps), key=str)


def _got(frame):
    return sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in frame.collect()), key=str)


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert _got(covering.near_duplicates(docs)) == _brute(rows)


def test_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert _got(covering.near_duplicates(odd)) == _brute(rows)


def test_no_rows(none):
    assert covering.near_duplicates(none).collect() == []


def test_a_text_in_pieces_has_the_same_fingerprint(monkeypatch):
    text = ("\t".join(f"Wörter{i % 911}  {i}" for i in range(3000)) + " ").encode()
    whole = covering.fingerprint(text)
    assert whole == _fingerprint(text.decode())
    for size in (1, 7, 1000):
        monkeypatch.setattr(covering, "PIECE", size * 16)
        assert covering.fingerprint(text) == whole


@pytest.mark.parametrize("agreed", [0, *covering.cover()[:2], covering.covers(1)[3][5]])
def test_every_close_pair_shares_a_mask(agreed):
    masks = covering.cover(agreed)
    open_ = [b for b in range(64) if not agreed >> b & 1]
    draw = random.Random(1)
    for _ in range(3000):
        gap = sum(1 << b for b in draw.sample(open_, min(3, len(open_))))
        assert any(not gap & m for m in masks)
    assert all(m & agreed == agreed for m in masks)


def test_the_last_cover_leaves_few_open_positions():
    assert max(64 - m.bit_count() for part in covering.covers(covering.COVERS - 1) for m in part) <= 8


@pytest.mark.parametrize("bucket", [3, 1024])
def test_crowded_buckets_lose_no_link(spark, bucket):
    draw = random.Random(5)
    fps = set()
    for _ in range(6):
        x = draw.getrandbits(64)
        for _ in range(60):
            fps.add(x)
            x ^= sum(1 << b for b in draw.sample(range(64), draw.choice([1, 2, 3, 4])))
    base = draw.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in draw.sample(range(20), draw.randint(0, 12))) for _ in range(500)}
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    links = covering.links(spark.createDataFrame(signed, "fp long"), bucket=bucket).collect()
    assert all(((r.a ^ r.b) % 2**64).bit_count() <= 3 for r in links)
    want = _components(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        parent[root(r.a % 2**64)] = root(r.b % 2**64)
    got = {}
    for f in sorted(fps):
        got.setdefault(root(f), []).append(f)
    assert sorted(got.values()) == sorted({tuple(v): v for v in want.values()}.values())
