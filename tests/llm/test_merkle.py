import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wellspring.llm import merkle, queries

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _tree(level):
    """Root, and for each leaf its sibling segments from below."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 8 * 8
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 8])))
        at = [i // 8 for i in at]
        level = [_sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], paths


def _brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [_tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    if not trees:
        return []
    root, tops = _tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), top in zip(order, trees, tops, strict=True):
        for (_, _, leaf, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            whole = path + top
            h = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                h = _leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in whole:
                h = _sha(left + h + right)
            out.append((r[0], leaf, subroot, root, _sha("".join(a + b for a, b in whole)), h, h == root))
    return out


def _got(spark, tmp_path, rows, extra=False):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    frame = spark.createDataFrame(rows, schema)
    if extra:
        frame = frame.withColumns({c: F.lit(7) for c in ("grp", "hash", "load", "pos", "size", "left", "leaf", "root")})
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    return [tuple(r) for r in queries.op13_merkle(spark, str(tmp_path)).collect()]


def _key(r):
    return tuple((v is not None, v) for v in r)


def test_matches_brute_force_on_documents(spark, docs, tmp_path):
    rows = [tuple(r) for r in docs.select(COLUMNS).collect()]
    assert sorted(_got(spark, tmp_path, rows, True), key=_key) == sorted(_brute(rows), key=_key)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rows = []
    for lang, n in (("aa", 1), ("bb", 8), ("cc", 9), ("dd", 64), ("ee", 65), (None, 514), ("", 2), ("é", 7), ("z", 1), ("zz", 3)):
        rows += [(i - 5, None if i % 3 else "S", lang, i, None if i % 7 == 6 else f"Text {i} É") for i in range(n)]
    assert sorted(_got(spark, tmp_path, rows), key=_key) == sorted(_brute(rows), key=_key)


def test_odd_rows(spark, tmp_path):
    long = "Word " * 50_000
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", 0, ""), (1, "", "en", 0, "a"),
            (1, "", "en", 0, "a"), (2, "s", "en", 3, long), (3, "s", "en", -3, "ABC")]
    got = _got(spark, tmp_path, rows)
    assert sorted(got, key=_key) == sorted(_brute(rows), key=_key)


def test_one_row_is_its_own_root(spark, tmp_path):
    rows = [(1, "a", "en", 1, "A")]
    [found] = _got(spark, tmp_path, rows)
    assert found == _brute(rows)[0] and found[1] == found[2] == found[3] and found[4] == _sha("")


def test_no_rows(spark, tmp_path):
    assert _got(spark, tmp_path, []) == []
