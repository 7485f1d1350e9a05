import numpy as np

from wellspring.llm import substring
from wellspring.llm.words import from_planes, planes, rolling, words_of


def _brute(rows, window):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        out.append((doc_id, len(words), sum(gone), kept))
    return sorted(out)


def _got(frame):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in frame.collect())


def _rows(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_matches_brute_force(docs):
    for window in (20, 6):
        assert _got(substring.remove_repeats(docs, window)) == _brute(_rows(docs), window)


def test_odd_rows(odd, none):
    real = odd.where("doc_id > 0")
    assert _got(substring.remove_repeats(real)) == _brute(_rows(real), 20)
    assert substring.remove_repeats(odd).where("doc_id IS NULL").first().kept_text == "no number here"
    assert substring.remove_repeats(none).count() == 0


def test_spans_are_what_is_removed(docs):
    for row in substring.remove_repeats(docs).where("n_removed > 0").collect():
        assert sum(s.end - s.start for s in row.repeats) == row.n_removed


def test_word_hashes_depend_on_the_word_alone():
    data = b"ab  cd ab\nab" + b"y" * 50 + b" ab"
    w = words_of(np.frombuffer(data, np.uint8), np.array([0, 10, len(data)]))
    assert [data[a:b] for a, b in zip(w.starts, w.ends, strict=True)] == [b"ab", b"cd", b"ab", b"ab" + b"y" * 50, b"ab"]
    assert w.hashes[0] == w.hashes[2] == w.hashes[4] != w.hashes[1]
    assert list(w.first) == [0, 3, 5]
    assert len(set(rolling(w.hashes, 2).tolist())) == 4


def test_planes_round_trip():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 47, 1000).astype(np.uint64))
    assert (from_planes(planes(values, 6), 6) == values).all()


def test_ranges_follow_the_values_and_not_their_number():
    values = np.sort(np.random.default_rng(2).integers(0, 1 << 46, 500).astype(np.uint64))
    for bits in (1, 4, 20, 31):
        ranges, cuts = substring._ranges(values, 46, bits)
        assert len(ranges) <= len(values) and cuts[0] == 0 and cuts[-1] == len(values)
        for r, a, b in zip(ranges, cuts[:-1], cuts[1:], strict=True):
            assert set((values[a:b] >> np.uint64(46 - bits)).tolist()) == {int(r)}
    assert [len(x) for x in substring._ranges(values[:0], 64, 5)] == [0, 1]
