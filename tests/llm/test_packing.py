import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wellspring.llm import packing
from wellspring.llm.queries import tokenizer_path


def _ids(text):
    return [*packing._tokenizer(tokenizer_path()).encode(text or "", add_special_tokens=False).ids, 2]


def _check(frame, capacity):
    texts = defaultdict(list)
    for r in frame.select("doc_id", "text").collect():
        texts[r.doc_id].append(_ids(r.text))
    pieces = packing.pack_documents(frame, tokenizer_path(), capacity).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").size == p.length and zlib.crc32(p.ids) == p.ids_crc32
        by_doc[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    assert by_doc.keys() == texts.keys()
    for doc, ids in texts.items():
        assert sorted(x for _, part, _ in by_doc[doc] for x in part) == sorted(x for one in ids for x in one)
        if len(ids) == 1:
            assert [x for _, part, _ in sorted(by_doc[doc]) for x in part] == ids[0]
            assert {n for *_, n in by_doc[doc]} == {len(ids[0])}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sum(p.length for p in pieces) / capacity / len(by_sequence)


def test_every_id_in_one_piece_with_little_padding(docs):
    assert _check(docs, 512) > 0.97


def test_odd_rows(odd, none):
    _check(odd, 4096)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_words_give_the_ids_of_the_whole_text():
    texts = ["It's DON'T\u00a0x\u2003y <|endoftext|> z", "İSTANBUL ΣΑΣ e\u0301 \u0301a", "a\x0bb\x1cc\x85d", "", "  ", None, "日本語 текст"]
    got = [x.tolist() for x in packing.tokenise(pa.array(texts, pa.string()), tokenizer_path(), 2)]
    assert got == [_ids(t) for t in texts]


@pytest.mark.parametrize("seed", range(5))
def test_tree_is_first_fit_decreasing(seed):
    lengths = np.random.default_rng(seed).integers(1, 100, 300)
    room, expected = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(100)
        expected[i] = (at, 100 - room[at])
        room[at] -= lengths[i]
    sequence, offset = packing.first_fit_decreasing(lengths, 100)
    assert {i: (sequence[i], offset[i]) for i in range(300)} == expected
