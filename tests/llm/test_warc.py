import gzip
import hashlib
import io

import pytest

from wellspring.llm import warc

PAGE = "page_id long, url string, html string, digest string, payload int"


def test_round_trip(spark):
    big = "é" * 90_000
    rows = [
        (5, "u5", "x" * 100), (3, "u3", "x" * 100), (9, None, "x" * 100), (4, "u4", "y" * 99), (6, "u6", "y" * 99),
        (7, "a\r\nWARC-Type: revisit", ""), (8, "u8", None), (10, "u10", big), (11, "u11", big), (12, "u12", "a\r\n\r\nb"), (12, "u12", "a\r\n\r\nb"),
        (None, "u", "z"),
    ]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], PAGE)
    folder = warc.new_folder(spark)
    got = warc.read_archives(warc.write_archives(pages, folder), folder).collect()
    answer = {"x" * 100: 3, big: 10}
    expected = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        to = answer.get(html, page_id)
        expected.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if to == page_id else "revisit", None if to == page_id else to))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(expected, key=str)


def test_empty_table(spark):
    folder = warc.new_folder(spark)
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGE), folder), folder).count() == 0


def _archive(n=3):
    payload = [f"page {i} ".encode() * 9000 for i in range(n)]
    return b"".join(warc.member(i, f"u{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payload))


def test_each_record_is_a_member_and_has_its_position():
    data = _archive()
    records = list(warc.read_records(io.BytesIO(data)))
    assert [r["page_id"] for r in records] == [0, 1, 2]
    for r in records:
        assert next(warc.read_records(io.BytesIO(data[r["position"] :])))["page_id"] == r["page_id"]


def test_damage_is_noticed():
    data = _archive(1)
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-20])))
    plain = gzip.decompress(data)
    for old, new in ((b"page 0 page", b"page 1 page"), (b"Content-Length: 6", b"Content-Length: 5")):
        with pytest.raises(ValueError):
            list(warc.read_records(io.BytesIO(gzip.compress(plain.replace(old, new, 1)))))
