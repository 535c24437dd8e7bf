import gzip
import hashlib
import io

import pytest

from spindrift.llm import warc

BIG, OTHER = "é" * 700, "b" * 1000
PAGES = [(1, "http://a/ b", BIG), (2, None, "small"), (3, "http://c", BIG), (9, "http://d", BIG), (9, "http://d", BIG), (4, "x", "small"), (5, "y", None), (6, "z", ""), (7, "u", OTHER), (8, "v", OTHER[:-1]), (None, "n", BIG), (10, "w", "\r\n\r\nWARC/1.1" * 30_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, digest string").repartition(4)
    rows = warc.warc_round_trip(df, archive_bytes=2000).collect()
    assert len(rows) == len(PAGES)
    for key, _, html in PAGES:
        data = (html or "").encode()
        last = max(k for k, _, h in PAGES if h == html and k is not None)
        revisit = len(data) >= 1000 and key != last
        for r in (r for r in rows if r.page_id == key):
            assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None)
            assert r.payload == (None if revisit else data)
    assert warc.warc_round_trip(df.limit(0)).collect() == []


def test_archive_is_plain_gzip_members_and_damage_is_found():
    one = warc.record_bytes(1, "u", b"abc", None, False, "1970-01-01T00:00:00Z")
    two = warc.record_bytes(2, "u", b"x" * 200_000, 7, True, "1970-01-01T00:00:00Z")
    assert gzip.decompress(one + two).count(b"WARC/1.1") == 2
    got = list(warc.read_records(io.BytesIO(one + two)))
    assert [r["record_type"] for r in got] == ["response", "revisit"] and got[1]["payload_bytes"] == 200_000
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(io.BytesIO(one[:-9])))
    plain = gzip.decompress(one)
    for bad, what in ((plain.replace(b"abc", b"abd"), "digest"), (plain.replace(b"abc", b"ab"), "shorter"), (plain.replace(b"abc", b"abcd"), "longer")):
        with pytest.raises(ValueError, match=what):
            list(warc.read_records(io.BytesIO(gzip.compress(bad))))
