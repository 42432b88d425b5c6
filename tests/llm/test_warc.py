import base64
import gzip
import hashlib
import io

import pytest

from webloom.llm import registry, warc


def expected(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        revisit = i is not None and i < last[html or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return sorted(out, key=str)


def result(df):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()], key=str)


def test_round_trip(spark, tmp_path):
    rows = [(1, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "a\r\nb", None), (4, "x", ""), (4, "x", ""), (5, "v", "y" * 300_000), (None, "n", "<p>é</p>"), (6, "r", "WARC/1.1\r\n\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write(warc.mark_revisits(pages), f"file://{tmp_path}/w")
    got = warc.scan(archives)
    assert result(got) == expected(rows)
    payloads = {r.page_id: bytes(r.payload) for r in got.filter("record_type = 'response'").collect()}
    assert payloads[5] == b"y" * 300_000 and payloads[6] == b"WARC/1.1\r\n\r\n\r\n"
    assert archives.agg({"n_records": "sum"}).first()[0] == len(rows)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(registry.op5_warc(spark, sf)) == expected(rows)


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.scan(warc.write(warc.mark_revisits(pages), f"file://{tmp_path}/e")).count() == 0


def test_one_member_per_record_and_damage_is_told():
    a, b = warc.record(1, "u", b"abc" * 1000, None), warc.record(2, "u", b"abc" * 1000, 1)
    assert gzip.decompress(a).count(b"WARC/1.1") == 1
    assert len(list(warc.records(io.BytesIO(a + b)))) == 2
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(a[:-20])))
    text = gzip.decompress(a)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(text.replace(b"abcabc", b"abcabd", 1)))))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(gzip.compress(text.replace(b"Content-Length: 3", b"Content-Length: 2", 1)))))


def test_members_hold_one_record_each():
    a, b = warc.record(1, "u", b"abc" * 1000, None), warc.record(2, "u", b"xyz" * 70_000, None)
    both = gzip.compress(gzip.decompress(a) + gzip.decompress(b))
    with pytest.raises(ValueError, match="more than its record"):
        list(warc.records(io.BytesIO(both)))
    text = gzip.decompress(b)
    with pytest.raises(ValueError, match="beyond its gzip member"):
        list(warc.records(io.BytesIO(gzip.compress(text[:100_000]) + gzip.compress(text[100_000:]))))


@pytest.mark.parametrize("kind", ["digest", "bytes", "two", "start"])
def test_reading_goes_on_after_damage(spark, tmp_path, kind):
    a, b, c = (warc.record(i, "u", bytes([64 + i]) * 90_000, None) for i in (1, 2, 3))
    broken = {
        "digest": gzip.compress(gzip.decompress(b).replace(b"BBBB", b"BBBC", 1)), "bytes": b[:40] + b"\x00\xff" * 8 + b[56:],
        "two": gzip.compress(gzip.decompress(b) * 2), "start": gzip.compress(b"WRAC/1.1\r\n" + gzip.decompress(b)[10:]),
    }[kind]
    (tmp_path / "x.warc.gz").write_bytes(a + broken + c)
    wrong: list[str] = []
    assert [f["warc-record-id"] for f, _ in warc.records(io.BytesIO(a + broken + c), wrong)] == ["<urn:page:1>", "<urn:page:3>"] and wrong
    archives = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz",)], "path string")
    assert sorted(r.page_id for r in warc.scan(archives, strict=False).collect()) == [1, 3]
    told = warc.damaged(archives).first()
    assert told.n_records == 2 and len(told.errors) >= 1
    with pytest.raises(Exception):
        warc.scan(archives).collect()
