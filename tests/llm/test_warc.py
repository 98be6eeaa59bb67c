import base64
import hashlib
import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from loomwright.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_round_trip(spark):
    random.seed(1)
    html = [f"<p>{random.randint(0, 40)}</p>" * random.randint(0, 50) for _ in range(300)] + [None, "", "é" * 100_000, "a\r\n\r\nWARC/1.1"]
    rows = [(i, f"http://x/{i} \r\nA: b", h, "x") for i, h in enumerate(html)] + [(None, None, "lonely", "x"), (5, "http://x/5", html[5], "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    largest = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        largest[b] = max(largest.get(b, -1), -1 if i is None else i)
    of = {r[0]: (r[2] or "").encode() for r in rows}
    for r in got:
        b = of[r["page_id"]]
        revisit = r["page_id"] is not None and largest[b] != r["page_id"]
        expected = (len(b), digest(b), "revisit" if revisit else "response", largest[b] if revisit else None)
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == expected
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_ids_of_any_text(spark):
    ids = ["a b", "", "none", "<x>", "é/ü%20+&", "7", None]
    pages = spark.createDataFrame([(i, None, f"page {k // 2}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()}
    assert set(got) == set(ids)
    assert got["a b"] == ("response", None) and got[""] == ("revisit", "a b") and got["none"] == ("response", None) and got["<x>"] == ("revisit", "none")
    assert got["é/ü%20+&"] == ("response", None) and got["7"] == ("revisit", "é/ü%20+&") and got[None] == ("response", None)


def test_payloads_come_back(spark):
    pages = spark.createDataFrame([(i, "http://x", "y" * i) for i in range(50)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, file_bytes=500)).collect()
    assert sorted(bytes(r["payload"]) for r in got) == sorted(b"y" * i for i in range(50)) and all(r["error"] is None for r in got)


@pytest.mark.parametrize(
    "damage",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Data"),
        lambda r: r.replace(b"hello", b"hellO"),
        lambda r: r[:-2],
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: nothing"),
        lambda r: r.replace(b"\r\nWARC-Date", b"\r\nno colon\r\nWARC-Date"),
    ],
)
def test_bad_records(damage):
    good = warc.make_record("<urn:page:1>", "http://x", b"hello")
    assert warc.parse_record(good)["payload"] == b"hello"
    with pytest.raises(ValueError):
        warc.parse_record(damage(good))


def test_frames():
    out = io.BytesIO()
    out.close_, out.close = out.close, lambda: None
    w = warc.ArchiveWriter(out, 3)
    records = [warc.make_record(f"<urn:page:{i}>", "http://x", b"z" * i) for i in range(500)]
    for r in records:
        w.add(r)
    w.close()
    data = out.getvalue()
    assert list(warc.read_frames(io.BytesIO(data))) == records
    size = int.from_bytes(data[4:8], "little")
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + size])  # a compressed dictionary is read too
    again = data[:4] + len(packed).to_bytes(4, "little") + packed + data[8 + size :]
    assert list(warc.read_frames(io.BytesIO(again))) == records
    for bad in (data[:-3], b"", data[8 + size :], data[:-20] + b"\0" * 20):
        with pytest.raises(ValueError):
            list(warc.read_frames(io.BytesIO(bad)))


def test_permissive(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(b"nonsense")
    paths = spark.createDataFrame([(f"file://{tmp_path}/x.warc.zst",)], "path string")
    rows = warc.read_archives(paths, permissive=True).collect()
    assert len(rows) == 1 and rows[0]["error"] and rows[0]["record_type"] is None
    with pytest.raises(Exception, match="dictionary frame|within a frame"):
        warc.read_archives(paths).select(F.count("*")).collect()
