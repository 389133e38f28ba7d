import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from wayloom.llm import warc
from wayloom.session import scratch_path

SCHEMA = "page_id long, url string, html string, payload string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def expected(rows, min_bytes=0):
    groups = {}
    for key, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(key)
    out = []
    for key, _, html in rows:
        payload = (html or "").encode()
        ids = [k for k in groups[payload] if k is not None]
        first = max(ids, default=None)
        revisit = first is not None and key != first and len(payload) >= min_bytes
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((key, len(payload), digest, "revisit" if revisit else "response", first if revisit else None))
    return out


def got(frame):
    rows = frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted(map(tuple, rows), key=str)


ROWS = [
    (1, "http://a.example/1", "<p>one</p>"),
    (2, "http://a.example/2", "<p>one</p>"),
    (3, "http://a.example/3\r\nX: y z", "two\r\n\r\nlines é"),
    (4, None, None),
    (5, "http://a.example/5", ""),
    (None, "http://a.example/n", "<p>one</p>"),
    (None, "http://a.example/m", "only without id"),
    (7, "http://a.example/7", "x" * 3_000_000),
    (7, "http://a.example/7", "x" * 3_000_000),
    (6, "http://a.example/6", "x" * 3_000_000),
]


@pytest.mark.parametrize("min_bytes", [0, 11])
def test_round_trip(spark, min_bytes):
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, ROWS), path, min_bytes=min_bytes)
    want = sorted(expected(ROWS, min_bytes), key=str)
    for payload in ("bytes", "digest", "none"):
        assert got(warc.read(spark, path, payload)) == want
    texts = {
        (r["page_id"], bytes(r["payload"]).decode())
        for r in warc.read(spark, path).where("record_type = 'response'").collect()
    }
    kept = {(k, h or "") for (k, _, h), e in zip(ROWS, expected(ROWS, min_bytes)) if e[3] == "response"}
    assert texts == kept
    uris = {r[0] for r in warc.read(spark, path, "none").select("target_uri").collect()}
    assert "http://a.example/3%0D%0AX:%20y%20z" in uris


def test_filters_reach_the_reader(spark):
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, ROWS), path)
    found = warc.read(spark, path, "digest").where("record_type = 'revisit'")
    assert found.count() == sum(e[3] == "revisit" for e in expected(ROWS))
    assert warc.read(spark, path).where(F.col("page_id").isin(3, 5)).count() == 2
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, IsNotNull

    rest = [IsNotNull(("record_type",)), EqualTo(("payload_bytes",), 3)]
    assert list(reader.pushFilters([EqualTo(("record_type",), "revisit"), *rest])) == rest
    assert reader.tests == [("record_type", frozenset(["revisit"]))]


def raw(**row):
    base = {"record_type": "response", "page_id": 1, "url": "http://x/", "refers_to": None}
    payload = row.pop("payload", b"body")
    base |= {"payload": payload, "payload_bytes": len(payload), "sha1": hashlib.sha1(payload).hexdigest()}
    return warc.record(base | row)


@pytest.mark.parametrize("pack", [warc.member, gzip.compress])
def test_unwanted_records_are_stepped_over(pack):
    members = [pack(raw(page_id=i, payload=bytes([65 + i]) * 50_000)) for i in range(4)]
    source = io.BytesIO(b"".join(members))
    size = len(source.getvalue())
    found = list(warc.records(source, size, lambda r: r["page_id"] in (1, 3), "bytes"))
    assert [(r["page_id"], r["payload"]) for r in found] == [(1, b"B" * 50_000), (3, b"D" * 50_000)]
    assert gzip.decompress(source.getvalue()).count(b"WARC/1.1") == 4


def test_damaged_payloads_are_found():
    data = raw(payload=b"body").replace(b"body", b"bodi")
    packed = warc.member(data)
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(packed), len(packed), lambda r: True, "digest"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(packed[:-30]), len(packed) - 30, lambda r: True, "digest"))


def test_empty_table(spark):
    path = scratch_path(spark, "warc")
    warc.archive(table(spark, []), path)
    assert warc.read(spark, path).count() == 0


def test_query_on_whole_pages(spark, folder):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    assert got(warc.op9_warc(spark, folder)) == sorted(expected(rows), key=str)
