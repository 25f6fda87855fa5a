"""WARC archives: round trips against the given rows, foreign archives, odd input."""

import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from costlens.llm import warc

TRAP = "before\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nafter"
HOT = "<html>the same page everywhere é</html>"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        html = html or ""
        again = len(html.encode()) >= least and first.get(html) != i
        out.append((i, len(html.encode()), digest(html), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def pages():
    rows = [(i, f"http://h{i % 5}.example.org/p/{i}?q#f", f"<p>page {i} 漢\U0001f600</p>" * (i % 9)) for i in range(60)]
    rows += [(1000 + i, "https://hot.example.net", HOT) for i in range(40)]
    rows += [(5, "http://again.example.org/", "page five once more"), (5, "http://again.example.org/", "page five once more"), (7, None, "page five once more")]
    rows += [(None, "http://no.id/", "no id"), (None, None, "no id"), (None, "x", "no id either"), (2, "not a url", "no id either"), (-4, "ftp://f", TRAP)]
    rows += [(300, "http://line\r\nX-Evil: 1/", TRAP), (301, "", None), (302, "http://long/", "long ü " * 60000), (303, "http://nul/", "\x00 nul \x1f")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string")
    return df.withColumn("first", F.lit("clash")).withColumn("copies", F.lit(9)).withColumn("value", F.lit("clash")).repartition(6)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(table, least):
    assert sorted(map(tuple, warc.archived(table, least).collect()), key=str) == want(pages(), least)


@pytest.mark.parametrize("compression,file_bytes", [("gzip", 64 << 20), ("none", 3000)])
def test_nested_captures_hold_everything(spark, table, tmp_path, compression, file_bytes):
    path = str(tmp_path / "archive")
    warc.write(table, path, compression=compression, file_bytes=file_bytes)
    records = warc.read_records(spark, path, payload=True).cache()
    rows = warc.transactions(records).collect()
    assert len(rows) == len(pages()) and {len(r.requests) for r in rows} == {len(r.metadata) for r in rows} == {1}
    assert len({r.record_id for r in records.collect()}) == 3 * len(pages())
    got = sorted(((r.metadata[0].fields.get("page-id"), r.target_uri, r.payload.decode()) for r in rows if r.type == "response"), key=str)
    assert all(r.digest_ok for r in rows if r.type == "response") and not [r for r in rows if r.type == "revisit" and r.payload]
    kept = {(k[0], k[1]) for k in want(pages()) if k[3] == "response"}
    assert {(None if i is None else int(i), len(t.encode())) for i, _, t in got} == kept
    assert ("300", "http://line%0D%0AX-Evil: 1/") in {(r.metadata[0].fields.get("page-id"), r.target_uri) for r in rows}
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        if r.refers_to:
            assert by_id[r.refers_to].payload_digest == r.payload_digest and by_id[r.refers_to].type == "response"
    requests = {r.requests[0].target_uri for r in rows}
    assert None in requests and "http://long/" in requests


def member(kind, name, block=b"", **headers):
    lines = [b"WARC/1.0", b"warc-type: " + kind.encode(), b"WARC-Record-ID: <" + name.encode() + b">", b"Content-Length: " + str(len(block)).encode()]
    for k, values in headers.items():
        lines += [k.replace("_", "-").encode() + b": " + v.encode() for v in values]
    return gzip.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_foreign_archives_link_in_any_direction(spark, tmp_path):
    http = "application/http; msgtype=response"
    first = [
        member("warcinfo", "info", b"software: x\r\n", Content_Type=["application/warc-fields"]),
        member("response", "r1", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", Content_Type=[http], WARC_Concurrent_To=["<q1>"], WARC_Payload_Digest=["sha1:WRONG"]),
        member("metadata", "m1", b"k: v\r\n more\r\n", Content_Type=["application/warc-fields"], WARC_Concurrent_To=["<q1>"]),
        member("response", "r2", b"no http at all \xff\xfe"),
        member("metadata", "m3", b"", WARC_Concurrent_To=["<nowhere>"]),
    ]
    second = [member("request", "q1", b"GET / HTTP/1.1\r\n\r\n"), member("metadata", "m2", b"", WARC_Concurrent_To=["<r1>", "<r2>"])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(first))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(second))
    records = warc.read_records(spark, str(tmp_path), payload=True).cache()
    assert records.count() == 7
    rows = {r.record_id: r for r in warc.transactions(records).collect()}
    assert set(rows) == {"<r1>", "<r2>"}
    one, two = rows["<r1>"], rows["<r2>"]
    assert [r.record_id for r in one.requests] == ["<q1>"] and [r.record_id for r in one.metadata] == ["<m1>", "<m2>"]
    assert one.metadata[0].fields == {"k": "v more"} and one.payload == b"body" and one.digest_ok is False
    assert two.payload == b"no http at all \xff\xfe" and two.digest_ok is None and [r.record_id for r in two.metadata] == ["<m2>"] and two.requests == []


def test_crowded_capture_is_split(spark, tmp_path):
    blocks = [member("response", "r", b"x")] + [member("metadata", f"m{i:03d}", b"", WARC_Concurrent_To=["<r>"]) for i in range(90)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(blocks))
    records = warc.read_records(spark, str(tmp_path)).cache()
    rows = warc.transactions(records, part=10).collect()
    assert len(rows) > 8 and sorted(m.record_id for r in rows for m in r.metadata) == sorted(f"<m{i:03d}>" for i in range(90))
    assert max(len(r.metadata) for r in rows) < 20 and len({r.part for r in rows}) == len(rows)


@pytest.mark.parametrize("cut", [1, 10, 60])
def test_damaged_file_is_named(spark, tmp_path, cut):
    whole = gzip.decompress(member("response", "r", b"some block of bytes"))
    (tmp_path / "bad.warc").write_bytes(whole[: len(whole) - 4 - cut])
    with pytest.raises(Exception, match="bad.warc.*record at byte 0"):
        warc.read_records(spark, str(tmp_path)).collect()


def test_empty_tables(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(empty).collect() == []
    os.makedirs(tmp_path / "e")
    empty.write.parquet(str(tmp_path / "e" / "p"))
    assert warc.archived(spark.read.parquet(str(tmp_path / "e" / "p"))).collect() == []
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.warc").write_bytes(b"\r\n")
    assert warc.read_records(spark, str(tmp_path / "z")).collect() == []
