"""WARC archives: pages written as records, records read back and assembled to captures.

A page becomes three records of one transaction: its request, its response (or, where its payload is that of another page,
a revisit of that page's response) and a metadata record; request and metadata name the response in WARC-Concurrent-To.
Records are built by SQL functions and written by Spark's text writer, whose separator is the end of a record, so a file
appears whole or not at all, on any shared file system.

Any archive is read back, also one of another writer (plain, or gzip with a member a record): a task parses one file's bytes,
record by record.  ``transactions`` joins the records through their concurrent-to identifiers, in either direction and over
one intermediate record, and gives one nested row a capture.

Equal payloads are found by SHA-1 and length; a payload that a large share of all pages hold is looked up by broadcast, the
others by one shuffle.

Defined results: null html is the empty payload, null url means no WARC-Target-URI, line ends in a url are written as %0D
and %0A; a null ``page_id`` is the largest of its group and written as no page-id; rows that repeat the smallest
``page_id`` of equal payloads are all responses (the revisits then name a page, a URI and a digest but no single record);
extra columns are ignored; an empty table gives an archive without records.  A file of a read archive may have 2 GB; a
record cut short or without its end raises an error that names file and place.  Records that reach no capture give no
row; a capture with more than ``PART`` companions has several rows, told by ``part``."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import looked_up, on_workers, saved
from costlens.session import scratch_path

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Bytes of records in one file of an archive, about; bytes of payloads in one Arrow batch that the reader gives.
FILE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
#: Requests and metadata records in one nested row at most; more give more rows.
PART = 1000
CAPTURES = ("response", "revisit", "resource")
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(sha1: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 in hexadecimal: five hex digits are four digits to the base 32."""
    groups = [F.lpad(F.conv(F.substring(sha1, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _HEX32, _BASE32)


def _urn(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cuts = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _record(kind: str, headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """A record without its final line ends; a null header is left out."""
    lines = [F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}")]
    lines += [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def pages_with_kind(pages: DataFrame, least: int = 0) -> tuple[DataFrame, int, int]:
    """page_id, url, payload, payload_bytes, sha1, and for pages whose payload (of ``least`` bytes or more) others hold: first
    (the smallest page_id), first_rows (rows with it), first_url.  Also the number of pages and of payload bytes."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    )
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    seen = Observation()
    narrow = rows.select("sha1", "payload_bytes", "page_id", "url")
    narrow = narrow.observe(seen, F.count(F.lit(1)).alias("pages"), F.sum("payload_bytes").alias("bytes"))
    one = narrow.groupBy("sha1", "payload_bytes", "page_id").agg(F.count(F.lit(1)).alias("m"), F.min("url").alias("url"))
    rank = F.struct(F.col("page_id").isNull(), "page_id")
    groups = one.groupBy("sha1", "payload_bytes").agg(
        F.sum("m").alias("copies"), F.min("page_id").alias("first"), F.min_by("m", rank).alias("first_rows"), F.min_by("url", rank).alias("first_url")
    )
    shared = saved(groups.filter((F.col("copies") > 1) & (F.col("payload_bytes") >= least)), "warc-shared-payloads")
    found = looked_up(rows, shared.drop("payload_bytes"), "sha1", "copies", F.col("page_id"))
    return found, seen.get["pages"] or 0, seen.get["bytes"] or 0


def records_of(found: DataFrame, date: str = DATE) -> DataFrame:
    """One row ``value`` a record: request, response or revisit, metadata of every page."""
    run = F.lit(uuid.uuid4().hex)
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    alone = F.coalesce(F.col("first_rows") == 1, F.lit(True))
    first = F.coalesce(F.col("first").cast("string"), F.lit(""))
    named = lambda who: _urn(run, F.lit("response"), who, F.col("sha1"))
    # the number is new in every attempt of a task, but a transaction's three records are written by one attempt
    rows = found.withColumn("_own", F.monotonically_increasing_id())
    rows = rows.withColumn("_id", F.when(~revisit & alone, named(page)).otherwise(_urn(run, F.lit("row"), page, F.col("_own"))))
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target, day = ("WARC-Target-URI", F.col("url")), ("WARC-Date", date)
    part_of = ("WARC-Concurrent-To", F.col("_id"))
    lines = F.concat(F.lit("GET "), F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    request = _record(
        "request",
        [("WARC-Record-ID", _urn(run, F.lit("request"), F.col("_id"))), day, target, part_of, ("Content-Type", "application/http; msgtype=request")],
        F.coalesce(lines, F.lit("GET / HTTP/1.1" + END)),
    )
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1"))))
    common = [("WARC-Record-ID", F.col("_id")), day, target, digest]
    response = _record("response", [*common, ("Content-Type", "application/http; msgtype=response")], F.concat(head, "payload"))
    refers = [("WARC-Refers-To", F.when(alone, named(first))), ("WARC-Refers-To-Target-URI", F.col("first_url"))]
    again = _record("revisit", [*common, *refers, ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")], head)
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("page-id: "), F.col("page_id").cast("string")),
        F.concat(F.lit("payload-bytes: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("refers-to-page-id: "), F.col("first").cast("string"))),
        F.lit(""),
    )
    metadata = _record(
        "metadata", [("WARC-Record-ID", _urn(run, F.lit("metadata"), F.col("_id"))), day, target, part_of, ("Content-Type", "application/warc-fields")], fields
    )
    return rows.select(F.explode(F.array(request, F.when(revisit, again).otherwise(response), metadata)).alias("value"))


def write(pages: DataFrame, path: str, least: int = 0, date: str = DATE, compression: str = "gzip", file_bytes: int = FILE_BYTES) -> None:
    """Write an archive of ``pages`` (page_id, url, html) into the folder ``path``, files of about ``file_bytes``."""
    found, many, size = pages_with_kind(pages, least)
    per_file = max(3, 3 * int(file_bytes // (2000 + size / max(many, 1))))
    writer = records_of(found, date).write.option("lineSep", END).option("compression", compression)
    writer.option("maxRecordsPerFile", per_file).text(path)


RECORD = (
    "file string, place long, record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, date string, "
    "headers map<string,string>, fields map<string,string>, payload_bytes long, payload_digest string, digest_ok boolean"
)


def _header(stream: BinaryIO) -> dict[str, list[str]]:
    """Header lines up to the empty one, names in lower case; continued lines are joined."""
    out: dict[str, list[str]] = {}
    last = None
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise EOFError("ends within a header")
        text = line.decode("utf-8", "replace").strip("\r\n")
        if text[0] in " \t" and last:
            out[last][-1] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out.setdefault(last, []).append(value.strip())
    return out


def parse(data: bytes) -> Iterator[tuple[int, dict[str, list[str]], bytes]]:
    """Place, header and block of every record of a file, plain or in gzip members."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    while True:
        place = stream.tell()
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        try:
            if not line.startswith(b"WARC/"):
                raise ValueError("is no WARC record")
            header = _header(stream)
            size = int(header["content-length"][0])
            block = stream.read(size)
            if size < 0 or len(block) < size:
                raise EOFError("ends within a block")
        except (ValueError, EOFError, KeyError) as e:
            raise ValueError(f"record at byte {place}: {e}") from e
        yield place, header, block


def _reader(with_payload: bool):
    names = [f.split()[0] for f in RECORD.split(", ")] + ["payload"] * with_payload
    text = pa.map_(pa.string(), pa.string())
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), *[pa.string()] * 3, text, text, pa.int64(), pa.string(), pa.bool_()]
    kinds += [pa.binary()] * with_payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def row(file: str, place: int, header: dict[str, list[str]], block: bytes) -> tuple:
        one = lambda name: header.get(name, [None])[0]
        kind, content = one("warc-type"), (one("content-type") or "").lower()
        payload, fields, size, digest, ok = block, None, None, None, None
        if content.startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2]
        elif content.startswith("application/warc-fields"):
            fields = [(k, v[0]) for k, v in _header(io.BytesIO(block + b"\r\n\r\n")).items() if k]
        stated = one("warc-payload-digest")
        if kind in ("response", "resource"):
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if stated and stated.lower().startswith("sha1:"):
                ok = stated[5:].strip().upper() == digest
        elif stated:
            digest = stated.partition(":")[2] if stated.lower().startswith("sha1:") else stated
        flat = [(k, ", ".join(v)) for k, v in header.items()]
        out = (file, place, one("warc-record-id"), kind, header.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-refers-to"), one("warc-date"))
        return (*out, flat, fields, size, digest, ok) + (payload,) * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for given in batches:
            for file, content in zip(given.column("path"), given.column("content")):
                try:
                    for place, header, block in parse(content.as_buffer().to_pybytes()):
                        rows.append(row(file.as_py(), place, header, block))
                        held += 1000 + len(block) * with_payload
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                except (ValueError, EOFError, gzip.BadGzipFile) as e:
                    raise ValueError(f"{file.as_py()}: {e}") from e
        if rows:
            yield batch(rows)

    return run


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """Every record of the archive's files; ``payload``: also the payload's bytes."""
    on_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_reader(payload), RECORD + ", payload binary" * payload)


def owners(records: DataFrame) -> DataFrame:
    """record_id, owner: the captures that requests, metadata and other records belong to."""
    is_capture = F.col("type").isin(*CAPTURES)
    links = records.select("record_id", is_capture.alias("capture"), F.explode("concurrent_to").alias("other")).filter("record_id is not null")
    back = links.filter("capture").select(F.col("other").alias("record_id"), F.col("record_id").alias("owner"))
    links = links.filter(~F.col("capture")).select("record_id", "other")
    captures = records.filter(is_capture).select(F.col("record_id").alias("other"), F.col("record_id").alias("owner")).distinct()
    named = links.groupBy("other").agg(F.count(F.lit(1)).alias("times"))
    named = saved(named.join(captures.hint("shuffle_hash"), "other", "left"), "warc-named")
    links = saved(looked_up(links, named, "other", "times", F.col("record_id")).drop("times"), "warc-links")
    direct = saved(back.union(links.filter("owner is not null").select("record_id", "owner")).distinct(), "warc-owners")
    # over one intermediate record, for those without an own capture
    inner = links.filter("owner is null").select("record_id", "other")
    inner = inner.union(inner.select("other", "record_id")).distinct()
    step = inner.join(direct.select("record_id").distinct(), "record_id", "left_anti")
    step = step.join(direct.select(F.col("record_id").alias("other"), "owner"), "other").select("record_id", "owner").distinct()
    return direct.union(step)


def transactions(records: DataFrame, part: int = PART) -> DataFrame:
    """One row a capture (a response, revisit or resource): its own columns, ``requests`` and ``metadata`` as arrays of
    structs by record id, ``part`` (0 but for captures with more than ``part`` companions).

    ``records`` is read several times: pass a written table."""
    is_capture = F.col("type").isin(*CAPTURES)
    found = owners(records)
    crowded = found.groupBy("owner").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > part)
    found = found.join(crowded.hint("shuffle_hash"), "owner", "left")
    parts = F.ceil(F.coalesce("many", F.lit(1)) * 2 / part)  # dealt by a hash: aim at half of the most
    found = found.select("record_id", "owner", F.when(F.col("many").isNull(), 0).otherwise(F.pmod(F.xxhash64("record_id"), parts)).cast("int").alias("part"))
    companion = F.struct("record_id", "target_uri", "date", "fields", "headers")
    others = records.filter(~is_capture).join(found.hint("shuffle_hash"), "record_id")
    of = F.col("type") == "request"
    # maps have no order: sorted by the ids, which come first
    first = lambda a, b: F.when(a["record_id"] < b["record_id"], -1).when(a["record_id"] > b["record_id"], 1).otherwise(0)
    kind = lambda only: F.array_sort(F.collect_list(F.when(only, companion)), first)
    others = others.groupBy(F.col("owner").alias("_owner"), "part").agg(kind(of).alias("requests"), kind(~of).alias("metadata"))
    captures = records.filter(is_capture).drop("concurrent_to", "fields")
    out = captures.join(others, F.col("record_id") == F.col("_owner"), "left").drop("_owner")
    none = F.expr("array()")
    return out.withColumns({"requests": F.coalesce("requests", none), "metadata": F.coalesce("metadata", none), "part": F.coalesce("part", F.lit(0))})


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages``, read the archive back, assemble: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, least)
    records = saved(read_records(spark, path), "warc-records")
    field = lambda name: F.col("metadata")[0]["fields"][name].cast("long")
    return transactions(records).select(
        field("page-id").alias("page_id"),
        F.coalesce("payload_bytes", field("payload-bytes")).alias("payload_bytes"),
        "payload_digest",
        F.col("type").alias("record_type"),
        field("refers-to-page-id").alias("refers_to"),
    )


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT page_id, first, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, page_id IS DISTINCT FROM first AS again FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}',
         1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM d
"""
