"""WARC archives: writing with segments, and reading back by segment reassembly.

A page becomes a `response` record whose block is an HTTP message in chunked transfer framing; a block longer than
`SEGMENT_BYTES` is cut into a first segment and `continuation` records, which name the first record as their origin and
number themselves; the last one states the total length. A page with a payload that another page of a smaller id has
becomes a `revisit` without a payload. Reading parses archives record by record by their Content-Length, decodes whole
records where they are, groups continuations by origin, orders them by number, checks numbers and total length, and
decodes the framing. Only segmented records are shuffled.

Archives are written by Spark's text writer (a record ends in an empty line, so CRLF parts rows) with gzip, in files of
at most `FILE_RECORDS` pages, to the shared folder or any path Spark can write.

Null html is an empty payload; a null url has no target. Of equal payloads, all rows with the smallest page_id are
responses (repeated rows too); null ids come last. Records whose segments are incomplete come back with complete false
and no payload. Fields that WARC leaves open to extensions: WARC-Page-ID, WARC-Refers-To-Page-ID, WARC-Payload-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import cut, map_rows, shared_folder, table

SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4_096
FILE_RECORDS = 4_000
MIN_REVISIT_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for i in range(0, len(payload), size) if (p := payload[i : i + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The payload in chunked framing, or None where the framing is broken."""
    parts, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(data[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes | None:
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n"


def page_records(record_id: str, page: dict, segment: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The records of one page; `page` has page_id, url, payload, refers_to, refers_uri and revisit."""
    payload = page["payload"]
    common = [("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", page["url"]), ("WARC-Page-ID", page["page_id"]),
              ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response")]
    if page["revisit"]:
        more = [("WARC-Profile", _PROFILE), ("WARC-Refers-To-Target-URI", page["refers_uri"]), ("WARC-Refers-To-Date", DATE),
                ("WARC-Refers-To-Page-ID", page["refers_to"]), ("WARC-Payload-Length", len(payload))]
        yield _record([("WARC-Type", "revisit"), *common, *more], _HTTP)
        return
    block = _HTTP + chunked(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], block[:segment])
    for n, at in enumerate(range(segment, len(block), segment), 2):
        last = [("WARC-Segment-Total-Length", len(block))] if at + segment >= len(block) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id}/{n}').urn}>"), ("WARC-Date", DATE)]
        yield _record([*own, ("WARC-Segment-Origin-ID", f"<{record_id}>"), ("WARC-Segment-Number", n), *last], block[at : at + segment])


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) < int(head["content-length"]):
            raise ValueError("the archive ends inside a record")
        yield head, block


def write_warc(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT_BYTES, segment: int = SEGMENT_BYTES, text: str = "html") -> None:
    """Write a record per row of pages (page_id, url, and the payload in column `text`) as gzip archives below `path`."""
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload"))
    copies = (
        rows.select("page_id", "url", F.sha1("payload").alias("sha"), F.length("payload").alias("n")).where(F.col("n") >= min_revisit)
        .groupBy("sha", "n").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"))
        .where("copies > 1").select("sha", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_uri"), F.lit(True).alias("copied"))
    )
    # Written first: its size then decides how it is joined, and unique pages need not move where copies are few.
    joined = rows.withColumn("sha", F.sha1("payload")).join(cut(copies), "sha", "left").where(F.lit(True))
    revisit = F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    plan = joined.select("page_id", "url", "payload", "refers_to", "refers_uri", revisit.alias("revisit"))

    def make():
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0

        def step(given):
            nonlocal count
            out = []
            for values in zip(*given.values()):
                page = dict(zip(given, values))
                # Unique in this archive, and the same when a lost task runs again.
                record_id = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}/{part}/{count}/{page['page_id']}").urn
                count += 1
                out += page_records(record_id, page, segment)
            yield {"record": out}

        return step

    records = map_rows(plan, "record binary", make, rows=128)
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", FILE_RECORDS
    ).text(path)


_OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, complete boolean"


def _number(head: dict[str, str], name: str) -> int | None:
    return int(head[name]) if name in head else None


def _described(head: dict[str, str], payload: bytes | None, keep: bool) -> dict:
    row = {"page_id": _number(head, "warc-page-id"), "record_type": head["warc-type"], "refers_to": _number(head, "warc-refers-to-page-id")}
    if head["warc-type"] == "revisit":
        row |= {"payload_bytes": _number(head, "warc-payload-length"), "complete": True, "payload": None,
                "payload_digest": head["warc-payload-digest"].removeprefix("sha1:")}
    else:
        digest = None if payload is None else sha1_base32(payload)
        row |= {"payload_bytes": None if payload is None else len(payload), "payload_digest": digest, "payload": payload if keep else None,
                "complete": digest is not None and head.get("warc-payload-digest", f"sha1:{digest}") == f"sha1:{digest}"}
    return row


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per response and revisit below `path`: page_id, payload_bytes, payload_digest, record_type, refers_to, complete
    and, if asked for, payload (of responses)."""
    out = _OUT + ", payload binary"
    names = [x.split()[0] for x in out.split(", ")]
    seg = "origin string, number int, total long, head map<string,string>, block binary"

    def make_parsed():
        def step(given):
            for content in given["content"]:
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content))) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
                rows: list[dict] = []
                for head, block in parse(stream):
                    origin = head.get("warc-segment-origin-id") or (head["warc-record-id"] if "warc-segment-number" in head else None)
                    if origin is None and head["warc-type"] in ("response", "revisit"):
                        whole = _described(head, http_payload(block), with_payload)
                        rows.append(whole | dict.fromkeys(("origin", "number", "total", "head", "block")))
                    elif origin is not None:
                        rows.append(dict.fromkeys(names) | {"origin": origin, "number": int(head["warc-segment-number"]), "block": block,
                                    "total": _number(head, "warc-segment-total-length"), "head": list(head.items()) if "warc-segment-origin-id" not in head else None})
                    if len(rows) == 500:
                        yield _columns(rows)
                        rows = []
                yield _columns(rows)

        def _columns(rows):
            return {n: [r[n] for r in rows] for n in [*names, "origin", "number", "total", "head", "block"]}

        return step

    parsed = cut(map_rows(spark.read.format("binaryFile").load(path).select("content"), f"{out}, {seg}", make_parsed, rows=1))
    # One group is one page: its segments meet, nothing else does.
    grouped = parsed.where("origin is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "total", F.map_entries("head").alias("head"), "block"))).alias("segments")
    )

    def make_joined():
        def step(given):
            rows = []
            for segments in given["segments"]:
                block = b"".join(s["block"] for s in segments)
                head = dict((e["key"], e["value"]) for e in segments[0]["head"] or ())
                right = [s["number"] for s in segments] == list(range(1, len(segments) + 1)) and segments[-1]["total"] == len(block)
                head = head or {"warc-type": "response"}
                rows.append(_described(head, http_payload(block) if right else None, with_payload))
            yield {n: [r[n] for r in rows] for n in names}

        return step

    joined = map_rows(grouped.select("segments"), out, make_joined, rows=64)
    whole = parsed.where("origin is null").select(*names).unionByName(joined)
    return whole if with_payload else whole.drop("payload")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path)


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, {5 * g + 1}, 5))::bigint >> {s}) % 32, 1)"
    for g in range(8) for s in (15, 10, 5, 0)
)
OP6_SQL = f"""
with p as (select page_id, coalesce(html, '') b, sha1(coalesce(html, '')) h from pages),
f as (select page_id, strlen(b) payload_bytes, h, min(page_id) over (partition by h) first from p)
select page_id, payload_bytes, {_DIGITS} payload_digest, case when page_id = first then 'response' else 'revisit' end record_type,
  case when page_id = first then null else first end refers_to, true complete from f
"""
