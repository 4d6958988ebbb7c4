import base64
import hashlib
import io

from dossier.llm import warc
from dossier.llm.common import shared_folder
from tests.llm.frames import crowded, rows

PAGES = "page_id long, url string, html string"
HTML = ["<p>é\r\n\r\nWARC/1.1\r\n</p>" * 40, "", None, "x", "y" * 16000, "0\r\n\r\n", "long " * 5000, "x", "long " * 5000, "🙂" * 3000]
ROWS = [(i + 5, [f"http://h{i}/", None, "http://a/\r\nX: y"][i % 3], h) for i, h in enumerate(HTML)]
ROWS += [(2, "http://late/", "x"), (2, "http://late/", "x"), (None, None, "x"), (None, "http://n/", "alone")]


def wanted(given, least=0):
    out = []
    for page_id, _, html in given:
        data = (html or "").encode()
        same = [p for p, _, h in given if (h or "") == (html or "")]
        first = min((p for p in same if p is not None), default=None)
        kept = page_id == first or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page_id, len(data), digest, "response" if kept else "revisit", None if kept else first, True))
    return sorted(out, key=lambda r: [(v is not None, v if v is not None else 0) for v in r])


NAMES = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "complete")


def test_round_trip(spark):
    pages = crowded(spark.createDataFrame(ROWS, PAGES)).repartition(3)
    for least, segment in ((0, 100), (0, 16_384), (2, 1000)):
        path = shared_folder(spark)
        warc.write_warc(pages, path, min_revisit=least, segment=segment)
        assert rows(warc.read_warc(spark, path), *NAMES) == wanted(ROWS, least)
        bodies = {bytes(r["payload"]) for r in warc.read_warc(spark, path, True).collect() if r["payload"] is not None}
        assert bodies == {(h or "").encode() for _, _, h in ROWS}


def test_binary_payloads_and_empty_table(spark):
    data = [(1, "u", bytes(range(256)) * 300), (2, "u", b"\xff\xfe\r\n"), (3, None, None)]
    path = shared_folder(spark)
    warc.write_warc(spark.createDataFrame(data, "page_id long, url string, body binary"), path, segment=999, text="body")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, path, True).collect()}
    assert got == {1: data[0][2], 2: data[1][2], 3: b""}
    empty = shared_folder(spark)
    warc.write_warc(spark.createDataFrame([], PAGES), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_missing_segment_is_reported(spark, tmp_path):
    page = {"page_id": 4, "url": "u", "payload": b"z" * 900, "refers_to": None, "refers_uri": None, "revisit": False}
    records = [r + b"\r\n" for r in warc.page_records("urn:uuid:1", page, segment=200)]
    assert len(records) > 3
    (tmp_path / "broken.warc").write_bytes(b"".join(records[:2] + records[3:]))
    got = warc.read_warc(spark, str(tmp_path)).collect()
    assert [(r["page_id"], r["complete"], r["payload_bytes"]) for r in got] == [(4, False, None)]
    out = tmp_path / "mixed"
    out.mkdir()
    (out / "a.warc").write_bytes(b"".join(reversed(records[2:])))
    (out / "b.warc").write_bytes(b"".join(records[:2]))
    assert rows(warc.read_warc(spark, str(out)), "page_id", "payload_bytes", "complete") == [(4, 900, True)]


def test_framing():
    for size in (0, 1, 4095, 4096, 4097, 20_000):
        data = b"\r\n" * (size // 2) + b"q" * (size % 2)
        assert warc.unchunked(warc.chunked(data)) == data
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"") is None and warc.unchunked(b"zz\r\n") is None
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert list(warc.parse(io.BytesIO(b""))) == []
