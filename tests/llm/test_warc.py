import base64
import hashlib

import pytest

from tekstara.llm import common, warc
from tekstara.llm.warc import archive, arc_header, arc_record, gzip_member, read_arc, read_warc, records, split_http, warc_record, warcinfo


def test_arc_versions_and_lengths():
    for version in (1, 2):
        blocks = [b"", b"HTTP/1.1 200 OK\r\n\r\nline\n\nfiledesc: no header\n", b"x" * 100_000]
        plain = arc_header("a.arc", version) + b"".join(arc_record(f"http://h/{i} b", b, version, "a.arc", 0) for i, b in enumerate(blocks))
        zipped = gzip_member(arc_header("a.arc", version)) + b"".join(gzip_member(arc_record(f"http://h/{i} b", b, version, "a.arc", 0)) for i, b in enumerate(blocks))
        for data in (plain, zipped):
            got = list(records(data))
            assert len(list(read_arc(data))) == len(blocks) + 1
            assert [b for _, b in got] == blocks
            assert got[1][0]["url"] == "http://h/1%20b" and len(got[0][0]) == (5 if version == 1 else 10)


def test_bad_arcs():
    head = arc_header("a.arc", 1)
    for bad in (b"http://h 0.0.0.0 20240101000000 text/html\nx\n", b"http://h 0.0.0.0 20240101000000 text/html 99\nx\n", b"http://h 0.0.0.0 20240101000000 text/html x1\nx\n"):
        with pytest.raises(ValueError):
            list(read_arc(head + bad))


def test_warc_round_trip():
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\npay\r\n\r\nload"
    fields = {"url": "http://h/", "ip": "0.0.0.0", "date": "20240102030405", "type": "text/html", "length": "1"}
    data = gzip_member(warc_record(fields, block, "f", 1, "response")) + gzip_member(warc_record(fields, block, "f", 2, "revisit", "f:1"))
    (a, x), (b, y) = read_warc(data)
    assert x == block and y == split_http(block)[0] and split_http(y)[1] == b""
    assert a["WARC-Date"] == "2024-01-02T03:04:05Z" and b["WARC-Refers-To"] == a["WARC-Record-ID"] and a["WARC-Record-ID"] != b["WARC-Record-ID"]
    assert a["WARC-Payload-Digest"] == b["WARC-Payload-Digest"]


def brute(rows):
    payload = {i: (h or "").encode() for i, _, h in rows}
    out = {}
    for i, p in payload.items():
        top = max(j for j, q in payload.items() if q == p)
        out[i] = (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == top else "revisit", None if i == top else top)
    return out


def test_archive_against_brute_force(spark):
    rows = [(0, "http://a/", "<p>x"), (1, None, "<p>x"), (2, "", None), (3, "u v\nw", ""), (4, "http://ü/", "ü" * 70_000), (1 << 60, "b", "<p>x"), (6, "c", "\r\n\r\nHTTP/1.1 200\r\n\r\n"), (7, "d", "plain")]
    rows += [(100 + i, f"http://h/{i}", "copy") for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as file").repartition(4)
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive(df).collect()}
    assert got == brute(rows)
    # below the least size all are responses
    least = {r["page_id"]: r["record_type"] for r in archive(df, least=5, version=2).collect()}
    assert least[100] == "response" and set(least.values()) == {"response"}


def test_repeated_rows_null_ids_and_empty(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (None, "b", "x")], "page_id long, url string, html string")
    kinds = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"]) for r in archive(df).collect())
    assert [k for _, k, _ in kinds].count("response") == 1 and {t for _, k, t in kinds if k == "revisit"} == {1}
    assert archive(df.limit(0)).count() == 0


def test_text_ids(spark):
    df = spark.createDataFrame([("b", "u", "x"), ("a b/ü", "u", "x"), ("c\r\nd", "u", "y"), (None, "u", "y")], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in archive(df).collect()}
    assert got == {("b", "response", None), ("a b/ü", "revisit", "b"), ("c\r\nd", "response", None), (None, "revisit", "c\r\nd")}


def test_rolled_files_and_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 7)
    rows = [(i, f"http://h/{i}", "" if i % 3 else f"page {i} " * 20) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    uri = common.shared_dir(spark)
    monkeypatch.setattr(warc, "ROLL", 2000)
    files = warc.write_arc(df, uri).collect()
    assert sum(r["n"] for r in files) == 200 and len({r["file"] for r in files}) >= 1
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in archive(df).collect()}
    assert got == brute(rows)


def test_version_block_becomes_warcinfo():
    (fields, block), *_ = read_arc(arc_header("a.arc", 1))
    ((head, body),) = read_warc(warcinfo(fields, block, "a.arc"))
    assert head["WARC-Type"] == "warcinfo" and head["WARC-Date"] == "2024-01-01T00:00:00Z" and b"URL IP-address Archive-date" in body
    other = warc_record({"url": "u", "ip": "0.0.0.0", "date": "2024", "type": "text/html", "length": "1"}, b"x", "a.arc", 0, "response")
    assert next(read_warc(other))[0]["WARC-Warcinfo-ID"] == head["WARC-Record-ID"]
