"""ARC to WARC: version-specific ARC header lines and declared lengths in, equivalent WARC records out."""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, map_arrow, salted_join, settle, shared_dir, tidy
from .ngram_lm import put, store

# The fields of a URL record line in the two ARC versions.
FIELDS = {1: ["url", "ip", "date", "type", "length"], 2: ["url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length"]}
WHEN = "20240101000000"
PAGE = "X-Page-Id"
#: Compressed bytes that are read at a time.
FEED = 1 << 14
#: A file is closed after the record that takes it to this size.
ROLL = 64 << 20
_NAMES = uuid.UUID("6f1b8e0a-3a51-5b0c-9c5e-0d6f5f1f9d42")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def fetch(uri: str) -> bytes:
    if urlparse(uri).scheme in ("", "file"):
        with open(urlparse(uri).path, "rb") as f:
            return f.read()
    fs, at = store(uri)
    with fs.open_input_stream(at) as f:
        return f.read()


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file one by one; plain data is one piece."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        z = zlib.decompressobj(31)
        out = []
        # fed bit by bit, as what follows a member's end is copied
        while not z.eof and at < len(data):
            piece = view[at : at + FEED]
            out.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        yield b"".join(out)


def arc_header(name: str, version: int) -> bytes:
    line = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 tekstara\n{line}\n".encode()
    tail = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {WHEN} {tail}\n".encode() + body + b"\n"


def arc_record(url: str, block: bytes, version: int, name: str, offset: int, when: str = WHEN) -> bytes:
    u = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "about:blank"
    tail = f"text/html {len(block)}" if version == 1 else f"text/html 200 {digest(block)} - {offset} {name} {len(block)}"
    return f"{u} 0.0.0.0 {when} {tail}\n".encode() + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of the version block, whose URL begins with ``filedesc:``, and of every URL record after it. The
    version block names the version, whose line has 5 or 10 fields.

    Blocks are cut by declared length, so newlines in them do no harm; blank lines between records are skipped. A line with too
    few fields, a length that isn't a number or that runs past the end raises ValueError.
    """
    version = 0
    for piece in members(data):
        at = 0
        while at < len(piece):
            if piece[at : at + 1] in (b"\n", b"\r"):
                at += 1
                continue
            end = piece.find(b"\n", at)
            if end < 0:
                raise ValueError("ARC: header line without an end")
            parts = piece[at:end].decode("utf-8").rstrip("\r").split(" ")
            described = parts[0].startswith("filedesc:")
            names = FIELDS[1 if len(parts) == 5 else 2] if described else FIELDS[version or 1]
            if len(parts) != len(names) or not parts[-1].isdigit():
                raise ValueError(f"ARC: not a version {version or 1} header line: {parts}")
            fields = dict(zip(names, parts, strict=True))
            start, size = end + 1, int(fields["length"])
            if start + size > len(piece):
                raise ValueError("ARC: declared length runs past the end")
            block = piece[start : start + size]
            at = start + size
            if described:
                version = int(block.split(b" ", 1)[0])
            yield fields, block


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The URL records of an ARC file."""
    return (x for x in read_arc(data) if not x[0]["url"].startswith("filedesc:"))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; a block without one is all payload."""
    if block.startswith(b"HTTP/"):
        for mark in (b"\r\n\r\n", b"\n\n"):
            if (at := block.find(mark)) >= 0:
                return block[: at + len(mark)], block[at + len(mark) :]
    return b"", block


def page_of(http: bytes) -> str | None:
    m = re.search(rb"(?im)^" + PAGE.encode() + rb":[ \t]*([^\r\n]*)", http)
    return unquote(m[1].decode()) if m else None


def dated(arc_date: str) -> str:
    """An ARC date, of which the last parts may be missing, as a WARC date."""
    return datetime.strptime(arc_date[:14] + "00000101000000"[len(arc_date) :], "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def warcinfo(fields: dict[str, str], block: bytes, name: str) -> bytes:
    """The warcinfo record that an ARC file's version block becomes; the block's own lines stay as a field."""
    lines = " / ".join(block.decode("utf-8", "replace").split("\n")).strip(" /")
    body = f"software: tekstara\r\nformat: WARC File Format 1.1\r\nsource: {fields['url']}\r\narc-version-block: {lines}\r\n".encode()
    head = {
        "WARC-Type": "warcinfo", "WARC-Date": dated(fields["date"]), "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{name}:info')}>",
        "WARC-Filename": name, "Content-Type": "application/warc-fields", "WARC-Block-Digest": f"sha1:{digest(body)}", "Content-Length": str(len(body)),
    }
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def warc_record(fields: dict[str, str], block: bytes, name: str, offset: int, kind: str, refers: str | None = None) -> bytes:
    """The WARC record that an ARC record becomes: type, date, identifier (from file and place, so repeats agree) and digests."""
    http, payload = split_http(block)
    body = http if kind == "revisit" else block
    head = {
        "WARC-Type": kind, "WARC-Target-URI": fields["url"], "WARC-Date": dated(fields["date"]), "WARC-Warcinfo-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{name}:info')}>",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_NAMES, f'{name}:{offset}')}>", "WARC-IP-Address": fields["ip"],
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(body)}",
        "X-Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response" if http else fields["type"],
    }
    if kind == "revisit":
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:uuid:{uuid.uuid5(_NAMES, refers or '')}>"
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    for piece in members(data):
        at = 0
        while at < len(piece):
            end = piece.index(b"\r\n\r\n", at)
            lines = piece[at:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("WARC: no version line")
            head = dict(x.split(": ", 1) for x in lines[1:])
            start, size = end + 4, int(head["Content-Length"])
            if start + size > len(piece):
                raise ValueError("WARC: declared length runs past the end")
            yield head, piece[start : start + size]
            at = start + size + 4


def write_arc(df: DataFrame, uri: str, version: int = 1) -> DataFrame:
    """Write columns page_id, url, html as ARC files of the given version, of up to about ROLL bytes; returns the files' names and row counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, part = TaskContext.get().partitionId(), 0
        out, n = io.BytesIO(), 0

        def close() -> pa.RecordBatch:
            nonlocal out, n, part
            put(uri, name, out.getvalue())
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n"])
            out, n, part = io.BytesIO(), 0, part + 1
            return row

        for b in batches:
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                name = f"part-{task:06d}-{part:06d}.arc.gz"
                if not n:
                    out.write(gzip_member(arc_header(name, version)))
                payload = (html or "").encode("utf-8")
                mark = "" if page is None else f"{PAGE}: {quote(page, safe=' ')}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                out.write(gzip_member(arc_record(url or "", block, version, name, out.tell())))
                n += 1
                if out.tell() >= ROLL:
                    yield close()
        if n:
            yield close()

    return map_arrow(df.select(df["page_id"].cast("string"), "url", "html"), run, "file string, n long")


def index_arc(files: DataFrame, uri: str, id_type: str = "long") -> DataFrame:
    """file, place (number in the file), page_id, n_bytes and digest of every record of the named ARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for i, (_, block) in enumerate(records(fetch(f"{uri}/{name}"))):
                    http, payload = split_http(block)
                    rows.append((name, i, page_of(http), len(payload), digest(payload)))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "place", "page_id", "n_bytes", "digest"])

    found = map_arrow(files.select("file"), run, "file string, place long, page_id string, n_bytes long, digest string")
    return found.withColumn("page_id", F.col("page_id").cast(id_type))


def decided(index: DataFrame, least: int) -> DataFrame:
    """``index`` with what each record refers to (null: it is a response): the largest page_id of its payload (null ones are
    least), then the last file, then the first place. A payload that many records share, such as the empty one, is dealt over tasks."""
    index = index.withColumn("payload", F.when(F.col("n_bytes") >= least, F.concat_ws(":", "digest", "n_bytes")))
    best = settle(index.where("payload is not null").groupBy("payload").agg(F.max(F.struct("page_id", "file", (-F.col("place")).alias("place"))).alias("best"), F.count("*").alias("c")))
    both = salted_join(index, best.drop("c"), "payload", "left", counts=best.select("payload", "c"))
    same = (F.col("file") == F.col("best.file")) & (F.col("place") == -F.col("best.place"))
    to = F.when(F.col("best").isNotNull() & ~same, F.col("best"))
    return both.select("file", "place", to["page_id"].cast("string").alias("to_page"), F.when(to.isNotNull(), F.concat_ws(":", to["file"], (-to["place"]).cast("string"))).alias("to_record"))


def convert(decisions: DataFrame, uri: str, files: int) -> DataFrame:
    """Write a WARC file for each ARC file; returns its name and number of records. One file's decisions meet in one task, and
    files are dealt evenly over as many tasks as there are files."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["file"].iloc[0]
        to = dict(zip(pdf["place"], pdf["to_record"], strict=True))
        pages = dict(zip(pdf["place"], pdf["to_page"], strict=True))
        out, i = io.BytesIO(), 0
        for fields, block in read_arc(fetch(f"{uri}/{name}")):
            if fields["url"].startswith("filedesc:"):
                out.write(gzip_member(warcinfo(fields, block, name)))
                continue
            kind = "response" if to[i] is None else "revisit"
            record = warc_record(fields, block, name, i, kind, to[i])
            if kind == "revisit" and not pd.isna(pages[i]):
                record = record.replace(b"WARC/1.1\r\n", f"WARC/1.1\r\nX-Refers-To-Page: {quote(pages[i], safe=' ')}\r\n".encode(), 1)
            out.write(gzip_member(record))
            i += 1
        put(uri, new := name.replace(".arc.gz", ".warc.gz"), out.getvalue())
        return pd.DataFrame({"file": [new], "n": [i]})

    # a given number of ranges, which adaptive execution doesn't merge
    return decisions.repartitionByRange(files, "file").groupBy("file").applyInPandas(run, "file string, n long")


def read_back(files: DataFrame, uri: str, id_type: str = "long") -> DataFrame:
    """page_id, url, payload length and digest, type, what it refers to, date and identifier of every WARC record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                for head, block in read_warc(fetch(f"{uri}/{name}")):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, payload = split_http(block)
                    said = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest(payload) != said:
                        raise ValueError(f"WARC: payload of {head['WARC-Record-ID']} doesn't match its digest")
                    to = head.get("X-Refers-To-Page")
                    rows.append((page_of(http), int(head["X-Payload-Length"]), said, head["WARC-Type"], unquote(to) if to else None, head["WARC-Target-URI"], head["WARC-Date"], head["WARC-Record-ID"]))
                cols = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date", "record_id"])

    out = map_arrow(files.select("file"), run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, target_uri string, warc_date string, record_id string")
    return out.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


@tidy
def archive(df: DataFrame, least: int = 0, version: int = 1) -> DataFrame:
    """Write ``df`` (page_id, url, html) as ARC files, convert them to WARC files, and return a row for each record read back.

    Null html is an empty payload, null url ``about:blank``. Of records with equal payloads of at least ``least`` bytes, that
    with the largest page_id (a null one last; of repeats, the first in the last file) is the response and the others
    revisit it. Page ids may be of any type that text can be cast to. Every row has a record, repeated rows too; an empty table
    gives an empty result. Files of up to about ROLL bytes are in the shared folder until they are read back; one file's bytes and
    its decisions are in memory at a time.
    """
    uri, id_type = shared_dir(df.sparkSession), dict(df.dtypes)["page_id"]
    files = settle(write_arc(df, uri, version)).select("file")
    n = max(1, files.count())
    spread = lambda f: f.repartitionByRange(n, "file")
    decisions = settle(decided(settle(index_arc(spread(files), uri, id_type)), least))
    warcs = settle(convert(decisions, uri, n))
    return read_back(spread(warcs.select("file")), uri, id_type)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(load(spark, sf_dir, "pages"))
