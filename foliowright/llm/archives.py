"""Web archives: ARC files of versions 1 and 2, and their conversion to WARC.

An ARC file is a version block and records, each a header line whose fields depend on the version and a block of the
declared length. Conversion reads whole files in Spark (plain or compressed), parses them as a stream, and makes the
WARC equivalents: record ids that are the same in every run, ISO timestamps, record types by scheme and content, and
SHA-1 digests of block and payload. Records whose payload an earlier page holds become revisits of it.

Files are written by Spark's text writer, one record a row and the format's record end as the line end; bytes go
through unchanged. A file is as large as the split or partition that it came from.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from zlib import error as zlib_error

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load, materialize, shared_dir

# The field lines of the two versions, their header lines, the end of a WARC record.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LINE = {
    1: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<mime>.*\S) (?P<length>\d+)"),
    2: re.compile(rb"(?P<url>\S.*) (?P<ip>\S+) (?P<date>\d{8,14}) (?P<mime>.*\S) (?P<status>\d+|-) (?P<sum>\S+) (?P<to>\S+) (?P<at>\d+|-) (?P<file>\S+) (?P<length>\d+)"),
}
RECORD_END = "\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
CAPTURED = "20000101000000"  # the date of pages that have none
LEAST = 0  # bytes of payload from which on equal payloads are written once
HOT = 1024  # payloads that more than 1/HOT of all records share are joined by broadcast: at most HOT of them
_GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}  # about half the writing time for a tenth more bytes
_FLUSH = 8 << 20
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs
_ODD = re.compile(rb"[\x00-\x20\x7f]")


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1: 32 letters and digits."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ' '.join(map(str, parts)))}>"


def iso_date(date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date; digits that name no time become the earliest that fit."""
    full = date[:14].ljust(14, "0")
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        clip = lambda s, lo, hi: min(max(int(s), lo), hi)
        return "%04d-%02d-%02dT%02d:%02d:%02dZ" % (clip(full[:4], 1, 9999), clip(full[4:6], 1, 12), clip(full[6:8], 1, 28), clip(full[8:10], 0, 23), clip(full[10:12], 0, 59), clip(full[12:], 0, 59))


def split_http(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP response; None where the block doesn't start with a status line."""
    if not block.startswith(b"HTTP/"):
        return None
    ends = [(at + len(e), e) for e in (b"\r\n\r\n", b"\n\n") if (at := block.find(e)) >= 0]
    at = min(ends)[0] if ends else len(block)
    return block[:at], block[at:]


def http_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].strip() if found else None


class Source:
    """Bytes of an archive, plain or gzip (one member or many); what a damaged end leaves unreadable is missing."""

    def __init__(self, content: bytes):
        raw = io.BytesIO(content)
        self.f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
        self.at = 0

    def _held(self, get: Callable[[], bytes]) -> bytes:
        try:
            got = get()
        except (EOFError, OSError, zlib_error):
            got = b""
        self.at += len(got)
        return got

    def line(self) -> bytes:
        return self._held(self.f.readline)

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0 and (got := self._held(lambda n=n: self.f.read(min(n, 1 << 20)))):
            parts.append(got)
            n -= len(got)
        return b"".join(parts)


# -- ARC


def arc_rows(pages: Iterable[tuple], name: str, version: int, captured: str) -> Iterator[bytes]:
    """The version block and one record a page (page_id, url, html), without the line end between records."""
    if version == 1:
        head = lambda url, at, length: b"%s 0.0.0.0 %s %s %d" % (url, captured.encode(), b"text/html", length)
    else:
        head = lambda url, at, length: b"%s 0.0.0.0 %s %s 200 - - %d %s %d" % (url, captured.encode(), b"text/html", at, name.encode(), length)
    block = b"%d 0 foliowright\n%s\n" % (version, FIELDS[version])
    row = head(b"filedesc://" + name.encode(), 0, len(block)).replace(b"text/html", b"text/plain", 1) + b"\n" + block
    at = len(row) + 1
    yield row
    for page_id, url, html in pages:
        url, html = _ODD.sub(lambda m: b"%%%02X" % m[0][0], url or b""), html or b""
        own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n%s\r\n" % (len(html), own)
        row = head(url or b"urn:page:%s" % str(page_id).encode(), at, len(http) + len(html)) + b"\n" + http + html
        at += len(row) + 1
        yield row


def _binary_rows(made: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of about _FLUSH bytes; a column of type string takes bytes as they are."""
    rows, held = [], 0

    def batch():
        columns = [pa.array(c, pa.binary()).view(pa.string()) if f.metadata else pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)

    for row in made:
        rows.append(row)
        held += sum(len(c) for c in row if isinstance(c, (bytes, str))) + 64
        if held >= _FLUSH:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


_RAW = pa.schema([pa.field("value", pa.string(), metadata={"raw": "bytes"})])


def write_arc(pages: DataFrame, path: str, captured: str = CAPTURED, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes pages as ARC files, version 1 in even partitions and 2 in odd ones.

    A null payload is an empty one; blanks and control characters of an address are escaped; a page without an address
    gets ``urn:page:`` and its id; a null id is left out.
    """
    rows = pages.select(F.col(page_id).cast("long"), F.col(url).cast("binary"), F.col(html).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        every = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield from _binary_rows(((r,) for r in arc_rows(every, f"pages-{part:06d}.arc", 1 + part % 2, captured)), _RAW)

    rows.mapInArrow(run, "value string").write.options(**_GZIP).option("lineSep", "\n").text(path)


def arc_records(source: Source) -> Iterator[dict]:
    """Records of an ARC file: offset, version, url, ip, date, mime, status, block, truncated.

    The version block tells which fields the following header lines have. A line that is no header line (a damaged
    record, or one whose declared length is too short) is passed over up to the next one that is; ``skipped`` counts its
    bytes. A block that ends before its declared length is truncated.
    """
    version, skipped, name, info = None, 0, "", None
    while line := source.line():
        bare = line.rstrip(b"\r\n")
        if not bare.strip():
            continue
        order = [version] if version else [2, 1]  # before the version block: the longer line first
        found = next((m for v in order if (m := LINE[v].fullmatch(bare))), None)
        if not found:
            skipped += len(line)
            continue
        offset, length = source.at - len(line), int(found["length"])
        block = source.read(length)
        url = found["url"].decode("utf-8", "replace")
        if url.startswith("filedesc:"):
            told = re.match(rb"(\d+) (\d+) ", block)
            version = int(told[1]) if told and int(told[1]) in LINE else (2 if "file" in found.groupdict() else 1)
            name = url.partition("://")[2]
            info = record_id(name, offset, url, found["date"].decode())
        status = found.groupdict().get("status")
        yield {
            "arc": name, "info": info, "offset": offset, "version": version or 1, "url": url, "ip": found["ip"].decode("ascii", "replace"), "date": found["date"].decode(),
            "mime": found["mime"].decode("utf-8", "replace"), "status": int(status) if status and status != b"-" else None, "block": block,
            "truncated": len(block) < length, "skipped": skipped,
        }
        skipped = 0


# -- ARC to WARC


def equivalent(r: dict) -> dict:
    """What the WARC record of an ARC record holds: type, ids, times, digests, head and payload."""
    url, block, http = r["url"], r["block"], None
    if url.startswith("filedesc:"):
        kind, content = "warcinfo", "text/plain"
    elif url.startswith("dns:"):
        kind, content = "resource", "text/dns"
    else:
        http = split_http(block)
        kind, content = ("response", "application/http; msgtype=response") if http else ("resource", r["mime"])
    head, payload = http or (b"", block)
    page = http_field(head, b"X-Page-Id")
    return {
        "id": record_id(r["arc"], r["offset"], url, r["date"]), "kind": kind, "content": content, "url": url, "ip": r["ip"], "date": iso_date(r["date"]),
        "info": r["info"], "head": head, "payload": payload, "digest": sha1(payload),
        "page": int(page) if page and re.fullmatch(rb"-?\d{1,18}", page) else None, "truncated": r["truncated"],
    }


def read_files(spark: SparkSession, path: str, parse: Callable[[Source], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Rows that ``parse`` makes of every file below ``path``; each is read as a whole, by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(b.num_rows):
                file = b.column(0)[x].as_py()
                yield from _binary_rows(((file, *row) for row in parse(Source(b.column(1)[x].as_py()))), schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, ddl)


def warc_head(kind: str, fields: list[tuple[str, object]], content: str, length: int) -> bytes:
    lines = ["WARC/1.0", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Type: {content}", f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "replace")


def convert(spark: SparkSession, arc_path: str, warc_path: str, least: int = LEAST) -> None:
    """Converts all ARC files below ``arc_path`` to WARC files in the folder ``warc_path``.

    Of records with equal payloads (responses of at least ``least`` bytes) the one with the smallest page id is written
    whole, a missing id last, equal ones by archive and offset; the others are revisits that hold the HTTP head alone
    and name it. Version blocks become warcinfo records, DNS answers and blocks without a status line resources. A
    file that can't be parsed at all gives no records. The first pass takes digests only, the second one the payloads;
    only records that are revisits are joined back to theirs, by file and offset.
    """
    small = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page", pa.int64()), ("digest", pa.string()), ("id", pa.string()), ("url", pa.string()), ("date", pa.string())])

    def digests(source: Source) -> Iterator[tuple]:
        for r in arc_records(source):
            e = equivalent(r)
            if e["kind"] == "response" and len(e["payload"]) >= least and not e["truncated"]:
                yield r["offset"], e["page"], e["digest"], e["id"], e["url"], e["date"]

    index = read_files(spark, arc_path, digests, small, "file string, offset bigint, page bigint, digest string, id string, url string, date string")
    index = materialize(index, "archive-index")
    first = F.min(F.struct(F.col("page").isNull().alias("none"), "page", "file", "offset", "id", "url", "date")).alias("first")
    firsts = materialize(index.groupBy("digest").agg(first, F.count("*").alias("n")).where("n > 1"), "archive-firsts")
    total = index.count()
    hot = F.broadcast(firsts.where(F.col("n") * HOT > total).select("digest", "first"))  # at most HOT rows
    own = index.select("digest", "file", "offset")
    again = own.join(hot, "digest").union(own.join(hot, "digest", "left_anti").join(firsts.where(F.col("n") * HOT <= total).select("digest", "first"), "digest"))
    again = again.where("file <> first.file OR offset <> first.offset")
    again = materialize(again.select("file", "offset", F.col("first.page").alias("of_page"), F.col("first.id").alias("of_id"), F.col("first.url").alias("of_url"), F.col("first.date").alias("of_date")), "archive-revisits")

    names = ["id", "info", "kind", "content", "url", "ip", "date", "head", "payload", "digest", "truncated"]
    whole = pa.schema([("file", pa.string()), ("offset", pa.int64()), *((n, pa.binary() if n in ("head", "payload") else pa.bool_() if n == "truncated" else pa.string()) for n in names)])
    rows = read_files(
        spark, arc_path, lambda s: ((r["offset"], *(e[n] for n in names)) for r in arc_records(s) if (e := equivalent(r))), whole,
        "file string, offset bigint, id string, info string, kind string, content string, url string, ip string, date string, head binary, payload binary, digest string, truncated boolean",
    )
    joined = rows.join(again, ["file", "offset"], "left").select(*names, "of_page", "of_id", "of_url", "of_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _binary_rows(((warc_record(*x),) for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), _RAW)

    joined.mapInArrow(run, "value string").write.options(**_GZIP).option("lineSep", RECORD_END).text(warc_path)


def warc_record(id_, info, kind, content, url, ip, date, head, payload, digest, truncated, of_page, of_id, of_url, of_date) -> bytes:
    again = of_id is not None
    block = head if again else head + payload
    fields = [
        ("WARC-Record-ID", id_), ("WARC-Date", date), ("WARC-Target-URI", None if kind == "warcinfo" else url), ("WARC-Filename", url.partition("://")[2] if kind == "warcinfo" else None),
        ("WARC-Warcinfo-ID", None if kind == "warcinfo" else info), ("WARC-IP-Address", None if ip == "0.0.0.0" else ip), ("WARC-Block-Digest", f"sha1:{sha1(block)}"),
        ("WARC-Payload-Digest", None if kind == "warcinfo" else f"sha1:{digest}"), ("WARC-Truncated", "unspecified" if truncated else None),
        ("WARC-Profile", IDENTICAL if again else None), ("WARC-Refers-To", of_id), ("WARC-Refers-To-Target-URI", of_url), ("WARC-Refers-To-Date", of_date), ("X-Refers-To-Page-Id", of_page),
    ]
    return warc_head("revisit" if again else kind, fields, content, len(block)) + block


# -- WARC


def warc_records(source: Source) -> Iterator[dict]:
    """Records of a WARC file: fields by lower-case name, block, truncated. Lines between records that don't start one are passed over."""
    while line := source.line():
        if not line.startswith(b"WARC/"):
            continue
        fields, last = {}, None
        while (line := source.line()).strip():
            if line[:1] in b" \t" and last:  # a folded line
                fields[last] += " " + line.decode("utf-8", "replace").strip()
            else:
                key, _, value = line.decode("utf-8", "replace").partition(":")
                last = key.strip().lower()
                fields[last] = value.strip()
        told = fields.get("content-length", "")
        length = int(told) if told.isdecimal() else 0
        block = source.read(length)
        yield {"fields": fields, "block": block, "truncated": len(block) < length}


WARC_ROWS = "path string, record_id string, record_type string, date string, uri string, page_id bigint, payload_bytes bigint, payload_digest string, refers_to bigint, intact boolean"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row a record of all WARC files below ``path``: WARC_ROWS.

    payload_bytes and payload_digest are those of the full payload: computed for a record that holds it, and for a
    revisit those that it declares. ``intact``: the block has its declared length and digest.
    """

    def rows(source: Source) -> Iterator[tuple]:
        for r in warc_records(source):
            f, block = r["fields"], r["block"]
            head, payload = split_http(block) or (b"", block)
            page, of, size = http_field(head, b"X-Page-Id"), f.get("x-refers-to-page-id"), len(payload)
            digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
            if f.get("warc-type") == "revisit":
                told = http_field(head, b"Content-Length")
                size = int(told) if told and told.isdigit() else None
            else:
                digest = sha1(payload)
            intact = not r["truncated"] and f.get("warc-block-digest") == f"sha1:{sha1(block)}"
            yield f.get("warc-record-id"), f.get("warc-type"), f.get("warc-date"), f.get("warc-target-uri"), int(page) if page else None, size, digest, int(of) if of else None, intact

    schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])
    return read_files(spark, path, rows, schema, WARC_ROWS)


def op13_warc(spark, sf_dir: str) -> DataFrame:
    """Pages as ARC files, converted to WARC and read back; the files lie in the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/foliowright/archives-{uuid.uuid4().hex}"
    write_arc(load(spark, sf_dir, "pages"), f"{folder}/arc")
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc").where("record_type IN ('response', 'revisit')").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b FROM pages
), d AS (
  SELECT *, sha1(b) AS h, first_value(r) OVER (PARTITION BY b ORDER BY page_id NULLS LAST, r) AS first,
         first_value(page_id) OVER (PARTITION BY b ORDER BY page_id NULLS LAST, r) AS of FROM p
)
SELECT page_id, octet_length(b) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, 10 * (i // 8)::INTEGER + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::BIGINT) & 31) + 1), 1)), '') AS payload_digest,
       CASE WHEN r = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first THEN of END AS refers_to
FROM d
"""
