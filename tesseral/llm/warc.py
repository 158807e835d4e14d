"""Web archives: legacy ARC records converted to WARC, duplicates as revisits, written and read back.

An ARC file starts with a version block (`filedesc://`) that says which header
line its records have: version 1 gives url, ip, date, type and length, version 2
puts result code, checksum, location, offset and file name before the length. The
declared length rules, never the content. Header lines are read from both ends,
so that blanks in a URL or a content type do no harm, as UTF-8 or else Latin-1.
A line that does not fit, or a length beyond the file, is a bad record: it raises
ValueError, or with `bad` given is noted there with its place and reason, and
reading goes on at the next line that fits. Files may be gzip members, one or
many; a member that breaks off gives what it holds.

Each record becomes a WARC record with an identifier, date, type and digests made
from it; a record whose payload stands in another one becomes a revisit that
refers to it.

Archives are written through Spark's text writer, compressed, about `archive`
bytes of records a file, so that they land in any store Spark can write; no
archive is in memory as a whole, neither written nor read. Read back, the digest
and length of each response are those of the bytes that were read, and must be
the ones its header declares; a revisit has those of the response it refers to.

Defined results: a null or empty html has an empty payload; null urls are written
as `urn:none`; blanks in urls are percent-encoded; equal payloads with equal
page_id are all responses; a null page_id is a response that nothing refers to;
an empty table gives an empty result. Ids are integers of 64 bits, as identifiers
hold them: others fail the job. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, split_by


@dataclass(frozen=True)
class Params:
    """least: payload bytes from which equal payloads are revisits. version: of the ARC header lines. archive: bytes of records in a file; group: bytes of records converted at once. most: repeats that are broadcast at most."""

    least: int = 1000
    version: int = 1
    archive: int = 1 << 30
    group: int = 1 << 20
    date: str = "20240101000000"
    most: int = 1_000_000


@dataclass(frozen=True)
class ArcRecord:
    """fields: the header line's values by the version's names; block: the declared number of bytes."""

    fields: dict[str, str]
    block: bytes


#: Fixed names of the header line's fields for each version of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def write_arc(records: list[tuple[str, str, str, bytes]], version: int = 1, date: str = "20240101000000") -> bytes:
    """An ARC file of records (url, date, content type, block)."""
    body = f"{version} 0 tesseral\n{' '.join(FIELDS[version])}\n".encode()

    def line(url: str, when: str, kind: str, size: int, at: int) -> bytes:
        middle = "" if version == 1 else f" 200 - - {at} tesseral.arc"
        return f"{url} 0.0.0.0 {when} {kind}{middle} {size}\n".encode()

    out = [line("filedesc://tesseral.arc", date, "text/plain", len(body), 0), body, b"\n"]
    at = sum(map(len, out))
    for url, when, kind, block in records:
        head = line(url, when, kind, len(block), at)
        out += [head, block, b"\n"]
        at += len(head) + len(block) + 1
    return b"".join(out)


#: Header lines from both ends: url, ip, date, type, whatever stands before the length, length.
_LINES = {
    1: re.compile(r"(\S.*) (\S+) (\d{8,14}) (.*) (\d+)"),
    2: re.compile(r"(\S.*) (\S+) (\d{8,14}) (.*) (\S+) (\S+) (\S+) (\d+) (\S+) (\d+)"),
}


def _decoded(line: bytes) -> str:
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("latin-1")


def inflate(data: bytes) -> bytes:
    """data as it is, or what its gzip members hold; a member that breaks off gives what can be read, others follow it."""
    if not data.startswith(b"\x1f\x8b"):
        return data
    out, at = [], 0
    while at >= 0:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data[at:]))
            at = len(data) - len(member.unused_data) if member.eof and member.unused_data else -1
        except zlib.error:
            at += 2
        at = data.find(b"\x1f\x8b\x08", at) if at >= 0 else -1
    return b"".join(out)


def read_arc(data: bytes, bad: list[tuple[int, str]] | None = None) -> Iterator[ArcRecord]:
    """The records after the version block. Bad records raise ValueError, or go to `bad` as (place, reason)."""
    data, version, at = inflate(data), None, 0

    def failed(reason: str) -> None:
        if bad is None:
            raise ValueError(f"{reason} at {at}")
        bad.append((at, reason))

    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        fits = _LINES[version or 1].fullmatch(_decoded(line))
        size = int(fits[fits.re.groups]) if fits else -1
        if end < 0 or not fits:
            failed("header line does not end" if end < 0 else f"header line does not fit version {version or 1}")
        elif end + 1 + size > len(data):
            failed(f"record declares {size} bytes, {len(data) - end - 1} are left")
        else:
            block = data[end + 1 : end + 1 + size]
            if version is None:
                said = block.split(b" ", 1)[0]
                version = int(said) if said in (b"1", b"2") else 1
                if not line.startswith(b"filedesc://"):
                    failed("no version block")
                    yield ArcRecord(dict(zip(FIELDS[1], fits.groups(), strict=True)), block)
            else:
                yield ArcRecord(dict(zip(FIELDS[version], fits.groups(), strict=True)), block)
            at = end + 1 + size
            continue
        # Only when told to go on: the next line that could be a header.
        at = len(data) if end < 0 else end + 1


def _arc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "url", "ip", "date", "content_type", "block", "error"]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            bad: list[tuple[int, str]] = []
            for r in read_arc(data.as_py(), bad):
                values = [path, *(r.fields[k] for k in FIELDS[1][:4]), r.block, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if n == "block" else pa.string()) for n, v in zip(names, values, strict=True)], names=names)
            errors = [f"{reason} at {at}" for at, reason in bad]
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(bad), pa.string()), *[pa.nulls(len(bad), pa.string())] * 4, pa.nulls(len(bad), pa.binary()), pa.array(errors, pa.string())], names=names)


def read_arc_files(spark, path: str) -> DataFrame:  # noqa: ANN001
    """(path, url, ip, date, content_type, block, error) of all .arc and .arc.gz files that Spark's path names: a row a record, and a row with its reason for every record that could not be read. A file is read by one task and has to fit its memory."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_arc_rows, "path string, url string, ip string, date string, content_type string, block binary, error string")


def record_id(number: int | None, seed: bytes = b"") -> str:
    """A UUID (version 8) that holds a 64-bit number; a version 5 one from the seed where there is none."""
    if number is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, hashlib.sha1(seed).hexdigest())}>"
    value = (number + (1 << 63)) & ((1 << 64) - 1)
    return f"<urn:uuid:{uuid.UUID(int=(value >> 16) << 80 | 8 << 76 | ((value >> 4) & 0xFFF) << 64 | 0b10 << 62 | (value & 0xF) << 58)}>"


def record_number(name: str | None) -> int | None:
    """The number that record_id() put into an identifier."""
    if not name:
        return None
    x = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if (x >> 76) & 15 != 8:
        return None
    return (((x >> 80) << 16) | (((x >> 64) & 0xFFF) << 4) | ((x >> 58) & 0xF)) - (1 << 63)


def _head(block: bytes) -> tuple[dict[str, str], int]:
    """Headers of an HTTP message, lower-case names, and where its payload begins."""
    at = block.find(b"\r\n\r\n")
    at = len(block) if at < 0 else at
    lines = _decoded(block[:at]).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, min(len(block), at + 4)


def arc_to_warc(record: ArcRecord) -> bytes:
    """One WARC record without the blank lines after it. Our own pages name themselves and what they repeat in their HTTP headers."""
    when = record.fields["Archive-date"]
    when = when.ljust(14, "0")
    date = f"{when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z"
    heads, at = _head(record.block)
    payload = record.block[at:]
    number = int(heads["x-page-id"]) if "x-page-id" in heads else None
    digest = hashlib.sha1(payload).hexdigest()
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id(number, record.block), "WARC-Date": date, "WARC-Target-URI": record.fields["URL"], "WARC-IP-Address": record.fields["IP-address"], "WARC-Payload-Digest": f"sha1:{digest}"}
    block = record.block
    if "x-repeats" in heads:
        headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(int(heads["x-repeats"]))}
        block = record.block[:at]
    headers |= {"WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record, by declared lengths."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at {at}")
        heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8").split("\r\n")[1:])}
        size = int(heads["content-length"])
        if end + 4 + size > len(data):
            raise ValueError(f"record at {at} declares {size} bytes")
        yield heads, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def _safe(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def _archives(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (page_id, url, html, refers_to) as WARC records, one a row: ARC files of about `group` bytes, converted."""

    def group(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([arc_to_warc(r) for r in read_arc(write_arc(held, p.version, p.date))], pa.binary())], names=["record"])

    held, size = [], 0
    for batch in batches:
        for i in range(len(batch)):
            page, url, html, to = (batch.column(k)[i].as_py() for k in range(4))
            payload = (html or "").encode()
            own = (f"X-Page-Id: {page}\r\n" if page is not None else "") + (f"X-Repeats: {to}\r\n" if to is not None else "")
            block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload
            held.append((_safe(url), p.date, "text/html", block))
            size += len(block)
            if size >= p.group:
                yield group(held)
                held, size = [], 0
    if held:
        yield group(held)


_END = "\r\n\r\n"


def write_archives(pages: DataFrame, path: str, params: Params = Params()) -> None:
    """Writes pages(page_id, url, html, refers_to) as compressed WARC files below path; a file ends after as many records as have `archive` bytes at the table's mean, or with its task."""
    rows = pages.select("page_id", "url", "html", "refers_to")
    mean = rows.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    records = rows.mapInArrow(lambda it: _archives(it, params), "record binary")
    # Bytes pass through the text writer as they are; it ends each record.
    out = records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", _END).option("compression", "gzip")
    out.option("maxRecordsPerFile", max(1, int(params.archive / (mean + 500)))).text(path)


class Reader:
    """Records from the pieces of an archive between blank lines: a header, then as many pieces as its declared length has."""

    def __init__(self) -> None:
        self.heads: dict[str, str] | None = None
        self.parts: list[bytes] = []
        self.have = self.size = 0

    def take(self, piece: bytes) -> tuple[dict[str, str], bytes] | None:
        """Headers (lower-case names) and block of the record that this piece ends, if it does."""
        if self.heads is None:
            if not piece.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {piece[:40]!r}")
            self.heads = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in piece.decode("utf-8").split("\r\n")[1:])}
            self.parts, self.have, self.size = [], 0, int(self.heads["content-length"])
            return None
        if self.parts:
            self.parts.append(_END.encode())
            self.have += len(_END)
        self.parts.append(piece)
        self.have += len(piece)
        if self.have > self.size:
            raise ValueError(f"{self.heads.get('warc-record-id')} declares {self.size} bytes and has more")
        if self.have < self.size:
            return None
        heads, self.heads = self.heads, None
        return heads, b"".join(self.parts)


def read_record(heads: dict[str, str], block: bytes) -> tuple[int | None, int | None, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to. The digests of what was read must be the declared ones, else ValueError; a revisit has no payload of its own."""
    declared, kind = heads["warc-payload-digest"].removeprefix("sha1:"), heads["warc-type"]
    if heads["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"{heads['warc-record-id']}: block digest differs")
    _, at = _head(block)
    if kind == "response" and hashlib.sha1(block[at:]).hexdigest() != declared:
        raise ValueError(f"{heads['warc-record-id']}: payload digest differs")
    return record_number(heads["warc-record-id"]), len(block) - at if kind == "response" else None, declared, kind, record_number(heads.get("warc-refers-to"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    reader = Reader()
    for batch in batches:
        rows = [read_record(*found) for piece in batch.column(0).to_pylist() if (found := reader.take(piece))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    if reader.heads is not None:
        raise ValueError(f"{reader.heads.get('warc-record-id')} breaks off")


def read_archives(spark, path: str) -> DataFrame:  # noqa: ANN001
    """page_id, payload_bytes (null for a revisit), payload_digest, record_type, refers_to of every record below path. A compressed file is one task's; it is read piece by piece."""
    pieces = spark.read.option("lineSep", _END).text(path).select(F.col("value").cast("binary").alias("piece"))
    return pieces.mapInArrow(_records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def find_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: Params = Params()) -> DataFrame:
    """page_id, url, html, refers_to: the largest page_id with the same payload of at least `least` bytes, null for itself."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    key = F.when(F.octet_length("html") >= params.least, F.sha2("html", 256))
    # A key of 256 bits and the largest id travel, not the pages.
    keys = materialize(rows.where("page_id is not null").select("page_id", key.alias("key")).where("key is not null"), "keys")
    same = materialize(keys.groupBy("key").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least")).where("last > least").select("key", "last"), "same")
    repeats = keys.join(same, "key").where("page_id != last").select(F.col("page_id").alias("id"), F.col("key").alias("own"), F.col("last").alias("refers_to")).distinct()
    repeats = materialize(repeats, "repeats")

    def met(some: DataFrame, other: DataFrame) -> DataFrame:
        return some.withColumn("key", key).join(other, F.expr("page_id = id and key = own"), "left").select("page_id", "url", "html", "refers_to")

    if repeats.count() <= params.most:
        return met(rows, F.broadcast(repeats))
    # Beyond that only pages whose id repeats something are shuffled, the others pass by a filter of fixed size.
    near, others = split_by(rows, "page_id", repeats, "id")
    return met(near, repeats).unionByName(others.withColumn("refers_to", F.lit(None).cast("long")))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", params: Params = Params()) -> DataFrame:
    """Writes pages as archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(find_revisits(pages, id_col, url_col, html_col, params), path, params)
    found = materialize(read_archives(spark, path), "records")
    # A revisit's payload is the one of the response that it names, under the digest that both declare.
    again = found.where("record_type = 'revisit'")
    whole = found.where("record_type = 'response'").select(F.col("page_id").alias("id"), F.col("payload_digest").alias("same"), F.col("payload_bytes").alias("size"))
    whole = whole.join(again.select(F.col("refers_to").alias("id")).distinct(), "id", "left_semi").distinct()
    met = again.join(whole, F.expr("refers_to = id and payload_digest = same"), "left")
    return found.where("record_type = 'response'").unionByName(met.select("page_id", F.col("size").alias("payload_bytes"), F.col("same").alias("payload_digest"), "record_type", "refers_to"))
