"""Converter of legacy ARC archives to WARC.

An ARC record is a header line, whose fields depend on the version that the file's first record
declares, and as many bytes as the line says. Each becomes a WARC record with the same URI, time and
block, an identifier made from these, a type by its block, and SHA-1 digests of block and payload.

Archives are written by Spark's own text writer, compressed as a whole by gzip: every record ends in a line feed, so
a record without it is one row. A file holds at most about ``bytes_per_file`` bytes of records, or one record that is
larger. No file is opened by path in Python, so any store that Spark reaches will do.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, small_batches

#: Fields of the header line by ARC version; the last is the length in either.
ARC_FIELDS = {1: ("url", "ip", "date", "mime", "length"), 2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # of URLs, RFC 4122
CRLF = b"\r\n"


@dataclass
class ArcRecord:
    version: int
    fields: dict[str, str]
    block: bytes


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def to_bytes(self) -> bytes:
        head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return head.encode() + CRLF + self.block + CRLF + CRLF


class ArchiveError(ValueError):
    """An archive that doesn't hold to its format."""


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file; the version is the one its filedesc record declares, 1 without one."""
    version, at = 1, 0
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ArchiveError(f"header line without an end at {at}")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        parts = line.split(" ")
        if parts[0].startswith("filedesc:"):
            own = 1
        else:
            own = version
        names = ARC_FIELDS[own]
        if len(parts) != len(names):
            raise ArchiveError(f"{len(parts)} fields in an ARC version {own} header at {at}")
        fields = dict(zip(names, parts))
        if not fields["length"].isdigit():
            raise ArchiveError(f"length {fields['length']!r} at {at}")
        n = int(fields["length"])
        block = data[end + 1 : end + 1 + n]
        if len(block) < n:
            raise ArchiveError(f"record at {at} is cut short")
        at = end + 1 + n
        yield ArcRecord(own, fields, block)
        if parts[0].startswith("filedesc:"):
            declared = block.split(b" ", 1)[0]
            version = int(declared) if declared in (b"1", b"2") else 1


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(head with its empty line, body) of an HTTP message; no head if the block isn't one."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


def warc_date(arc_date: str) -> str:
    d = re.sub(r"\D", "", arc_date).ljust(14, "0")[:14]
    month, day = max("01", d[4:6]), max("01", d[6:8])
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(uri: str, date: str, block_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, ' '.join((uri, date, block_digest)))}>"


def convert(arc: ArcRecord) -> WarcRecord:
    """The WARC record that says the same: warcinfo for a file description, response for an HTTP message, else resource."""
    uri, date = arc.fields["url"], warc_date(arc.fields["date"])
    head, body = split_http(arc.block)
    block_digest = digest(arc.block)
    kind = "warcinfo" if uri.startswith("filedesc:") else "response" if head else "resource"
    h = {"WARC-Type": kind, "WARC-Record-ID": record_id(uri, date, block_digest), "WARC-Date": date}
    if kind == "warcinfo":
        h["WARC-Filename"] = uri.removeprefix("filedesc://")
    else:
        h["WARC-Target-URI"] = uri
        if arc.fields["ip"] not in ("", "-", "0.0.0.0"):
            h["WARC-IP-Address"] = arc.fields["ip"]
        h["WARC-Payload-Digest"] = digest(body)
    h["WARC-Block-Digest"] = block_digest
    h["Content-Type"] = "application/http; msgtype=response" if kind == "response" else arc.fields["mime"]
    h["Content-Length"] = str(len(arc.block))
    return WarcRecord(h, arc.block)


def as_revisit(record: WarcRecord, refers_to: str) -> WarcRecord:
    """The record with its payload replaced by a reference to the record that holds it."""
    head, _ = split_http(record.block)
    h = dict(record.headers) | {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", "WARC-Refers-To": refers_to, "WARC-Block-Digest": digest(head), "Content-Length": str(len(head))}
    return WarcRecord(h, head)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ArchiveError(f"no WARC record at {at}")
        head = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) for line in head)
        n = int(headers["Content-Length"])
        block = data[end + 4 : end + 4 + n]
        at = end + 4 + n
        if len(block) < n or data[at : at + 4] != b"\r\n\r\n":
            raise ArchiveError(f"record that should end at {at} is cut short")
        at += 4
        yield WarcRecord(headers, block)


def unpacked(content: bytes) -> bytes:
    """The bytes of an archive; gzip in one or many members is undone."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out.append(d.decompress(content))
        content = d.unused_data
    return b"".join(out)


# -- DataFrames -----------------------------------------------------------------------------------


def arc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20240101000000", version: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(the kept columns, arc): a one-record ARC file of each row, of version 1 or 2, as text. The id travels in the HTTP head, as does the payload's length.

    Null payloads are empty, null urls are ``-``; spaces and ASCII control characters in urls are percent-encoded.
    """
    version = F.lit(1) if version is None else version
    body = F.coalesce(F.col(payload_col), F.lit(""))
    key = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col(id_col).cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), key, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    url = F.col(url_col)
    for c in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    url = F.coalesce(F.nullif(url, F.lit("")), F.lit("-"))
    size = (F.octet_length(head) + F.octet_length(body)).cast("string")
    more = F.when(version == 2, F.lit(" 200 - - 0 - ")).otherwise(F.lit(" "))
    desc = {n: f"{n} 0 corpusloom\n{' '.join(('URL', 'IP-address', 'Archive-date', 'Content-type') + (('Result-code', 'Checksum', 'Location', 'Offset', 'Filename') if n == 2 else ()) + ('Archive-length',))}\n" for n in (1, 2)}
    first = {n: f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(d)}\n{d}\n" for n, d in desc.items()}
    start = F.when(version == 2, F.lit(first[2])).otherwise(F.lit(first[1]))
    return pages.select(*keep, F.concat(start, url, F.lit(f" 0.0.0.0 {date} text/html"), more, size, F.lit("\n"), head, body, F.lit("\n")).alias("arc"))


def to_warc(arcs: DataFrame, refers: str | None = None) -> DataFrame:
    """The WARC records of ARC texts (column arc), a row (value) each, without its last line feed. The column named
    ``refers`` may hold the record id that the records of its row revisit."""
    small_batches(arcs.sparkSession)

    def work(batches):
        for b in batches:
            out = []
            for arc, to in zip(b.column(0), b.column(1).to_pylist()):
                for r in parse_arc(arc.as_buffer().to_pybytes()):
                    if r.fields["url"].startswith("filedesc:"):
                        continue
                    w = convert(r)
                    out.append((as_revisit(w, to) if to else w).to_bytes()[:-1])
            # The bytes are UTF-8 if the archives are; what is not is refused here rather than altered.
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    to = F.col(refers) if refers else F.lit(None).cast("string")
    return arcs.select("arc", to.alias("to")).mapInArrow(work, "value string")


def record_ids(arcs: DataFrame, key: str) -> DataFrame:
    """(key, record_id) of the records that to_warc makes."""

    def work(batches):
        for b in batches:
            keys, ids = [], []
            for arc, k in zip(b.column(0), b.column(1).to_pylist()):
                for r in parse_arc(arc.as_buffer().to_pybytes()):
                    if not r.fields["url"].startswith("filedesc:"):
                        keys.append(k)
                        ids.append(convert(r).headers["WARC-Record-ID"])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.string())], [key, "record_id"])

    return arcs.select("arc", key).mapInArrow(work, f"{key} long, record_id string")


def write_warc(records: DataFrame, path: str, bytes_per_file: int = 1 << 26) -> None:
    """Writes the records (column value) of each task to one file after another of at most about ``bytes_per_file`` bytes."""

    def number(batches):
        size = nth = 0
        for b in batches:
            sizes = pc.binary_length(b.column(0)).to_numpy(zero_copy_only=False)
            of = np.zeros(len(sizes), np.int32)
            for i, n in enumerate(sizes.tolist()):
                if size and size + n > bytes_per_file:
                    size, nth = 0, nth + 1
                size += n
                of[i] = nth
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(of)], ["value", "file"])

    numbered = records.mapInArrow(number, "value string, file int")
    numbered.write.partitionBy("file").option("lineSep", "\n").option("compression", "gzip").mode("error").text(path)


def read_warc(spark, path: str) -> DataFrame:
    """A row for each record of the archives under path: record_id, type, uri, date, refers_to (record id), page_id and
    payload_bytes (from the HTTP head), payload_digest (lower-case hex), payload_ok (a full payload agrees with its
    declared length and digest; null for revisits)."""
    schema = "record_id string, type string, uri string, date string, refers_to string, page_id long, payload_bytes long, payload_digest string, payload_ok boolean"

    def work(batches):
        for b in batches:
            for content in b.column(0):
                rows = []
                for r in parse_warc(unpacked(content.as_buffer().to_pybytes())):
                    h = r.headers
                    head, body = split_http(r.block)
                    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
                    want = h.get("WARC-Payload-Digest", "")
                    revisit = h["WARC-Type"] == "revisit"
                    n = int(fields.get("Content-Length", len(body)))
                    rows.append((h["WARC-Record-ID"], h["WARC-Type"], h.get("WARC-Target-URI"), h["WARC-Date"], h.get("WARC-Refers-To"), int(fields["X-Page-Id"]) if "X-Page-Id" in fields else None, n, base64.b32decode(want.removeprefix("sha1:")).hex(), None if revisit else n == len(body) and digest(body) == want))
                cols = list(zip(*rows)) or [[]] * 9
                kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], [x.split(" ")[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(work, schema)


class LegacyArchive:
    """Writes pages as WARC by way of ARC records, payloads repeated at ``least`` bytes or more as revisits, and reads them back.

    Of the rows with one payload the one with the largest id is the response (rows that share that id all
    are); the others revisit it. A row without an id is never referred to, and revisits nothing.
    """

    SPREAD = 16

    def __init__(self, least: int = 1000, date: str = "20240101000000", bytes_per_file: int = 1 << 26):
        self.least, self.date, self.bytes_per_file = least, date, bytes_per_file

    def write(self, pages: DataFrame, path: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
        body = F.coalesce(F.col(payload_col), F.lit(""))
        sha = F.when((F.octet_length(body) >= self.least) & F.col(id_col).isNotNull(), F.sha1(body.cast("binary")))
        src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
        keyed = src.withColumn("sha", sha)
        twice = keyed.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("page_id"), F.count("*").alias("n")).where("n > 1").select("sha", "page_id")
        # The small table is written first: only then does its size decide how it is joined.
        twice = scratch.save(twice, "twice")
        refers = None
        if not twice.isEmpty():
            holders = keyed.join(twice, ["sha", "page_id"])
            ids = record_ids(self._arcs(holders, ("page_id",)), "page_id").groupBy("page_id").agg(F.min("record_id").alias("to"))
            named = scratch.save(twice.join(ids, "page_id").select("sha", F.col("page_id").alias("last"), "to"), "named")
            # A payload that very many pages have is dealt out some ways, and pages without a payload to look up by their id.
            place = F.pmod(F.xxhash64("page_id"), F.lit(self.SPREAD)).cast("int")
            keyed = keyed.withColumn("place", place).withColumn("sha", F.coalesce("sha", F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
            named = named.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(self.SPREAD - 1))))
            src = keyed.join(named, ["sha", "place"], "left").withColumn("to", F.when(F.col("last") != F.col("page_id"), F.col("to")))
            refers = "to"
        write_warc(to_warc(self._arcs(src, (refers,) if refers else ()), refers), path, self.bytes_per_file)

    def _arcs(self, src: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        return arc_records(src, date=self.date, version=F.when(F.col("page_id") % 2 == 1, 2).otherwise(1), keep=keep)

    def read(self, spark, path: str, scratch: Scratch) -> DataFrame:
        """page_id, payload_bytes, payload_digest, record_type, refers_to (a page id), payload_ok."""
        got = scratch.save(read_warc(spark, path), "read")
        cols = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type")]
        plain = got.where("refers_to is null").select(*cols, F.lit(None).cast("long").alias("refers_to"), "payload_ok")
        ids = got.where("refers_to is null").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("page_id").alias("holder"))
        revisits = got.where("refers_to is not null").join(ids, "refers_to", "left").select(*cols, F.col("holder").alias("refers_to"), "payload_ok")
        return plain.union(revisits)

    def run(self, pages: DataFrame, **names) -> DataFrame:
        scratch = Scratch(pages.sparkSession, "warc")
        path = scratch.path("archives")
        self.write(pages, path, scratch, **names)
        return self.read(pages.sparkSession, path, scratch)
