"""Legacy ARC archives: writer, reader and converter to WARC 1.1.

An ARC file starts with a ``filedesc://`` record that states its version; each
record is a header line of the fields of that version, then exactly the declared
number of bytes.  The converter turns a record into a WARC record: the archive
date becomes WARC-Date, the type follows from the URL scheme and the content,
the record id is a name-based UUID of url, date, page and digest, and payload and
block digests are made from the bytes.  Records whose payload is that of another
become revisits that refer to it.

Archives are written by Spark's text writer, whose record separator is just what
follows a record in either format, and read as binary files, so every byte goes
through Spark's file systems and only through shared folders.  Files are gzipped
as a whole and hold about ``FILE_BYTES`` bytes of payload.

Cases: a null or empty payload is empty; a null url is ``unknown:``; white space
in a url is percent-encoded in headers; page ids travel in an HTTP header, a null one
has none; repeated rows give repeated records; an empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path

FILE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
MIN_REVISIT = 100
#: How archives are written: the least work of gzip's levels, as all is read again at once.
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}
DATE = "20200101000000"
#: The header fields of the two ARC versions.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http", pa.string()), ("payload", pa.string()), ("digest", pa.string()), ("n_bytes", pa.int64())])
HEADERS = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def header_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def http_head(page_id: int | None, n: int) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n{own}\r\n".encode()


# ---- ARC


def arc_description(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 cairnfield\n{' '.join(FIELDS[version])}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name) + body


def arc_header(version: int, url: str, ip: str, date: str, kind: str, n: int, name: str) -> bytes:
    middle = [] if version == 1 else ["200", "-", "-", "0", name]
    return (" ".join([url, ip, date, kind, *middle, str(n)]) + "\n").encode()


def arc_record(version: int, page_id: int | None, url: str | None, payload: bytes, name: str, date: str = DATE) -> bytes:
    block = http_head(page_id, len(payload)) + payload
    return arc_header(version, header_url(url), "0.0.0.0", date, "text/html", len(block), name) + block


class Source:
    """Reads a gzipped or plain archive piece by piece; members may follow each other."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.held = memoryview(raw), 0, bytearray()
        self.zip = zlib.decompressobj(31) if bytes(raw[:2]) == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.raw):
            return False
        piece = self.raw[self.at : self.at + 65536]
        self.at += len(piece)
        if self.zip is None:
            self.held += piece
            return True
        self.held += self.zip.decompress(piece)
        if self.zip.eof:
            self.at -= len(self.zip.unused_data)
            self.zip = zlib.decompressobj(31)
        return True

    def line(self) -> bytes | None:
        """The next line with its end; None at the end of the archive."""
        seen = 0
        while (end := self.held.find(b"\n", seen)) < 0:
            seen = len(self.held)
            if not self._more():
                break
        n = end + 1 if end >= 0 else len(self.held)
        out = bytes(self.held[:n])
        del self.held[:n]
        return out or None

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise ValueError(f"the archive ends {n - len(self.held)} bytes before a record does")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def read_arc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record after the description."""
    source, fields = Source(raw), None
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogatepass").rstrip("\r\n").split(" ")
        content = source.take(int(parts[-1]))
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC archive starts with a filedesc record")
            fields = FIELDS[int(content.split(b" ", 1)[0])]
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} header fields, not {len(fields)}")
        yield dict(zip(fields, parts)), content


def split_http(block: bytes) -> tuple[bytes, bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return head + b"\r\n\r\n", body


def http_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode()
    return None


# ---- WARC


def record_id(url: str, date: str, page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {page_id} {digest}')}>"


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block


def warc_info(name: str) -> bytes:
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(name, DATE, None, "")), ("WARC-Date", warc_date(DATE)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: cairnfield\r\nformat: WARC File Format 1.1\r\n")


def converted(r: dict, first: int | None) -> bytes:
    """The WARC record of an ARC record; ``first`` is the page that its payload belongs to."""
    ident = record_id(r["url"], r["date"], r["page_id"], r["digest"])
    web = r["url"].startswith(("http://", "https://"))
    kind = "revisit" if first is not None and first != r["page_id"] else "response" if web or r["http"] else "resource"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["first_id"])]
        return warc_record(fields, encode(r["http"]))
    return warc_record(fields, encode(r["http"]) + encode(r["payload"] or ""))


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    source = Source(raw)
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        fields: dict[str, str] = {}
        while (line := source.line()) is not None and line.strip():
            k, _, v = line.decode("utf-8", "surrogatepass").partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, source.take(int(fields["content-length"]))


# ---- Spark


def batches(rows: Iterator[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of about BATCH_BYTES from rows and their sizes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


VALUE = pa.schema([("value", pa.string())])


def texts(pieces: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    return batches((((p.decode("utf-8"),), len(p)) for p in pieces), VALUE)


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as ARC archives, of version 1 and 2 in turn."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    total = rows.agg(F.sum(F.octet_length("html") + 200)).first()[0] or 0

    def archive(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name = 1 + part % 2, f"part-{part:05d}.arc"

        def pieces() -> Iterator[bytes]:
            yield arc_description(version, name)
            for b in it:
                for i, u, h in zip(*b.columns):
                    yield arc_record(version, i.as_py(), u.as_py(), encode(h.as_py() or ""), name)

        return texts(pieces())

    rows.repartition(int(1 + total // FILE_BYTES)).mapInArrow(archive, "value string").write.option("lineSep", "\n").options(**GZIP).text(path)


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def arc_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of ARC archives with the digest and length of their payloads."""

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in it:
                for raw in b.column(0):
                    for f, content in read_arc(raw.as_buffer().to_pybytes()):
                        head, body = split_http(content) if content.startswith(b"HTTP/") else (b"", content)
                        own = http_value(head, "X-Page-Id")
                        yield (int(own) if own is not None else None, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], head.decode(), body.decode("utf-8"), hashlib.sha256(body).hexdigest(), len(body)), len(content)

        return batches(rows(), RECORD)

    return archives(spark, path).mapInArrow(records, "page_id long, url string, ip string, date string, content_type string, http string, payload string, digest string, n_bytes long")


def convert(spark: SparkSession, arc: str, warc: str, least: int = MIN_REVISIT) -> None:
    """Convert ARC archives to WARC archives with revisit records for payloads seen at a smaller page id."""
    found = arc_records(spark, arc)
    seen = cut(found.select("page_id", "digest", "n_bytes", "url", "date"), "seen").where(F.col("n_bytes") >= least)
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    owner = seen.join(firsts, "digest").where("page_id = first").groupBy("digest", "first").agg(F.min(F.struct("url", "date")).alias("o"))
    owner = cut(owner.select("digest", "first", F.col("o.url").alias("first_url"), F.col("o.date").alias("first_date")), "firsts")
    joined = found.join(owner, "digest", "left")
    names = joined.columns

    def archive(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[bytes]:
            yield warc_info(f"part-{TaskContext.get().partitionId():05d}.warc.gz")
            for b in it:
                for row in zip(*b.columns):
                    r = {k: v.as_py() for k, v in zip(names, row)}
                    if r["first"] is not None:
                        r["first_id"] = record_id(r["first_url"], r["first_date"], r["first"], r["digest"])
                    yield converted(r, r["first"])

        return texts(pieces())

    joined.mapInArrow(archive, "value string").write.option("lineSep", "\r\n\r\n").options(**GZIP).text(warc)


def warc_records(spark: SparkSession, path: str) -> DataFrame:
    """The page records of WARC archives; digests of responses are made anew from their bytes and must agree."""

    def records(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in it:
                for raw in b.column(0):
                    for f, block in read_warc(raw.as_buffer().to_pybytes()):
                        kind = f["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, body = split_http(block)
                        digest = f["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"the payload of {f['warc-record-id']} has another digest")
                        own = http_value(head, "X-Page-Id")
                        n = len(body) if kind == "response" else int(http_value(head, "Content-Length") or 0)
                        yield (f["warc-record-id"], kind, f.get("warc-refers-to"), int(own) if own is not None else None, f["warc-target-uri"], n, digest), 400

        return batches(rows(), HEADERS)

    return archives(spark, path).mapInArrow(records, "record_id string, record_type string, refers_to_id string, page_id long, url string, payload_bytes long, payload_digest string")


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ARC archives, convert them, read the WARC archives: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    spark = pages.sparkSession
    arc, warc = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, arc, page_id, url, html)
    convert(spark, arc, warc)
    back = cut(warc_records(spark, warc), "warc-index")
    used = back.where("record_type = 'revisit'").select(F.col("refers_to_id").alias("record_id")).distinct()
    named = back.where("record_type <> 'revisit'").select("record_id", "page_id").join(used, "record_id", "left_semi").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
    named = cut(named.withColumnRenamed("record_id", "refers_to_id"), "referred")
    return back.join(named, "refers_to_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
