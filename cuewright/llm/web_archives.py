"""Web archives in ZIP packages: WARC records, read by range without unpacking.

A package is a ZIP file of stored (uncompressed) members: archive/data.warc.gz with one gzip member for each record,
indexes/index.cdxj with each record's place in it, and datapackage.json. The reader finds the central directory from the
file's end, with ZIP64 records where they exist, takes the members' places from it and reads records by their offsets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import struct
import urllib.parse
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_column, small_batches, staged, work_dir
from .linkage import small_side

WARC_MEMBER, INDEX_MEMBER, PACKAGE_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

# --- records --------------------------------------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", urllib.parse.quote(url, safe="".join(map(chr, range(33, 127))))))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes

    @property
    def page_id(self) -> int | None:
        return int(self.headers["x-page-id"]) if "x-page-id" in self.headers else None

    @property
    def refers_to(self) -> int | None:
        return int(self.headers["x-refers-to-page-id"]) if "x-refers-to-page-id" in self.headers else None


def parse_record(raw: bytes) -> Record:
    """A record's headers (lower-case names) and its payload, which is checked against its length and digest."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("a WARC record is cut short")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and f"sha1:{digest_of(payload)}" != headers["warc-payload-digest"]:
        raise ValueError("a payload does not match its digest")
    return Record(headers, payload)


def gzip_member(raw: bytes, level: int = 3) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# --- packages -------------------------------------------------------------------------------------------------------


class PackageWriter:
    """Writes one package to a stream that need not be seekable."""

    def __init__(self, out) -> None:
        self.zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.warc = self.zip.open(zipfile.ZipInfo(WARC_MEMBER), "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, key: str, raw: bytes, **more: object) -> None:
        member = gzip_member(raw)
        self.warc.write(member)
        entry = {"offset": self.at, "length": len(member), "filename": WARC_MEMBER} | more
        self.lines.append((key, self.at, f"{key} {json.dumps(entry)}\n"))
        self.at += len(member)

    def close(self) -> None:
        self.warc.close()
        index = "".join(line for *_, line in sorted(self.lines)).encode()
        self.zip.writestr(zipfile.ZipInfo(INDEX_MEMBER), index)
        resources = [{"path": WARC_MEMBER, "bytes": self.at}, {"path": INDEX_MEMBER, "bytes": len(index)}]
        self.zip.writestr(zipfile.ZipInfo(PACKAGE_MEMBER), json.dumps({"profile": "data-package", "resources": resources}))
        self.zip.close()


@dataclass
class Member:
    name: str
    method: int
    size: int
    packed: int
    header_at: int


class PackageReader:
    """Finds and range-reads the stored members of a ZIP file. f: anything with size() and read_at(length, offset)."""

    def __init__(self, f) -> None:
        self.f, self.length = f, f.size()
        self.members = {m.name: m for m in self._directory()}

    def _read(self, at: int, n: int) -> bytes:
        raw = self.f.read_at(n, at)
        if len(raw) < n:
            raise ValueError("a ZIP file is cut short")
        return raw

    def _directory(self) -> list[Member]:
        tail_at = max(0, self.length - 22 - 65_535)
        tail = self._read(tail_at, self.length - tail_at)
        end = tail.rfind(b"PK\x05\x06")
        while end >= 0 and (end + 22 > len(tail) or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\x05\x06", 0, end)  # the mark may stand in the comment
        if end < 0:
            raise ValueError("no end of central directory")
        count, size, start = struct.unpack_from("<HII", tail, end + 10)
        if count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF:
            mark, _, at, _ = struct.unpack("<4sIQI", self._read(tail_at + end - 20, 20))
            if mark != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            record = self._read(at, 56)
            if record[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            count, size, start = struct.unpack_from("<QQQ", record, 32)
        raw, members, at = self._read(start, size), [], 0
        for _ in range(count):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("a central directory entry is damaged")
            method, packed, plain = struct.unpack_from("<H8xII", raw, at + 10)
            n, extra, comment = struct.unpack_from("<HHH", raw, at + 28)
            header = struct.unpack_from("<I", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + n].decode("utf-8", "replace")
            wide = self._zip64(raw[at + 46 + n : at + 46 + n + extra])
            plain, packed, header = ((wide.pop(0) if v == 0xFFFFFFFF else v) for v in (plain, packed, header))
            members.append(Member(name, method, plain, packed, header))
            at += 46 + n + extra + comment
        return members

    @staticmethod
    def _zip64(extra: bytes) -> list[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                return list(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
            at += 4 + n
        return []

    def data_at(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin in the file, and how many there are."""
        m = self.members[name]
        if m.method != 0 or m.size != m.packed:
            raise ValueError(f"{name} is not stored")
        head = self._read(m.header_at, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        n, extra = struct.unpack_from("<HH", head, 26)
        return m.header_at + 30 + n + extra, m.size

    def index(self) -> list[dict]:
        """The index entries, by place in the archive."""
        at, n = self.data_at(INDEX_MEMBER)
        lines = self._read(at, n).decode().splitlines()
        return sorted((json.loads(x[x.index("{") :]) for x in lines if x), key=lambda e: (e["filename"], e["offset"]))

    def records(self, entries: list[dict] | None = None, ahead: int = 1 << 22) -> Iterator[Record]:
        """The records of index entries (all by default); neighbours are read together, some megabytes at a time."""
        entries = self.index() if entries is None else entries
        k = 0
        while k < len(entries):
            first, to = entries[k], k + 1
            while to < len(entries) and entries[to]["filename"] == first["filename"]:
                last = entries[to - 1]
                if entries[to]["offset"] != last["offset"] + last["length"] or entries[to]["offset"] + entries[to]["length"] - first["offset"] > ahead:
                    break
                to += 1
            at, size = self.data_at(first["filename"])
            end = entries[to - 1]["offset"] + entries[to - 1]["length"]
            if end > size:
                raise ValueError("an index entry points behind its archive")
            raw = self._read(at + first["offset"], end - first["offset"])
            for e in entries[k:to]:
                a = e["offset"] - first["offset"]
                yield parse_record(zlib.decompress(raw[a : a + e["length"]], 31))
            k = to


# --- Spark ----------------------------------------------------------------------------------------------------------


def _key(url: str | None) -> str:
    """The URL as an index key: host parts reversed, then the path; no blanks."""
    parts = urllib.parse.urlsplit(urllib.parse.quote(url or "", safe="".join(map(chr, range(33, 127)))).replace("[", "").replace("]", ""))
    return ",".join(reversed(parts.netloc.lower().split(":")[0].split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def write_archives(pages: DataFrame, folder: str, *, least_bytes: int = 0, package_bytes: int = 64 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into packages under folder; returns their names.

    A null html is empty. Of rows with equal payloads of at least least_bytes, that with the smallest page_id is a
    response and the others revisit it; rows that repeat that page_id are responses too, and rows without an id revisit
    unless none of the payload's rows has one. Digests and page ids alone are shuffled to find these; pages themselves
    are shuffled only if the repeated digests are too many to be broadcast.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html"))).withColumn("bytes", F.octet_length("html"))
    groups = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = staged(groups.filter("n > 1 and first is not null").select("digest", "first"), "repeated-payloads")
    rows = rows.join(small_side(repeated), "digest", "left").select("page_id", "url", "html", "first", "digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        names, package, stream, attempt = [], None, None, f"{uuid.uuid4().hex[:12]}"

        def finish() -> None:
            package.close()
            stream.close()

        for batch in batches:
            for piece in small_batches(batch):
                columns = piece.column(0).to_pylist(), piece.column(1).to_pylist(), binary_column(piece, "html"), piece.column(3).to_pylist(), piece.column(4).to_pylist()
                for page_id, url, payload, first, sha1 in zip(*columns, strict=True):
                    if package is None:
                        # the name is this attempt's own: the manifest, which Spark commits, has those of one attempt
                        names.append(posixpath.join(root, f"part-{part:06d}-{len(names):04d}-{attempt}.wacz"))
                        stream = fs.open_output_stream(names[-1])
                        package = PackageWriter(stream)
                    revisit, digest = first is not None and page_id != first, base64.b32encode(sha1).decode()
                    package.add(_key(url), warc_record(page_id, url, payload, digest, first, revisit, date), digest=digest)
                    if package.at > package_bytes:
                        finish()
                        package = None
        if package is not None:
            finish()
        if names:
            yield pa.RecordBatch.from_pydict({"name": names})

    return staged(rows.mapInArrow(write, "name string"), "archive-names")


def read_archives(spark: SparkSession, names: DataFrame, store: str, *, payloads: bool = False) -> DataFrame:
    """The records of packages: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    names: name, one row for each package; store: a URI in the same file system. Every response's payload is checked
    against its digest. An empty table of names gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(store)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(name) as f:
                    rows: list[tuple] = []
                    for r in PackageReader(f).records():
                        h = r.headers
                        rows.append((r.page_id, h.get("warc-target-uri"), int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], r.refers_to, r.payload if payloads else None))
                        if len(rows) >= 1000:
                            yield _rows(rows, payloads)
                            rows = []
                    if rows:
                        yield _rows(rows, payloads)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return names.repartitionByRange(max(1, names.count()), "name").mapInArrow(read, schema)


def _rows(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    n = 6 + payloads
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:n], kinds[:n], strict=True)], names=list(names[:n]))


def archive_round_trip(pages: DataFrame, *, least_bytes: int = 0) -> DataFrame:
    """Write every page into packages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = work_dir(spark, "web-archives")
    names = write_archives(pages, folder, least_bytes=least_bytes)
    return read_archives(spark, names, folder).drop("url")
