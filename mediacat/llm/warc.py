"""Web archives in ZIP packages: WARC records written and read back by byte range.

A package is a ZIP file whose members are all stored, not deflated:

* ``archive/data.warc.gz``: one gzip member per WARC/1.1 record;
* ``indexes/index.jsonl``: one line per record with the archive member's name below
  ``archive/`` and the record's offset and length inside it.

The reader takes any number of archives and of indexes (``.jsonl``) under these folders. A line
that names no archive is about the only one.

The reader never extracts a member. It reads the end-of-central-directory record from
the tail (with its ZIP64 locator and record where sizes or counts need them), walks the
central directory, resolves each member's data offset from its local header, reads the
index member, and then range-reads single records.

Writing: each task streams its rows into one package under a fresh name and returns one
manifest row. The manifest is checkpointed, so a package left behind by a lost or
repeated attempt is never read. Packages live in the shared folder and are opened by
``pyarrow.fs``, which takes local, HDFS and object-store URIs.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediacat.llm.common import BROADCAST_ROWS, join_in_place, materialize, shared_dir, text_or_empty

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Payloads below this size are always stored in full.
MIN_REVISIT_BYTES = 1000
_DATE = "2000-01-01T00:00:00Z"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


# ---------------------------------------------------------------- ZIP packages


class StoredZipWriter:
    """Writes stored members to a stream that can't seek; ZIP64 throughout if ``zip64``."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.zip64, self.members = out, 0, zip64, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.members.append({"name": raw, "header": self.at, "size": 0, "crc": 0})
        # Sizes follow in a ZIP64 data descriptor (flag bit 3), as they aren't known yet.
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0x0808, 0, 0, 0x21, 0, _MAX32, _MAX32, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> int:
        """Append to the open member; the offset inside it at which ``data`` starts."""
        m = self.members[-1]
        at = m["size"]
        self._put(data)
        m["size"] += len(data)
        m["crc"] = zlib.crc32(data, m["crc"])
        return at

    def end(self) -> None:
        m = self.members[-1]
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", m["crc"], m["size"], m["size"]))

    def close(self) -> None:
        start = self.at
        for m in self.members:
            wide = self.zip64 or m["size"] >= _MAX32 or m["header"] >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["header"]) if wide else b""
            size, header = (_MAX32, _MAX32) if wide else (m["size"], m["header"])
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size, len(m["name"]), len(extra), 0, 0, 0, 0, header) + m["name"] + extra)
        length, n = self.at - start, len(self.members)
        if self.zip64 or start >= _MAX32 or length >= _MAX32 or n >= _MAX16:
            end = self.at
            self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, length, start))
            self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
            n, length, start = _MAX16, _MAX32, _MAX32
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, length, start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    size: int


def zip_directory(read_at, size: int) -> dict[str, Member]:
    """The stored members of a package; ``read_at(offset, length)`` returns bytes.

    Raises ``ValueError`` if there is no directory or a member is compressed.
    """
    tail_at = max(0, size - (22 + _MAX16))
    tail = read_at(tail_at, size - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)  # the signature may occur inside the comment
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, start = struct.unpack_from("<HHHHII", tail, at + 4)
    if n == _MAX16 or length == _MAX32 or start == _MAX32:
        locator = read_at(tail_at + at - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = read_at(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, at, found = read_at(start, length), 0, {}
    for _ in range(n):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, csize, usize = struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20)
        len_name, len_extra, len_comment = struct.unpack_from("<HHH", directory, at + 28)
        header = struct.unpack_from("<I", directory, at + 42)[0]
        name = directory[at + 46 : at + 46 + len_name].decode()
        extra = directory[at + 46 + len_name : at + 46 + len_name + len_extra]
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == 1:  # holds only the values that don't fit, in this order
                wide = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                usize = next(wide) if usize == _MAX32 else usize
                csize = next(wide) if csize == _MAX32 else csize
                header = next(wide) if header == _MAX32 else header
            extra = extra[4 + k :]
        if method != 0 or csize != usize:
            raise ValueError(f"{name} is compressed")
        local = read_at(header, 30)
        found[name] = Member(name, header + 30 + sum(struct.unpack_from("<HH", local, 26)), usize)
        at += 46 + len_name + len_extra + len_comment
    return found


# ---------------------------------------------------------------- WARC records


def warc_record(kind: str, record_id: str, uri: str, digest: str, payload: bytes, payload_bytes: int, refers_to: str | None) -> bytes:
    """One record; a revisit has no block and names the record that holds its payload."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", _DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to), ("X-Payload-Length", str(payload_bytes))]
        payload = b""
    lines += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    clean = lambda v: " ".join(str(v).split())  # noqa: E731  a header's value stays on its line
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {clean(v)}\r\n" for k, v in lines).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_warc_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def _record_id(page_id) -> str:
    return "<urn:page:none>" if page_id is None else f"<urn:page:{page_id}>"


def _page_id(record_id: str | None) -> int | None:
    value = record_id[len("<urn:page:") : -1] if record_id else "none"
    return None if value == "none" else int(value)


# ---------------------------------------------------------------- Spark jobs

_MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("n_records", T.LongType())])
_PLACES = "path string, offset bigint, length bigint"
_RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, html, digest, n_bytes, keeper)``: keeper is the largest id among rows
    with an equal payload of at least ``min_bytes`` bytes, null where no other row has it."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    p = p.withColumn("digest", F.sha1(F.encode("html", "utf-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    repeated = p.where(F.col("n_bytes") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    repeated = materialize(repeated)
    # Payloads of more than that share of the rows are fewer than the bound: broadcast, so hot ones stay in place.
    often = repeated.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * BROADCAST_ROWS > often
    met = p.join(F.broadcast(repeated.where(hot).drop("n")), "digest", "left")
    rest = repeated.where(~hot).select("digest", F.col("keeper").alias("other"))
    columns = ["page_id", "url", "html", "digest", "n_bytes", "keeper"]
    if rest.isEmpty():
        return met.select(*columns)
    met = join_in_place(met, materialize(rest), ["digest"], "left")
    return met.withColumn("keeper", F.coalesce("keeper", "other")).select(*columns)


def write_packages(pages: DataFrame, folder: str, zip64: bool = False) -> DataFrame:
    """Write the rows of :func:`with_revisits` as packages under the URI ``folder``.

    Returns the materialized manifest ``(path, size, n_records)``. Rows whose id equals
    their keeper are responses, the other rows of that payload are revisits.
    """
    columns = ["page_id", "url", "html", "digest", "n_bytes", "keeper"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(len(columns))), strict=True):
                page_id, url, html, digest, n_bytes, keeper = (x.as_py() for x in row)
                if out is None:
                    store, base = fs.FileSystem.from_uri(folder)
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{base}/{name}")
                    package, places = StoredZipWriter(out, zip64), []
                    package.begin(ARCHIVE)
                again = keeper is not None and page_id != keeper
                raw = gzip.compress(warc_record("revisit" if again else "response", _record_id(page_id), url or "", digest, html.encode(), n_bytes, _record_id(keeper)), 6, mtime=0)
                places.append((package.write(raw), len(raw)))
        if out is None:
            return
        package.end()
        package.begin(INDEX)
        for offset, length in places:
            package.write(json.dumps({"filename": ARCHIVE.partition("/")[2], "offset": offset, "length": length}).encode() + b"\n")
        package.end()
        package.close()
        out.close()
        yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "size": package.at, "n_records": len(places)}], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("n_records", pa.int64())]))

    return materialize(pages.select(*columns).mapInArrow(run, _MANIFEST))


def _opened(path: str):
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def record_places(members: dict[str, Member], read) -> list[tuple[int, int]]:
    """``(offset, length)`` in the file of every record that the indexes of a package list.

    ``read(member)`` returns a member's bytes. ``ValueError`` for a line about an archive that
    the package doesn't hold, or about none of several.
    """
    archives = {n.removeprefix("archive/"): m for n, m in members.items() if n.startswith("archive/") and m.size}
    out = []
    for name in sorted(n for n in members if n.startswith("indexes/") and n.endswith(".jsonl")):
        for line in map(json.loads, read(members[name]).splitlines()):
            archive = archives.get(line["filename"]) if "filename" in line else next(iter(archives.values())) if len(archives) == 1 else None
            if archive is None:
                raise ValueError(f"{name}: a line names no archive of the package")
            out.append((archive.offset + int(line["offset"]), int(line["length"])))
    return out


def locate_records(manifest: DataFrame, batch: int = 10_000) -> DataFrame:
    """``(path, offset, length)`` of every record, from each package's directory and index;
    offsets count from the start of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                with _opened(path) as f:
                    members = zip_directory(lambda at, n: f.read_at(n, at), f.size())
                    places = record_places(members, lambda m: f.read_at(m.size, m.offset))  # noqa: B023
                for k in range(0, len(places), batch):
                    part = places[k : k + batch]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64())], names=["path", "offset", "length"])

    return manifest.select("path").mapInArrow(run, _PLACES)


def read_records(places: DataFrame, with_payload: bool = True, batch: int = 256) -> DataFrame:
    """Range-read the records; digests and sizes of responses are taken from their bytes.

    A record whose bytes don't have the digest in its header raises ``ValueError``.
    """

    def row(raw: bytes) -> dict:
        headers, payload = parse_warc_record(gzip.decompress(raw))
        digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{headers['warc-record-id']}: wrong payload digest")
        n = len(payload) if kind == "response" else int(headers["x-payload-length"])
        return {"page_id": _page_id(headers["warc-record-id"]), "url": headers["warc-target-uri"], "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": _page_id(headers.get("warc-refers-to")), "payload": payload if with_payload and kind == "response" else None}

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            rows = []
            for p, at, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if p != path:
                    if f is not None:
                        f.close()
                    path, f = p, _opened(p)
                rows.append(row(f.read_at(n, at)))
                if len(rows) == batch:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if f is not None:
            f.close()

    return places.mapInArrow(run, _RECORDS)


def round_trip(pages: DataFrame, folder: str | None = None, zip64: bool = False) -> DataFrame:
    """Write every row of ``pages`` as a record, read all packages back and describe each record.

    Null html is an empty payload; null ids are kept (record id ``<urn:page:none>``);
    rows repeated with the largest id are responses each; no row gives no package.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    places = locate_records(write_packages(with_revisits(pages), folder, zip64))
    return read_records(places, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
