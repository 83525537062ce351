"""WARC records in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file whose members are stored: `archive/data.warc.gz`, one gzip member per record, and
`indexes/index.cdxj`, one line per record with its offset and length in that member. The reader fetches the end of the
file, parses the end-of-directory record (and the ZIP64 one where sizes or counts overflow), the central directory and
the local headers, and then reads single records by their ranges. Reading is in two Spark steps, index lines and records,
so that a filter on the lines saves the reads. Lines are dealt to tasks by package and SPAN bytes of its data, so that
the number of reading tasks follows the bytes and several tasks can read one package.

Every task writes packages of bounded size under names of its own attempt; the table of packages, written by Spark, lists
those of the attempts that succeeded, so that a lost executor leaves only files that nothing refers to.

Defined cases: null html is an empty payload; a null url is left out; control characters in urls are percent-encoded; rows
of the least page_id of a payload are all responses; null page_ids rank after all others; an empty table writes nothing
and gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.staging import new_path, shuffle_width, staged

PACKAGE_BYTES, SPAN = 32 << 20, 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF
DATE = "1970-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with a response record, or a revisit record that keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    block = http if revisit else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def parse_record(member: bytes) -> dict:
    """Headers and payload of a record; checks the payload of a response against its digest."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class PackageWriter:
    """Writes stored ZIP members one after another; zip64 also forces the 64-bit directory forms."""

    def __init__(self, sink, zip64: bool = False):
        self.sink, self.zip64, self.at, self.entries = sink, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: list[bytes]) -> None:
        size, crc, raw = sum(map(len, chunks)), 0, name.encode()
        for c in chunks:
            crc = zlib.crc32(c, crc)
        wide = self.zip64 or size >= BIG32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if wide else b""
        self.entries.append((raw, crc, size, self.at))
        self._put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x800, 0, 0, 33, crc, BIG32 if wide else size, BIG32 if wide else size, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._put(c)

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, at in self.entries:
            wide = self.zip64 or size >= BIG32 or at >= BIG32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            self._put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x800, 0, 0, 33, crc, BIG32 if wide else size, BIG32 if wide else size, len(raw), len(extra), 0, 0, 0, 0, BIG32 if wide else at) + raw + extra)
        n, size = len(self.entries), self.at - begin
        wide = self.zip64 or begin >= BIG32 or n >= BIG16
        if wide:
            end = self.at
            self._put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, begin))
            self._put(LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        self._put(END + struct.pack("<HHHHIIH", 0, 0, BIG16 if wide else n, BIG16 if wide else n, BIG32 if wide else size, BIG32 if wide else begin, 0))


class PackageReader:
    """Finds members through the central directory and reads ranges of stored ones; file needs size(), seek() and read()."""

    def __init__(self, file):
        self.file, self.length = file, file.size()
        self.members = self._directory()

    def _range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the package is cut short")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        tail_at = max(0, self.length - 65_557)  # the end record and the longest comment
        tail = self._range(tail_at, self.length - tail_at)
        found = tail.rfind(END)
        if found < 0:
            raise ValueError("not a ZIP package: no end of directory")
        n, size, at = struct.unpack_from("<HII", tail, found + 10)
        if BIG16 == n or BIG32 in (size, at):
            where = tail_at + found - 20
            locator = self._range(where, 20) if where >= 0 else b""
            if locator[:4] == LOCATOR64:
                end = self._range(struct.unpack_from("<Q", locator, 8)[0], 56)
                if end[:4] != END64:
                    raise ValueError("broken ZIP64 directory")
                n, size, at = struct.unpack_from("<QQQ", end, 32)
        data, members, i = self._range(at, size), {}, 0
        for _ in range(n):
            if data[i : i + 4] != CENTRAL:
                raise ValueError("broken central directory")
            method, packed, plain, names, extras, comments, offset = (*struct.unpack_from("<H", data, i + 10), *struct.unpack_from("<II", data, i + 20), *struct.unpack_from("<HHH", data, i + 28), *struct.unpack_from("<I", data, i + 42))
            name, extra = data[i + 46 : i + 46 + names].decode(), data[i + 46 + names : i + 46 + names + extras]
            wide, j = [], 0
            while j + 4 <= len(extra):
                tag, length = struct.unpack_from("<HH", extra, j)
                if tag == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, j + 4))
                j += 4 + length
            plain = wide.pop(0) if plain == BIG32 and wide else plain
            packed = wide.pop(0) if packed == BIG32 and wide else packed
            offset = wide.pop(0) if offset == BIG32 and wide else offset
            members[name] = (method, offset, packed)
            i += 46 + names + extras + comments
        return members

    def start(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and their number."""
        method, at, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = self._range(at, 30)
        if head[:4] != LOCAL:
            raise ValueError("broken local header")
        return at + 30 + sum(struct.unpack_from("<HH", head, 26)), size

    def read(self, name: str, offset: int = 0, size: int | None = None) -> bytes:
        at, whole = self.start(name)
        return self._range(at + offset, whole - offset if size is None else size)


def first_of_each(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest (hex SHA-1), first_id and revisit.

    Digests alone are compared; html crosses the network once, dealt by page, and never by a common payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    narrow = staged(rows.select("page_id", "digest"), "payloads")
    shared = narrow.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id")
    again = narrow.join(shared, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("s_id"), F.col("digest").alias("s_digest"), "first_id").distinct()
    joined = rows.join(again, F.col("page_id").eqNullSafe(F.col("s_id")) & (F.col("digest") == F.col("s_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", "first_id", F.col("s_digest").isNotNull().alias("revisit"))


def write_packages(pages: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes all pages and returns the table of packages: path, n_records, n_bytes (of the records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        members, lines, size = [], [], 0

        def flush() -> pa.RecordBatch:
            name = f"{root}/{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(name) as sink:
                writer = PackageWriter(sink, zip64)
                writer.member(DATA, members)
                writer.member(INDEX, ["".join(lines).encode()])
                writer.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(members)], pa.int64()), pa.array([size], pa.int64())], names=["path", "n_records", "n_bytes"])

        for batch in batches:
            for page_id, url, html, digest, first_id, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = base64.b32encode(bytes.fromhex(digest)).decode()
                member = record(page_id, url, html.encode(), own, first_id, revisit)
                lines.append(json.dumps({"id": page_id, "offset": size, "length": len(member)}) + "\n")
                members.append(member)
                size += len(member)
                if size >= package_bytes:
                    yield flush()
                    members, lines, size = [], [], 0
        if members:
            yield flush()

    return staged(first_of_each(pages).mapInArrow(run, "path string, n_records long, n_bytes long"), "packages")


def read_index(packages: DataFrame, folder: str) -> DataFrame:
    """One row per record: path, page_id, offset, length; only directories and indexes are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with fs.open_input_file(path) as file:
                    package = PackageReader(file)
                    begin, _ = package.start(DATA)
                    rows = [json.loads(x) for x in package.read(INDEX).decode().splitlines()]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([r["id"] for r in rows], pa.int64()), pa.array([begin + r["offset"] for r in rows], pa.int64()), pa.array([r["length"] for r in rows], pa.int64())], names=["path", "page_id", "offset", "length"])

    width = shuffle_width(packages.sparkSession)
    load = packages.agg(F.sum("n_bytes")).first()[0] or 0
    lines = packages.select("path").repartition(width, "path").mapInArrow(run, "path string, page_id long, offset long, length long")
    # a number of its own, so that adaptive execution does not put the small lines of large records together
    return lines.repartition(max(width, -(-load // SPAN)), "path", F.expr(f"offset div {SPAN}")).sortWithinPartitions("path", "offset")


def read_records(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """The records of index lines, each read by its range; payloads adds the bytes of responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            found = []
            for path, at, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if path != name:
                    if file:
                        file.close()
                    name, file = path, fs.open_input_file(path)
                found.append(parse_record(file.read_at(size, at)))
            if found:
                columns = [pa.array([r["page_id"] for r in found], pa.int64()), pa.array([r["url"] for r in found], pa.string()), pa.array([r["record_type"] for r in found], pa.string()), pa.array([r["payload_bytes"] for r in found], pa.int64()), pa.array([r["payload_digest"] for r in found], pa.string()), pa.array([r["refers_to"] for r in found], pa.int64())]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                if payloads:
                    columns.append(pa.array([r["payload"] for r in found], pa.binary()))
                    names.append("payload")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        if file:
            file.close()

    return index.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payloads)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages to packages in the shared folder and reads every record back."""
    folder = new_path(pages.sparkSession, "wacz")
    return read_records(read_index(write_packages(pages, folder), folder), folder)
