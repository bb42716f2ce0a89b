"""WARC archives as a Python data source, and revisit records for equal payloads.

Archives are gzip members of one record each. A member's extra field "PL" holds its compressed length, so a reader
that needs a record no further goes to the next without inflating it. Files of other writers are read as well: from
the first member without that field, or from the start where a file isn't compressed, records follow one another in
the inflated bytes, several in a member or one across members, and are skipped by their Content-Length. Header names
count in any case, and any header but Content-Length may be missing. Files are the partitions of a scan. Filters on record_type and other header columns are
pushed down: the reader inflates a record's headers first, and payloads only of records that pass, and only if
they are asked for (option payload, "true" unless set).

Defined results: a null payload counts as empty; whole payloads are kept, of any length; equal payloads of at
least `least` bytes become revisits of the record with the smallest page_id among them; repeated rows with that
page_id are responses each; records of other types have no payload here, those of other writers no page_id; their url is
kept as it stands, their digest too, and where they have none it is that of the payload if that is read; a file that
ends inside a record is an error; appending adds records to a folder; a null page_id is no smallest id unless all are null; a null url is kept as null; an
empty table writes no records and reads back none; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

from .shared import columns, small_batches, store, table, work_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # planning workers may lack this package

SCHEMA = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"
WRITTEN = ("page_id", "url", "payload", "record_type", "payload_digest", "refers_to")
ROLL = 64 << 20
HEADERS = {"record_type": "warc-type", "url": "warc-target-uri", "payload_digest": "warc-payload-digest", "page_id": "x-page-id", "refers_to": "x-refers-to-page"}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    total = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHI", 8, b"PL", 4, total) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(page_id, url, payload: bytes, kind: str, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        plain = url == url.strip() and "\r" not in url and "\n" not in url
        lines += ["WARC-Target-URI: " + url] if plain else ["X-Escaped-URI: 1", "WARC-Target-URI: " + quote(url, safe="")]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class Warc(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own; only those that the driver's commit names count."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        paths, out, size = [], None, 0
        for batch in iterator:
            cols = [batch.column(batch.schema.names.index(n)) for n in WRITTEN]
            for i in range(batch.num_rows):
                if out is None or size > ROLL:
                    if out:
                        out.close()
                    paths.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{root}/{paths[-1]}", compression=None), 0
                page_id, url, payload, kind, digest, refers_to = (c[i].as_py() for c in cols)
                got = member(record(page_id, url, payload or b"", kind, digest, refers_to))
                out.write(got)
                size += len(got)
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages):
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_committed-{uuid.uuid4().hex}") as f:  # one for each write
            f.write("".join(f"{p}\n" for m in messages if m for p in m.paths).encode())

    def abort(self, messages):
        fs, root = _fs(self.path)
        for p in (p for m in messages if m for p in m.paths):
            fs.delete_file(f"{root}/{p}")


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.wanted = path, payload, {}

    def pushFilters(self, filters):
        for f in filters:
            at = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if at in HEADERS and isinstance(f, EqualTo):
                self.wanted.setdefault(at, []).append({f.value})
            elif at in HEADERS and isinstance(f, In):
                self.wanted.setdefault(at, []).append(set(f.value))
            elif not (at in HEADERS and isinstance(f, IsNotNull) and at in ("record_type", "payload_digest")):
                yield f

    def partitions(self):
        from pyarrow import fs as pfs

        fs, root = _fs(self.path)
        there = sorted(i.base_name for i in fs.get_file_info(pfs.FileSelector(root)))
        commits = [n for n in there if n.startswith("_committed-")]
        names = [n for n in there if n.endswith((".warc.gz", ".warc"))]
        if commits:
            names = []
            for c in commits:
                with fs.open_input_stream(f"{root}/{c}", compression=None) as f:
                    names += f.read().decode().split()
        return [Files([f"{root}/{n}"]) for n in names] or [Files([])]

    def read(self, partition):
        fs, _ = _fs(self.path)
        rows = []
        for path in partition.paths:
            with fs.open_input_file(path) as f:
                for row in self.records(f):
                    rows.append(row)
                    if len(rows) >= 500:
                        yield self.batch(rows)
                        rows = []
        if rows:
            yield self.batch(rows)

    def batch(self, rows):
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(col, k) for col, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def records(self, f):
        size, at = f.size(), 0
        while at < size:
            f.seek(at)
            head = f.read(64 << 10)
            length = own_length(head)
            if length is None:
                yield from self.parsed(Stream(inflated(f, at) if head[:2] == b"\x1f\x8b" else plain(f, at)))
                return
            start = 12 + struct.unpack_from("<H", head, 10)[0]
            z = zlib.decompressobj(-15)
            got, taken = z.decompress(head[start:length], 4096), min(length, len(head))
            while b"\r\n\r\n" not in got and not z.eof:
                got, taken = self.more(f, z, got, at, taken, length)
            first, _, rest = got.partition(b"\r\n\r\n")
            fields = headers(first)
            passes = self.passes(fields)
            if passes and self.payload and fields["warc-type"] == "response":
                parts = [rest]
                while not z.eof:
                    got, taken = self.more(f, z, b"", at, taken, length, 1 << 20)
                    parts.append(got)
                rest = b"".join(parts)
            if passes:
                yield self.row(fields, rest[: int(fields["content-length"])])
            at += length

    def parsed(self, stream):
        """Records that follow one another in a stream."""
        while (first := stream.until(b"\r\n\r\n")) is not None:
            fields = headers(first)
            passes = self.passes(fields)
            block = stream.take(int(fields["content-length"]), passes and self.payload and fields.get("warc-type") in PAYLOADS)
            if passes:
                yield self.row(fields, block)

    @staticmethod
    def more(f, z, got, at, taken, length, most=4096):
        fed = z.unconsumed_tail
        if not fed:
            f.seek(at + taken)
            fed = f.read(min(1 << 20, length - taken))
            taken += len(fed)
            if not fed:
                raise ValueError("a record ends early")
        return got + z.decompress(fed, most), taken

    def passes(self, fields):
        return all(self.value(fields, column) in s for column, sets in self.wanted.items() for s in sets)

    @staticmethod
    def value(fields, column):
        """A column that a header gives; null where the header is missing."""
        value = fields.get(HEADERS[column])
        if value is None:
            return None
        if column in ("page_id", "refers_to"):
            return int(value)
        if column == "payload_digest":
            return value[5:] if value[:5].lower() == "sha1:" else value
        return unquote(value) if column == "url" and "x-escaped-uri" in fields else value

    def row(self, fields, block):
        kind, digest, payload = fields.get("warc-type"), self.value(fields, "payload_digest"), None
        size = int(fields["x-payload-length"]) if "x-payload-length" in fields else None
        if self.payload and kind in PAYLOADS:
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" and block[:5] == b"HTTP/" else block
            found = base32_sha1(payload)
            if size is not None and (found, len(payload)) != (digest, size):
                raise ValueError(f"a payload differs from its digest: {fields.get('warc-record-id')}")
            digest, size = digest or found, len(payload)
        return (self.value(fields, "page_id"), self.value(fields, "url"), kind, digest, size, self.value(fields, "refers_to"), payload)


#: Types of records that hold a payload.
PAYLOADS = ("response", "resource")
#: Bytes of a header at most.
HEADER = 1 << 20


def own_length(head: bytes) -> int | None:
    """The length of a member that says it itself."""
    if head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"PL\x04\0":
        return struct.unpack_from("<I", head, 16)[0]
    return None


def headers(first: bytes) -> dict[str, str]:
    """A record's headers, names in lower case; lines that begin with white space go on with the one before."""
    version, *lines = first.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record begins here")
    out, name = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        else:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    if "content-length" not in out:
        raise ValueError("a record without Content-Length")
    return out


def plain(f, at: int):
    f.seek(at)
    while part := f.read(1 << 20):
        yield part


def inflated(f, at: int):
    """Bytes of gzip members that follow one another."""
    z, fed = zlib.decompressobj(31), b""
    f.seek(at)
    while True:
        if z.eof:
            fed, z = z.unused_data, zlib.decompressobj(31)
        fed = fed or f.read(1 << 20)
        if not fed:
            return
        got = z.decompress(fed, 1 << 20)
        fed = z.unconsumed_tail
        if got:
            yield got


class Stream:
    """Parts of bytes, taken up to a mark or by number; what isn't asked for is not kept."""

    def __init__(self, parts):
        self.parts, self.held = iter(parts), b""

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark, line ends in front left out; null at the end of the stream."""
        self.held = self.held.lstrip(b"\r\n")
        while (at := self.held.find(mark)) < 0:
            part = next(self.parts, None)
            if part is None and not self.held:
                return None
            if part is None or len(self.held) > HEADER:
                raise ValueError("a record's header does not end")
            self.held = (self.held + part).lstrip(b"\r\n")
        out, self.held = self.held[:at], self.held[at + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        out = []
        while True:
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
            if not n:
                return b"".join(out)
            self.held = next(self.parts, b"")
            if not self.held:
                raise ValueError("a record ends early")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, record_type, payload_digest, refers_to for pages (page_id, url, payload)."""
    keyed = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    first = keyed.where(F.col("n") >= least).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select(F.col("sha").alias("f_sha"), F.col("n").alias("f_n"), "first")
    joined = keyed.join(store(first, "first"), (F.col("sha") == F.col("f_sha")) & (F.col("n") == F.col("f_n")), "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.lit("").alias("payload_digest"), F.when(again, F.col("first")).alias("refers_to"))


def _digested(batches):
    for b in batches:
        at = b.schema.names.index("payload")
        cols = [b.column(i) for i in range(b.num_columns)]
        cols[b.schema.names.index("payload_digest")] = pa.array([base32_sha1(p) for p in b.column(at).to_pylist()])
        yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write pages (page_id, url, payload) to archives in a new folder."""
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    records = revisits(pages, least)
    records.mapInArrow(_digested, records.schema).write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op6(spark, sf_dir: str) -> DataFrame:
    pages = columns(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    path = work_path(spark, "warc")
    write(pages.select("page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
