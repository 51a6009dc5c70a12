"""WARC archives as a Spark data source, in both directions.

Reading plans byte ranges of the files below a path, inflates only the head of a record,
holds its headers against the pushed-down predicates, and inflates or reads the payload
only of records that pass and only where payloads are asked for. Archives are
``.warc.gz`` (a gzip member for each record; ranges may start anywhere) or ``.warc``
(one range a file). The writer notes each member's length in a gzip extra field, so that
later reads step over unwanted members without inflating them; members of other writers
without that field are inflated to their end.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tallyforge.llm.common import whole_path
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

#: Column, header, and whether it is a number.
FIELDS = [
    ("record_type", "warc-type", False),
    ("record_id", "warc-record-id", False),
    ("target_uri", "warc-target-uri", False),
    ("date", "warc-date", False),
    ("payload_digest", "warc-payload-digest", False),
    ("refers_to_id", "warc-refers-to", False),
    ("content_length", "content-length", True),
    ("page_id", "x-page-id", True),
    ("refers_to", "x-refers-to-page-id", True),
    ("payload_bytes", "x-payload-length", True),
]
SCHEMA = ", ".join(f"{name} {'long' if number else 'string'}" for name, _, number in FIELDS) + ", headers map<string,string>, payload binary"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD, CHUNK, BATCH_BYTES = 2048, 1 << 20, 8 << 20
MAGIC = b"\x1f\x8b\x08"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def make_record(page_id, url, payload: bytes | None, digest: str, size: int, refers_to, date: str) -> bytes:
    """One record; ``payload`` is None for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http + (payload or b"")
    clean = lambda x: " ".join(str(x).split())  # noqa: E731  header values stay on one line
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"] if payload is None else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field "sl" holds its own and the plain length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    whole = 10 + 2 + 20 + len(body) + 8
    extra = b"sl" + struct.pack("<HQQ", 16, whole, len(data))
    return MAGIC + b"\x04" + bytes(6) + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def row_of(headers: dict[str, str]) -> dict:
    row = {}
    for name, header, number in FIELDS:
        value = headers.get(header)
        if number:
            value = int(value) if value is not None and value.lstrip("-").isdigit() else None
        row[name] = value
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].partition(":")[2] or row["payload_digest"]
    return row


def payload_of(block: bytes, headers: dict[str, str]) -> bytes:
    """What follows the HTTP head of a block that has one; else the block."""
    return block.partition(b"\r\n\r\n")[2] if "application/http" in headers.get("content-type", "") else block


class _Bytes:
    """A window over a file that grows on demand and forgets what is behind."""

    def __init__(self, file):
        self.file, self.at, self.base, self.held = file, 0, 0, b""

    def seek(self, at: int) -> None:
        if not self.base <= at <= self.base + len(self.held):
            self.base, self.held = at, b""
        self.at = at

    def want(self, n: int) -> bytes:
        skip = self.at - self.base
        if len(self.held) - skip < n:
            self.file.seek(self.base + len(self.held))
            self.held = self.held[skip:] + self.file.read(max(n - len(self.held) + skip, CHUNK))
            self.base, skip = self.at, 0
        return self.held[skip : skip + n]


def _zipped(data: _Bytes, start: int, end: int, size: int, wanted, payloads: bool):
    """Records of the members that begin in [start, end)."""
    at = start
    while at < end:
        data.seek(at)
        head = data.want(HEAD)
        if len(head) < 18:
            return
        if not head.startswith(MAGIC):  # only at the start of a range: look for the next member
            window = data.want(min(CHUNK, size - at))
            hit = window.find(MAGIC, 1)
            at += hit if hit > 0 else max(1, len(window) - 2)
            continue
        skip = 0
        if head[3] & 4 and head[12:16] == b"sl\x10\0":
            skip = struct.unpack("<Q", head[16:24])[0]
        inflate, text, used = zlib.decompressobj(31), b"", 0
        try:
            while b"\r\n\r\n" not in text and not inflate.eof:
                piece = inflate.unconsumed_tail or data.want(used + HEAD)[used:]
                if not piece:
                    break
                before = len(inflate.unconsumed_tail)
                text += inflate.decompress(piece, HEAD)
                used += 0 if before else len(piece)
        except zlib.error:
            text = b""
        if not text.startswith(b"WARC/"):
            at += 1
            continue
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        row = row_of(headers)
        keep = wanted(row)
        need = keep and payloads
        if need or not skip:
            blocks, plain, size_of = [rest], len(rest), row["content_length"] or 0
            behind = rest[size_of:]
            while not inflate.eof:
                piece = inflate.unconsumed_tail or data.want(max(used + 1, min(skip or used + CHUNK, used + CHUNK)))[used:]
                if not piece:
                    break
                before = len(inflate.unconsumed_tail)
                out = inflate.decompress(piece, CHUNK)
                used += 0 if before else len(piece)
                if plain + len(out) > size_of and not behind.strip():
                    behind = out[max(0, size_of - plain) :]
                plain += len(out)
                if need:
                    blocks.append(out)
            if behind.strip():
                raise ValueError(f"the gzip member at {at} holds more than one record, which this reader does not split")
            length = used - len(inflate.unused_data)
            block = b"".join(blocks)[:size_of] if need else b""
        if keep:
            yield row, headers, payload_of(block, headers) if need else None
        at += skip or max(1, length)


def _plain(data: _Bytes, size: int, wanted, payloads: bool):
    at = 0
    while at < size:
        data.seek(at)
        n = HEAD
        while b"\r\n\r\n" not in (head := data.want(n)) and len(head) == n:
            n *= 2
        stop = head.find(b"\r\n\r\n")
        if stop < 0 or not head.startswith(b"WARC/"):
            return
        headers = parse_headers(head[:stop])
        row = row_of(headers)
        length = row["content_length"] or 0
        if wanted(row):
            payload = None
            if payloads:
                data.seek(at + stop + 4)
                payload = payload_of(data.want(length), headers)
            yield row, headers, payload
        at += stop + 4 + length + 4


_TESTS = {
    EqualTo: lambda x, v: x == v,
    In: lambda x, v: x in v,
    GreaterThan: lambda x, v: x > v,
    GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v,
    LessThanOrEqual: lambda x, v: x <= v,
    StringStartsWith: lambda x, v: x.startswith(v),
    StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x,
}


@dataclass
class Range(InputPartition):
    pieces: list  # (path, start, end, size)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payloads = str(options.get("payloads", "true")).lower() == "true"
        self.range_bytes = int(options.get("rangebytes", 32 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        names = {name for name, _, _ in FIELDS}
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if column in names and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((column, type(f).__name__, None))
            elif column in names and type(f) in _TESTS:
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        """Byte ranges of about ``rangebytes``; small files share a partition."""
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        parts, room, now = [], 0, []
        for x in sorted((x for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/.pending/" not in x.path), key=lambda x: x.path):
            step = self.range_bytes if x.path.endswith(".gz") else max(1, x.size)
            for start in range(0, x.size, step):
                end = min(x.size, start + step)
                if now and room + end - start > self.range_bytes:
                    parts, room, now = [*parts, Range(now)], 0, []
                now.append((x.path, start, end, x.size))
                room += end - start
        return [*parts, Range(now)]

    def _wanted(self, row) -> bool:
        by_name = {k.__name__: v for k, v in _TESTS.items()}
        for column, kind, value in self.tests:
            x = row[column]
            if kind == "IsNull":
                ok = x is None
            else:
                ok = x is not None and (kind == "IsNotNull" or by_name[kind](x, value))
            if not ok:
                return False
        return True

    def read(self, partition):
        fs, _ = file_system(self.path)
        kinds = [pa.int64() if number else pa.string() for _, _, number in FIELDS] + [pa.map_(pa.string(), pa.string()), pa.binary()]
        names = [name for name, _, _ in FIELDS] + ["headers", "payload"]
        rows, held = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
        for path, start, end, size in partition.pieces:
            with fs.open_input_file(path) as file:
                data = _Bytes(file)
                found = _zipped(data, start, end, size, self._wanted, self.payloads) if path.endswith(".gz") else _plain(data, size, self._wanted, self.payloads)
                for row, headers, payload in found:
                    rows.append((*row.values(), list(headers.items()), payload))
                    held += len(payload or b"") + 1024
                    if held > BATCH_BYTES:
                        yield pack()
                        rows, held = [], 0
        if rows:
            yield pack()


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    """A file for each task under a name of its own; only committed tasks' files stay."""

    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.date = options["path"], overwrite, options.get("date", "2024-01-01T00:00:00Z")
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        fs, root = file_system(self.path)
        name, out = None, None
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(f"{root}/.pending", recursive=True)
                    name = f"{self.job}-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/.pending/{name}", compression=None)
                out.write(gzip_member(make_record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["payload_bytes"], row["refers_to"], self.date)))
        if out is not None:
            out.close()
        return Written(name)

    def commit(self, messages):
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if x.type == pafs.FileType.File:
                    fs.delete_file(x.path)
        for m in messages:
            if m is not None and m.path:
                fs.move(f"{root}/.pending/{m.path}", f"{root}/{m.path}")
        self._clear(fs, root)

    def abort(self, messages):
        self._clear(*file_system(self.path))

    def _clear(self, fs, root):
        if fs.get_file_info(f"{root}/.pending").type == pafs.FileType.NotFound:
            return
        for x in fs.get_file_info(pafs.FileSelector(f"{root}/.pending")):
            if x.base_name.startswith(self.job):
                fs.delete_file(x.path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options: path, payloads (true), rangeBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records below ``path`` (a path without scheme is one of Spark's default file system)."""
    register(spark)
    return spark.read.format("warc").option("payloads", str(payloads).lower()).load(whole_path(spark, path))


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(column):
    """RFC 4648 base32 of the 20 bytes in 40 hex digits, by built-in functions."""
    bits = F.lpad(F.conv(F.substring(column, 1, 10), 16, 2), 40, "0")
    for k in (11, 21, 31):
        bits = F.concat(bits, F.lpad(F.conv(F.substring(column, k, 10), 16, 2), 40, "0"))
    letters = [F.substring(F.lit(BASE32), F.conv(F.substring(bits, 5 * k + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)]
    return F.concat(*letters)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to: what the writer takes.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the
    smallest page_id carries the payload; the others have payload null and refers_to.

    Defined results: a null html is an empty payload; a null page_id revisits the smallest
    id of its payload, and is a response if there is none; rows that repeat the smallest
    id are responses too; other columns are ignored; an empty table gives an empty result.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(html, "UTF-8").alias("body"))
    rows = rows.select("*", F.octet_length("body").cast("long").alias("payload_bytes"), F.sha1("body").alias("sha1"))
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = rows.join(first, ["sha1", "payload_bytes"], "left")
    again = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return both.select(
        "page_id",
        "url",
        F.when(~again, F.col("body")).alias("payload"),
        "payload_bytes",
        base32_of_hex(F.col("sha1")).alias("payload_digest"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, mode: str = "overwrite") -> None:
    """Writes ``pages`` (page_id, url, html) as archives below ``path``; see with_revisits."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode(mode).save(whole_path(pages.sparkSession, path))
