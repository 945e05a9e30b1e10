"""WARC archives as a Spark data source, in both directions.

Reading plans one input partition for files of up to ``partition_bytes``
together, takes predicates on record type and headers, parses headers first
and leaves payloads that nobody wants undecoded: of an uncompressed record it
seeks past the block, of a compressed one it inflates no more than the
headers and seeks by the member's ``sl`` field (compressed and full size), the
field that the WARC standard's annex on compression gives for the purpose.
Members without it are inflated to their end but not decoded.

Writing makes one gzip member a record.  A task writes files under names of
its own; the commit lists them in ``_manifest.json``, and readers go by the
list, so a retried or speculative task leaves nothing that is read.

Files are reached through ``pyarrow.fs``, so any URI that Arrow knows will do.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from trackloom.llm.common import forget_at_exit, fresh_path, materialize, table

SCHEMA = "record_id string, warc_type string, target_uri string, date string, refers_to string, header_digest string, payload_bytes long, content_length long, computed_digest string, payload binary"
#: Columns that headers alone decide.
HEADER_COLUMNS = ("record_id", "warc_type", "target_uri", "date", "refers_to", "header_digest", "content_length")
#: Payloads with copies (32 bytes of hash and an id each) that are broadcast.
SHARED = 200_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def split_uri(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def hex_of_base32(digest: str | None) -> str | None:
    """``sha1:BASE32`` (or hex) as bare lower-case hex."""
    if not digest:
        return None
    value = digest.rpartition(":")[2]
    return base64.b32decode(value).hex() if len(value) == 32 else value.lower()


def record_bytes(row: dict) -> bytes:
    """A whole record: WARC headers, HTTP headers, payload (none for a revisit)."""
    payload = row["payload"] or b""
    n = row["payload_bytes"] if row["payload_bytes"] is not None else len(payload)
    revisit = row["warc_type"] == "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", row["target_uri"])
        lines.append(f"WARC-Target-URI: {uri}")
    if row["header_digest"]:
        lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['header_digest'])).decode()}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: {row['refers_to']}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field ``sl`` has its compressed and full size."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(raw) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    """Header lines below the version line, names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


class _Member:
    """One gzip member, inflated as far as asked for."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.start = file, file.tell()
        first = file.read(24)
        self.size = None
        if len(first) == 24 and first[3] & 4 and first[12:14] == b"sl":
            self.size = struct.unpack("<I", first[16:20])[0]
        file.seek(self.start)
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def _more(self, want: int) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.file.read(4096 if want < 1 << 16 else 1 << 16)
        if not data:
            return False
        self.ready += self.inflate.decompress(data, max(want, 1))
        return True

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        """Bytes up to and with ``mark``, which are then consumed; None, and nothing
        consumed, if it does not end within the next ``most`` bytes."""
        while (at := self.ready.find(mark, 0, most)) < 0:
            if most is not None and len(self.ready) >= most or not self._more(1024):
                return None
        out, self.ready = self.ready[: at + len(mark)], self.ready[at + len(mark) :]
        return out

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and self._more(n - len(self.ready)):
            pass
        out, self.ready = self.ready[:n], self.ready[n:]
        return out

    def skip(self, n: int) -> None:
        """The rest of the member is not needed."""

    def end(self) -> None:
        if self.size is not None:
            self.file.seek(self.start + self.size)
            return
        while not self.inflate.eof and self._more(1 << 16):
            self.ready = b""
        self.file.seek(self.file.tell() - len(self.inflate.unused_data))


class _Plain:
    """An uncompressed record."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.left = file, 0

    def until(self, mark: bytes, most: int | None = None) -> bytes | None:
        start, out = self.file.tell(), b""
        while not out.endswith(mark):
            line = self.file.readline(-1 if most is None else most - len(out))
            if not line:
                self.file.seek(start)
                return None
            out += line
        return out

    def read(self, n: int) -> bytes:
        return self.file.read(n)

    def skip(self, n: int) -> None:
        self.file.seek(n, io.SEEK_CUR)

    def end(self) -> None:
        while (at := self.file.tell()) >= 0 and (two := self.file.read(2)) == b"\r\n":
            continue
        self.file.seek(at if two else self.file.tell())


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() else None


def read_records(raw, wanted, payload: str) -> Iterator[dict]:
    """Records of an open file as rows of ``SCHEMA``.

    ``wanted`` judges the header columns; ``payload`` is ``full``, ``digest``
    (decoded and digested but not returned) or ``none``.

    Defined cases: an empty file has no records; headers that the file's end
    cuts off are no record, and a payload that it cuts off is as long as what
    is there (where it is read); a block of type ``application/http`` without
    a blank line is payload as a whole; a ``Content-Length`` that is no number
    counts as 0; payloads may be of any length, and only those asked for are
    held, one at a time.  Bytes that are no gzip where gzip began raise.
    """
    file = io.BufferedReader(raw, 1 << 18)
    while head := file.peek(2)[:2]:
        record = _Member(file) if head == b"\x1f\x8b" else _Plain(file)
        top = record.until(b"\r\n\r\n")
        if top is None:
            return
        h = parse_headers(top.lstrip(b"\r\n"))
        length = _number(h.get("content-length")) or 0
        row = {
            "record_id": h.get("warc-record-id"), "warc_type": h.get("warc-type"), "target_uri": h.get("warc-target-uri"), "date": h.get("warc-date"),
            "refers_to": h.get("warc-refers-to"), "header_digest": hex_of_base32(h.get("warc-payload-digest")), "content_length": length,
            "payload_bytes": None, "computed_digest": None, "payload": None,
        }
        if not wanted(row):
            record.skip(length)
            record.end()
            continue
        left = length
        if length and h.get("content-type", "").startswith("application/http"):
            http = record.until(b"\r\n\r\n", length) or b""
            left -= len(http)
            stated = _number(parse_headers(http).get("content-length"))
            row["payload_bytes"] = stated if stated is not None and row["warc_type"] == "revisit" else left
        else:
            row["payload_bytes"] = left
        if payload == "none" or row["warc_type"] == "revisit":
            record.skip(left)
        else:
            body = record.read(left)
            row["payload_bytes"] = len(body)
            row["computed_digest"] = hashlib.sha1(body).hexdigest()
            if payload == "full":
                row["payload"] = body
        record.end()
        yield row


def predicate(filters: list[Filter]):
    """The pushed filters that headers decide as one function, and the filters left over."""
    tests, rest = [], []
    for f in filters:
        inner = f.child if isinstance(f, Not) else f
        column = inner.attribute[0] if len(getattr(inner, "attribute", ())) == 1 else None
        test = _TESTS.get(type(inner)) if column in HEADER_COLUMNS else None
        if test is None:
            rest.append(f)
        else:
            tests.append((column, test, inner, isinstance(f, Not)))

    def wanted(row: dict) -> bool:
        for column, test, f, negated in tests:
            value = row[column]
            if value is None and not isinstance(f, (IsNull, IsNotNull, EqualNullSafe)):
                return False  # null is no match, negated or not
            if bool(test(value, f)) == negated:
                return False
        return True

    return wanted, rest


_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    EqualNullSafe: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    IsNull: lambda v, f: v is None,
    IsNotNull: lambda v, f: v is not None,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
}


@dataclass
class WarcFiles(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.payload = options["path"], options.get("payload", "full")
        self.partition_bytes = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        filters = list(filters)
        _, rest = predicate(filters)
        self.filters = [f for f in filters if f not in rest]
        yield from rest

    def partitions(self) -> list[WarcFiles]:
        fs, root = split_uri(self.path)
        manifest = f"{root}/_manifest.json"
        if fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                found = [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        else:
            info = fs.get_file_info(root)
            every = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
            found = [(i.path, i.size) for i in every if i.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path)]
        out, group, held = [], [], 0
        for name, size in sorted(found):
            if group and held + size > self.partition_bytes:
                out.append(WarcFiles(tuple(group)))
                group, held = [], 0
            group.append(name)
            held += size
        if group:
            out.append(WarcFiles(tuple(group)))
        return out or [WarcFiles(())]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        fs, _ = split_uri(self.path)
        wanted, _ = predicate(self.filters)
        rows, held = [], 0
        for name in partition.files:
            with fs.open_input_file(name) as raw:
                for row in read_records(raw, wanted, self.payload):
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])


@dataclass
class WarcWritten(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", 64 << 20))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcWritten:
        fs, root = split_uri(self.path)
        fs.create_dir(root, recursive=True)
        done, out, name = [], None, ""
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20)
                out.write(gzip_member(record_bytes(row)))
                if out.tell() >= self.file_bytes:
                    done.append((name, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((name, out.tell()))
            out.close()
        return WarcWritten(done)

    def commit(self, messages: list[WarcWritten | None]) -> None:
        fs, root = split_uri(self.path)
        fs.create_dir(root, recursive=True)
        manifest, found = f"{root}/_manifest.json", [list(f) for m in messages if m for f in m.files]
        if not self.overwrite and fs.get_file_info(manifest).type == pafs.FileType.File:
            with fs.open_input_stream(manifest) as f:
                found += json.loads(f.read())
        with fs.open_output_stream(manifest) as f:
            f.write(json.dumps(found).encode())

    def abort(self, messages: list[WarcWritten | None]) -> None:
        fs, root = split_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                fs.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; see the module's docstring."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark: SparkSession, path: str, payload: str = "full") -> DataFrame:
    """The records at a URI.  Read anew for each set of conditions: Spark keeps what a Python source
    was once pushed for all later uses of the same DataFrame."""
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Rows to write, one for each page.  Of equal payloads of at least ``least``
    bytes that with the largest id is the response, the others revisit it.

    Defined cases: a null payload is empty; a null url has no header; rows
    with a null id revisit the largest id of their payload, and are responses
    if it has none; rows repeated under the largest id are responses all; an
    empty table gives no records; payloads may be of any length; other columns
    are ignored.
    """
    raw = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("target_uri"), raw.alias("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    keyed = rows.where(F.col("n") >= least).withColumn("key", F.unhex(F.sha2("payload", 256)))
    shared = keyed.groupBy("key").agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1").select("key", "top")
    shared = materialize(shared, "warc-shared")
    # a checked bound for the broadcast; more shared payloads are joined by key, and small ones pass by
    few = shared.limit(SHARED + 1).count() <= SHARED
    joined = keyed.join(F.broadcast(shared) if few else shared, "key", "left").drop("key").unionByName(rows.where(F.col("n") < least).withColumn("top", F.lit(None).cast("long")))
    revisit = F.col("top").isNotNull() & ~F.col("id").eqNullSafe(F.col("top"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    return joined.select(
        urn(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("warc_type"), "target_uri", F.lit(date).alias("date"),
        F.when(revisit, urn(F.col("top"))).alias("refers_to"), F.sha1("payload").alias("header_digest"), F.col("n").alias("payload_bytes"), F.lit(0).cast("long").alias("content_length"),
        F.lit(None).cast("string").alias("computed_digest"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").option("path", path).save()


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    forget_at_exit(spark, path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, 'urn:page:([^>]*)', 1) AS bigint)")
    back = read_warc(spark, path, payload="digest").where(F.col("warc_type").isin("response", "revisit"))
    return back.select(
        page("record_id").alias("page_id"), "payload_bytes", F.coalesce("computed_digest", "header_digest").alias("payload_digest"), F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS n, sha1(html) AS digest,
         max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d
"""
