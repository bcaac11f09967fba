"""WARC archives as a Spark data source, and page tables written as archives.

Reading plans files as partitions (small ones together, none split, since only
the start of a file is sure to start a record). Of each record the header is
parsed first; predicates on the record type and on header columns that are
pushed down are settled there, and what does not match is skipped: plain files
by their Content-Length, compressed ones by the ``sl`` field that this writer
puts into each gzip member's header (total and plain length), others by
inflating without keeping anything. Payloads are only cut out of records that
match.

Predicates come with read_archives(where=...), or, with the option
planner_filters and spark.sql.python.filterPushdown.enabled set, from Spark's
planner. Both are off by default: in Spark 4.1 all plans over one loaded frame
share the filters that were pushed last, so a frame must then be loaded anew
for each query. Filters given to read_archives belong to the frame and are safe.

Writing gives each task files of its own, one gzip member a record. The list of
files is written by the driver when all tasks are done, and readers go by that
list, so files of tasks that were repeated or lost are never read. Files are
reached through pyarrow's file systems (local and shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from .staging import named, new_path, staged

FORMAT = "lodestone_warc"
SCHEMA = "record_type string, record_id string, date string, target_uri string, content_type string, payload_digest string, refers_to string, payload_length long, payload binary, headers map<string,string>, file string, offset long, error string"
#: Fixed by the WARC 1.1 standard.
VERSION, REVISIT_PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
LIST = "_files.json"
#: The records that stand for pages.
PAGES = (D.In(("record_type",), ("response", "revisit")),)
_CHUNK, _BATCH_BYTES, _BATCH_ROWS = 1 << 20, 8 << 20, 4096
_PRINTABLE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "%")


def _fs(path: str):
    from pyarrow import fs

    if "://" not in path and path.startswith("file:"):
        path = path[5:]
    return fs.FileSystem.from_uri(path)


# --- records as bytes


def member(data: bytes, level: int) -> bytes:
    """``data`` as one gzip member whose header tells its total and plain length."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    if max(total, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data)) + body + tail


def _value(text: str) -> str:
    return quote(text, safe=_PRINTABLE + " ").strip()


def record(row: dict) -> bytes:
    """A record of the row's record_type, with HTTP headers and, but for revisits, its payload (null: empty)."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    told = row.get("payload_length")
    length = len(payload) if told is None or not revisit else told
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {row['record_id']}", f"WARC-Date: {row['date']}"]
    if row.get("target_uri") is not None:
        lines.append(f"WARC-Target-URI: {quote(row['target_uri'], safe=_PRINTABLE)}")
    if row.get("payload_digest") is not None:
        lines.append(f"WARC-Payload-Digest: {row['payload_digest']}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {row['refers_to']}"]
    lines += [f"{k}: {_value(v)}" for k, v in row.get("headers") or [] if v is not None]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


class _Window:
    """Bytes of a file from a place on, read in large pieces and kept for a while."""

    def __init__(self, file):
        self.file, self.size, self.base, self.data = file, file.size(), 0, b""

    def take(self, at: int, n: int) -> bytes:
        """At most n bytes from ``at``; fewer only at the end of the file."""
        n = min(n, self.size - at)
        if at < self.base or at + n > self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(max(n, min(_CHUNK, self.size - at)), at)
        return self.data[at - self.base : at - self.base + n]


class _Plain:
    """A record of an uncompressed file: its bytes in order, and the place after it."""

    def __init__(self, window: _Window, at: int):
        self.window, self.at, self.start = window, at, at

    def more(self) -> bytes:
        got = self.window.take(self.at, 4096)
        self.at += len(got)
        return got

    def end(self, head: int, content: int) -> int:
        return self.start + head + content + 4

    def rest(self, have: bytes, need: int) -> bytes:
        return (have + self.window.take(self.at, need - len(have)))[:need] if need > len(have) else have[:need]


class _Member:
    """A record of a compressed file, inflated as far as it is asked for."""

    def __init__(self, window: _Window, at: int):
        self.window, self.start, self.total = window, at, None
        flags = window.take(at, 10)[3]
        self.at = at + 10
        if flags & 4:
            extra = window.take(self.at + 2, struct.unpack("<H", window.take(self.at, 2))[0])
            self.at += 2 + len(extra)
            while len(extra) >= 4:
                name, n = extra[:2], struct.unpack("<H", extra[2:4])[0]
                if name == b"sl" and n == 8:
                    self.total = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        for flag in (8, 16):  # name, comment
            if flags & flag:
                while window.take(self.at, 1) not in (b"\0", b""):
                    self.at += 1
                self.at += 1
        self.at += 2 * bool(flags & 2)
        self.inflate = zlib.decompressobj(-15)
        self.fed = b""

    def more(self, most: int = 4096) -> bytes:
        while not self.inflate.eof:
            if not self.fed:
                self.fed = self.window.take(self.at, 4096 if most <= 4096 else 1 << 16)
                self.at += len(self.fed)
                if not self.fed:
                    raise ValueError("the file ends inside a record")
            got = self.inflate.decompress(self.fed, most)
            self.fed = self.inflate.unconsumed_tail
            if got:
                return got
        return b""

    def end(self, head: int, content: int) -> int:
        if self.total is not None:
            return self.start + self.total
        while not self.inflate.eof:
            self.more(1 << 20)
        return self.at - len(self.inflate.unused_data) + 8

    def rest(self, have: bytes, need: int) -> bytes:
        parts, n = [have], len(have)
        while n < need and (got := self.more(1 << 20)):
            parts.append(got)
            n += len(got)
        return b"".join(parts)[:need]


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields by their names in lower case; continuation lines belong to the field above; of repeated fields the first counts."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record begins here: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        last = name.strip().lower() if colon else None
        if last:
            fields.setdefault(last, value.strip())
    return fields


def records(file, wanted: Callable[[dict[str, str]], bool], payloads: bool = True) -> Iterator[tuple[int, dict[str, str], int | None, bytes | None]]:
    """offset, header fields, length and bytes of the payload for each record whose header is wanted.

    The length of a revisit's payload is what its HTTP headers tell, for the
    payload itself is not there (null); without ``payloads`` no bytes are cut out.
    """
    window, at = _Window(file), 0
    while at < window.size:
        if window.take(at, 2) in (b"\r\n", b"\n\n"):  # empty lines between plain records
            at += 2
            continue
        unit = _Member(window, at) if window.take(at, 2) == b"\x1f\x8b" else _Plain(window, at)
        text = b""
        while (cut := text.find(b"\r\n\r\n")) < 0:
            got = unit.more()
            if not got:
                raise ValueError("a header does not end")
            text += got
        fields = parse_head(text[:cut])
        content = int(fields.get("content-length", "0"))
        if wanted(fields):
            http, kind = fields.get("content-type", "").startswith("application/http"), fields.get("warc-type")
            need = cut + 4 + content
            if payloads and kind != "revisit":
                block = unit.rest(text, need)
                if len(block) < need:
                    raise ValueError("the file ends inside a record")
                body = block[cut + 4 :]
                mark = body.find(b"\r\n\r\n") if http else -4
                payload = body[mark + 4 :] if mark != -1 else b""
                yield at, fields, len(payload), payload
            else:
                length = None if http else content
                if http:  # the HTTP headers tell
                    while (stop := text.find(b"\r\n\r\n", cut + 4)) < 0 and len(text) < need and (got := unit.more()):
                        text += got
                    told = [x.partition(b":")[2] for x in text[cut + 4 : stop if stop >= 0 else need].split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    length = int(told[0]) if told else None
                yield at, fields, length, None
        at = unit.end(cut + 4, content)


# --- the data source


@dataclass
class Files(D.InputPartition):
    names: list[str] = field(default_factory=list)


class Reader(D.DataSourceReader):
    """Options: path; payloads (true); partition_bytes (64 MB of files a task); mode (failfast, or permissive: a fault is a row and ends its file)."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"
        self.filters: list = json.loads(options.get("where", "[]"))

    def partitions(self):
        from pyarrow import fs

        store, path = _fs(self.path)
        if store.get_file_info(path).type == fs.FileType.File:
            return [Files([path])]
        if store.get_file_info(f"{path}/{LIST}").type == fs.FileType.File:
            with store.open_input_stream(f"{path}/{LIST}") as f:
                found = [(f"{path}/{n}", size) for n, size in json.loads(f.read())]
        else:
            found = [(i.path, i.size) for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        groups, held = [], 0
        for name, size in sorted(found, key=lambda x: (-x[1], x[0])):
            if not groups or held + size > self.bytes:
                groups.append(Files())
                held = 0
            groups[-1].names.append(name)
            held += size
        return groups or [Files()]

    def read(self, partition):
        store, _ = _fs(self.path)
        kind = pa.schema([*((n, pa.string()) for n in HEADERS), ("payload_length", pa.int64()), ("payload", pa.binary()), ("headers", pa.map_(pa.string(), pa.string())), ("file", pa.string()), ("offset", pa.int64()), ("error", pa.string())])
        wanted = lambda fields: all(_holds(t, fields) for t in self.filters)
        held, size = [], 0

        def batch():
            return pa.RecordBatch.from_pylist(held, schema=kind)

        for name in partition.names:
            at = -1
            try:
                with store.open_input_file(name) as file:
                    for at, fields, length, payload in records(file, wanted, self.payloads):
                        row = {n: column_value(n, fields) for n in HEADERS}
                        held.append(row | {"payload_length": length, "payload": payload, "headers": list(fields.items()), "file": name, "offset": at, "error": None})
                        size += len(payload or b"") + 512
                        if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                            yield batch()
                            held, size = [], 0
            except (ValueError, zlib.error, struct.error, IndexError) as fault:
                if not self.permissive:
                    raise ValueError(f"{name}: after the record at {at}: {fault}") from fault
                if all(t[0] == "null" for t in self.filters):
                    held.append(dict.fromkeys(kind.names) | {"file": name, "offset": at, "error": str(fault)})
        if held:
            yield batch()


class PushingReader(Reader):
    """Takes filters from Spark's planner as well; Spark refuses such a reader unless its setting is on."""

    def pushFilters(self, filters):
        for f in filters:
            if (test := _test(f)) is None:
                yield f
            else:
                self.filters.append(test)


def column_value(column: str, fields: dict[str, str]) -> str | None:
    value = fields.get(HEADERS[column])
    return unquote(value) if column == "target_uri" and value is not None else value


def _test(f) -> tuple | None:
    """A predicate on one header column that records() can settle from the header; None: Spark has to."""
    column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
    if isinstance(f, D.Not):
        inner = _test(f.child)
        return None if inner is None or inner[0] in ("null", "same") else ("not", inner[1], inner)
    if column not in HEADERS:
        return None
    kinds = {D.EqualTo: "in", D.EqualNullSafe: "same", D.In: "in", D.StringStartsWith: "starts", D.StringEndsWith: "ends", D.StringContains: "has", D.IsNull: "null", D.IsNotNull: "some", D.GreaterThan: ">", D.GreaterThanOrEqual: ">=", D.LessThan: "<", D.LessThanOrEqual: "<="}
    kind = kinds.get(type(f))
    if kind is None or kind in ("null", "some"):
        return kind and (kind, column, None)
    value = list(f.value) if isinstance(f, D.In) else [f.value] if kind == "in" else f.value
    if kind == "in":
        return None if any(v is None for v in value) else (kind, column, value)
    return (kind, column, value)


def _holds(test: tuple, fields: dict[str, str]) -> bool:
    kind, column, value = test
    own = column_value(column, fields)
    if kind in ("null", "same"):
        return own is None if kind == "null" else own == value
    if own is None:
        return False
    if kind == "not":
        return not _holds(value, fields)
    # comparisons by UTF-8 bytes, as Spark has them
    checks = {"some": lambda: True, "in": lambda: own in value, "starts": lambda: own.startswith(value), "ends": lambda: own.endswith(value), "has": lambda: value in own, ">": lambda: own.encode() > value.encode(), ">=": lambda: own.encode() >= value.encode(), "<": lambda: own.encode() < value.encode(), "<=": lambda: own.encode() <= value.encode()}
    return checks[kind]()


@dataclass
class Written(D.WriterCommitMessage):
    files: list[tuple[str, int]]


class Writer(D.DataSourceArrowWriter):
    """Options: path; level (of compression, 6; 0: plain files); file_bytes (a task goes on in another file beyond it, 128 MB)."""

    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.level, self.most = int(options.get("level", 6)), int(options.get("file_bytes", 128 << 20))

    def write(self, iterator):
        store, path = _fs(self.path)
        store.create_dir(path, recursive=True)
        files, out, size = [], None, 0

        def closed():
            if out is not None:
                out.close()
                files.append((name, size))

        for b in iterator:
            for row in (row for k in range(0, b.num_rows, 64) for row in b.slice(k, 64).to_pylist()):
                if out is None or size >= self.most:
                    closed()
                    name, size = f"{uuid.uuid4().hex}.warc{'.gz' if self.level else ''}", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    size += self._put(out, _info())
                size += self._put(out, record(row))
        closed()
        return Written(files)

    def _put(self, out, data: bytes) -> int:
        data = member(data, self.level) if self.level else data
        out.write(data)
        return len(data)

    def commit(self, messages):
        store, path = _fs(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{LIST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m is not None for x in m.files)).encode())

    def abort(self, messages):
        store, path = _fs(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else []:
                store.delete_file(f"{path}/{name}")


def _info() -> bytes:
    body = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
    head = f"{VERSION}\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


class Source(D.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return (PushingReader if self.options.get("planner_filters", "false").lower() == "true" else Reader)(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def read_archives(spark: SparkSession, path: str, where: Sequence[D.Filter] = (), **options: str) -> DataFrame:
    """Rows of the records in ``path`` (a file, or a folder: the files of its list, or all .warc and .warc.gz below it).

    ``where``: filters of pyspark.sql.datasource on header columns, all of which
    must hold; they are settled before payloads are looked at. A filter that
    cannot be is an error.
    """
    tests = [_test(f) for f in where]
    if None in tests:
        raise ValueError(f"not a predicate on a header column: {where[tests.index(None)]}")
    spark.dataSource.register(Source)
    return spark.read.format(FORMAT).options(where=json.dumps(tests), **options).load(path)


def write_archives(rows: DataFrame, path: str, **options: str) -> None:
    """Rows with record_type, record_id, date, target_uri, payload_digest, refers_to, payload_length, payload and headers (map) as records in a new folder."""
    rows.sparkSession.dataSource.register(Source)
    columns = ["record_type", "record_id", "date", "target_uri", "payload_digest", "refers_to", "payload_length", "payload", "headers"]
    rows.select(*columns).write.format(FORMAT).options(**options).mode("append").save(path)


def _urn(page_id: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("/", page_id.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def page_records(pages: DataFrame, least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for each page (page_id, url, html): of equal payloads of ``least`` bytes or more all but those of the smallest page_id are revisits.

    The first pages of repeated payloads alone are joined back (they are few, or
    Spark splits the join where one payload is very common). A null html is
    empty, a null url gives no target; null page_ids are the last in order and,
    among themselves, all responses; rows that share the smallest page_id are
    all responses. Of an empty table nothing comes. Other columns are ignored.
    """
    body = F.coalesce(named("html"), F.lit("")).cast("binary")
    rows = pages.select(named("page_id").alias("page_id"), named("url").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("payload_length"))
    seen = rows.where(F.col("payload_length") >= least).select("digest", "page_id")
    firsts = seen.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    rows = rows.join(staged(firsts, "first-pages"), "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    fields = F.create_map(F.lit("X-Page-Id"), F.col("page_id").cast("string"), F.lit("X-Refers-To-Page-Id"), F.when(again, F.col("first").cast("string")))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("page_id"), F.col("digest")).alias("record_id"),
        F.lit(date).alias("date"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, _urn(F.col("first"), F.col("digest"))).alias("refers_to"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
        fields.alias("headers"),
    )


def archive_pages(pages: DataFrame, least: int = 100, **options: str) -> str:
    """page_records() written to a new folder of the shared folder, whose path is returned."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(page_records(pages, least), path, **options)
    return path


def pages_of(archives: DataFrame, id_type: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archived pages.

    What a response holds is measured and hashed anew; a revisit holds nothing,
    and its own headers tell the length and digest of the full payload.
    """
    rows = archives.where(F.col("record_type").isin("response", "revisit"))
    full = F.col("record_type") == "response"
    page = lambda name: F.col("headers").getItem(name).cast(id_type)
    return rows.select(
        page("x-page-id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page("x-refers-to-page-id").alias("refers_to"),
    )
