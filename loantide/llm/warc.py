"""WARC archives as a Spark data source, written and read, and an archive of pages without repeated payloads.

Reading plans groups of whole files as partitions. Predicates on the record type and on the other header columns are
pushed down: of each record the headers are parsed first, and where the predicates fail, or no column asks for the
payload, its bytes are neither inflated nor copied. Uncompressed archives are skipped by Content-Length, compressed ones
(one gzip member a record) by the skip lengths in the member's extra field (ISO 28500, annex D); members without them are
inflated and thrown away piece by piece. Give ``read_warc`` only the columns that are needed: a Python source is told its
schema, not the columns a query uses.

Writing makes files of a bounded size, each of one task, and one manifest at commit, which names the files of the tasks
that succeeded. A reader that finds manifests reads the files they name, so a repeated task leaves no second copy. Paths
may be local or in any store that pyarrow reads.

Defined results: a null payload is empty; a null header value is left out and read back as null; control characters in
header values are percent-encoded; HTTP bodies are kept as stored (no decoding of transfer or content encodings); payloads
of any length below 2 GB are taken whole; an empty table writes a manifest without files and reads as an empty one.
``archive_pages``: a null html is the empty payload; repeated rows are records of their own, of which one is the response;
a null page_id is the smallest; an empty table makes an empty archive; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull,
    IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from loantide.llm.common import ship
from loantide.session import scratch_path, written

FILE_BYTES = 256 << 20
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2_000
_CHUNK = 64 << 10
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Columns that are header fields.
HEADERS = {
    "record_id": "WARC-Record-ID", "warc_type": "WARC-Type", "warc_date": "WARC-Date", "target_uri": "WARC-Target-URI",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "content_type": "Content-Type",
}
#: ``payload_length`` is what the HTTP headers or, without them, the record says; the ``read_`` columns are of the payload's bytes.
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", block_length long, payload_length long, headers map<string,string>, payload binary, read_length long, read_digest string, file string"
_OF_PAYLOAD = {"payload", "read_length", "read_digest"}
_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


# --- records as bytes -------------------------------------------------------------------------------------------------


def _line(name: str, value) -> str:
    safe = re.sub("[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", str(value))
    return f"{name}: {safe}\r\n"


def encode_record(row: dict) -> bytes:
    """One record: a response or revisit has an HTTP header with the payload's length, other types are the bare payload."""
    payload = row.get("payload") or b""
    http = b""
    if row["warc_type"] in ("response", "revisit"):
        length = row.get("payload_length")
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
        row = {"content_type": "application/http; msgtype=response", **{k: v for k, v in row.items() if v is not None}}
    head = "WARC/1.1\r\n" + "".join(_line(h, row[c]) for c, h in HEADERS.items() if row.get(c) is not None)
    head += "".join(_line(k, v) for k, v in (row.get("headers") or ()) if v is not None)
    head += f"Content-Length: {len(http) + len(payload)}\r\n\r\n"
    return head.encode("utf-8", "surrogatepass") + http + payload + b"\r\n\r\n"


def gzip_member(record: bytes, level: int = 6) -> bytes:
    """A gzip member whose extra field ``sl`` holds its compressed and plain lengths (left out beyond 32 bits)."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(record) + c.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    whole = 24 + len(body) + len(tail)
    if max(whole, len(record)) >= 1 << 32:
        return struct.pack("<4BIBB", 0x1F, 0x8B, 8, 0, 0, 0, 255) + body + tail
    return struct.pack("<4BIBB", 0x1F, 0x8B, 8, 4, 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, whole, len(record)) + body + tail


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    pairs = (x.partition(":") for x in lines[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Bytes:
    """The plain bytes of a file from ``start`` to the end of a gzip member, or to the end of the file."""

    def __init__(self, file, start: int):
        self.file, self.start, self.buffer = file, start, b""
        head = self._at(start, 24)
        self.packed = head[:2] == b"\x1f\x8b"
        self.skip = None
        if self.packed:
            if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
                self.skip = struct.unpack("<II", head[16:24])
            self.inflate = zlib.decompressobj(31)
        self.at = start

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        return self.file.read(n)

    def _more(self) -> bool:
        if not self.packed:
            got = self._at(self.at, _CHUNK)
            self.at += len(got)
            self.buffer += got
            return bool(got)
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                raw = self._at(self.at, _CHUNK)
                self.at += len(raw)
                if not raw:
                    raise ValueError("the file ends within a member")
            # at most one chunk of plain bytes at a time: the rest of a large payload stays packed
            if got := self.inflate.decompress(raw, _CHUNK):
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before ``mark``; None at the end."""
        done = 0
        while (i := self.buffer.find(mark, done)) < 0:
            done = max(0, len(self.buffer) - len(mark))
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("a record's headers do not end")
                return None
        out, self.buffer = self.buffer[:i], self.buffer[i + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("a record is shorter than its length says")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def drop(self, n: int) -> None:
        if not self.packed and n > len(self.buffer):
            self.at, self.buffer = self.at + n - len(self.buffer), b""
            return
        while n > len(self.buffer):
            n, self.buffer = n - len(self.buffer), b""
            if not self._more():
                raise ValueError("a record is shorter than its length says")
        self.buffer = self.buffer[n:]

    def end(self) -> int:
        """The place after what was read; for a member only once it has ended."""
        return self.at - len(self.inflate.unused_data) if self.packed else self.at - len(self.buffer)


def records(file, size: int, wanted: Callable[[dict], bool], columns: set[str]) -> Iterator[dict]:
    """The wanted records of an open file: headers, and the payload where a column asks for it."""
    place = 0
    with_payload, with_http = bool(_OF_PAYLOAD & columns), "payload_length" in columns
    while place < size:
        stream = _Bytes(file, place)
        first = True
        while True:
            head = stream.until(b"\r\n\r\n")
            if head is None:
                place = max(stream.end(), place + 1)
                break
            head = head.lstrip(b"\r\n\x00 ")
            if not head.startswith(b"WARC/"):
                raise ValueError("no WARC record where one should begin")
            fields = _fields(head)
            length = int(fields["content-length"])
            row = {"fields": fields, "block_length": length, "payload_length": length}
            chosen, left = wanted(fields), length
            if chosen:
                is_http = fields.get("content-type", "").startswith("application/http") and length > 0
                if is_http and (with_payload or with_http):
                    http = stream.until(b"\r\n\r\n")
                    left = length - len(http) - 4
                    if (said := _fields(http).get("content-length", "")).isdigit():
                        row["payload_length"] = int(said)
                    else:
                        row["payload_length"] = left
                if with_payload:
                    row["payload"], left = stream.take(left), 0
                yield row
            if first and stream.skip and left and stream.skip[1] == len(head) + 4 + length + 4:
                place += stream.skip[0]  # the rest of the member stays packed
                break
            stream.drop(left + 4)
            first = False
            if not stream.packed:
                place = stream.end()
                break


# --- the data source --------------------------------------------------------------------------------------------------


class WarcPartition(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(files)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options):
        self.schema, self.path = schema, options["path"]
        self.bytes = int(options.get("partition_bytes", 128 << 20))
        self.damaged = options.get("damaged", "fail")
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            name = getattr(f, "attribute", ("",))[0]
            if name in HEADERS and type(f) in (*_TESTS, IsNotNull, IsNull):
                self.tests.append((HEADERS[name].lower(), type(f), getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, fields: dict) -> bool:
        for name, kind, value in self.tests:
            own = fields.get(name)
            if kind is IsNull:
                if own is not None:
                    return False
            elif own is None or kind is not IsNotNull and not _TESTS[kind](own, value):
                return False
        return True

    def files(self) -> list[tuple[str, int]]:
        store, top = _open(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        manifests = [x for x in found if x.base_name.startswith("_manifest-")]
        if manifests:
            names = set()
            for m in manifests:
                with store.open_input_stream(m.path) as s:
                    names |= set(json.loads(s.read()))
            found = [x for x in found if x.base_name in names]
        return sorted((x.path, x.size) for x in found if re.search(r"\.warc(\.gz)?$", x.base_name))

    def partitions(self) -> list[InputPartition]:
        out, group, size = [], [], 0
        for path, n in self.files():
            if group and size + n > self.bytes:
                out.append(WarcPartition(group))
                group, size = [], 0
            group.append((path, n))
            size += n
        return [*out, WarcPartition(group)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)
        names = self.schema.names
        arrow = pa.schema([(f.name, _ARROW[f.dataType.simpleString()]) for f in self.schema.fields])
        rows, held = [], 0
        for path, size in partition.value:
            with store.open_input_file(path) as f:
                try:
                    for r in records(f, size, self.wanted, set(names)):
                        rows.append(self._row(r, path, names))
                        held += len(r.get("payload", b"")) + 1000
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                except (ValueError, KeyError, zlib.error) as e:
                    if self.damaged != "skip":
                        raise ValueError(f"{path} is no sound archive: {e}") from e
        yield pa.RecordBatch.from_pylist(rows, arrow)

    def _row(self, r: dict, path: str, names: list[str]) -> dict:
        out, fields = {}, r["fields"]
        for n in names:
            if n in HEADERS:
                out[n] = fields.get(HEADERS[n].lower())
            elif n == "headers":
                out[n] = list(fields.items())
            elif n == "file":
                out[n] = path
            elif n == "read_length":
                out[n] = len(r["payload"])
            elif n == "read_digest":
                out[n] = base32_sha1(r["payload"])
            else:
                out[n] = r[n]
        return out


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class Named(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.bytes, self.packed = int(options.get("file_bytes", FILE_BYTES)), options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        names, out, done = [], None, 0
        pack = gzip_member if self.packed else lambda x: x
        for b in iterator:
            for i in range(b.num_rows):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.packed)
                    out, done = store.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
                    about = {"warc_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "content_type": "application/warc-fields"}
                    done += out.write(pack(encode_record({**about, "warc_date": _now(), "payload": b"format: WARC File Format 1.1\r\n"})))
                done += out.write(pack(encode_record({n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)})))
                if done >= self.bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Named(names)

    def commit(self, messages) -> None:
        store, top = _open(self.path)
        store.create_dir(top, recursive=True)
        old = [x for x in store.get_file_info(fs.FileSelector(top)) if x.base_name.startswith("_manifest-")] if self.overwrite else []
        with store.open_output_stream(f"{top}/_manifest-{uuid.uuid4().hex}.json", compression=None) as s:
            s.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        for x in old:
            store.delete_file(x.path)

    def abort(self, messages) -> None:
        store, top = _open(self.path)
        for m in messages:
            for n in m.names if m else ():
                store.delete_file(f"{top}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options, overwrite)


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known, with predicate pushdown for Python sources."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """The records below ``path`` with the named columns of ``SCHEMA`` (all without names)."""
    register(spark)
    schema = T.StructType.fromDDL(SCHEMA)
    if columns is not None:
        schema = T.StructType([schema[c] for c in columns])
    options.setdefault("partition_bytes", spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write_warc(df: DataFrame, path: str, **options) -> None:
    """Append the rows as records: columns of ``HEADERS``, ``payload``, ``payload_length`` and ``headers`` are used."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").options(**options).save(path)


# --- pages ------------------------------------------------------------------------------------------------------------


def archive_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """A record per row of ``page_id, url, html``. Of rows with equal payloads of at least ``min_bytes`` bytes the one with
    the largest page_id is the response and the others revisit it; smaller payloads are all responses.

    Payloads are equal if SHA-1 and length are. The pages are read once for the repeated payloads and once for the records.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # per repeated payload its largest page_id, and how many rows have that one
    by_page = rows.where(F.col("bytes") >= min_bytes).groupBy("sha", "bytes", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = by_page.groupBy("sha", "bytes").agg(F.max(F.struct("page_id", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1").drop("n")
    groups = written(groups, "payloads")
    joined = rows.join(groups, ["sha", "bytes"], "left")
    largest = F.col("best").isNotNull() & F.col("page_id").eqNullSafe(F.col("best.page_id"))
    tied = largest & (F.col("best.n") > 1)
    _write_pages(joined.where(~tied).withColumn("again", F.col("best").isNotNull() & ~largest), path)
    if groups.where("best.n > 1").isEmpty():
        return
    # equal rows with the largest page_id: numbered on disk, the first is the response
    equal = written(joined.where(tied).withColumn("row", F.monotonically_increasing_id()), "tied")
    first = equal.groupBy("sha", "bytes").agg(F.min("row").alias("first"))
    _write_pages(equal.join(first, ["sha", "bytes"]).withColumn("again", F.col("row") != F.col("first")), path)


def _write_pages(rows: DataFrame, path: str) -> None:
    """Record names: of a response that is revisited its page and digest, of other records a random part as well."""
    name = lambda page, *more: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), F.hex("sha"), *more, F.lit(">"))
    again = F.col("again")
    head = F.col("best").isNotNull() & ~again
    out = rows.select(
        F.when(head, name(F.col("page_id"))).otherwise(name(F.col("page_id"), F.lit(":"), F.uuid())).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("warc_type"),
        F.lit(_now()).alias("warc_date"),
        F.col("url").alias("target_uri"),
        F.when(again, name(F.col("best.page_id"))).alias("refers_to"),
        F.concat(F.lit("sha1:"), _base32(F.hex("sha"))).alias("payload_digest"),
        F.when(again, F.create_map(F.lit("WARC-Profile"), F.lit(_REVISIT))).alias("headers"),
        F.when(~again, F.encode("html", "UTF-8")).alias("payload"),
        F.col("bytes").alias("payload_length"),
    )
    write_warc(out, path)


def _base32(hex_: str):
    """Base 32 of a hexadecimal SHA-1: 32 digits of five bits, each read from two hexadecimal digits."""
    value = lambda i: F.conv(F.substring(hex_, 5 * i // 4 + 1, 2), 16, 10).cast("int")
    digit = lambda i: F.shiftright(value(i), 3 - 5 * i % 4).bitwiseAND(F.lit(31))
    return F.concat(*[F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), digit(i) + 1, F.lit(1)) for i in range(32)])


def page_id_of(record_id: str):
    return F.regexp_extract(record_id, "^<urn:x-page:(-?[0-9]*):", 1).try_cast("long")


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """What the archive says of each page. Responses are read with their payloads, whose length and digest are taken anew;
    of revisits only headers are read."""
    of_type = lambda t, *columns: read_warc(spark, path, ["record_id", "warc_type", *columns]).where(F.col("warc_type") == t)
    responses = of_type("response", "read_length", "read_digest").select(
        page_id_of("record_id").alias("page_id"), F.col("read_length").alias("payload_bytes"), F.col("read_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = of_type("revisit", "refers_to", "payload_digest", "payload_length").select(
        page_id_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        F.col("warc_type").alias("record_type"), page_id_of("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def archive_and_read(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes the archive of ``pages`` to the shared folder and returns what it holds."""
    path = scratch_path(pages.sparkSession, "warc")
    archive_pages(pages, path, min_bytes)
    return page_records(pages.sparkSession, path)
