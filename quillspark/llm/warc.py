"""WARC archives: a writer with revisit records, and a Python data source that reads them.

Records are gzip members of their own. The writer stores each member's length in
the gzip header's extra field ``sl``, so a reader that has seen enough of a
record's headers goes to the next one without inflating the rest; members
without that field, and plain archives, are read too.

The reader plans one partition for each file, tests pushed-down predicates on the
record type and other headers before it looks at a block, and decodes payloads
only if they are asked for.

Defined cases: a null html is the empty payload; pages with equal payloads of at
least ``least`` bytes have one response, that with the largest id, and revisits;
rows that repeat the largest id are all responses; a null id is kept as null;
very long payloads are one record; other columns, whatever their names, are not
looked at; an empty table gives no archives and no rows. A record that breaks
the format ends the read, unless ``malformed`` is ``keep``: it is then a row of
record type ``malformed`` whose headers say where and why, and reading goes on at
the next record of the archive.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import StructType

from .skew import FREQUENT_ROWS
from .storage import filesystem, new_folder

#: Archives are closed when they have grown to this many bytes.
ROLL_BYTES = 256 << 20
#: Lists the archives of a folder that this writer filled; other folders are listed as they are.
MANIFEST = "manifest.json"
LEVEL = 6
CHUNK = 1 << 20


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that carries a 64-bit id."""
    n = (page_id or 0) & (2**64 - 1)
    return uuid.UUID(int=(n >> 16) << 80 | 8 << 76 | (page_id is None) << 64 | 2 << 62 | (n & 0xFFFF)).urn


def page_of(record: str | None) -> int | None:
    """The id in a record id that ``record_id`` made; null for any other."""
    try:
        n = uuid.UUID((record or "").strip("<>")).int
    except ValueError:
        return None
    if n >> 64 & 1 or n >> 62 & 3 != 2 or n >> 76 & 15 != 8:
        return None
    page = (n >> 80) << 16 | n & 0xFFFF
    return page - 2**64 if page >= 2**63 else page


def member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with its own length, and its content's, in the extra field ``sl``."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF) if size < 2**32 else b"sl" + struct.pack("<HII", 8, 0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return member(head.encode() + block + b"\r\n\r\n")


def _uri(url: str | None) -> str:
    return "".join(c for c in url or "about:blank" if c > " ")


def write_warc(pages: DataFrame, folder: str | None = None, least: int = 0, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """One record for every page, response or revisit; returns the folder.

    Payloads are compared by their SHA-1. Only digests of repeated payloads are
    joined back to the pages; payloads of a digest with very many pages meet it
    by broadcast. A task writes archives under names of its attempt, and the
    manifest, written last, lists those of the attempts that count: another
    attempt of a task, whatever it left behind, adds no record.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    system, where = filesystem(folder)
    system.create_dir(where)
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha1("payload"))
    repeated = own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    ready = with_responses(own, repeated).select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, where = filesystem(folder)
        part, rolled, out, temporary, names, attempt = TaskContext.get().partitionId(), 0, None, "", [], uuid.uuid4().hex

        def close() -> None:
            nonlocal out, rolled
            if out is not None:
                out.close()
                name = f"part-{part:06d}-{rolled:04d}-{attempt}.warc.gz"
                system.move(temporary, f"{where}/{name}")
                names.append(name)
                out, rolled = None, rolled + 1

        for batch in batches:
            columns = (batch.column(i) for i in range(5))
            for page, url, payload, digest, response in zip(*columns, strict=True):
                page, url, payload, response = page.as_py(), _uri(url.as_py()), payload.as_py(), response.as_py()
                if out is None:
                    temporary = f"{where}/.part-{part:06d}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary, compression=None)
                    info = b"format: WARC File Format 1.1\r\n"
                    out.write(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{part}/{rolled}').urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                fields = [
                    ("WARC-Type", "response" if response is None else "revisit"),
                    ("WARC-Record-ID", f"<{record_id(page)}>"),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", url),
                    ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest.as_py())).decode()),
                    ("Content-Type", "application/http; msgtype=response"),
                ]
                if response is not None:
                    fields += [("WARC-Refers-To", f"<{record_id(response)}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                out.write(_record(fields, http + (payload if response is None else b"")))
                if out.tell() >= ROLL_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string())})

    names = sorted(r.name for r in ready.mapInArrow(write, "name string").collect())  # one for 256 MB of archives
    with system.open_output_stream(f"{where}/{MANIFEST}", compression=None) as f:
        f.write(json.dumps({"archives": names}).encode())
    return folder


def with_responses(own: DataFrame, repeated: DataFrame) -> DataFrame:
    """The pages with the ``response`` of their digest, null where no other page has it.

    Digests of over 10,000 pages and a thousandth of all go by a broadcast of
    under 1,000 rows; others by a shuffle or, while they are few, as Spark decides.
    """
    total = own.count()
    most = max(FREQUENT_ROWS, total // 1000)
    if total <= most:
        return own.join(repeated.drop("n"), "digest", "left")
    frequent = F.broadcast(repeated.where(F.col("n") > most).drop("n").withColumnRenamed("response", "frequent"))
    seldom = repeated.where(F.col("n") <= most).drop("n")
    marked = own.join(frequent, "digest", "left")
    # a page whose digest is frequent gets a key of its own, so that none is dealt out by it
    key = F.when(F.col("frequent").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    met = marked.withColumn("key", key).join(seldom.withColumnRenamed("digest", "key"), "key", "left").drop("key")
    return met.withColumn("response", F.coalesce("frequent", "response")).drop("frequent")


SCHEMA = (
    "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, "
    "content_length long, payload_bytes long, headers map<string,string>, payload binary"
)
#: Columns whose values are headers as they stand.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


class WarcFile(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Inflater:
    """Bytes of one gzip member, inflated as far as asked."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start = file, start
        head = file.read_at(12, start)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        self.skip = 0
        if head[3] & 4:
            extra = file.read_at(struct.unpack("<H", head[10:12])[0], start + 12)
            while len(extra) >= 4:
                [n] = struct.unpack("<H", extra[2:4])
                if extra[:2] == b"sl" and n == 8:
                    self.skip = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.inflate, self.at, self.data = zlib.decompressobj(31), start, b""
        self.step = 4096

    def upto(self, n: int | None = None, mark: bytes = b"") -> bool:
        """Inflate until there are n bytes, or the mark is there, or the member ends."""
        while not self.inflate.eof and (n is None or len(self.data) < n) and not (mark and mark in self.data):
            raw = self.inflate.unconsumed_tail or self.file.read_at(self.step, self.at)
            if not raw:
                raise ValueError(f"the gzip member at byte {self.start} is cut off")
            if not self.inflate.unconsumed_tail:
                self.at += len(raw)
                self.step = min(2 * self.step, CHUNK)
            self.data += self.inflate.decompress(raw, 0 if n is None and not mark else max(self.step, 4096))
        return not self.inflate.eof

    def next(self) -> int:
        """Start of the next member."""
        if self.skip:
            return self.start + self.skip
        while self.upto():
            self.data = b""
        return self.at - len(self.inflate.unused_data)


class _Plain:
    """Bytes of a record in a plain archive."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.start, self.data, self.length = file, start, b"", 0

    def upto(self, n: int | None = None, mark: bytes = b"") -> bool:
        while (n is not None and len(self.data) < n) or (mark and mark not in self.data):
            raw = self.file.read_at(max(8192, (n or 0) - len(self.data)), self.start + len(self.data))
            if not raw:
                return False
            self.data += raw
        return True

    def next(self) -> int:
        return self.start + self.length + 4


def _fields(lines: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = ""
    for line in lines.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _next_start(file: pa.NativeFile, start: int, size: int, packed: bool) -> int:
    """First byte from ``start`` on at which a record begins, or the end of the archive."""
    mark = b"\x1f\x8b\x08" if packed else b"WARC/"
    while start < size:
        raw = file.read_at(CHUNK, start)
        at = raw.find(mark)
        while at >= 0:
            if not packed:
                return start + at
            try:
                if zlib.decompressobj(31).decompress(file.read_at(4096, start + at), 5) == b"WARC/":
                    return start + at
            except zlib.error:
                pass
            at = raw.find(mark, at + 1)
        start += max(1, len(raw) - len(mark) + 1)
    return size


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.keep = str(options.get("malformed", "fail")).lower() == "keep"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep predicates on headers; return the others to Spark."""
        kinds = {EqualTo: "=", In: "in", IsNotNull: "there", StringStartsWith: "starts", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            kind, name = kinds.get(type(f)), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if kind and (name in HEADERS or (name == "content_length" and kind in ("=", ">", ">=", "<", "<=", "there"))):
                self.tests.append((name, kind, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, where = filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(where, recursive=True)) if system.get_file_info(where).type == fs.FileType.Directory else [system.get_file_info(where)]
        # names that start with a full stop belong to unfinished attempts
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith((".warc", ".warc.gz")) and not f.base_name.startswith("."))
        if (lists := f"{where.rstrip('/')}/{MANIFEST}") in {f.path for f in found}:
            with system.open_input_stream(lists, compression=None) as f:
                names = [f"{where.rstrip('/')}/{n}" for n in json.loads(f.read())["archives"]]
        prefix = self.path[: self.path.rindex(where)] if where in self.path else "file://"
        return [WarcFile(prefix + n) for n in names]

    def _passes(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None:
                return False
            ok = (
                True if kind == "there"
                else own in value if kind == "in"
                else own.startswith(value) if kind == "starts"
                else own == value if kind == "="
                else own > value if kind == ">"
                else own >= value if kind == ">="
                else own < value if kind == "<"
                else own <= value
            )
            if not ok:
                return False
        return True

    def records(self, uri: str) -> Iterator[dict]:
        """Records of one archive that pass the pushed-down predicates."""
        system, where = filesystem(uri)
        with system.open_input_file(where) as file:
            start, size, packed = 0, file.size(), where.endswith(".gz")
            while start < size:
                try:
                    row, following = self._record(file, start, packed)
                except (ValueError, zlib.error) as e:
                    if not self.keep:
                        raise ValueError(f"{uri}, byte {start}: {e}") from e
                    row = dict.fromkeys([*HEADERS, "content_length", "payload_bytes", "payload"]) | {"record_type": "malformed", "headers": {"archive": uri, "byte": str(start), "error": str(e)}}
                    row, following = row if self._passes(row) else None, _next_start(file, start + 1, size, packed)
                if row is not None:
                    yield row
                start = following

    def _record(self, file: pa.NativeFile, start: int, packed: bool) -> tuple[dict | None, int]:
        """The record at ``start``, null if a predicate rejects it by its headers, and where the next one starts."""
        source = (_Inflater if packed else _Plain)(file, start)
        source.upto(mark=b"\r\n\r\n")
        head, there, _ = source.data.partition(b"\r\n\r\n")
        if not there or not head.startswith(b"WARC/"):
            raise ValueError("no record header")
        fields = _fields(head)
        length, begin = int(fields.get("content-length", 0)), len(head) + 4
        if length < 0:
            raise ValueError("a negative Content-Length")
        if isinstance(source, _Plain):
            source.length = begin + length
        row = {c: fields.get(h) for c, h in HEADERS.items()} | {"content_length": length, "headers": fields}
        if not self._passes(row):
            return None, source.next()
        http, payload_bytes = 0, length
        if fields.get("content-type", "").startswith("application/http"):
            at = -1
            while at < 0 and len(source.data) < begin + length:
                before = len(source.data)
                source.upto(min(begin + length, before + 4096))
                at = source.data.find(b"\r\n\r\n", begin)
                if len(source.data) == before:
                    raise ValueError("the record is cut off")
            at = source.data.find(b"\r\n\r\n", begin) if at < 0 else at
            if 0 <= at < begin + length:
                http = at + 4 - begin
                own = _fields(source.data[begin:at])
                payload_bytes = length - http
                if row["record_type"] == "revisit" and own.get("content-length", "").isdigit():
                    payload_bytes = int(own["content-length"])
        row["payload_bytes"], row["payload"] = payload_bytes, None
        if self.payload and row["record_type"] != "revisit":
            source.upto(begin + length)
            if len(source.data) < begin + length:
                raise ValueError("the record is cut off")
            row["payload"] = source.data[begin + http : begin + length]
        return row, source.next()

    def read(self, partition: WarcFile | None) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string()] * 6 + [pa.int64()] * 2 + [pa.map_(pa.string(), pa.string()), pa.binary()]

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        if partition is None:  # Spark's stand-in where no file was found
            return
        rows, size = [], 0
        for row in self.records(partition.uri):
            rows.append(row)
            size += len(row["payload"] or b"") + 500
            if size > 8 << 20:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").option("payload", "false").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True, malformed: str = "fail") -> DataFrame:
    """Records of all archives of a folder, or of one; predicates on headers are pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).option("malformed", malformed).load(path)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records that write_warc wrote."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pa.array(map(page_of, b.column(c).to_pylist()), pa.int64()) for c in ("record_id", "refers_to")]
            yield pa.RecordBatch.from_arrays([own[0], b.column("payload_bytes"), b.column("payload_digest"), b.column("record_type"), own[1]], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    own = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", "refers_to", "payload_bytes", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type")
    return own.mapInArrow(decode, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
