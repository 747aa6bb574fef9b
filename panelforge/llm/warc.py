"""WARC archives as a Spark data source, written and read, and pages archived with repeated payloads as revisits.

``register(spark)`` makes ``spark.read.format("warc")`` and ``df.write.format("warc")`` known. The reader plans one partition for about
``partitionBytes`` of whole files, takes predicates on record types and headers, parses a record's headers first and skips the payload
where predicates reject the record or the asked schema has no payload. Files are opened through Arrow's file systems (local, HDFS, S3, GCS),
in tasks and for planning alike.

Predicates reach the reader in two ways. ``read(..., where=[EqualTo(("record_type",), "response")])`` fixes them for the relation. The
option ``pushdown`` lets Catalyst push the filters of a query; Spark 4.1 keeps what was pushed with the relation and applies it to later
queries and to other branches of the same one, so such a frame is for one use in one query, and the option is off unless asked for.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from panelforge.llm.common import HEAVY, discard, shared_dir, stage, table

#: Columns that are header fields.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "content_type": "content-type",
    "content_length": "content-length",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, payload_digest string, refers_to string, payload_bytes long, payload binary"
WRITTEN = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of a file that are fetched at once, and of inflated data at once.
READ = 1 << 20
#: Bytes of the longest block of headers, and bytes that are first inflated to find them.
LONGEST_HEADERS, FIRST = 1 << 20, 2048
#: Payload bytes and rows of a batch that goes to Spark.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


# Bytes of files


class File:
    """A file by position, with one stretch of it in memory."""

    def __init__(self, path: str):
        system, at = fs.FileSystem.from_uri(path)
        self.f = system.open_input_file(at)
        self.size, self.start, self.held = self.f.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        """``n`` bytes from ``at``, fewer at the end."""
        if at < self.start or at + n > self.start + len(self.held):
            self.f.seek(at)
            self.start, self.held = at, self.f.read(max(n, READ))
        return self.held[at - self.start : at - self.start + n]

    def close(self) -> None:
        self.f.close()


class Plain:
    """Bytes as they are: what is skipped is not read."""

    def __init__(self, file: File, at: int):
        self.file, self.at = file, at

    def read(self, n: int) -> bytes:
        out = self.file.get(self.at, n)
        self.at += len(out)
        return out

    def peek(self, n: int) -> bytes:
        return self.file.get(self.at, n)

    def skip(self, n: int) -> None:
        self.at += n


class Inflated:
    """Inflated bytes from one gzip member after another; what is skipped is inflated in small parts and dropped."""

    def __init__(self, file: File, at: int, end: int | None = None):
        self.file, self.at, self.end = file, at, file.size if end is None else end
        self.z, self.held = zlib.decompressobj(31), b""

    def more(self, n: int) -> bool:
        """Inflate about ``n`` more bytes; False at the end."""
        left = self.z.unconsumed_tail
        if not left and self.at < self.end and not self.z.eof:
            left = self.file.get(self.at, min(READ, self.end - self.at))
            self.at += len(left)
        if self.z.eof:
            rest = self.z.unused_data
            if not rest and self.at >= self.end:
                return False
            if not rest:
                rest = self.file.get(self.at, min(READ, self.end - self.at))
                self.at += len(rest)
            self.z, left = zlib.decompressobj(31), rest
        if not left:
            raise ValueError("a compressed record ends early")
        self.held += self.z.decompress(left, n)
        return True

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and self.more(max(n - len(self.held), FIRST)):
            pass
        return self.held[:n]

    def read(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(min(n - have, READ)):
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def finish(self) -> None:
        """Inflate the member to its end, where its checksum is compared."""
        while not self.z.eof:
            self.held = b""
            self.more(READ)

    def skip(self, n: int) -> None:
        while n:
            got = len(self.read(min(n, READ)))
            if not got:
                raise ValueError("a compressed record ends early")
            n -= got


def member_size(file: File, at: int) -> int:
    """Bytes of the gzip member at ``at``, as its `sl` field (skip lengths) states; 0 where it has none."""
    h = file.get(at, 24)
    if len(h) == 24 and h[:4] == b"\x1f\x8b\x08\x04" and h[10:16] == b"\x0c\x00sl\x08\x00":
        return int.from_bytes(h[16:20], "little")
    return 0


def member(data: bytes, level: int) -> bytes:
    """A gzip member of one record, with its own length and the record's in its `sl` field, so that readers can skip it unread."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = z.compress(data) + z.flush()
    size = 24 + len(packed) + 8
    lengths = [size, len(data)] if size < 1 << 32 and len(data) < 1 << 32 else [0, 0]  # 0: unknown, to be inflated
    extra = b"\x0c\x00sl\x08\x00" + b"".join(n.to_bytes(4, "little") for n in lengths)
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + extra + packed + zlib.crc32(data).to_bytes(4, "little") + (len(data) & 0xFFFFFFFF).to_bytes(4, "little")


# Records


def fields(block: bytes) -> dict[str, str]:
    """Header fields by name in small letters; a line that begins with white space goes on with the one before; first of equal names wins."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", block).split(b"\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace"))
    return out


def head_end(stream: Plain | Inflated, most: int) -> int:
    """Bytes up to and including the empty line that ends a block of headers; -1 where ``most`` bytes hold none."""
    n = FIRST
    while True:
        n = min(n, most)
        have = stream.peek(n)
        ends = [m.end() for m in [re.search(rb"\r?\n\r?\n", have)] if m]
        if ends:
            return ends[0]
        if len(have) < n or n == most:
            return -1
        n *= 4


def row_of(head: dict[str, str]) -> dict:
    row = {c: head.get(name) for c, name in HEADERS.items()}
    row["content_length"] = int(head.get("content-length", 0))
    return row


def body(stream: Plain | Inflated, row: dict, want_payload: bool) -> int:
    """Fill in ``payload_bytes`` and, if wanted, ``payload``; returns the bytes of the block that are left unread."""
    left = row["content_length"]
    http = (row["content_type"] or "").replace(" ", "").lower().startswith("application/http")
    stated = None
    if http and (end := head_end(stream, min(left, LONGEST_HEADERS))) >= 0:
        stated = fields(stream.read(end)).get("content-length")
        left -= end
    # A revisit holds the HTTP headers alone: they state how long the payload was.
    row["payload_bytes"] = int(stated) if row["record_type"] == "revisit" and stated and stated.isdigit() else left
    if want_payload:
        row["payload"] = None if row["record_type"] == "revisit" else stream.read(left)
        if row["payload"] is not None and len(row["payload"]) < left:
            raise ValueError("a record's block ends early")
        left = left if row["payload"] is None else 0
    return left


def records(file: File, packed: bool, wanted: set[str], passes) -> Iterator[dict]:
    """A file's records that pass, with the wanted columns. Only headers are parsed of those that do not."""
    at, stream = 0, None
    while at < file.size:
        size = member_size(file, at) if packed else 0
        if size:
            stream = Inflated(file, at, at + size)
        elif stream is None or not isinstance(stream, (Plain, Inflated)):
            stream = Inflated(file, at) if packed else Plain(file, at)
        while not size and (gap := stream.peek(2)[:1]) and gap in b"\r\n":  # blank lines between records
            stream.skip(1)
        if not stream.peek(1):
            return
        end = head_end(stream, LONGEST_HEADERS)
        if end < 0 or stream.peek(5) != b"WARC/":
            raise ValueError("no WARC record where one has to begin")
        row = row_of(fields(stream.read(end)))
        left = row["content_length"]
        if passes(row):
            if wanted & {"payload", "payload_bytes"}:
                left = body(stream, row, "payload" in wanted)
            if size and "payload" in wanted:
                stream.finish()
            yield row
        if size:
            at, stream = at + size, None  # the rest of the member stays packed
        else:
            stream.skip(left)
            at = stream.at if isinstance(stream, Plain) else 0  # an inflated stream ends by itself


# Predicates


def value_of(f: Filter) -> str | None:
    return f.attribute[0] if len(f.attribute) == 1 and f.attribute[0] in HEADERS else None


def predicate(f: Filter):
    """A predicate on a row of headers as a function that is true, false or (unknown) None; None where this one is not taken."""
    if isinstance(f, Not):
        inner = predicate(f.child)
        return inner and (lambda r: None if (v := inner(r)) is None else not v)
    if not hasattr(f, "attribute") or (c := value_of(f)) is None:
        return None
    known = lambda test: lambda r: None if r[c] is None else test(r[c])
    match f:
        case IsNull():
            return lambda r: r[c] is None
        case IsNotNull():
            return lambda r: r[c] is not None
        case EqualNullSafe():
            return lambda r: r[c] == f.value
        case EqualTo():
            return known(lambda v: v == f.value)
        case In():
            return known(lambda v: v in f.value)
        case StringStartsWith():
            return known(lambda v: v.startswith(f.value))
        case StringEndsWith():
            return known(lambda v: v.endswith(f.value))
        case StringContains():
            return known(lambda v: f.value in v)
    if c == "content_length":  # order of texts is that of their bytes in Spark, so only numbers are compared here
        match f:
            case GreaterThan():
                return known(lambda v: v > f.value)
            case GreaterThanOrEqual():
                return known(lambda v: v >= f.value)
            case LessThan():
                return known(lambda v: v < f.value)
            case LessThanOrEqual():
                return known(lambda v: v <= f.value)
    return None


KINDS = {k.__name__: k for k in (EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith)}


def dumps(filters: Sequence[Filter]) -> str:
    """Predicates as text, for an option of the source."""
    plain = lambda f: {"not": plain(f.child)} if isinstance(f, Not) else {"is": type(f).__name__, "attribute": list(f.attribute)} | ({"value": list(f.value) if isinstance(f, In) else f.value} if hasattr(f, "value") else {})
    return json.dumps([plain(f) for f in filters])


def loads(text: str) -> list[Filter]:
    def made(x: dict) -> Filter:
        if "not" in x:
            return Not(made(x["not"]))
        rest = {"value": tuple(x["value"]) if x["is"] == "In" else x["value"]} if "value" in x else {}
        return KINDS[x["is"]](tuple(x["attribute"]), **rest)

    return [made(x) for x in json.loads(text)]


# The data source


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def locate(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def uri(path: str, inside: str) -> str:
    """The address of a file inside the system that ``path`` names."""
    scheme = re.match(r"([a-z0-9+.-]+):", path)
    if not scheme or scheme[1] == "file":
        return f"file://{inside}"
    _, base = locate(path)
    return path.split("?")[0].removesuffix(base) + inside if path.split("?")[0].endswith(base) else f"{scheme[1]}://{inside}"


def listing(path: str) -> list[tuple[str, int]]:
    """Files of an archive and their sizes. Where manifests are, they tell the committed files; else all files of that ending count."""
    system, base = locate(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = [i for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    manifests = [i.path for i in inside if re.fullmatch(r"_manifest-.*\.json", i.base_name)]
    if manifests:
        names: set[str] = set()
        for m in manifests:
            with system.open_input_file(m) as f:
                names |= {posixpath.join(posixpath.dirname(m), n) for n in json.loads(f.read())["files"]}
        inside = [i for i in inside if i.path in names]
        if gone := names - {i.path for i in inside}:
            raise FileNotFoundError(f"{len(gone)} committed files of {path} are gone: {min(gone)}")
    return sorted((uri(path, i.path), i.size) for i in inside if re.search(r"\.warc(\.gz)?$", i.path))


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.options, self.filters = schema.names, options, loads(options.get("where", "[]"))
        if any(predicate(f) is None for f in self.filters):
            raise ValueError("a predicate has to be on a header column")
        if unknown := set(self.columns) - {c.split()[0] for c in SCHEMA.split(", ")}:
            raise ValueError(f"a WARC record has no column {sorted(unknown)}")
        self.arrow = pa.schema([(c, pa.int64() if c in ("content_length", "payload_bytes") else pa.binary() if c == "payload" else pa.string()) for c in self.columns])

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, in order, about ``partitionBytes`` together: a record's start cannot be told safely from within a file."""
        most, out, size = int(self.options.get("partitionbytes", 64 << 20)), [], 0
        for path, n in listing(self.options["path"]):
            if not out or size + n > most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        tests = [predicate(f) for f in self.filters]
        wanted, rows, size = set(self.columns), [], 0
        for path in partition.paths:
            file = File(path)
            try:
                for row in records(file, path.endswith(".gz"), wanted, lambda r: all(t(r) for t in tests)):
                    rows.append(row)
                    size += len(row.get("payload") or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield self.batch(rows)
                        rows, size = [], 0
            except (ValueError, zlib.error) as e:
                raise ValueError(f"{path}: {e}") from e
            finally:
                file.close()
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in self.arrow], schema=self.arrow)


class PushedReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if predicate(f) is None:
                yield f  # Spark applies it
            else:
                self.filters.append(f)


class Writer(DataSourceArrowWriter):
    """Each task writes files of its own name; the manifest, written last, makes those of the attempts that count visible at once."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def record(self, r: dict) -> bytes:
        kind, payload = r["record_type"] or "response", r.get("payload")
        n = r.get("payload_bytes")
        n = len(payload or b"") if n is None or kind != "revisit" else n
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
        block = http if kind == "revisit" else http + (payload or b"")
        head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {safe(r['record_id'] or f'<urn:uuid:{uuid.uuid4()}>')}", f"WARC-Date: {self.date}"]
        for name, c in (("WARC-Target-URI", "target_uri"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Refers-To", "refers_to")):
            if r.get(c) is not None:
                head.append(f"{name}: {safe(r[c])}")
        if kind == "revisit":
            head.append(f"WARC-Profile: {REVISIT}")
        head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
        return "\r\n".join(head).encode() + block + b"\r\n\r\n"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = locate(self.options["path"])
        system.create_dir(base, recursive=True)
        most, packed = int(self.options.get("filebytes", 128 << 20)), self.options.get("compression", "gzip") == "gzip"
        level, names, out, size = int(self.options.get("level", 6)), [], None, 0
        try:
            for part in iterator:
                for at in range(0, part.num_rows, 64):
                    for r in part.slice(at, 64).to_pylist():
                        if out is None or size >= most:
                            if out is not None:
                                out.close()
                            names.append(f"{self.job}-{uuid.uuid4().hex}.warc{'.gz' if packed else ''}")
                            out, size = system.open_output_stream(f"{base}/{names[-1]}", compression=None), 0
                        data = self.record(r)
                        size += out.write(member(data, level) if packed else data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, base = locate(self.options["path"])
        system.create_dir(base, recursive=True)
        before = [i.path for i in system.get_file_info(fs.FileSelector(base))] if self.overwrite else []
        name = f"{base}/_manifest-{self.job}.json"
        with system.open_output_stream(name) as f:
            f.write(json.dumps({"files": [n for m in messages if m for n in m.files]}).encode())
        mine = {name, *(f"{base}/{n}" for m in messages if m for n in m.files)}
        for old in sorted(set(before) - mine, key=lambda p: "_manifest-" not in p):  # manifests first: without them the old files do not count
            if system.get_file_info(old).type == fs.FileType.File:
                system.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, base = locate(self.options["path"])
        for n in [n for m in messages if m for n in m.files]:
            if system.get_file_info(f"{base}/{n}").type == fs.FileType.File:
                system.delete_file(f"{base}/{n}")


def safe(value: str) -> str:
    """A header value that cannot begin a line of its own: control characters are percent-encoded, so are blanks at its ends."""
    coded = lambda m: "".join(f"%{b:02X}" for b in m[0].encode())
    return re.sub(r"[\x00-\x1f\x7f\x85  ]|^\s|\s$", coded, value)


class Warc(DataSource):
    """Options: ``path``; read: ``partitionBytes``, ``where``, ``pushdown``; write: ``fileBytes``, ``compression`` (gzip, none), ``level``, ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        options = self.lower()
        return (PushedReader if options.get("pushdown", "false").lower() == "true" else Reader)(schema, options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.lower(), overwrite)


def register(spark: SparkSession) -> None:
    """Make format `warc` known to the session."""
    spark.dataSource.register(Warc)


def read(spark: SparkSession, path: str, columns: str = SCHEMA, where: Sequence[Filter] = (), pushdown: bool = False) -> DataFrame:
    """Records of an archive with the asked columns alone (a part of ``SCHEMA``); payloads are decoded only where asked for.

    ``where``: predicates on header columns, of the classes in ``pyspark.sql.datasource``, all of which a record has to pass.
    """
    register(spark)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).option("where", dumps(where)).option("pushdown", str(pushdown).lower()).load(path)


# Pages

#: Rows of repeated digests that are sent to every task at most: some 50 MB.
MOST_SENT = 500_000


def with_first(rows: DataFrame, repeated: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``rows`` with ``first``, the smallest page of an equal payload, null where no other page has it.

    ``repeated`` (written before) has ``digest, first, copies``. Up to ``most`` of them are sent to the rows, which stay where they are; beyond,
    digests of more than a thousandth of the copies are sent and only the other rows are shuffled.
    """
    few = repeated.select("digest", "first")
    n, total = repeated.agg(F.count(F.lit(1)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    if n <= most:
        return rows.join(F.broadcast(few), "digest", "left")
    heavy = F.broadcast(few.where(F.col("copies") * HEAVY > total))
    light = repeated.where(F.col("copies") * HEAVY <= total).select("digest", "first")
    rest = rows.join(heavy.select("digest"), "digest", "left_anti").join(light, "digest", "left")
    return rows.join(heavy, "digest").unionByName(rest)


def urn(page: str):
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(">"))


def page_of(column: str):
    return F.nullif(F.regexp_extract(column, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 100, most_sent: int = MOST_SENT) -> None:
    """Archive ``page_id, url, html``: a record a row; of equal payloads of ``least_bytes`` and more all but the smallest page's are revisits.

    A null ``html`` is an empty payload; a null ``url`` gives a record without target; a row without ``page_id`` is a response only if no row
    with one has its payload (then all such rows are); rows that repeat the smallest page's id are responses as well; shorter payloads
    always are. Other columns are left out; an empty table gives an archive without records. Payloads are compared by SHA-256.
    """
    spark = pages.sparkSession
    register(spark)
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload")).withColumns({"n": F.length("payload").cast("long"), "digest": F.unhex(F.sha2("payload", 256))})
    long_enough = rows.where(F.col("n") >= least_bytes).select("digest", "page_id")
    repeated = stage(long_enough.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated")
    again = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    kinds = with_first(rows, repeated, most_sent).withColumn("again", F.coalesce(again, F.lit(False)))
    out = kinds.select(
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("payload_digest"), F.when(F.col("again"), urn("first")).alias("refers_to"), F.col("n").alias("payload_bytes"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)
    discard(repeated)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of an archive of pages.

    Responses are measured from their payloads; of revisits only headers are parsed.
    """
    kind = lambda k: [EqualTo(("record_type",), k)]
    whole = read(spark, path, "record_type string, record_id string, payload binary", kind("response"))
    brief = read(spark, path, "record_type string, record_id string, payload_digest string, refers_to string, payload_bytes long", kind("revisit"))
    first = whole.select(page_of("record_id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(brief.select(page_of("record_id").alias("page_id"), "payload_bytes", F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, octet_length(b)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM r
"""
