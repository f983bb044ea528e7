"""WARC archives as a PySpark data source, for reading and writing.

Writing: each task writes archives of one gzip member per record under names of its own; the driver lists
those of the tasks that won in a manifest, so a task that runs twice leaves nothing that is read.

Reading: archives are dealt to partitions by size, and an archive that has the writer's index of member lengths is
split by it (option split_bytes). Archives of others are read whole, by one task each, since a record's beginning
can't be told from payload that looks like one. Equality, membership, presence, order and prefix filters on any
header are pushed down. A record's headers are parsed first; the payload of a record that a filter rejects, or all
payloads with the option payload=false, are skipped without decoding where the index allows it, and otherwise
inflated, in pieces that are dropped, only to find their end.
Spark doesn't tell a Python source which columns a query selects, so that option has to be given.

Paths go through Arrow's file systems, so a store needs no mount: file, hdfs, s3, gs.

Records with nulls: a null payload is written empty; a null header is left out and read back as null. Carriage
returns and line feeds in a header's value are written as %0D and %0A, so no value can end its line.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

#: Columns and the headers they hold.
HEADERS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", payload_bytes long, payload binary"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "_manifest.json"
#: Bytes of an archive before the next is begun, and of archives that a partition reads.
ARCHIVE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def head(values: dict[str, str | None], length: int) -> bytes:
    whole = lambda v: v.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", *(f"{HEADERS[c]}: {whole(v)}" for c, v in values.items() if v is not None), f"Content-Length: {length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_head(data: bytes) -> dict[str, str]:
    """Headers of a record by lower-case name; continued lines are joined."""
    found: dict[str, str] = {}
    name = ""
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


class Archives(InputPartition):
    """Archives, or the records of one that begin in a range of its bytes."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files


#: Comparisons of a header's value with a constant; strings compare by code point, as Spark's do.
_COMPARED = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.want_payload = str(options.get("payload", "true")).lower() != "false"
        self.split_bytes = int(options.get("split_bytes", PARTITION_BYTES))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, membership, presence, order and prefixes of headers; gives back the rest."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, EqualTo):
                self.tests.append((name, "in", {f.value}))
            elif name in HEADERS and isinstance(f, In):
                self.tests.append((name, "in", set(f.value)))
            elif name in HEADERS and isinstance(f, IsNotNull):
                self.tests.append((name, "set", None))
            elif name in HEADERS and type(f) in _COMPARED and isinstance(f.value, str):
                self.tests.append((name, _COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Small archives together; an archive with an index in ranges of `split_bytes`; one without it as a whole,
        as nothing outside its records says where they begin."""
        fs, root = open_store(self.path)
        info = fs.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True))
        sizes = {i.base_name: i.size for i in info if i.is_file}
        if MANIFEST in sizes:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
        else:
            names = sorted(n for n in sizes if n.endswith((".warc", ".warc.gz")))
        parts: list[InputPartition] = []
        held: list[tuple[str, int, int]] = []
        total = 0
        for name in names:
            step = self.split_bytes if f"{name}.idx" in sizes else max(sizes[name], 1)
            for lo in range(0, max(sizes[name], 1), step):
                hi = min(lo + step, sizes[name])
                if held and total + hi - lo > self.split_bytes:
                    parts.append(Archives(held))
                    held, total = [], 0
                held.append((f"{root}/{name}", lo, hi))
                total += hi - lo
        return [*parts, Archives(held)] if held or not parts else parts

    def accepts(self, headers: dict[str, str]) -> bool:
        for column, kind, wanted in self.tests:
            value = headers.get(HEADERS[column].lower())
            if value is None or not _passes(kind, value, wanted):
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(self.path)
        for name, lo, hi in partition.files:
            starts = None
            if fs.get_file_info(name + ".idx").is_file:
                with fs.open_input_stream(name + ".idx") as f:
                    lengths = json.loads(zlib.decompress(f.read()))
                starts = [(at - n, n) for n, at in zip(lengths, accumulate(lengths), strict=True) if lo <= at - n < hi]
            with fs.open_input_file(name) as f:
                yield from self.batches(records(f, name.endswith(".gz"), starts, self.accepts, self.want_payload))

    def batches(self, found: Iterator[tuple[dict[str, str], bytes | None]]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[dict[str, str], bytes | None]] = []
        held = 0
        for row in found:
            rows.append(row)
            held += 200 + len(row[1] or b"")
            if held >= BATCH_BYTES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
        columns = []
        for c in self.columns:
            if c == "payload":
                columns.append(pa.array([p for _, p in rows], pa.binary()))
            elif c == "payload_bytes":
                columns.append(pa.array([int(h.get("content-length", 0)) for h, _ in rows], pa.int64()))
            else:
                columns.append(pa.array([h.get(HEADERS[c].lower()) for h, _ in rows], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=self.columns)


def _passes(kind: str, value: str, wanted) -> bool:
    if kind == "in":
        return value in wanted
    if kind == "starts":
        return value.startswith(wanted)
    return kind == "set" or {">": value > wanted, ">=": value >= wanted, "<": value < wanted, "<=": value <= wanted}[kind]


def records(f, zipped: bool, starts: list[tuple[int, int]] | None, accepts, want_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Accepted records of an archive, in order: headers, and the payload if it is wanted.

    `starts` has the places and lengths of gzip members to read, each holding one record, as this library's index has
    them. Without it the archive is read as one stream of records, however its members divide it.
    """
    if zipped and starts is not None:
        yield from _indexed(f, starts, accepts, want_payload)
        return
    stream = Stream(f, zipped)
    while (head_ := stream.head()) is not None:
        headers = parse_head(head_)
        size = int(headers.get("content-length", 0))
        if accepts(headers):
            if want_payload:
                yield headers, stream.take(size)
                continue
            yield headers, None
        stream.skip(size)


def _indexed(f, starts, accepts, want_payload):
    for at, length in starts:
        f.seek(at)
        inflate = zlib.decompressobj(31)
        fed = f.read(min(length, 4096))
        data = inflate.decompress(fed, 2048)
        while (cut := data.find(b"\r\n\r\n")) < 0 and (inflate.unconsumed_tail or len(fed) < length):
            more = inflate.unconsumed_tail
            if not more:
                more = f.read(min(length - len(fed), 4096))
                fed += more
            data += inflate.decompress(more, 4096)
        headers = parse_head(data[:cut])
        if not accepts(headers):
            continue
        if want_payload:
            size = int(headers["content-length"])
            data += inflate.decompress(inflate.unconsumed_tail + f.read(length - len(fed)))
            yield headers, data[cut + 4 : cut + 4 + size]
        else:
            yield headers, None


class Stream:
    """Bytes of an archive in order. A plain archive is passed over by seeking, a zipped one by inflating and dropping;
    no more than a record's head, or a payload that is wanted, is held."""

    STEP = 1 << 16

    def __init__(self, f, zipped: bool) -> None:
        self.f, self.held = f, b""
        self.inflate = zlib.decompressobj(31) if zipped else None
        self.rest = b""
        self.begun = False

    def _more(self) -> bytes:
        """The next bytes; none at the end."""
        if self.inflate is None:
            return self.f.read(self.STEP)
        while True:
            if self.inflate.eof:
                self.rest = self.inflate.unused_data
                self.inflate, self.begun = zlib.decompressobj(31), False
            data = self.rest or self.f.read(self.STEP)
            self.rest = b""
            if not data:
                if self.begun:
                    raise ValueError("the archive ends within a record")
                return b""
            self.begun = True
            out = self.inflate.decompress(data, 16 * self.STEP)
            self.rest = self.inflate.unconsumed_tail
            if out:
                return out

    def head(self) -> bytes | None:
        """The next record's head, without the line breaks before it; None at the end of the archive."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if (cut := self.held.find(b"\r\n\r\n")) >= 0:
                head_, self.held = self.held[:cut], self.held[cut + 4 :]
                return head_
            more = self._more()
            if not more:
                if self.held.strip():
                    raise ValueError("the archive ends within a record")
                return None
            self.held += more

    def take(self, size: int) -> bytes:
        parts, left = [self.held[:size]], size - len(self.held)
        self.held = self.held[size:]
        while left > 0:
            more = self._more()
            if not more:
                raise ValueError("the archive ends within a record")
            parts.append(more[:left])
            self.held = more[left:]
            left -= len(more)
        return b"".join(parts)

    def skip(self, size: int) -> None:
        left = size - len(self.held)
        self.held = self.held[size:]
        if left > 0 and self.inflate is None:
            self.f.seek(self.f.tell() + left)
            return
        while left > 0:
            more = self._more()
            if not more:
                raise ValueError("the archive ends within a record")
            self.held = more[left:]
            left -= len(more)


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]) -> None:
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.level = int(options.get("level", "4"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        out, lengths, size = None, [], 0

        def close() -> None:
            out.close()
            with fs.open_output_stream(f"{root}/{names[-1]}.idx") as f:
                f.write(zlib.compress(json.dumps(lengths).encode(), 1))

        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None or size > ARCHIVE_BYTES:
                    if out is not None:
                        close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, lengths, size = fs.open_output_stream(f"{root}/{names[-1]}", compression=None), [], 0
                payload = columns["payload"][i]
                body = payload.as_buffer().to_pybytes() if payload.is_valid else b""
                values = {c: columns[c][i].as_py() for c in HEADERS if c in columns}
                deflate = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                data = deflate.compress(head(values, len(body))) + deflate.compress(body) + deflate.compress(b"\r\n\r\n") + deflate.flush()
                out.write(data)
                lengths.append(len(data))
                size += len(data)
        if out is not None:
            close()
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        names: list[str] = []
        if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{root}/{MANIFEST}") as f:
                names = json.loads(f.read())
        names += [n for m in messages if m is not None for n in m.names]
        with fs.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps(names).encode())
        if fs.get_file_info(f"{root}/{MANIFEST}").is_file:
            fs.delete_file(f"{root}/{MANIFEST}")
        fs.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = open_store(self.path)
        for m in messages:
            for n in m.names if m is not None else []:
                for name in (n, f"{n}.idx"):
                    if fs.get_file_info(f"{root}/{name}").is_file:
                        fs.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """`spark.read.format("warc")` and `df.write.format("warc")`; options: path, payload (false: headers only), level."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def write(df: DataFrame, path: str) -> None:
    """Write rows with the columns of HEADERS and `payload` as archives; others are left out."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").option("path", path).save()


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """A WARC record per row of (page_id, url, html), equal payloads of `least` bytes or more revisiting one response.

    The response is the record with the least page_id; a null html is an empty payload. Rows with a null
    page_id never stand for others: they are responses. Repeated page_ids with one payload are one
    response, repeated.
    """
    from quern.llm.shared import cut, small, with_group_min

    rows = pages.select("page_id", F.col("url").cast("string").alias("target_uri"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"))
    rows = rows.withColumn("_digest", F.sha2("payload", 256)).withColumn("_size", F.length("payload"))
    # records that share nothing get a key of their own, so short or empty payloads form no group
    lone = (F.col("_size") < least) | F.col("page_id").isNull()
    facts = cut(rows.select("page_id", "_digest", "_size").filter(~lone), "payload-facts")
    first = with_group_min(facts, ["_digest"], "page_id", "_first").filter("_first <> page_id").select(F.col("page_id").alias("_page"), F.col("_digest").alias("_same"), "_first").distinct()
    first = cut(first, "revisits")
    # while revisits are counted few, payloads stay where they are
    rows = rows.join(small(first, first.count()), (F.col("page_id") == F.col("_page")) & (F.col("_digest") == F.col("_same")), "left")
    record = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return rows.select(
        F.when(F.col("_first").isNotNull(), "revisit").otherwise("response").alias("warc_type"),
        record(F.col("page_id")).alias("record_id"),
        "target_uri",
        F.lit(DATE).alias("date"),
        F.concat(F.lit("sha256:"), "_digest").alias("payload_digest"),
        record(F.col("_first")).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        "payload",
    )
