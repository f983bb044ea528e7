"""An outbox as a streaming sink: lines of JSON, in order, each event once whatever is run again.

A task writes its rows of an epoch to a file of its own, in order of (occurred_at, event_id). The driver commits an
epoch by moving a manifest, which lists the files, to its name; a manifest that is there already stands, so an epoch that
is run again after a crash adds nothing. Files that no manifest lists are never read. The sink itself is never read to
find out what it has: within an epoch and across epochs the stream drops repeated ids by its own state.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

EPOCHS = "_epochs"


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path.removeprefix("file:"))
    return pafs.LocalFileSystem(), path


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat(timespec="microseconds")
    return value.isoformat() if isinstance(value, dt.date) else value


class Part(WriterCommitMessage):
    def __init__(self, name: str | None, rows: int) -> None:
        self.name, self.rows = name, rows


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.path, self.at, self.key = options["path"], options.get("order", "occurred_at"), options.get("key", "event_id")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        rows = sorted(iterator, key=lambda r: (r[self.at] is not None, r[self.at] or 0, str(r[self.key]).zfill(20)))  # a task's part of one epoch
        if not rows:
            return Part(None, 0)
        fs, root = open_store(self.path)
        fs.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.jsonl"
        with fs.open_output_stream(f"{root}/{name}") as f:
            for r in rows:
                f.write((json.dumps({c: _plain(r[c]) for c in self.names if r[c] is not None}, ensure_ascii=False) + "\n").encode())
        return Part(name, len(rows))

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803  Spark's name
        fs, root = open_store(self.path)
        fs.create_dir(f"{root}/{EPOCHS}", recursive=True)
        target = f"{root}/{EPOCHS}/{batchId:019}.json"
        if fs.get_file_info(target).is_file:  # this epoch is committed: what was written again is no part of it
            self.abort(messages, batchId)
            return
        parts = [{"file": m.name, "rows": m.rows} for m in messages if m is not None and m.name]
        made = f"{target}.{uuid.uuid4().hex}"
        with fs.open_output_stream(made) as f:
            f.write(json.dumps({"epoch": batchId, "parts": parts}).encode())
        fs.move(made, target)

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:  # noqa: N803
        fs, root = open_store(self.path)
        for m in messages:
            if m is not None and m.name and fs.get_file_info(f"{root}/{m.name}").is_file:
                fs.delete_file(f"{root}/{m.name}")


class OutboxSink(DataSource):
    """`writeStream.format("outbox")`; options: path, order (occurred_at), key (event_id)."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema: StructType, overwrite: bool) -> OutboxWriter:  # noqa: N802
        return OutboxWriter(schema, dict(self.options))


def export(stream: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: str = "occurred_at", lateness: str | None = None) -> StreamingQuery:
    """Export what a stream of events has by now, each key once across epochs and restarts; returns the running query.

    Keys are kept in the stream's state: all of them, or, with `lateness`, those that the watermark on `order` still admits.
    """
    spark = stream.sparkSession
    spark.dataSource.register(OutboxSink)
    once = stream.dropDuplicates([key]) if lateness is None else stream.withWatermark(order, lateness).dropDuplicatesWithinWatermark([key])
    return once.writeStream.format("outbox").option("path", path).option("order", order).option("key", key).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def exported(spark: SparkSession, path: str, schema: StructType, key: str = "event_id", order: str = "occurred_at") -> DataFrame:
    """The committed events, in order of epoch, then (`order`, `key`), with their `epoch`; the manifests alone are read on the driver."""
    fs, root = open_store(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{EPOCHS}", allow_not_found=True))
    parts = []
    for info in sorted((i for i in found if i.base_name.endswith(".json")), key=lambda i: i.base_name):
        with fs.open_input_stream(info.path) as f:
            told = json.loads(f.read())
        parts += [(p["file"], told["epoch"]) for p in told["parts"]]
    if not parts:
        return spark.createDataFrame([], schema).withColumn("epoch", F.lit(0).cast("long"))
    epochs = spark.createDataFrame(parts, "_file string, epoch long")
    rows = spark.read.schema(schema).json([f"{path.rstrip('/')}/{name}" for name, _ in parts]).withColumn("_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return rows.join(F.broadcast(epochs), "_file").drop("_file").orderBy("epoch", order, key)
