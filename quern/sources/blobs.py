"""A content-addressed store of files: two hex digits of the digest name the folder, the rest the file."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a file read at a time.
PIECE = 1 << 20


def blob_path(digest: Column) -> Column:
    """Path of a blob below the root of its store."""
    return F.concat(F.substring(digest, 1, 2), F.lit("/"), F.substring(digest, 3, 62))


def promote(rows: DataFrame, root: str, content: str = "content") -> DataFrame:
    """Store each distinct content once: (sha256, bytes, relative_path, created). Null contents are left out.

    `root` is a folder or URI that all executors reach. A file is written under another name and then moved, so a reader
    never meets part of it, a repeated task does no harm, and what is there already stays.
    """
    bytes_of = F.col(content).cast("binary")
    blobs = rows.filter(F.col(content).isNotNull()).select(F.sha2(bytes_of, 256).alias("sha256"), bytes_of.alias("content"))
    blobs = blobs.dropDuplicates(["sha256"]).withColumn("relative_path", blob_path(F.col("sha256")))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            made = []
            for path, data in zip(batch["relative_path"], batch["content"], strict=True):
                target = f"{base}/{path}"
                there = store.get_file_info(target).type == fs.FileType.File
                if not there:
                    part = f"{base}/{path[:2]}/.{uuid.uuid4().hex}"
                    store.create_dir(f"{base}/{path[:2]}", recursive=True)
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    store.move(part, target)
                made.append(not there)
            yield pd.DataFrame({"sha256": batch["sha256"], "bytes": [len(d) for d in batch["content"]], "relative_path": batch["relative_path"], "created": made})

    return blobs.mapInPandas(write, "sha256 string, bytes long, relative_path string, created boolean")


def verify(records: DataFrame, root: str) -> DataFrame:
    """(sha256, bytes, relative_path) records against the store: those with a fault, missing or altered.

    Each record's file is read in pieces where the record is; empty files count, which Spark's readers pass over.
    """

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            faults = []
            for path, digest in zip(batch["relative_path"], batch["sha256"], strict=True):
                if store.get_file_info(f"{base}/{path}").type != fs.FileType.File:
                    faults.append("missing")
                    continue
                seen = hashlib.sha256()
                with store.open_input_stream(f"{base}/{path}") as file:
                    while piece := file.read(PIECE):
                        seen.update(piece)
                faults.append(None if seen.hexdigest() == digest else "altered")
            yield pd.DataFrame({"sha256": batch["sha256"], "relative_path": batch["relative_path"], "fault": faults})

    found = records.select("sha256", "relative_path").mapInPandas(check, "sha256 string, relative_path string, fault string")
    return found.filter("fault IS NOT NULL")
