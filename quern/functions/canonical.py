"""Canonical bytes, content ids and fixed-point scores."""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def canonical_json(value: object) -> bytes:
    """Sorted keys, no spaces, NFC, UTF-8 unescaped; floats and keys that collide after NFC are refused."""

    def clean(v: object) -> object:
        if v is None or isinstance(v, bool | int):
            return v
        if isinstance(v, str):
            return unicodedata.normalize("NFC", v)
        if isinstance(v, list | tuple):
            return [clean(x) for x in v]
        if isinstance(v, dict):
            out: dict[str, object] = {}
            for k, x in v.items():
                if not isinstance(k, str):
                    raise TypeError("keys have to be strings")
                key = unicodedata.normalize("NFC", k)
                if key in out:
                    raise ValueError(f"keys collide: {key!r}")
                out[key] = clean(x)
            return out
        raise TypeError(f"{type(v).__name__} has no canonical form")

    return json.dumps(clean(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


@F.pandas_udf(StringType())
def canonical_text(payload: pd.Series) -> pd.Series:
    """Canonical form of a column of JSON texts."""
    return payload.map(lambda t: None if t is None else canonical_json(json.loads(t)).decode())


def content_id(prefix: str, payload: Column) -> Column:
    """`<prefix>_` and 32 hex digits of the payload's SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(payload.cast("binary"), 256), 1, 32))


def content_id_of(prefix: str, value: object) -> str:
    return f"{prefix}_{hashlib.sha256(canonical_json(value)).hexdigest()[:32]}"


def random_id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def file_uri(root: str, relative: Column) -> Column:
    """URI of a file under an absolute root; each part of the relative path is percent-encoded."""
    parts = F.transform(F.split(relative, "/"), lambda p: F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")))
    return F.concat(F.lit("file://" + root.rstrip("/") + "/"), F.array_join(parts, "/"))


def score_text(score: Column) -> Column:
    """Six places, half to even, no negative zero; rank before formatting."""
    return F.format_string("%.6f", F.bround(score, 6) + F.lit(0.0))


def points(value: Column) -> Column:
    return F.bround(value, 3).cast("decimal(18,3)")


def set_manifest(rows: DataFrame, by: str, member: str) -> DataFrame:
    """Per group its number of members and a hash of them as a set: the same for any order of the rows.

    Members fall into 65,536 buckets by their hash; a bucket hashes its sorted members and a group its sorted
    buckets, so no task holds a whole group.
    """
    hashed = rows.select(by, F.sha2(member, 256).alias("_h"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "\x1e"), 256)
    buckets = hashed.groupBy(by, F.substring("_h", 1, 4).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), joined("_h").alias("_x"))
    return buckets.groupBy(by).agg(F.sum("_n").alias("members"), joined(F.concat("_b", "_x")).alias("manifest_hash"))
