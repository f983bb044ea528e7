"""Helpers the training-data operators share: lineage cuts, size-checked broadcasts, joins on hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: code points other than U+0020 and U+0009..U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
NO_WORD = r"[^\x20\x09-\x0D]"

#: Rows of a few numbers that may be broadcast; beyond it a shuffled join takes over.
BROADCAST_ROWS = 1_000_000

_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application in the shared folder that spark.checkpoint.dir names; set only where it is unset."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not shared:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="quern-")  # unset: a local session, as in tests
            spark.sparkContext.setCheckpointDir(shared)
        root = f"{shared.rstrip('/')}/quern-{uuid.uuid4().hex}"
        _scratch[app] = root
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.deleteOnExit(path)
        atexit.register(_forget, fs, path)
    return _scratch[app]


def _forget(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # the JVM may be gone; deleteOnExit has then done it
        return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: the lineage ends there and outlives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame | None) -> None:
    """Delete what `cut` wrote for `df`, once nothing that is still to run reads it."""
    if df is not None:
        for name in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if its counted rows are within `limit`; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def row_key(*columns: str) -> Column:
    """128 bits that name a row by its content: two rows of 10**12 agree by chance once in 10**14 tables."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def words_of(text: str | Column) -> Column:
    """The words of a text; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")


def with_group_min(df: DataFrame, key: list[str], value: str, out: str, share: int = 1000) -> DataFrame:
    """Add the least `value` of each `key`, whatever share of the rows one key holds.

    Minima are pre-aggregated before the shuffle. A key with over 1/`share` of all rows is heavy; there
    are fewer than `share` of those, so they are joined by broadcast, and the rest by a shuffled join
    in which no key is large.
    """
    least = df.groupBy(*key).agg(F.min(value).alias(out), F.count(F.lit(1)).alias("_n"))
    least = cut(least.filter("_n > 1"), "group-min")
    total = df.count()
    heavy = least.filter(F.col("_n") * share > total).drop("_n")
    light = least.filter(F.col("_n") * share <= total).drop("_n")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    first = df.alias("a").join(F.broadcast(heavy).alias("b"), on, "left").select("a.*", F.col(f"b.{out}").alias("_h"))
    second = first.alias("a").join(light.alias("b"), on, "left").select("a.*", F.coalesce("a._h", f"b.{out}", f"a.{value}").alias(out))
    return second.drop("_h")
