"""Session settings that every entry point shares."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int = 8, name: str = "quern", **more: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    conf = SETTINGS | {
        "spark.master": f"local[{cpus}]",
        "spark.driver.memory": os.environ.get("QUERN_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
    }
    conf |= more
    session = SparkSession.builder.appName(name).config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
