"""Session set-up and cutting of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tickerloom", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def utc(spark: SparkSession) -> SparkSession:
    """All timestamps of the models are UTC; make the session read them so."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for cut lineage, taken from ``spark.checkpoint.dir``.

    Only a local session, where driver and executors are one process, may fall back
    to a folder of this machine.
    """
    sc = spark.sparkContext
    in_use = sc.getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or in_use
    if not named:
        if not sc.master.startswith(("local[", "local ")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tickerloom-")
    if in_use is None or named.removeprefix("file:").rstrip("/") not in in_use:
        sc.setCheckpointDir(named)
    return named


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Jobs within delete their shuffle files when they end, not whenever the driver happens to collect its garbage.

    The setting holds for the session, so other jobs that it begins meanwhile do so too; a frame that is run again shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, on reliable shared storage, and go on from the result."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into columnar files on the shared storage, and go on from them: for a costly table with many rows that is read again."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
