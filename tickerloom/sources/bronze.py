"""The raw layer: every message as it came, in one semi-structured column.

All raw tables lie under one folder, partitioned by table, day and batch, so that routing
is one write, a table is one pruned partition, and a batch that is delivered again
replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickerloom import names
from tickerloom.functions.payload import with_payload
from tickerloom.session import lean
from tickerloom.sources.versions import FILES, Files

UNREADABLE = "unreadable"
STORED = ("raw_payload variant, unreadable_text string, "
          "record_metadata struct<topic: string, partition: int, offset: bigint, timestamp: timestamp, key: string>, "
          "ingest_date date, batch string")


def table_of(topic: Column) -> Column:
    """The raw table of a topic; NULL for a topic that is not ours."""
    pairs = [F.lit(x) for feed in names.FEEDS for x in (feed.topic, feed.bronze)]
    return F.try_element_at(F.create_map(*pairs), topic)


def raw_rows(messages: DataFrame) -> DataFrame:
    """Queue records as raw rows: parsed payload, lineage, table.

    Empty messages and foreign topics are left out.  A message that is not JSON is kept as
    text under the table name ``unreadable``.
    """
    routed = messages.withColumn("bronze_table", table_of(F.col("topic"))).filter(
        "value IS NOT NULL AND bronze_table IS NOT NULL")
    payload = F.col("raw_payload")
    return with_payload(routed, "value", "raw_payload").select(
        payload,
        F.when(payload.isNull(), F.col("value")).alias("unreadable_text"),
        F.struct("topic", "partition", "offset", "timestamp", "key").alias("record_metadata"),
        F.when(payload.isNull(), F.lit(UNREADABLE)).otherwise(F.col("bronze_table")).alias("bronze_table"),
        F.coalesce(F.to_date("timestamp"), F.lit("1970-01-01").cast("date")).alias("ingest_date"),
    )


def append_batch(messages: DataFrame, root: str, batch: int | str) -> None:
    """Append one batch; the same batch again replaces what it wrote before.

    Rows of a table and day are brought together before they are written, so that a batch makes
    few files; adaptive execution cuts a table and day that is larger than its target size.
    """
    with lean(messages.sparkSession):
        (raw_rows(messages).withColumn("batch", F.lit(str(batch))).hint("rebalance", "bronze_table", "ingest_date")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**FILES)
         .partitionBy("bronze_table", "ingest_date", "batch").parquet(root))


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of one table's folder; none while nothing has been written to it."""
    try:
        return spark.read.schema(STORED).parquet(f"{root.rstrip('/')}/bronze_table={table}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORED)


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """One raw table: ``raw_payload`` and lineage columns.  Only its own folder is listed."""
    return _stored(spark, root, table).drop("unreadable_text")


def folders(spark: SparkSession, root: str, table: str) -> dict[str, int]:
    """The batch folders of a raw table, day by day, with the time of their last change."""
    files, base = Files(spark), f"{root.rstrip('/')}/bronze_table={table}"
    return {f"{day}/{batch}": at for day, _, _ in files.listed(base) if day.startswith("ingest_date=")
            for batch, _, at in files.listed(f"{base}/{day}") if batch.startswith("batch=")}


def read_folders(spark: SparkSession, root: str, table: str, some: Iterable[str]) -> DataFrame:
    """The payloads of some batch folders, nothing else being listed."""
    paths = [f"{root.rstrip('/')}/bronze_table={table}/{folder}" for folder in some]
    schema = "raw_payload variant"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, root, UNREADABLE).select("unreadable_text", "record_metadata")


def preview(table: DataFrame, n: int = 10) -> DataFrame:
    return table.limit(n)
