"""Deduplication of streams.

Each batch is reduced and added to a levelled store (:class:`tickerloom.sources.versions.Levels`), dealt in parts by the
keys: no row is too late, the result is that of the whole table, and what a read has to reduce
doesn't grow with the number of batches.  :func:`first_arrivals` bounds its state by a
watermark instead; it drops rows that are later than its delay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tickerloom.operators.dedup import keep_any, keep_latest
from tickerloom.sources.versions import Levels
from tickerloom.streaming.ingest import triggered

PARTS = 8


def first_arrivals(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str = "10 minutes",
                   pieces: int = 8) -> DataFrame:
    """First copy per key among those that arrive within ``delay`` of each other.

    Rows later than ``delay`` behind the newest one of an earlier batch are lost; where that
    must not be, use :func:`any_log`.

    A stream cannot reduce before the shuffle, so copies are first told apart in ``pieces`` by
    the split they came in; then at most ``pieces`` copies of a key meet in one task.
    """
    timed = stream.withColumn(event_time, F.col(event_time).cast("timestamp")).withWatermark(event_time, delay)
    if pieces > 1:
        timed = (timed.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(pieces)))
                 .dropDuplicatesWithinWatermark([*keys, "_piece"]).drop("_piece"))
    return timed.dropDuplicatesWithinWatermark(list(keys))


def part_of(keys: Sequence[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("string")


def batch_log(stream: DataFrame, store: Levels, checkpoint: str, run: str, continuous: bool) -> StreamingQuery:
    """Add each batch, reduced by itself, to a levelled store; a repeated batch changes nothing."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: store.add(batch, run, number)).option("checkpointLocation", checkpoint)
    return triggered(writer, continuous).start()


def any_store(spark: SparkSession, root: str, keys: Sequence[str], parts: int = PARTS) -> Levels:
    return Levels(spark, root, lambda df: keep_any(df, keys), part_of(keys, parts))


def latest_store(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], parts: int = PARTS) -> Levels:
    return Levels(spark, root, lambda df: keep_latest(df, keys, order), part_of(keys, parts))


def any_log(stream: DataFrame, keys: Sequence[str], root: str, checkpoint: str,
            run: str = "any", continuous: bool = False, parts: int = PARTS) -> StreamingQuery:
    """Add each batch's rows, one per key, to the store under ``root``; no row is ever too late."""
    return batch_log(stream, any_store(stream.sparkSession, root, keys, parts), checkpoint, run, continuous)


def current_any(spark: SparkSession, root: str, keys: Sequence[str]) -> DataFrame:
    """One row per key over all batches, the same as without a stream."""
    return any_store(spark, root, keys).current()


def latest_log(stream: DataFrame, keys: Sequence[str], order: Sequence[str], root: str, checkpoint: str,
               run: str = "latest", continuous: bool = False, parts: int = PARTS) -> StreamingQuery:
    """Add each batch's latest rows to the store under ``root``."""
    return batch_log(stream, latest_store(stream.sparkSession, root, keys, order, parts), checkpoint, run, continuous)


def current(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The latest row per key over all batches."""
    return latest_store(spark, root, keys, order).current()


def compact(spark: SparkSession, root: str, keys: Sequence[str], order: Sequence[str], target: str, parts: int = PARTS) -> None:
    """Write the current rows as the first batch of a new store."""
    latest_store(spark, target, keys, order, parts).add(current(spark, root, keys, order), "base", 0)
