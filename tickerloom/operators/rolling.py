"""Statistics over the last ``n`` rows of each series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom import names
from tickerloom.operators.lookup import lookup_join
from tickerloom.session import settle

BLOCK_ROWS = 100_000


def latest_trailing(df: DataFrame, key: str, order: str, value: str,
                    n: int = names.BASELINE_ROWS) -> DataFrame:
    """Per key the newest value with mean and sample deviation of the newest ``n`` rows.

    Equal to trailing frames over the whole series cut to the newest row, but each task
    sends on at most ``n`` rows per key.  ``order`` must be unique within a key; a missing one is the newest.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_first())
    recent = (df.select(key, order, value)
              .withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n))
    return recent.groupBy(key).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(value))).alias("latest"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("deviation"),
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row number within each key, ``_pos`` from 0, without bringing a key into one task.

    Rows are range-partitioned over keys and order together, so a large key lies on many
    partitions.  The number is the offset of the partition within the key plus the place in
    the partition.  ``order`` must be unique within a key.
    """
    keys, order = list(keys), list(order)
    df = df.withColumn("_key", F.struct(*keys))  # as one value, a missing part equals a missing part
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = (df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
              .withColumn("_place", F.monotonically_increasing_id())
              .withColumn("_part", F.spark_partition_id()))
    spread = settle(spread)  # the same places for both uses below
    chunks = spread.groupBy("_key", "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(
        "_key", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (lookup_join(spread, offsets, ["_key", "_part"])
            .withColumn("_pos", F.col("_place") + F.col("_shift"))
            .drop("_key", "_place", "_part", "_shift"))


def trailing_stats(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   n: int = names.BASELINE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``mean`` and ``deviation`` over each row and up to ``n - 1`` before it.

    Each series is cut into blocks of ``block_rows``; the last ``n - 1`` rows of a block are
    handed on to the next, where they only complete the frames.
    """
    keys = list(keys)
    placed = with_position(df, keys, order)
    block = F.floor(F.col("_pos") / block_rows)
    ends_block = F.pmod(F.col("_pos"), F.lit(block_rows)) >= block_rows - (n - 1)
    copies = F.when(ends_block, F.array(block, block + 1)).otherwise(F.array(block))
    blocked = placed.withColumn("_home", block).withColumn("_block", F.explode(copies))
    frame = (Window.partitionBy(*keys, "_block").orderBy("_pos").rowsBetween(-(n - 1), Window.currentRow))
    return (blocked
            .withColumn("mean", F.avg(value).over(frame))
            .withColumn("deviation", F.stddev_samp(value).over(frame))
            .filter("_home = _block")
            .drop("_pos", "_home", "_block"))
