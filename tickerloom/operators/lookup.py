"""Joins of a fact table with a table that has one row per key.

``lookup_join`` measures the lookup side and broadcasts it only if it is small.  Otherwise both sides are
shuffled, and keys that hold too many rows are split: by adaptive execution, which knows their size from the
shuffle itself, or, where that is off (as in streams), by ``skew_join``, which counts the facts first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickerloom.session import settle

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MIN_PIECE_ROWS = 100_000


def _hashable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _hashable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_hashable(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows: eight bytes per fixed-width value, text and nested by length."""
    width = F.lit(16)
    for field in df.schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(field.name)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            size = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            size = F.lit(8)
        width = width + F.coalesce(size, F.lit(0)) + 8
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def splits_large_partitions(df: DataFrame) -> bool:
    """Whether the session splits partitions of a shuffled join that are far larger than the others."""
    conf = df.sparkSession.conf
    return all(conf.get(f"spark.sql.adaptive.{name}").lower() == "true" for name in ("enabled", "skewJoin.enabled"))


def lookup_join(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left",
                max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` with ``lookup``, which is computed once and measured first.

    ``facts`` are computed once too, but with a large lookup where adaptive execution is off.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"{how}: every row of the result must belong to a row of facts")
    lookup = settle(lookup)
    return _joined(facts, lookup, on, how, measured_bytes(lookup) <= max_bytes)


def _joined(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, small: bool) -> DataFrame:
    if small:
        return facts.join(F.broadcast(lookup), list(on), how)
    if splits_large_partitions(facts):
        return facts.join(lookup, list(on), how)
    return skew_join(facts, lookup, on, how)


def split_by(facts: DataFrame, lookup: DataFrame, on: Sequence[str], max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows of ``facts`` that have their key in ``lookup``, and the others.  ``lookup`` is computed once and measured first."""
    lookup = settle(lookup)
    small = measured_bytes(lookup) <= max_bytes
    return _joined(facts, lookup, on, "left_semi", small), _joined(facts, lookup, on, "left_anti", small)


def _spread(df: DataFrame, pieces: Column) -> Column:
    """Number of the piece a row belongs to, the same on every attempt of a task.

    Copies of a row hash alike, so the number of the partition is mixed in: only copies
    within one partition, whose size is bounded, stay together.
    """
    columns = [f.name for f in df.schema if _hashable(f.dataType)]
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), pieces.cast("long"))


def skew_join(facts: DataFrame, other: DataFrame, on: Sequence[str], how: str = "left",
              pieces: int | None = None, min_rows: int = MIN_PIECE_ROWS) -> DataFrame:
    """Shuffled equi join in which no key brings more than ``1/pieces`` of ``facts`` into one task.

    Keys of up to ``min_rows`` rows are left alone.  A larger key is cut into numbered pieces,
    and its rows in ``other`` are repeated once per piece.  At most ``pieces`` keys can be that
    large, so the table of large keys is bounded whatever the data, and so are the repeated
    rows of a lookup.
    """
    on = list(on)
    if pieces is None:
        pieces = 4 * int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    has_key = F.lit(True)
    for c in on:
        has_key = has_key & F.col(c).isNotNull()
    counts = settle(facts.filter(has_key).groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
                    .filter(F.col("_rows") > min_rows))
    limit = max(min_rows, -(-(counts.agg(F.sum("_rows")).first()[0] or 0) // pieces))
    large = counts.filter(F.col("_rows") > limit).select(*on, F.ceil(F.col("_rows") / limit).alias("_pieces"))

    # Rows without a key match nothing; they are spread over all pieces.
    share = F.when(has_key, F.coalesce("_pieces", F.lit(1))).otherwise(F.lit(pieces))
    cut = facts.withColumn("_spread", _spread(facts, F.lit(2**31)))
    left = (cut.join(F.broadcast(large), on, "left")
            .withColumn("_piece", F.pmod(F.col("_spread"), share.cast("long")))
            .drop("_pieces", "_spread"))
    right = (other.join(F.broadcast(large), on, "left")
             .withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"),
                                                        F.coalesce("_pieces", F.lit(1)).cast("long") - 1)))
             .drop("_pieces"))
    return left.join(right, [*on, "_piece"], how).drop("_piece")
