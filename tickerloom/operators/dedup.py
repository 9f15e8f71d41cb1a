"""Removing redelivered records.

Both operators reduce on the map side first: ``keep_latest`` through the row-number
limit that Spark applies before the shuffle, ``keep_any`` through partial aggregation.
However many copies a key has, one task sends on at most one row of it.

Wide rows are better left where they are unless their key has copies: ``split_copies`` tells these
rows from the others by a number per key, which is all that is shuffled for it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tickerloom.operators.lookup import MAX_BROADCAST_BYTES, measured_bytes
from tickerloom.session import settle

KEY = "_key"


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the greatest by ``order``, a missing value counting as greatest.

    Rows that tie on ``order`` are told apart by their remaining columns, so the
    result does not depend on arrival.
    """
    ties = [f.name for f in df.schema
            if f.name not in keys and f.name not in order and _orderable(f.dataType)]
    ranked = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_first() for c in [*order, *ties]])
    return df.withColumn("_rank", F.row_number().over(ranked)).filter("_rank = 1").drop("_rank")


def keep_any(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key where any copy will do.

    Of each remaining column the smallest value is kept, so that re-runs agree.  Meant for
    one remaining column; with more, use :func:`keep_latest` to keep rows together.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    if len(rest) > 1:
        return keep_latest(df, keys, [])
    return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)


def split_copies(df: DataFrame, keys: Sequence[str], max_bytes: int = MAX_BROADCAST_BYTES) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key may have other rows besides, and those whose key surely has none.

    Rows stay in their partitions.  ``df`` is read once more, for the keys alone, and must give the same rows each time.  Keys that
    have copies are found by a number made of them, so that missing values count as equal; two keys of one
    number are both taken to have copies.  Where these are too many to broadcast, all rows may have some: the second part is None.
    """
    numbered = df.withColumn(KEY, F.xxhash64(*keys))
    several = settle(numbered.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select(KEY))
    if measured_bytes(several) > max_bytes:
        return df, None
    several = F.broadcast(several)
    return numbered.join(several, KEY, "left_semi").drop(KEY), numbered.join(several, KEY, "left_anti").drop(KEY)


def keep_latest_wide(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """:func:`keep_latest` for wide rows: only those of keys with copies are shuffled."""
    copies, alone = split_copies(df, keys, max_bytes)
    kept = keep_latest(copies, keys, order)
    return kept if alone is None else alone.unionByName(kept)
