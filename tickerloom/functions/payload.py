"""Reading raw payloads: typed paths out of a semi-structured column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def computed_once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with a column that is costly to compute.

    Filters on a plain column are moved below its projection, which computes it once more
    for the filter.  They are not moved below the unnesting of an array.  The value is computed in the
    projection below it, which is compiled; an unnesting may not be, and would interpret it.
    """
    return df.withColumn("_once", value).withColumn(name, F.explode(F.array("_once"))).drop("_once")


def with_payload(df: DataFrame, column: str = "raw_payload", name: str = "payload") -> DataFrame:
    """``df`` with the column as VARIANT, parsing it where it still is JSON text.

    Text that is not JSON becomes NULL.
    """
    if isinstance(df.schema[column].dataType, T.VariantType):
        return df.withColumn(name, F.col(column))
    return computed_once(df, F.try_parse_json(column), name)


def at(payload: Column, path: str, dtype: str = "string") -> Column:
    """Value at a path; NULL where the path is absent, null, or not of that type."""
    return F.try_variant_get(payload, path, dtype)


def key_path(key: str) -> str:
    return f'$["{key}"]'


def has_key(payload: Column, key: str) -> Column:
    """Whether the object has the key at all, even with a null value."""
    return F.try_variant_get(payload, key_path(key), "variant").isNotNull()


def to_text(value: Column) -> Column:
    """JSON text with nulls kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})
