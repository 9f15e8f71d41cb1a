"""Checking a parsed message against its shape, and bringing it into that shape.

Types are those the feeds' consumers accept: text must be a JSON string; a number may
also come as numeric text or as a boolean; a whole number may have a zero fraction.  Keys
that the shape does not name are ignored.  One bad element makes the whole message bad.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from tickerloom.functions.payload import key_path

# Numbers written as text.
DECIMAL_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"
WHOLE_TEXT = r"^\s*[+-]?\d+(\.0*)?\s*$"


def wire_name(field: T.StructField) -> str:
    return field.metadata.get("alias", field.name)


def _step(path: str, field: T.StructField) -> str:
    """The path of a field.  Whole paths are read from the message, so that no part of it is copied."""
    return path + key_path(wire_name(field))[1:]


def _whole(value: Column, path: str, dtype: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    from_text = F.trim(F.regexp_replace(F.try_variant_get(value, path, "string"), r"\.0*\s*$", "")).try_cast(dtype)
    return F.when(kind == "STRING", from_text).otherwise(F.try_variant_get(value, path, dtype))


def conforms(value: Column, dtype: T.DataType, path: str = "$") -> Column:
    """Whether the VARIANT has the given shape at the path.  Never NULL."""
    def read(as_type: str) -> Column:
        return F.try_variant_get(value, path, as_type)

    if isinstance(dtype, T.StructType):
        ok = F.lit(True)
        for field in dtype:
            ok = ok & field_conforms(value, field, path)
        return ok
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(F.forall(read("array<variant>"), lambda x: conforms(x, dtype.elementType)), F.lit(False))
    if isinstance(dtype, T.MapType):
        values = F.map_values(read("map<string,variant>"))
        return F.coalesce(F.forall(values, lambda x: conforms(x, dtype.valueType)), F.lit(False))
    if isinstance(dtype, T.VariantType):
        return read("variant").isNotNull()

    kind = F.schema_of_variant(read("variant"))
    if isinstance(dtype, T.StringType):
        ok = kind == "STRING"
    elif isinstance(dtype, T.DoubleType):
        ok = (F.when(kind == "STRING", read("string").rlike(DECIMAL_TEXT))
              .otherwise(kind.rlike("^(DECIMAL|BIGINT|DOUBLE|FLOAT|BOOLEAN)")))
    elif isinstance(dtype, (T.LongType, T.IntegerType)):
        ok = (F.when(kind.isin("BIGINT", "BOOLEAN"), read(dtype.simpleString()).isNotNull())
              .when(kind == "STRING", read("string").rlike(WHOLE_TEXT)
                    & _whole(value, path, dtype.simpleString()).isNotNull())
              .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), (read("double") == F.floor(read("double")))
                    & read(dtype.simpleString()).isNotNull()))
    else:
        raise TypeError(f"no rule for {dtype.simpleString()}")
    return F.coalesce(ok, F.lit(False))


def field_conforms(value: Column, field: T.StructField, path: str = "$") -> Column:
    here = _step(path, field)
    ok = conforms(value, field.dataType, here)
    if "default" in field.metadata:
        return ok | F.try_variant_get(value, here, "variant").isNull()
    if field.nullable:
        return ok | F.coalesce(F.is_variant_null(F.try_variant_get(value, here, "variant")), F.lit(False))
    return ok


def first_fault(value: Column, shape: T.StructType) -> Column:
    """Name of the first top-level key that breaks the shape, NULL when none does."""
    return F.coalesce(*[F.when(~field_conforms(value, f), F.lit(wire_name(f))) for f in shape])


def _all_text(dtype: T.DataType) -> bool:
    """Whether one typed read gives the value: only text, under its own names."""
    if isinstance(dtype, T.ArrayType):
        return _all_text(dtype.elementType)
    if isinstance(dtype, T.MapType):
        return _all_text(dtype.valueType)
    if isinstance(dtype, T.StructType):
        return all(_all_text(f.dataType) and not f.metadata for f in dtype)
    return isinstance(dtype, T.StringType)


def shaped(value: Column, dtype: T.DataType, path: str = "$") -> Column:
    """The value at the path, which conforms, as a typed column under our names."""
    if _all_text(dtype) or isinstance(dtype, T.DoubleType):
        return F.try_variant_get(value, path, dtype.simpleString())
    if isinstance(dtype, (T.LongType, T.IntegerType)):
        return _whole(value, path, dtype.simpleString())
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(value, path, "variant")
    if isinstance(dtype, T.ArrayType):
        return F.transform(F.try_variant_get(value, path, "array<variant>"), lambda x: shaped(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(F.try_variant_get(value, path, "map<string,variant>"),
                                  lambda _, x: shaped(x, dtype.valueType))
    fields = []
    for field in dtype:
        inner = shaped(value, field.dataType, _step(path, field))
        if "default" in field.metadata:
            inner = F.coalesce(inner, F.array().cast(field.dataType))
        fields.append(inner.alias(field.name))
    return F.struct(*fields)
