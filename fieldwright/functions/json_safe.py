"""Records as JSON in which no amount becomes a floating-point number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def decimals_as_text(value: Column, kind: T.DataType) -> Column:
    """The value with each decimal in it, at any depth, as text; `kind` is its type. Nulls stay null."""
    if isinstance(kind, T.DecimalType):
        return value.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: decimals_as_text(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: decimals_as_text(x, kind.valueType))
    if isinstance(kind, T.StructType):
        parts = F.struct(*[decimals_as_text(value.getField(f.name), f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), parts)
    return value


def json_safe(value: Column, kind: T.DataType) -> Column:
    """JSON text of a record; fields that are null are written as null."""
    return F.to_json(decimals_as_text(value, kind), {"ignoreNullFields": "false"})
