"""Masking of secrets held in maps, columns and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import rules
from cairn.functions.expr import ColumnLike, col, has_any


def mask_value(value: ColumnLike) -> Column:
    v = col(value)
    n = F.length(v)
    return F.when(
        n > 8,
        F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(v, -4, 4)),
    ).otherwise("***")


def mask_map(column: ColumnLike, keys: list[str] | None = None) -> Column:
    """Mask the values whose key names a secret, in a map<string,string>."""
    keys = keys or rules.SENSITIVE_KEYS
    return F.transform_values(
        col(column), lambda k, v: F.when(has_any(F.lower(k), keys), mask_value(v)).otherwise(v)
    )


def _masked(column: Column, name: str, dtype: T.DataType, keys: list[str]) -> Column:
    if any(k in name.lower() for k in keys):
        return mask_value(column) if isinstance(dtype, T.StringType) else F.lit("***")
    if isinstance(dtype, T.StructType):
        return F.when(
            column.isNotNull(),
            F.struct(*[_masked(column[f.name], f.name, f.dataType, keys).alias(f.name) for f in dtype.fields]),
        )
    if isinstance(dtype, T.MapType) and isinstance(dtype.keyType, T.StringType):
        if isinstance(dtype.valueType, T.StringType):
            return mask_map(column, keys)
        if isinstance(dtype.valueType, T.MapType):
            return F.transform_values(column, lambda k, v: _masked(v, "", dtype.valueType, keys))
    return column


def mask_columns(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mask every column, struct field and map entry whose name holds a secret word."""
    keys = keys or rules.SENSITIVE_KEYS
    return df.select(*[_masked(df[f.name], f.name, f.dataType, keys).alias(f.name) for f in df.schema.fields])
