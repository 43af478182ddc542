"""Fixed schemas of the catalog tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN = T.StructType(
    [
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("mode", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("primary_key", T.BooleanType()),
        T.StructField("default", T.StringType()),
        T.StructField("max_length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
    ]
)

ASSETS = T.StructType(
    [
        T.StructField("fingerprint", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("location", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("created_date", T.TimestampType()),
        T.StructField("modified_date", T.TimestampType()),
        T.StructField("discovered_date", T.TimestampType()),
        T.StructField("last_scanned", T.TimestampType()),
        T.StructField("columns", T.ArrayType(COLUMN)),
        T.StructField("num_rows", T.LongType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("is_active", T.BooleanType()),
    ]
)

HISTORY = T.StructType(
    [
        T.StructField("asset_fingerprint", T.StringType()),
        T.StructField("change_type", T.StringType()),
        T.StructField("change_date", T.TimestampType()),
        T.StructField("old_values", T.StringType()),
        T.StructField("new_values", T.StringType()),
    ]
)

RELATIONSHIPS = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("source_asset", T.StringType()),
        T.StructField("target_asset", T.StringType()),
        T.StructField("relationship_type", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)


def column_struct(**given: Column) -> Column:
    """A column descriptor with every field of COLUMN; absent ones are null."""
    return F.struct(
        *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in COLUMN.fields]
    )


def as_assets(df: DataFrame) -> DataFrame:
    """Project any listing onto the asset schema; absent columns become null.

    A single narrow projection, so it never costs a shuffle.  is_active defaults
    to true, size to 0.
    """
    have = set(df.columns)
    out = []
    for f in ASSETS.fields:
        col = F.col(f.name) if f.name in have else F.lit(None)
        if f.name == "is_active":
            col = F.coalesce(col.cast("boolean"), F.lit(True))
        if f.name == "size":
            col = F.coalesce(col.cast("bigint"), F.lit(0))
        out.append(col.cast(f.dataType).alias(f.name))
    return df.select(*out)


def columns_long(assets: DataFrame) -> DataFrame:
    """One row per column.  Explode is narrow, so no data moves between executors."""
    return assets.select(
        "fingerprint",
        F.col("name").alias("asset_name"),
        F.col("type").alias("asset_type"),
        "source",
        F.explode("columns").alias("c"),
    ).select(
        "fingerprint",
        "asset_name",
        "asset_type",
        "source",
        F.col("c.ordinal").alias("ordinal"),
        F.col("c.name").alias("column_name"),
        F.col("c.type").alias("column_type"),
        F.coalesce("c.mode", F.when(F.col("c.nullable") == F.lit(False), "REQUIRED").otherwise("NULLABLE")).alias(
            "mode"
        ),
        F.col("c.description").alias("description"),
        F.coalesce("c.nullable", F.coalesce("c.mode", F.lit("NULLABLE")) == "NULLABLE").alias("nullable"),
    )
