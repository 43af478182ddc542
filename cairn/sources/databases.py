"""Assets from the metadata tables of databases and warehouses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.expr import text
from cairn.operators.maintenance import moment
from cairn.schema import as_assets, column_struct

# fixed values
SYSTEM_SCHEMAS = ["information_schema", "pg_catalog", "pg_toast"]
SYSTEM_CATALOGS = ["system", "information_schema"]
ORACLE_BLOCK = 8192
BYTES_PER_CELL = 50


def read_information_schema(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """A metadata table (or bracketed query) of a database, over JDBC."""
    return spark.read.jdbc(url=url, table=table, properties=properties or {})


def column_arrays(columns: DataFrame, keys: list[str]) -> DataFrame:
    """One row per table with its columns in ordinal order.

    `columns` has the keys, ordinal, column_name, data_type and any of nullable, default,
    max_length, precision, scale, primary_key, description.  A table's width bounds its array.
    """
    optional = {
        n: F.col(n)
        for n in ("nullable", "default", "max_length", "precision", "scale", "primary_key", "description")
        if n in columns.columns
    }
    entry = column_struct(ordinal=F.col("ordinal"), name=F.col("column_name"), type=F.col("data_type"), **optional)
    return columns.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("columns"))


def _with_columns(tables: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    joined = tables.join(column_arrays(columns, keys), keys, "left")
    return joined.withColumn("width", F.greatest(F.coalesce(F.size("columns"), F.lit(0)), F.lit(0)))


def postgresql_assets(
    tables: DataFrame,
    views: DataFrame,
    columns: DataFrame,
    counts: DataFrame | None,
    base: str,
    as_of: str | Column,
) -> DataFrame:
    """Tables and views of user schemas; size is guessed from counted rows and width.

    tables/views: schema_name, table_name.  counts: schema_name, table_name, row_count.
    base: location prefix such as `postgresql://host:5432/db`.
    """
    keys = ["schema_name", "table_name"]
    both = tables.select(*keys, F.lit("table").alias("object_type")).unionAll(
        views.select(*keys, F.lit("view").alias("object_type"))
    )
    both = both.filter(~F.col("schema_name").isin(SYSTEM_SCHEMAS))
    t = _with_columns(both, columns, keys)
    if counts is not None:
        t = t.join(counts, keys, "left")
    rows = F.when(F.col("object_type") == "table", F.coalesce("row_count", F.lit(0))).otherwise(0)
    if counts is None:
        rows = F.lit(0)
    now = moment(as_of)
    return as_assets(
        t.select(
            F.concat_ws(".", *keys).alias("name"),
            F.concat(F.lit("postgresql_"), "object_type").alias("type"),
            F.lit("postgresql").alias("source"),
            F.concat_ws("/", F.lit(base), *keys).alias("location"),
            F.when(rows > 0, rows * F.col("width") * BYTES_PER_CELL).otherwise(0).cast("bigint").alias("size"),
            now.alias("created_date"),
            now.alias("modified_date"),
            "columns",
            rows.cast("bigint").alias("num_rows"),
            F.array(F.lit("postgresql"), F.lit("database"), "object_type", "schema_name").alias("tags"),
            F.create_map(
                F.lit("object_type"), F.col("object_type"), F.lit("column_count"), F.col("width").cast("string")
            ).alias("metadata"),
        )
    )


def mysql_assets(tables: DataFrame, columns: DataFrame, base: str, as_of: str | Column) -> DataFrame:
    """tables: table_name, table_type, table_rows, data_length, create_time, update_time."""
    t = _with_columns(tables, columns, ["table_name"])
    kind = F.when(F.col("table_type") == "VIEW", "view").otherwise("table")
    rows, size = F.coalesce("table_rows", F.lit(0)), F.coalesce("data_length", F.lit(0))
    now = moment(as_of)
    return as_assets(
        t.select(
            F.col("table_name").alias("name"),
            F.concat(F.lit("mysql_"), kind).alias("type"),
            F.lit("mysql").alias("source"),
            F.concat(F.lit(base + "/"), "table_name").alias("location"),
            size.cast("bigint").alias("size"),
            F.coalesce(F.col("create_time").cast("timestamp"), now).alias("created_date"),
            F.coalesce(F.col("update_time").cast("timestamp"), now).alias("modified_date"),
            "columns",
            rows.cast("bigint").alias("num_rows"),
            F.array(F.lit("mysql"), F.lit("database"), kind).alias("tags"),
            F.create_map(F.lit("object_type"), kind, F.lit("column_count"), F.col("width").cast("string")).alias(
                "metadata"
            ),
        )
    )


def oracle_assets(
    tables: DataFrame, views: DataFrame, columns: DataFrame, base: str, as_of: str | Column
) -> DataFrame:
    """tables: table_name, tablespace_name, num_rows, blocks, last_analyzed; views: view_name, text."""
    now = moment(as_of)
    t = tables.select(
        "table_name",
        F.lit("table").alias("kind"),
        F.coalesce("num_rows", F.lit(0)).cast("bigint").alias("num_rows"),
        (F.coalesce("blocks", F.lit(0)) * ORACLE_BLOCK).cast("bigint").alias("size"),
        F.coalesce(F.col("last_analyzed").cast("timestamp"), now).alias("modified_date"),
        F.create_map(F.lit("tablespace"), F.col("tablespace_name")).alias("metadata"),
    )
    v = views.select(
        F.col("view_name").alias("table_name"),
        F.lit("view").alias("kind"),
        F.lit(None).cast("bigint").alias("num_rows"),
        F.lit(0).cast("bigint").alias("size"),
        now.alias("modified_date"),
        F.create_map(F.lit("view_text"), text("text")).alias("metadata"),
    )
    both = _with_columns(t.unionByName(v), columns, ["table_name"])
    return as_assets(
        both.select(
            F.col("table_name").alias("name"),
            F.concat(F.lit("oracle_"), "kind").alias("type"),
            F.lit("oracle").alias("source"),
            F.concat(F.lit(base + "/"), "table_name").alias("location"),
            "size",
            now.alias("created_date"),
            "modified_date",
            "columns",
            "num_rows",
            F.array(F.lit("oracle"), F.lit("database"), "kind").alias("tags"),
            "metadata",
        )
    )


def hierarchy_assets(
    schemata: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    platform: str,
    base: str,
    as_of: str | Column,
    levels: tuple[str, str] = ("catalog", "schema"),
) -> DataFrame:
    """One asset per catalog, per schema and per table; system catalogs are left out.

    schemata: catalog_name, schema_name.  tables: catalog_name, schema_name, table_name,
    table_type.  columns: the same keys and column fields.  Each catalog appears once.
    """
    now = moment(as_of)
    user = lambda df: df.filter(~F.col("catalog_name").isin(SYSTEM_CATALOGS))
    stamp = lambda df: df.withColumns({"source": F.lit(platform), "created_date": now, "modified_date": now})
    catalogs = (
        user(schemata)
        .select("catalog_name")
        .distinct()
        .select(
            F.col("catalog_name").alias("name"),
            F.lit(f"{platform}_{levels[0]}").alias("type"),
            F.concat_ws("/", F.lit(base), "catalog_name").alias("location"),
            F.array(F.lit(platform), F.lit(levels[0])).alias("tags"),
        )
    )
    schemas = user(schemata).select(
        F.concat_ws(".", "catalog_name", "schema_name").alias("name"),
        F.lit(f"{platform}_{levels[1]}").alias("type"),
        F.concat_ws("/", F.lit(base), "catalog_name", "schema_name").alias("location"),
        F.array(F.lit(platform), F.lit(levels[1])).alias("tags"),
    )
    keys = ["catalog_name", "schema_name", "table_name"]
    leaves = _with_columns(user(tables), columns, keys).select(
        F.concat_ws(".", *keys).alias("name"),
        F.concat(F.lit(f"{platform}_"), F.lower("table_type")).alias("type"),
        F.concat_ws("/", F.lit(base), *keys).alias("location"),
        F.array(F.lit(platform), F.lower("table_type")).alias("tags"),
        "columns",
    )
    return as_assets(
        stamp(catalogs.unionByName(schemas).unionByName(leaves, allowMissingColumns=True))
    )


def assets_from_information_schema(dialect: str, **inputs) -> DataFrame:
    """Entry by dialect: postgresql, mysql or oracle."""
    makers = {"postgresql": postgresql_assets, "mysql": mysql_assets, "oracle": oracle_assets}
    if dialect not in makers:
        raise ValueError(f"unknown dialect {dialect!r}; known: {sorted(makers)}")
    return makers[dialect](**inputs)
