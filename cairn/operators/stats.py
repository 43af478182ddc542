"""Catalog statistics, health and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn import rules
from cairn.functions.expr import days_between
from cairn.functions.pii import pii_categories
from cairn.operators.maintenance import moment


def catalog_statistics(assets: DataFrame, as_of: str | Column) -> DataFrame:
    """Totals, per type and per source in one GROUPING SETS pass.

    Rows are (scope, key, assets, bytes, recent) with scope total, type or source;
    recent counts discoveries of the last seven days.
    """
    active = assets.filter("is_active").select(
        "type",
        "source",
        F.coalesce("size", F.lit(0)).alias("size"),
        (F.col("discovered_date") >= moment(as_of) - F.make_dt_interval(days=F.lit(7))).alias("fresh"),
    )
    grouped = active.groupingSets([[], ["type"], ["source"]], "type", "source").agg(
        F.count("*").alias("assets"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
        F.count_if("fresh").alias("recent"),
        F.grouping("type").alias("gt"),
        F.grouping("source").alias("gs"),
    )
    scope = F.when(F.col("gt") == 0, "type").when(F.col("gs") == 0, "source").otherwise("total")
    key = F.when(F.col("gt") == 0, F.col("type")).when(F.col("gs") == 0, F.col("source")).otherwise("")
    return grouped.select(scope.alias("scope"), key.alias("key"), "assets", "bytes", "recent")


def inventory(assets: DataFrame) -> DataFrame:
    """Counts only: total, per type, per source."""
    return catalog_statistics(assets, F.lit("1970-01-01").cast("timestamp")).select("scope", "key", "assets")


def discovered_today(assets: DataFrame, as_of: str | Column) -> DataFrame:
    """How many active assets were discovered less than one day ago."""
    return assets.filter("is_active").agg(
        F.count_if(days_between(moment(as_of), "discovered_date") < 1).alias("discovered_today")
    )


def connector_health(status: DataFrame) -> DataFrame:
    connected = F.count_if("connected")
    return status.agg(
        F.count("*").alias("total_connectors"),
        connected.alias("connected_connectors"),
        F.count_if(F.col("enabled") & F.col("connected")).alias("active_connectors"),
        F.when(connected > 0, "healthy").otherwise("degraded").alias("status"),
    )


def connectors_by_category(status: DataFrame) -> DataFrame:
    """Connectors per fixed category (empty ones as 0); anything else counts under `other`."""
    fixed = rules.CONNECTOR_CATEGORIES
    named = F.when(F.col("category").isin(fixed), F.col("category")).otherwise("other")
    counted = status.groupBy(named.alias("category")).agg(F.count("*").alias("connectors"))
    spark = status.sparkSession
    frame = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in fixed])).alias("category"))
    return frame.join(counted, "category", "full_outer").select(
        "category", F.coalesce("connectors", F.lit(0)).cast("bigint").alias("connectors")
    )


def facets(assets: DataFrame) -> DataFrame:
    """(facet, value, assets) for type and source, ascending."""
    pairs = F.array(
        F.struct(F.lit("source").alias("facet"), F.col("source").alias("value")),
        F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")),
    )
    return (
        assets.select(F.explode(pairs).alias("p"))
        .groupBy("p.facet", "p.value")
        .agg(F.count("*").alias("assets"))
        .orderBy("facet", "value")
    )


def _profiled_columns() -> Column:
    return F.transform(
        "columns",
        lambda c: F.struct(
            c["name"].alias("name"),
            F.coalesce(c["type"], F.lit("unknown")).alias("type"),
            F.coalesce(c["mode"], F.when(c["nullable"] == F.lit(False), "REQUIRED").otherwise("NULLABLE")).alias("mode"),
            pii_categories(c["name"]).alias("pii"),
        ),
    )


def _shares(types: str) -> Column:
    """(type, count, percentage) of an array of type names, percentages half-even to one decimal."""
    kinds = F.array_sort(F.array_distinct(types))

    def share(k: Column) -> Column:
        n = F.size(F.filter(types, lambda t: t == k))
        return F.struct(
            k.alias("type"), n.alias("count"), F.bround(n / F.size(types) * 100, 1).alias("percentage")
        )

    return F.transform(kinds, share)


def profile_assets(assets: DataFrame) -> DataFrame:
    """Column profile of every asset with columns.

    Works on the columns array inside the row: no explode, no shuffle.  Returns counts, the
    type distribution (type, count, percentage), PII columns and distinct PII types.
    """
    held = F.col("columns").isNotNull()
    base = assets.filter(held).select("fingerprint", "num_rows", _profiled_columns().alias("cols"))
    base = base.withColumn("types", F.transform("cols", lambda c: c["type"]))
    with_pii = F.filter("cols", lambda c: F.size(c["pii"]) > 0)
    return base.select(
        "fingerprint",
        F.size("cols").alias("total_columns"),
        F.size(F.filter("cols", lambda c: c["mode"] == "NULLABLE")).alias("nullable_columns"),
        F.coalesce("num_rows", F.lit(0)).alias("estimated_rows"),
        _shares("types").alias("type_distribution"),
        F.transform(with_pii, lambda c: c["name"]).alias("pii_columns"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("cols", lambda c: c["pii"])))).alias("pii_types"),
    )


def type_distribution(assets: DataFrame) -> DataFrame:
    """The type distribution of profile_assets as rows.

    The list is built inside the generator: exploding a column that a projection builds would
    add a filter on it below that projection and build it twice.
    """
    types = F.transform("columns", lambda c: F.coalesce(c["type"], F.lit("unknown")))
    return (
        assets.filter(F.col("columns").isNotNull())
        .select("fingerprint", types.alias("types"))
        .select("fingerprint", F.explode(_shares("types")).alias("t"))
        .select("fingerprint", F.col("t.type").alias("column_type"), F.col("t.count").alias("n"), "t.percentage")
    )


#: Registers of a distinct-count sketch, as a power of two: a standard error of about 1.6 %.
SKETCH_BITS = 12


def _profiled(schema: T.StructType, without: tuple[str, ...] = ()) -> list[tuple[str, str, Column]]:
    """(name, type, value) of every column; arrays, maps and structs count by their text form."""
    return [
        (f.name, f.dataType.simpleString(), F.col(f.name) if _is_atomic(f.dataType) else F.to_json(F.col(f.name)))
        for f in schema.fields
        if f.name not in without
    ]


def _per_column(one: DataFrame, columns: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per column out of the single row of rows, n<i>, d<i>, lo<i> and hi<i>."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("ordinal"),
                F.lit(name).alias("column_name"),
                F.lit(kind).alias("column_type"),
                F.col("rows").alias("row_count"),
                F.col(f"n{i}").alias("nulls"),
                F.col(f"d{i}").alias("distinct_values"),
                F.col(f"lo{i}").cast("string").alias("min_value"),
                F.col(f"hi{i}").cast("string").alias("max_value"),
            )
            for i, (name, kind, _) in enumerate(columns)
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def profile_table(df: DataFrame, exact: bool = False) -> DataFrame:
    """Value profile of any table, one output row per column.

    A single aggregation over the table; distinct counts are approximate unless
    exact=True.  Arrays, maps and structs are profiled by their text form.
    """
    columns = _profiled(df.schema)
    aggs = [F.count("*").alias("rows")]
    for i, (_, _, c) in enumerate(columns):
        distinct = F.count_distinct(c) if exact else F.approx_count_distinct(c)
        aggs += [F.count_if(c.isNull()).alias(f"n{i}"), distinct.alias(f"d{i}"), F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}")]
    return _per_column(df.agg(*aggs), columns)


def profile_sketches(df: DataFrame, *by: str) -> DataFrame:
    """Profiles that can be kept and merged, one row per value of the columns `by` (a file, a day), or one in all.

    Counts, bounds of each column's own type, and its distinct values as a sketch (binary, 4 KB at
    most).  A table that grows is profiled by sketching what is new; see merge_profiles.
    """
    aggs = [F.count("*").alias("rows")]
    for i, (_, _, c) in enumerate(_profiled(df.schema, by)):
        aggs += [
            F.count_if(c.isNull()).alias(f"n{i}"),
            F.hll_sketch_agg(c.cast("string"), SKETCH_BITS).alias(f"d{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
        ]
    return df.groupBy(*by).agg(*aggs)


def merge_profiles(sketches: DataFrame, schema: T.StructType, *by: str) -> DataFrame:
    """profile_table of all rows behind the sketches of profile_sketches(df, *by); schema is that of df.

    All but the distinct counts are exact.  Those are estimates with a standard error of about 1.6 %.
    """
    columns = _profiled(schema, by)
    aggs = [F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")]
    for i in range(len(columns)):
        aggs += [
            F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}"),
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(f"d{i}")), F.lit(0)).alias(f"d{i}"),
            F.min(f"lo{i}").alias(f"lo{i}"),
            F.max(f"hi{i}").alias(f"hi{i}"),
        ]
    return _per_column(sketches.agg(*aggs), columns)


def _is_atomic(dtype) -> bool:
    return not dtype.simpleString().startswith(("array", "map", "struct"))


def avg_confidence(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Mean confidence per target column in whole percent, halves up; 0 without an edge.

    `columns` lists every (target_id, column_name), `edges` the matches with a confidence.
    """
    mean = edges.groupBy("target_id", "column_name").agg(F.avg("confidence").alias("mean"))
    return columns.join(mean, ["target_id", "column_name"], "left").select(
        "target_id",
        "column_name",
        F.coalesce(F.floor(F.round(F.col("mean") * 100, 6) + 0.5), F.lit(0)).cast("bigint").alias("confidence"),
    )


def transformation_counts(transformations: DataFrame) -> DataFrame:
    return transformations.groupBy("type").agg(F.count("*").alias("n"))


def lineage_counts(nodes: DataFrame) -> DataFrame:
    """Per target: upstream, current and downstream nodes and the deepest level."""
    return nodes.groupBy("target_id").agg(
        F.count_if(F.col("level") < 0).alias("upstream"),
        F.count_if(F.col("level") == 0).alias("current"),
        F.count_if(F.col("level") > 0).alias("downstream"),
        F.max(F.abs("level")).alias("max_level"),
    )
