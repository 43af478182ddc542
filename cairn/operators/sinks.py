"""Writing the catalog: exports and lineage bundles; versioned tables are in `snapshots`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators.search import newest_first


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return df.select(
        *[
            F.to_json(c.name).alias(c.name)
            if isinstance(c.dataType, (T.ArrayType, T.MapType, T.StructType))
            else F.col(c.name)
            for c in df.schema.fields
        ]
    )


def export_catalog(
    assets: DataFrame, path: str, fmt: str = "json", limit: int | None = None, compression: str = "none"
) -> None:
    """Active assets, newest first, as JSON lines or CSV with a header, plain or packed by one of Spark's codecs.

    Without a limit the sort is a distributed range sort and every task writes its own file.
    """
    active = newest_first(assets.filter("is_active"))
    if limit is not None:
        active = active.limit(limit)
    if fmt == "json":
        active.write.option("compression", compression).json(path)
    elif fmt == "csv":
        flattened(active).write.options(header=True, escape='"', compression=compression).csv(path)
    else:
        raise ValueError("format is json or csv")


def lineage_bundle(nodes: DataFrame, edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Nodes, edges and column edges as rows (target_id, kind, body).

    One record per row rather than one document per target: a target with millions of edges
    still spreads over many tasks and files.
    """

    def part(df: DataFrame, kind: str) -> DataFrame:
        body = [c for c in df.columns if c != "target_id"]
        return df.select("target_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*body)).alias("body"))

    return part(nodes, "node").unionByName(part(edges, "edge")).unionByName(part(columns, "column"))


def export_lineage(nodes: DataFrame, edges: DataFrame, columns: DataFrame, path: str) -> None:
    """Lineage bundle as JSON lines, one folder per record kind."""
    lineage_bundle(nodes, edges, columns).write.partitionBy("kind").json(path)
