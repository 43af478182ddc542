"""Object-store listings, multi-source scans and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.classify import azure_blob_type, blob_tags, is_data_file, suffix
from cairn.schema import as_assets

# Filters per platform are fixed values.
PLATFORMS = ["gcs", "azure", "ceph"]
MIN_GCS_BYTES = 1024


def capped(listing: DataFrame, cap: int | None) -> DataFrame:
    """The first `cap` keys of each bucket.

    The row_number filter is applied inside each scan task first, so a huge bucket is
    shuffled as at most `cap` rows per task.
    """
    if cap is None:
        return listing
    w = Window.partitionBy("bucket").orderBy("key")
    return listing.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= cap).drop("_rn")


def object_assets(listing: DataFrame, platform: str, cap: int | None = None, endpoint: str = "store") -> DataFrame:
    """Bucket assets and object assets of a listing (bucket, key, size, modified_date).

    Everything is listed unless a cap of objects per bucket is asked for: gcs caps before its
    size filter, azure after its data-file filter, ceph before it.
    """
    if platform not in PLATFORMS:
        raise ValueError(f"unknown platform {platform!r}; known: {sorted(PLATFORMS)}")
    base = F.regexp_extract("key", r"([^/]*)$", 1)
    if platform == "gcs":
        found = capped(listing, cap).filter(F.col("size") > MIN_GCS_BYTES)
        ext = F.lower(suffix("key"))
        name, type_ = F.concat_ws("/", "bucket", "key"), F.lit("gcs_object")
        source, prefix = "gcp_cloud_storage", F.lit("gs://")
        tags = F.array(
            F.lit("gcp"), F.lit("cloud_storage"), F.lit("object"), F.when(ext != "", ext).otherwise("file")
        )
        bucket_type = "gcs_bucket"
    elif platform == "azure":
        found = capped(listing.filter(is_data_file("key")), cap)
        name, type_ = base, azure_blob_type("key")
        source, prefix = "azure_blob_storage", F.lit(f"https://{endpoint}.blob.core.windows.net/")
        tags = F.concat(F.array(F.lit("azure"), F.lit("blob_storage"), F.lit("blob")), blob_tags("key"))
        bucket_type = "azure_blob_container"
    else:
        found = capped(listing, cap).filter(is_data_file("key"))
        name, type_ = base, F.lit("ceph_object")
        source, prefix = "ceph", F.lit(f"ceph://{endpoint}/")
        tags = F.array().cast("array<string>")
        bucket_type = "ceph_bucket"
    objects = found.select(
        name.alias("name"),
        type_.alias("type"),
        F.concat(prefix, "bucket", F.lit("/"), "key").alias("location"),
        "size",
        F.col("modified_date").alias("created_date"),
        "modified_date",
        tags.alias("tags"),
    )
    if platform == "ceph":
        sized = bucket_rollup(listing, cap).select("bucket", F.col("total_size").alias("size"))
    else:
        sized = listing.select("bucket", F.lit(0).cast("bigint").alias("size")).distinct()
    buckets = sized.select(
        F.col("bucket").alias("name"),
        F.lit(bucket_type).alias("type"),
        F.concat(prefix, "bucket").alias("location"),
        "size",
    )
    return as_assets(
        buckets.unionByName(objects, allowMissingColumns=True).withColumn("source", F.lit(source))
    )


def bucket_rollup(listing: DataFrame, cap: int | None = None) -> DataFrame:
    """Bytes and objects per bucket over the listed objects, data files or not."""
    return capped(listing, cap).groupBy("bucket").agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"), F.count("*").alias("object_count")
    )


def scan_all(sources: dict[str, DataFrame | None], wanted: list[str] | None = None) -> DataFrame:
    """Assets of all (wanted) connectors with the connector's name.

    An unknown connector is skipped; one that failed to list is passed as None and yields
    nothing.
    """
    picked = {k: v for k, v in sources.items() if wanted is None or k in wanted}
    frames = [as_assets(v).withColumn("connector", F.lit(k)) for k, v in picked.items() if v is not None]
    if not frames:
        raise ValueError("no connector produced a listing")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Assets per connector and in total (connector null), in one rollup."""
    return scanned.rollup("connector").agg(F.count("*").alias("assets")).select(
        F.coalesce("connector", F.lit("total")).alias("connector"), "assets"
    )
