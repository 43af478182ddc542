"""Continuous discovery and catalog upkeep."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.maintenance import change_log, dedupe_batch, upsert_assets, with_fingerprint
from cairn.operators.snapshots import PARTS, has_files, load_manifest, read_snapshot, update_snapshot
from cairn.schema import ASSETS, HISTORY, as_assets
from cairn.sources.files import FILE_SCHEMA, file_assets


REFRESHED = ["name", "type", "source", "location", "size", "modified_date", "columns", "num_rows", "tags", "metadata"]


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_batch: int | None = None) -> DataFrame:
    """New files under a path as a stream of asset rows; file bytes are not read."""
    reader = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", True)
    )
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    files = reader.load(path).select(
        F.col("path").alias("location"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_date")
    )
    return with_fingerprint(file_assets(files))


def upsert_batch(
    batch: DataFrame,
    batch_id: int,
    root: str,
    order_col: str,
    as_of: Column | None = None,
    stream: str = "main",
    parts: int = PARTS,
) -> None:
    """Fold one micro-batch into the catalog under `root` and into its history.

    Only the parts of the catalog that the batch has keys in are read and written (see snapshots).
    Batch ids of a stream rise; one that the catalog already holds is skipped, so a replay after a failure
    changes nothing.  History goes to a folder of the batch's own, before the commit, and counts once the
    batch is committed.
    """
    spark, assets = batch.sparkSession, f"{root}/assets"
    head = load_manifest(spark, assets)
    if head is not None and batch_id <= head.done.get(stream, -1):
        return
    now = as_of if as_of is not None else F.current_timestamp()
    clean = as_assets(dedupe_batch(with_fingerprint(batch), order_col)).persist()

    def change(current: DataFrame) -> DataFrame:
        log = change_log(current, clean, now)
        log.write.mode("overwrite").parquet(f"{root}/history/stream={stream}/batch={batch_id}")
        return upsert_assets(current, clean, now)

    update_snapshot(clean, assets, change, ASSETS, f"{stream}-{batch_id}", {stream: batch_id}, parts)
    clean.unpersist()


def stream_upsert(
    events: DataFrame, root: str, order_col: str = "seq", as_of: Column | None = None, checkpoint: str | None = None
) -> StreamingQuery:
    """Run the upsert for everything available; `events` are asset rows with an order column.

    Streams with checkpoints of their own may share a root: each is named by its checkpoint.
    """
    stream = hashlib.md5(checkpoint.encode()).hexdigest() if checkpoint else "main"
    return (
        events.writeStream.foreachBatch(lambda df, i: upsert_batch(df, i, root, order_col, as_of, stream))
        .option("checkpointLocation", checkpoint or f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )


def stream_history(spark: SparkSession, root: str) -> DataFrame:
    """All change records of committed batches."""
    head = load_manifest(spark, f"{root}/assets")
    if head is None or not has_files(spark, f"{root}/history"):
        return spark.createDataFrame([], HISTORY)
    where = T.StructType([T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    records = spark.read.schema(T.StructType([*HISTORY.fields, *where.fields])).parquet(f"{root}/history")
    last = F.create_map(*(F.lit(x) for pair in head.done.items() for x in pair)).cast("map<string,bigint>")
    return records.filter(F.col("batch") <= F.element_at(last, F.col("stream"))).select(HISTORY.names)


def stream_discovery_counts(
    events: DataFrame,
    window: str = "1 day",
    delay: str = "1 day",
    slide: str | None = None,
    time_col: str = "change_date",
    by: str = "change_type",
) -> DataFrame:
    """Changes per time window and kind; rows later than the watermark are dropped.

    Works on a stream and on a table alike.
    """
    stamped = events.withColumn("_ts", F.col(time_col).cast("timestamp")).withWatermark("_ts", delay)
    w = F.window("_ts", window, slide) if slide else F.window("_ts", window)
    return (
        stamped.groupBy(w.alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")
    )


def stream_new_assets(
    events: DataFrame, lifetime: str = "3650 days", time_col: str = "change_date", key: str = "asset_fingerprint"
) -> DataFrame:
    """Each key once, when first seen; keys are remembered for `lifetime`."""
    stamped = events.withColumn("_ts", F.col(time_col).cast("timestamp")).withWatermark("_ts", lifetime)
    return stamped.dropDuplicatesWithinWatermark([key]).drop("_ts")


def snapshot_diff(old: DataFrame, new: DataFrame, compared: list[str] | None = None) -> DataFrame:
    """(fingerprint, change) with added, removed or changed between two listings.

    Every field that a scan refreshes is compared unless others are named; maps count as sorted entries.
    Compared fields are reduced to a hash before the join, so only key and hash are shuffled.
    """
    compared = compared or REFRESHED
    kinds = {f.name: f.dataType for f in new.schema.fields}

    def plain(c: str) -> Column:
        if isinstance(kinds[c], T.MapType):
            return F.to_json(F.array_sort(F.map_entries(c)))
        return F.to_json(c) if isinstance(kinds[c], (T.ArrayType, T.StructType)) else F.col(c).cast("string")

    digest = F.xxhash64(*[F.coalesce(plain(c), F.lit("\x00null")) for c in compared])
    o = old.select("fingerprint", digest.alias("old_hash"))
    n = new.select("fingerprint", digest.alias("new_hash"))
    return (
        o.join(n, "fingerprint", "full_outer")
        .withColumn(
            "change",
            F.when(F.col("old_hash").isNull(), "added")
            .when(F.col("new_hash").isNull(), "removed")
            .when(F.col("old_hash") != F.col("new_hash"), "changed"),
        )
        .filter("change is not null")
        .select("fingerprint", "change")
    )
