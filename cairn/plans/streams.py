"""Queries: streaming jobs run to completion over the driver tables, read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.plans.fixtures import AS_OF
from cairn.plans.maintenance import ts
from cairn.plans.registry import query
from cairn.plans.sources import event_files
from cairn.session import scratch_path
from cairn.sources import files as S
from cairn.streaming import ingest as I
from cairn.streaming import seen

#: Batches that a table of any size comes in: every batch reads the keys so far, so they grow in rows, not in number.
BATCHES = 70


def event_stream(i):
    """The events table as a stream."""
    schema = i.table("events").schema
    return i.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(i.sf_dir)


def drained(i, stream, label: str):
    """Write a stream to Parquet in the shared folder until it is drained, then read it back."""
    path = scratch_path(i.spark, label)
    q = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return i.spark.read.schema(stream.schema).parquet(f"{path}/out")


def _changes(events):
    kind = (
        F.when(F.col("event_type") == "signup", "CREATED")
        .when(F.col("event_type") == "error", "DEACTIVATED")
        .otherwise("UPDATED")
    )
    return events.select(
        "event_id",
        F.md5(F.col("user_id").cast("string")).alias("asset_fingerprint"),
        kind.alias("change_type"),
        F.col("ts").alias("change_date"),
    )


@query(
    "str1_stream_files",
    """select 'event_type=' || event_type as folder, 'parquet_file' as type, true as once from events group by event_type""",
)
def _(i):
    files = I.stream_files(i.spark, event_files(i, "stream"), glob="*.parquet").select("fingerprint", "location", "type")
    return (
        drained(i, files, "files")
        .groupBy(F.regexp_extract("location", r"(event_type=[a-z]+)/", 1).alias("folder"), "type")
        .agg((F.count("*") == F.count_distinct("fingerprint")).alias("once"))
    )


@query(
    "str1_discover",
    """select event_type as folder, case when event_type in ('click', 'view') then 0 else 1 end as look, count(*) as num_rows, true as once
       from events group by event_type""",
)
def _(i):
    # a folder that grows: two kinds of events, then the others, then nothing new
    path, root = scratch_path(i.spark, "growing"), scratch_path(i.spark, "looks")
    first = F.col("event_type").isin("click", "view")
    for part in (first, ~F.coalesce(first, F.lit(False)), None):
        if part is not None:
            i.table("events").filter(part).write.mode("append").partitionBy("event_type").option("maxRecordsPerFile", 500).parquet(path)
        seen.discover(i.spark, path, root, exts=["parquet"])
    held = S.profile_parquet(i.spark, path).select(F.regexp_replace("location", "^file:/+", "file:/").alias("location"), "num_rows")
    return (
        seen.discovered(i.spark, root)
        .join(held, "location", "full_outer")
        .groupBy(F.regexp_extract("location", "event_type=([a-z]+)/", 1).alias("folder"), F.col("batch").alias("look"))
        .agg(F.sum("num_rows").alias("num_rows"), (F.count("*") == F.count_distinct("location")).alias("once"))
    )


def _as_asset_rows(events):
    return events.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name"),
        F.concat("event_type", F.lit("_log")).alias("type"),
        F.lit("events").alias("source"),
        F.lit("/events").alias("location"),
        F.floor("value").cast("bigint").alias("size"),
        F.col("ts").cast("timestamp").alias("created_date"),
        F.col("ts").cast("timestamp").alias("modified_date"),
        F.col("event_id").alias("seq"),
    )


@query(
    "str2_stream_upsert",
    f"""select 'user_' || user_id as name, arg_max(event_type, event_id) || '_log' as type,
          cast(floor(arg_max(value, event_id)) as bigint) as size, strftime(arg_min(ts, event_id), '%Y-%m-%d %H:%M:%S') as created_date,
          '{AS_OF}' as last_scanned from events group by user_id""",
)
def _(i):
    root = scratch_path(i.spark, "upsert")
    now = F.lit(AS_OF).cast("timestamp")
    I.stream_upsert(_as_asset_rows(event_stream(i)), root, as_of=now).awaitTermination()
    done = I.read_snapshot(i.spark, f"{root}/assets", I.ASSETS)
    return done.select(
        "name", "type", "size", ts("created_date").alias("created_date"), ts("last_scanned").alias("last_scanned")
    )


@query(
    "str3_discovery_counts",
    """with w as (select time_bucket(interval 1 day, change_date) as s, change_type, count(*) as n from changes group by 1, 2)
       select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, change_type, n from w
       where s + interval 1 day <= (select max(change_date) from changes) - interval 1 day""",
    ["changes"],
)
def _(i):
    counts = I.stream_discovery_counts(_changes(event_stream(i)))
    done = drained(i, counts, "counts")
    return done.select(ts("window_start").alias("window_start"), "change_type", "n")


@query(
    "str3_discovery_counts_sliding",
    """with w as (select time_bucket(interval 6 hour, change_date) - k * interval 6 hour as s, change_type from changes, range(0, 4) r(k)),
         g as (select s, change_type, count(*) as n from w group by 1, 2)
       select strftime(s, '%Y-%m-%d %H:%M:%S') as window_start, change_type, n from g
       where s + interval 1 day <= (select max(change_date) from changes) - interval 1 day""",
    ["changes"],
)
def _(i):
    counts = I.stream_discovery_counts(_changes(event_stream(i)), slide="6 hours")
    done = drained(i, counts, "sliding")
    return done.select(ts("window_start").alias("window_start"), "change_type", "n")


@query("str4_new_assets", "select distinct asset_fingerprint from changes", ["changes"])
def _(i):
    seen = I.stream_new_assets(_changes(event_stream(i))).select("asset_fingerprint")
    return drained(i, seen, "new")


@query(
    "str4_first_seen",
    "select asset_fingerprint, count(distinct asset_fingerprint) as times from changes group by asset_fingerprint",
    ["changes"],
)
def _(i):
    # many batches: each asset is told once, in whichever of them it comes first
    root, schema = scratch_path(i.spark, "seen"), i.table("events").schema
    path = event_files(i, "seen_events", files=3 * BATCHES)
    at_once = max(3, -(-len(i.spark.read.schema(schema).parquet(path).inputFiles()) // BATCHES))
    files = i.spark.readStream.schema(schema).option("maxFilesPerTrigger", at_once).parquet(path)
    changes = _changes(files)
    seen.stream_first_seen(changes, root, ["asset_fingerprint"], ["change_date", "event_id"]).awaitTermination()
    rows = seen.first_seen(i.spark, root, changes.select("asset_fingerprint", "event_id", "change_type", "change_date").schema)
    return rows.groupBy("asset_fingerprint").agg(F.count("*").alias("times"))
