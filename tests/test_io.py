"""Sources, sinks and streams on files written for the test."""

import json
import os
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.operators import sinks, snapshots
from cairn.operators.maintenance import dedupe_batch, upsert_assets, with_fingerprint
from cairn.schema import ASSETS, as_assets
from cairn.session import cut_lineage
from cairn.sources import files as S
from cairn.sources import listings as N
from cairn.sources import objects as O
from cairn.sources.scan import scan_catalog
from cairn.streaming import ingest as I

AS_OF = "2024-06-01 00:00:00"


@pytest.fixture()
def lake(tmp_path):
    (tmp_path / "data" / "deep").mkdir(parents=True)
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    (tmp_path / "data" / "b.JSON").write_text('{"k": 1, "l": [1]}')
    (tmp_path / "data" / "deep" / "c.bin").write_text("zz" * 600_000)
    return tmp_path


def test_scan_files(spark, lake):
    found = S.scan_files(spark, str(lake))
    assert found.count() == 3
    assert S.scan_files(spark, str(lake), exts=[".csv", "json"]).count() == 2
    assert S.scan_files(spark, str(lake), max_mb=1).count() == 2
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    types = {r["name"]: r["type"] for r in S.file_assets(found).collect()}
    assert types == {"a.csv": "csv_file", "b.JSON": "json_file", "c.bin": "data_file"}


COLUMNS = {
    "i": ["1", "-2", "", "+3"],
    "l": ["1", "3000000000", "", "-5"],
    "big": ["1", "3000000000", "123456789012345678901234", ""],
    "small_big": ["1", "2", "1234567890123456789012", ""],
    "huge": ["1", "9" * 39, "2", ""],
    "d": ["1", "2.5", "1e3", ""],
    "wide": ["3000000000", "2.5", "12345678901234567890", "NaN"],
    "day": ["2024-01-01", "", "2023-12-31", "2020-02-29"],
    "when": ["2024-01-01", "2024-01-01T10:00:00", "", "2024-01-01 10:00:00.5"],
    "zone": ["2024-01-01T10:00:00.000Z", "", "", "2024-01-01T10:00:00+02:00"],
    "b": ["true", "FALSE", "", "True"],
    "b_or_1": ["true", "1", "", "false"],
    "n_or_day": ["7", "2024-01-01", "", "8"],
    "bad_day": ["2023-02-30", "2024-01-01", "", ""],
    "s": ["x", "1", "true", "2024-01-01"],
    "none": ["", "", "", ""],
    "a.b `c": ["1", "2", "3", "4"],
}


@pytest.mark.parametrize("turned", [False, True])
def test_types_of_csv_are_those_of_inference(spark, tmp_path, turned):
    rows = list(zip(*COLUMNS.values(), strict=True))[:: -1 if turned else 1]
    (tmp_path / "parts").mkdir()

    def write(name, part):
        (tmp_path / name).write_text("\n".join(",".join(r) for r in [tuple(COLUMNS), *part]) + "\n")

    for k, part in enumerate((rows[:1], rows[1:3], rows[3:])):
        write(f"parts/{k}.csv", part)
    # inference of one file: over several, it forgets types that have nothing in common and goes on with the next
    write("whole.csv", rows)
    told = S.profile_csv(spark, str(tmp_path / "parts")).first()
    assert (told["num_rows"], told["num_columns"]) == (4, len(COLUMNS))
    want = {f.name: f.dataType.simpleString() for f in spark.read.csv(str(tmp_path / "whole.csv"), header=True, inferSchema=True).schema}
    assert {c["name"]: c["type"] for c in told["columns"]} == want


def test_csv_without_rows_and_repeated_names(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,a,b\n")
    told = S.profile_csv(spark, str(tmp_path)).first()
    assert told["num_rows"] == 0 and [c["type"] for c in told["columns"]] == ["string"] * 3


def test_csv_is_read_in_one_pass(spark, lake):
    plan = S.profile_csv(spark, str(lake / "a.csv"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1


def test_depth_and_storage(spark, lake):
    found = S.scan_files(spark, str(lake))
    root = "file:" + str(lake)
    assert S.limit_depth(found, root, 1).count() == 2
    info = S.storage_info(found, root).first()
    assert (info["total_files"], info["total_directories"], info["total_size_mb"]) == (3, 2, 1.14)


def test_profiles(spark, lake):
    csv = S.profile_csv(spark, str(lake / "a.csv")).first()
    assert (csv["num_rows"], csv["num_columns"], [c["type"] for c in csv["columns"]]) == (2, 2, ["int", "string"])
    doc = S.profile_json(S.read_documents(spark, str(lake / "data" / "b.JSON")), "value").first()
    assert (doc["json_type"], doc["is_array"], doc["keys"]) == ("object", False, ["k", "l"])
    df = spark.createDataFrame([("[1,2,3]",), ("7",), ('"s"',), ("true",), ("null",), ("{x",)], "v string")
    rows = S.profile_json(df, "v").collect()
    assert [r["json_type"] for r in rows] == ["array", "number", "string", "boolean", "null", None]
    assert rows[0]["array_length"] == 3


def test_parquet_profile_reads_footers_only(spark, tmp_path):
    spark.range(100).repartition(2).write.parquet(str(tmp_path / "t"))
    prof = S.profile_parquet(spark, str(tmp_path / "t"))
    assert sorted(r["num_rows"] for r in prof.collect()) and prof.agg(F.sum("num_rows")).first()[0] == 100
    assert prof.count() == 2


def test_parquet_profile_tells_the_columns_of_each_file(spark, tmp_path):
    root = tmp_path / "a b[1]"
    one = "id bigint, name string, at timestamp, day date, p decimal(9,2), l array<struct<x:int,y:map<string,double>>>"
    for name, schema, rows in [("one", one, 3), ("two", "id int", 2), ("none", "id bigint, name string", 0), ("one_more", one, 1)]:
        held = spark.range(0, rows, 1, 1).selectExpr(*[f"cast(null as {t}) as {c}" for c, t in (f.split(" ", 1) for f in schema.split(", "))])
        held.write.parquet(str(root / f"k={name}"))
    pq.write_table(pa.table({"t": pa.array([1, 2], pa.time64("ns")), "u": [1, 2]}), root / "untyped.parquet", use_dictionary=False)
    pq.write_table(pa.table({"u": pa.array([1], pa.uint32()), "s": pa.array(["x"], pa.large_string())}), root / "other.parquet")
    (root / "not.txt").write_text("x")
    plain = str(root).replace("[", "\\[").replace("]", "\\]")
    told = S.profile_parquet(spark, plain).withColumn("names", F.transform("columns", lambda c: F.concat_ws(" ", c["ordinal"], c["name"], c["type"])))
    got = {r["location"].split("%5B1%5D/")[1].split("/")[0]: r for r in told.collect()}
    one_told = [f"{k} {f}" for k, f in enumerate(one.split(", "), 1)]
    want = {
        "k=one": (3, 6, one_told),
        "k=one_more": (1, 6, one_told),
        "k=two": (2, 1, ["1 id int"]),
        "k=none": (0, 2, ["1 id bigint", "2 name string"]),
        "other.parquet": (1, 2, ["1 u bigint", "2 s string"]),
        "untyped.parquet": (2, None, None),
    }
    assert {k: (r["num_rows"], r["num_columns"], r["names"]) for k, r in got.items()} == want
    assert all(r["size"] > 0 for r in got.values())
    (tmp_path / "nothing").mkdir()
    assert S.profile_parquet(spark, str(tmp_path / "nothing"), recursive=False).count() == 0


def test_parquet_files_that_only_spark_opens_are_told_too(spark, tmp_path, monkeypatch):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "t"))
    (f,) = spark.read.parquet(str(tmp_path / "t")).inputFiles()
    at = f.replace("file:///", "file:/")
    assert S._schema_key(at, f) == S._schema_key(at, "x") != f
    assert S._schema_key("viewfs://store/a", "viewfs://store/a") == "viewfs://store/a"
    monkeypatch.setattr(S, "_with_schema_keys", lambda batches: (pa.RecordBatch.from_arrays([*b.columns, b["location"]], names=[*b.schema.names, "key"]) for b in batches))
    (r,) = S.profile_parquet(spark, str(tmp_path / "t")).collect()
    assert (r["num_rows"], r["num_columns"], r["columns"][0]["name"], r["columns"][0]["type"]) == (3, 1, "id", "bigint")


LISTINGS = [
    ("kafka", {"topic": "t", "partitions": [{"replicas": [1, 2, 3]}]}, ("kafka_topic", "t", "kafka://h/t", 0)),
    ("kafka", {"topic": "empty", "partitions": []}, ("kafka_topic", "empty", "kafka://h/empty", 0)),
    ("pulsar", {"topic": "persistent://p/n/t", "stats": {"msgInCounter": 5, "subscriptions": {"a": {}, "b": {}}}}, ("pulsar_topic", "t", "pulsar://h/persistent://p/n/t", 5)),
    ("rabbitmq_queue", {"name": "q", "messages": 4, "created_at": 1000}, ("rabbitmq_queue", "q", "rabbitmq://h/q", 4)),
    ("rabbitmq_exchange", {"name": "amq.direct"}, None),
    ("rabbitmq_exchange", {"name": "mine"}, ("rabbitmq_exchange", "mine", "rabbitmq://h/exchanges/mine", 0)),
    ("redis", {"key": "k", "type": "string"}, None),
    ("redis", {"key": "k", "type": "stream", "length": 3}, ("redis_stream", "k", "redis://h/0/k", 3)),
    ("salesforce", {"name": "A__History", "queryable": True}, None),
    ("salesforce", {"name": "B", "queryable": False}, None),
    ("salesforce", {"name": "C", "queryable": True}, ("salesforce_object", "C", "salesforce://h.salesforce.com/C", 0)),
    ("servicenow", {"name": "sys_x"}, None),
    ("slack", {"name": "c", "id": "C1", "created": 10, "num_members": 2}, ("slack_channel", "c", "slack://workspace/C1", 2)),
    ("hubspot", {"object_type": "deals", "status": 404}, None),
    ("hubspot", {"object_type": "deals", "status": 200, "total": 8}, ("hubspot_object", "deals", "hubspot://api/crm/v3/objects/deals", 8)),
    ("tableau", {"kind": "flow", "id": "9"}, ("tableau_flow", "9", "tableau://h/flows/9", 0)),
    ("databricks_notebook", {"path": "/n", "object_type": "LIBRARY"}, None),
    ("databricks_job", {"job_id": 7, "settings": {"tasks": [1, 2]}}, ("databricks_job", "job_7", "databricks://h/job/7", 0)),
    ("hdfs", {"name": "f", "dir": "/d/", "type": "FILE", "length": 6, "modificationTime": 0}, ("hdfs_file", "f", "hdfs://h/d/f", 6)),
    ("nowhere", {"name": "x"}, None),
]


def test_listings(spark):
    df = spark.createDataFrame([(p, "h", json.dumps(b)) for p, b, _ in LISTINGS] + [("kafka", "h", "not json")], "platform string, endpoint string, payload string")
    rows = N.normalise_listing(df, AS_OF).collect()
    got = sorted((r["type"], r["name"], r["location"], r["size"]) for r in rows if r["name"])
    assert got == sorted(w for _, _, w in LISTINGS if w)
    meta = {r["name"]: r["metadata"] for r in rows}
    assert meta["t"]["platform_type"] in ("kafka", "pulsar") and meta["job_7"]["tasks"] == "2"
    kafka = {r["location"]: r["metadata"] for r in rows if r["type"] == "kafka_topic" and r["name"]}
    assert kafka["kafka://h/t"]["replication_factor"] == "3" and kafka["kafka://h/empty"]["replication_factor"] == "0"
    slack = next(r for r in rows if r["type"] == "slack_channel")
    assert slack["created_date"] == datetime(1970, 1, 1, 0, 0, 10)


def test_fixed_and_nested_listings(spark):
    assert N.normalise_listing(N.fixed_listing(spark, "adp"), AS_OF).count() == 6
    assert N.normalise_listing(N.fixed_listing(spark, "quickbooks", "42"), AS_OF).filter("location like '%/42/%'").count() == 8
    zoom = N.zoom_assets(spark.range(5), AS_OF).first()
    assert (zoom["name"], zoom["size"]) == ("zoom_users", 5)
    sql = spark.createDataFrame([("srv", ["a", "b"])], "server_name string, databases array<string>")
    assert [r["location"] for r in N.azure_sql_assets(sql, AS_OF).collect()] == ["srv.database.windows.net/a", "srv.database.windows.net/b"]
    cosmos = spark.createDataFrame([("acc", [("db", ["c1", "c2"])])], "account_name string, databases array<struct<name:string,containers:array<string>>>")
    assert sorted(r["name"] for r in N.cosmos_assets(cosmos, AS_OF).collect()) == ["db.c1", "db.c2"]


def test_text_listings(spark):
    lines = spark.createDataFrame(
        [("drwxr-xr-x 2 u g 4096 Jan 1 10:00 sub",), ("-rw-r--r-- 1 u g 12 Jan 1 10:00 my file.csv",), ("total 3",), ("-rw-r--r-- 1 u g x Jan 1 10:00 n.log",), ("drwx 1 u g 1 Jan 1 10:00 ..",)],
        "line string",
    )
    got = sorted((r["name"], r["type"], r["size"]) for r in N.ftp_list_assets(lines, "line", "/in/", "h", AS_OF).collect())
    assert got == [("my file.csv", "ftp_csv_file", 12), ("n.log", "ftp_log_file", 0)]
    hdfs = spark.createDataFrame([("drwx - u g 0 2024-01-01 10:00 /a/b",), ("Found 2 items",), ("-rw- 3 u g 99999999999999999999 2024-01-01 10:00 /a/f",), ("-short",)], "line string")
    got = sorted((r["name"], r["type"], r["size"]) for r in N.hdfs_ls_assets(hdfs, "line", "nn", AS_OF).collect())
    assert got == [("b", "hdfs_directory", 0), ("f", "hdfs_file", 0)]


def test_nas_keeps_directories(spark):
    df = spark.createDataFrame([("/a/d", 4096, True), ("/a/f.csv", 7, False), ("/a/g.exe", 7, False)], "path string, size bigint, is_directory boolean")
    nas = N.network_file_assets(df, "nas", "h", exts=[".csv"])
    assert sorted((r["name"], r["size"]) for r in nas.collect()) == [("d", 0), ("f.csv", 7)]
    assert N.network_file_assets(df, "smb", "h").count() == 2


def test_object_caps_differ_in_order(spark):
    rows = [("b", f"k{i:03d}.{'csv' if i % 2 else 'bin'}", 2000 if i % 3 else 10, datetime(2024, 1, 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "bucket string, key string, size bigint, modified_date timestamp")
    caps = {"gcs": 1000, "azure": 50, "ceph": 100}
    count = lambda p: O.object_assets(df, p, caps[p]).filter("type not in ('gcs_bucket', 'azure_blob_container', 'ceph_bucket')").count()
    assert count("azure") == 50  # filter, then cap
    assert count("ceph") == 50  # first 100 keys, half of them data
    assert count("gcs") == 200
    assert O.object_assets(df, "azure").count() == 151
    assert O.bucket_rollup(df, 100).first()["object_count"] == 100
    assert O.bucket_rollup(df).first()["object_count"] == 300


def test_a_failed_connector_yields_nothing(spark):
    ok = as_assets(spark.createDataFrame([("n",)], "name string"))
    out = O.scan_all({"good": ok, "bad": None}, ["good", "bad", "unknown"])
    assert {tuple(r) for r in O.scan_summary(out).collect()} == {("good", 1), ("total", 1)}


def test_scan_survives_a_failing_source(spark, tmp_path):
    good = spark.createDataFrame([("a", "t", "s", "/x"), ("a", "t", "s", "/x"), (None, None, None, None)], "name string, type string, source string, location string")
    fails_late = spark.range(1).select(F.raise_error(F.lit("gone")).cast("string").alias("name"))

    def fails_early():
        raise OSError("no route")

    sources = {"good": good, "late": fails_late, "early": fails_early, "unasked": good}
    root = str(tmp_path / "catalog")
    for scan_id in (0, 0, 1):
        rows = {r["connector"]: r for r in scan_catalog(spark, sources, root, AS_OF, ["good", "late", "early", "unknown"], scan_id).collect()}
        assert {k: r["assets"] for k, r in rows.items()} == {"good": 3, "late": 0, "early": 0, "total": 3}
        assert "gone" in rows["late"]["error"] and rows["early"]["error"] == "no route" and rows["good"]["error"] is None
        assert snapshots.read_snapshot(spark, f"{root}/assets").count() == 2
    assert sorted(r["change_type"] for r in I.stream_history(spark, root).collect()) == ["CREATED"] * 2 + ["UPDATED"] * 2
    nothing = scan_catalog(spark, {"early": fails_early}, root, AS_OF, scan_id=2)
    assert [(r["connector"], r["assets"]) for r in nothing.orderBy("connector").collect()] == [("early", 0), ("total", 0)]
    assert snapshots.read_snapshot(spark, f"{root}/assets").count() == 2


def test_exports(spark, tmp_path):
    a = as_assets(
        spark.createDataFrame([("f1", "a", True, ["x"]), ("f2", "b", False, [])], "fingerprint string, name string, is_active boolean, tags array<string>")
    )
    sinks.export_catalog(a, str(tmp_path / "j"))
    assert [r["name"] for r in spark.read.json(str(tmp_path / "j")).collect()] == ["a"]
    sinks.export_catalog(a, str(tmp_path / "c"), "csv", limit=5)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()["tags"] == '["x"]'


def test_lineage_export(spark, tmp_path):
    one = spark.createDataFrame([("t", "x")], "target_id string, id string")
    sinks.export_lineage(one, one, one, str(tmp_path / "l"))
    back = spark.read.json(str(tmp_path / "l"))
    assert sorted(r["kind"] for r in back.collect()) == ["column", "edge", "node"]


def test_snapshots_never_overwrite(spark, tmp_path):
    root = str(tmp_path / "s")
    assert snapshots.read_snapshot(spark, root, ASSETS).count() == 0
    snapshots.write_snapshot(spark.range(3), root, "one")
    snapshots.write_snapshot(snapshots.read_snapshot(spark, root).filter("id > 0"), root, "two")
    assert snapshots.read_snapshot(spark, root).count() == 2 and snapshots.read_snapshot(spark, root, version=1).count() == 3
    assert snapshots.snapshot_versions(spark, root) == [(1, "one"), (2, "two")]


def test_cut_lineage_reads_back(spark):
    df = cut_lineage(spark.range(10).withColumn("m", F.create_map(F.lit("a"), F.col("id"))))
    assert df.count() == 10 and "FileScan" in df._jdf.queryExecution().executedPlan().toString()


# --- streams -----------------------------------------------------------------------


def test_stream_files_sees_each_file_once(spark, lake, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")

    def run():
        q = (
            I.stream_files(spark, str(lake)).writeStream.format("parquet").option("path", str(out / "o"))
            .option("checkpointLocation", str(out / "c")).trigger(availableNow=True).start()
        )
        q.awaitTermination()

    run()
    (lake / "new.csv").write_text("a\n")
    run()
    names = sorted(r["name"] for r in spark.read.parquet(str(out / "o")).collect())
    assert names == ["a.csv", "b.JSON", "c.bin", "new.csv"]


def asset_events(spark, rows):
    return spark.createDataFrame(
        [(n, "t", "s", "/l", z, datetime(2024, 1, 1, k), k) for n, z, k in rows],
        "name string, type string, source string, location string, size bigint, created_date timestamp, seq int",
    )


def test_stream_upsert_equals_batch_and_replays_nothing(spark, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "cat")
    parts = [[("a", 1, 1), ("b", 1, 2), ("a", 2, 3)], [("a", 5, 4), ("c", 6, 5)]]
    now = F.lit(AS_OF).cast("timestamp")
    schema = None
    for p in parts:
        df = asset_events(spark, p)
        schema = df.schema
        df.coalesce(1).write.mode("append").parquet(src)
        I.stream_upsert(spark.readStream.schema(schema).parquet(src), root, as_of=now).awaitTermination()
    got = I.read_snapshot(spark, f"{root}/assets", ASSETS)
    state = sorted((r["name"], r["size"], r["created_date"].hour) for r in got.collect())
    assert state == [("a", 5, 1), ("b", 1, 2), ("c", 6, 5)]
    current = spark.createDataFrame([], ASSETS)
    for p in parts:
        current = upsert_assets(current, as_assets(dedupe_batch(with_fingerprint(asset_events(spark, p)), "seq")), now)
    assert sorted((r["name"], r["size"], r["created_date"].hour) for r in current.collect()) == state
    log = I.stream_history(spark, root)
    assert sorted(r["change_type"] for r in log.collect()) == ["CREATED", "CREATED", "CREATED", "UPDATED"]
    before = snapshots.snapshot_versions(spark, f"{root}/assets")
    I.upsert_batch(asset_events(spark, parts[1]), 1, root, "seq", now)
    assert snapshots.snapshot_versions(spark, f"{root}/assets") == before
    assert I.stream_history(spark, root).count() == 4


def test_late_rows_are_dropped(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "change_type string, change_date timestamp"
    batches = [
        [("CREATED", datetime(2024, 1, 1, 1)), ("CREATED", datetime(2024, 1, 10))],
        [("CREATED", datetime(2024, 1, 1, 2)), ("UPDATED", datetime(2024, 1, 20))],
        [("UPDATED", datetime(2024, 1, 30))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = (
            I.stream_discovery_counts(spark.readStream.schema(schema).parquet(src))
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c"))
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    got = {(r["window_start"].day, r["change_type"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert got == {(1, "CREATED", 1), (10, "CREATED", 1), (20, "UPDATED", 1)}


def test_new_assets_once(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "asset_fingerprint string, change_date timestamp"
    for d in (1, 2):
        spark.createDataFrame([("a", datetime(2024, 1, d)), (f"x{d}", datetime(2024, 1, d))], schema).coalesce(1).write.mode("append").parquet(src)
        q = (
            I.stream_new_assets(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet")
            .option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    assert sorted(r["asset_fingerprint"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "x1", "x2"]
    assert os.path.isdir(src)


def test_streams_with_their_own_checkpoints_share_a_root(spark, tmp_path):
    root, now = str(tmp_path / "cat"), F.lit(AS_OF).cast("timestamp")
    for name, rows in (("one", [("a", 1, 1)]), ("two", [("b", 2, 2)])):
        df = asset_events(spark, rows)
        df.write.parquet(str(tmp_path / name))
        events = spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
        I.stream_upsert(events, root, as_of=now, checkpoint=str(tmp_path / f"{name}-checkpoint")).awaitTermination()
    got = I.read_snapshot(spark, f"{root}/assets", ASSETS)
    assert sorted(r["name"] for r in got.collect()) == ["a", "b"]
    assert I.stream_history(spark, root).count() == 2
    asset_events(spark, [("c", 1, 1)]).write.parquet(f"{root}/history/stream=main/batch=99")  # not committed
    assert I.stream_history(spark, root).count() == 2


def test_a_renamed_column_is_a_change(spark):
    def asset(column, tag):
        rows = spark.range(1).select(
            F.lit("f").alias("fingerprint"),
            F.lit("n").alias("name"),
            F.array(F.named_struct(F.lit("name"), F.lit(column))).alias("columns"),
            F.create_map(F.lit("k"), F.lit(tag)).alias("metadata"),
        )
        return rows

    fields = ["name", "columns", "metadata"]
    assert I.snapshot_diff(asset("a", "x"), asset("b", "x"), fields).collect() == [("f", "changed")]
    assert I.snapshot_diff(asset("a", "x"), asset("a", "y"), fields).collect() == [("f", "changed")]
    assert I.snapshot_diff(asset("a", "x"), asset("a", "x"), fields).count() == 0
    assert {"columns", "num_rows", "tags", "metadata"} <= set(I.REFRESHED)


def test_listings_have_no_hidden_cap(spark):
    keys = spark.range(1500).select(
        F.lit("b").alias("bucket"),
        F.format_string("k%05d.csv", "id").alias("key"),
        F.lit(2000).cast("bigint").alias("size"),
        F.lit("2024-01-01").cast("timestamp").alias("modified_date"),
    )
    for platform in ("gcs", "azure", "ceph"):
        assert O.object_assets(keys, platform).count() == 1501
    assert O.bucket_rollup(keys).first()["object_count"] == 1500
