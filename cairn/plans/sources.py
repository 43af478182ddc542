"""Queries: file scans, database metadata, object stores, platform listings, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import sinks, snapshots
from cairn.plans.fixtures import AS_OF, TABLES, _COLUMNS
from cairn.plans.maintenance import sql_ts, ts
from cairn.plans.registry import query
from cairn.session import scratch_path
from cairn.sources import databases as DB
from cairn.sources import files as S
from cairn.sources import listings as N
from cairn.sources import objects as O
from cairn.sources.scan import scan_catalog
from cairn.sources.tree import tree_files
from cairn.streaming.ingest import stream_history

# --- files ---------------------------------------------------------------------------


def event_files(i, label: str, files: int | None = None) -> str:
    """The events table written as files of at most 500 rows, one folder per kind.

    With `files`, a file of a large table has more rows, so that about so many are full.
    """
    path, events = scratch_path(i.spark, label), i.table("events")
    rows = 500 if files is None else max(500, -(-events.count() // files))
    events.write.partitionBy("event_type").option("maxRecordsPerFile", rows).parquet(path)
    return path


@query(
    "src1_scan_files",
    """select 'event_type=' || event_type as folder, 'parquet_file' as type, true as sized, 'ext_parquet,size_small' as tags
       from events group by event_type""",
)
def _(i):
    found = S.file_assets(S.scan_files(i.spark, event_files(i, "scan"), exts=[".parquet"]))
    return found.groupBy(
        F.regexp_extract("location", r"(event_type=[a-z]+)/", 1).alias("folder"),
        "type",
        F.array_join("tags", ",").alias("tags"),
    ).agg(F.bool_and(F.col("size") > 0).alias("sized"))


@query("src1_list_tree", "select event_type as folder, count(*) as num_rows, true as same_sizes, true as once from events group by event_type")
def _(i):
    # every file that footers are read from is listed once with its size, and nothing else is
    path = event_files(i, "tree")
    listed = tree_files(i.spark, path, exts=["parquet"]).withColumn("times", F.lit(1))
    held = S.profile_parquet(i.spark, path).select(F.regexp_replace("location", "^file:/+", "file:/").alias("at"), "num_rows", F.col("size").alias("bytes"))
    both = listed.join(held, F.col("location") == F.col("at"), "full_outer")
    return both.groupBy(F.regexp_extract(F.coalesce("location", "at"), "event_type=([a-z]+)/", 1).alias("folder")).agg(
        F.sum("num_rows").alias("num_rows"),
        F.bool_and(F.coalesce(F.col("size") == F.col("bytes"), F.lit(False))).alias("same_sizes"),
        (F.sum("times") == F.count_distinct("location")).alias("once"),
    )


def _located(i):
    return i.projection("files").select("file_id", F.concat(F.lit("/lake/"), "key").alias("location"), "size")


_DEPTH = "cast(len(string_split(key, '/')) - 1 as integer)"


@query("src2_limit_depth", f"select file_id, {_DEPTH} as depth from files where {_DEPTH} <= 5", ["files"])
def _(i):
    return S.limit_depth(_located(i), "/lake", 5).select("file_id", "depth")


@query(
    "src2_directories",
    """select distinct array_to_string(string_split(key, '/')[1:d], '/') as directory
       from files, range(1, 5) r(d) where d <= len(string_split(key, '/')) - 1""",
    ["files"],
)
def _(i):
    return S.directories(_located(i), "/lake", 4)


@query(
    "src4_profile_csv",
    """select count(*) as num_rows, 6 as num_columns,
         'event_id ' || case when max(event_id) < 2147483648 then 'int' else 'bigint' end ||
         ',ts ' || case when count(ts) > 0 then 'timestamp' else 'string' end ||
         ',user_id ' || case when max(user_id) < 2147483648 then 'int' else 'bigint' end ||
         ',event_type string,value double,props string' as columns from events""",
)
def _(i):
    path = scratch_path(i.spark, "csv")
    i.table("events").select("event_id", "ts", "user_id", "event_type", "value", "props").write.option("header", True).option(
        "escape", '"'
    ).csv(path)
    told = F.transform("columns", lambda c: F.concat_ws(" ", c["name"], c["type"]))
    return S.profile_csv(i.spark, path).select("num_rows", "num_columns", F.array_join(told, ",").alias("columns"))


@query(
    "src5_profile_json",
    """select 'event' as kind, event_id as id, 'object' as json_type, false as is_array, 'k' as keys, cast(null as integer) as array_length from events
       union all select 'vector', vec_id, 'array', true, null, cast(len(embedding) as integer) from embeddings
       union all select 'text', doc_id, null, false, null, null from documents""",
)
def _(i):
    docs = (
        i.table("events")
        .select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("props").alias("body"))
        .unionByName(
            i.table("embeddings").select(
                F.lit("vector").alias("kind"), F.col("vec_id").alias("id"), F.to_json("embedding").alias("body")
            )
        )
        .unionByName(
            i.table("documents").select(F.lit("text").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
        )
    )
    return S.profile_json(docs, "body").select(
        "kind", "id", "json_type", "is_array", F.array_join("keys", ",").alias("keys"), "array_length"
    )


@query(
    "src6_profile_parquet",
    " union all ".join(
        f"select '{t}' as name, count(*) as num_rows, {len(c.split(', '))} as num_columns, true as sized from {t}"
        for t, c in _COLUMNS
    ),
)
def _(i):
    out = None
    for t in TABLES:
        one = S.with_table_shape(S.profile_parquet(i.spark, i.path(t)), i.table(t))
        out = one if out is None else out.unionByName(one)
    return out.select(
        F.regexp_extract("location", r"([^/]+)\.parquet$", 1).alias("name"),
        "num_rows",
        "num_columns",
        (F.col("size") > 0).alias("sized"),
    )


@query("src7_columnar_files", "select 'orc' as format, true as listed, count(*) as num_rows from orders")
def _(i):
    path = scratch_path(i.spark, "orc")
    i.table("orders").write.orc(path)
    listed = S.columnar_files(i.spark, path, "orc").groupBy("format").agg((F.sum("size") > 0).alias("listed"))
    rows = i.spark.read.orc(path).agg(F.count("*").alias("num_rows"))
    return listed.join(F.broadcast(rows))


@query(
    "src8_catalog_tables",
    " union all ".join(
        f"select 'cairn_{t}' as name, {len(c.split(', '))} as width, count(*) as num_rows, "
        f"count(*) * {len(c.split(', '))} * 100 as size from {t}"
        for t, c in _COLUMNS
    ),
)
def _(i):
    views = [f"cairn_{t}" for t in TABLES]
    for t, v in zip(TABLES, views):
        i.table(t).createOrReplaceTempView(v)
    try:
        listed = S.catalog_table_assets(i.spark, "default").filter(F.col("name").isin(views))
        counts = None
        for v in views:
            one = i.spark.table(v).agg(F.count("*").alias("rows")).select(F.lit(v).alias("name"), "rows")
            counts = one if counts is None else counts.unionByName(one)
    finally:
        for v in views:
            i.spark.catalog.dropTempView(v)
    return listed.join(counts, "name").select(
        "name",
        F.size("columns").alias("width"),
        F.col("rows").alias("num_rows"),
        S.estimated_table_size("rows", "columns").alias("size"),
    )


@query(
    "src18_storage_info",
    """with d as (select count(distinct array_to_string(string_split(key, '/')[1:d], '/')) as n
                  from files, range(1, 20) r(d) where d <= len(string_split(key, '/')) - 1)
       select count(*) as total_files, any_value(n) as total_directories, cast(sum(size) as bigint) as total_size_bytes,
         round(sum(size) / 1048576, 2) as total_size_mb, round(sum(size) / 1073741824, 2) as total_size_gb from files, d""",
    ["files"],
)
def _(i):
    return S.storage_info(_located(i), "/lake")


# --- databases -------------------------------------------------------------------------

_SCHEMAS = "public,sales,information_schema,hr,pg_catalog"


def _schema_of(row_id="row_id"):
    return F.split_part(F.lit(_SCHEMAS), F.lit(","), (F.col(row_id) % 5 + 1).cast("int"))


def _metadata(i):
    """Metadata tables of a database holding every catalog asset: tables, views, columns, counts."""
    assets = i.catalog().withColumns({"table_name": F.col("name"), "schema_name": _schema_of()})
    keyed = assets.select("fingerprint", "table_name", "schema_name", "row_id", "num_rows", "size", "type")
    columns = assets.select("schema_name", "table_name", F.explode("columns").alias("c")).select(
        "schema_name",
        "table_name",
        F.col("c.ordinal").alias("ordinal"),
        F.col("c.name").alias("column_name"),
        F.col("c.type").alias("data_type"),
        F.col("c.nullable").alias("nullable"),
    )
    is_view = F.col("type").contains("view")
    return keyed.filter(~is_view), keyed.filter(is_view), columns


_META = f"""meta as (select *, name as table_name, split_part('{_SCHEMAS}', ',', cast(row_id % 5 + 1 as int)) as schema_name,
     contains(type, 'view') as is_view from catalog),
  widths as (select fingerprint, count(*) as width, string_agg(column_name || case when mode = 'NULLABLE' then '?' else '' end, ','
     order by ordinal) as cols from columns_long group by fingerprint)"""


def _listed(df):
    cols = F.transform("columns", lambda c: F.concat(c["name"], F.when(c["nullable"], "?").otherwise("")))
    return df.select(
        "name", "type", "location", "size", F.array_join(cols, ",").alias("columns"), F.array_join("tags", ",").alias("tags")
    )


@query(
    "src9_postgresql",
    f"""with {_META} select schema_name || '.' || table_name as name, case when is_view then 'postgresql_view' else 'postgresql_table' end as type,
          'postgresql://db:5432/shop/' || schema_name || '/' || table_name as location,
          case when is_view then 0 else num_rows * width * 50 end as size, cols as columns,
          'postgresql,database,' || case when is_view then 'view' else 'table' end || ',' || schema_name as tags
        from meta join widths using (fingerprint) where schema_name not in ('information_schema', 'pg_catalog', 'pg_toast')""",
    ["catalog", "columns_long"],
)
def _(i):
    tables, views, columns = _metadata(i)
    counts = tables.select("schema_name", "table_name", F.col("num_rows").alias("row_count"))
    made = DB.assets_from_information_schema(
        "postgresql",
        tables=tables,
        views=views,
        columns=columns,
        counts=counts,
        base="postgresql://db:5432/shop",
        as_of=AS_OF,
    )
    return _listed(made)


@query(
    "src10_mysql",
    f"""with {_META} select table_name as name, case when is_view then 'mysql_view' else 'mysql_table' end as type,
          'mysql://db:3306/shop/' || table_name as location, case when is_view then 0 else size end as size, cols as columns,
          'mysql,database,' || case when is_view then 'view' else 'table' end as tags
        from meta join widths using (fingerprint)""",
    ["catalog", "columns_long"],
)
def _(i):
    tables, views, columns = _metadata(i)
    none = F.lit(None)
    listed = tables.select(
        "table_name", F.lit("BASE TABLE").alias("table_type"), "num_rows", F.col("size").alias("data_length")
    ).unionByName(
        views.select(
            "table_name",
            F.lit("VIEW").alias("table_type"),
            none.cast("bigint").alias("num_rows"),
            none.cast("bigint").alias("data_length"),
        )
    )
    full = listed.withColumns(
        {"table_rows": F.col("num_rows"), "create_time": none.cast("timestamp"), "update_time": none.cast("timestamp")}
    )
    made = DB.assets_from_information_schema(
        "mysql", tables=full, columns=columns.drop("schema_name"), base="mysql://db:3306/shop", as_of=AS_OF
    )
    return _listed(made)


@query(
    "src11_oracle",
    f"""with {_META} select table_name as name, case when is_view then 'oracle_view' else 'oracle_table' end as type,
          'oracle://db:1521/shop/' || table_name as location, case when is_view then 0 else (num_rows + 3) * 8192 end as size,
          cols as columns, 'oracle,database,' || case when is_view then 'view' else 'table' end as tags,
          case when is_view then 900 end as text_length
        from meta join widths using (fingerprint)""",
    ["catalog", "columns_long"],
)
def _(i):
    tables, views, columns = _metadata(i)
    t = tables.select(
        "table_name",
        F.lit("users").alias("tablespace_name"),
        "num_rows",
        (F.col("num_rows") + 3).alias("blocks"),
        F.lit(None).cast("timestamp").alias("last_analyzed"),
    )
    v = views.select(F.col("table_name").alias("view_name"), F.repeat(F.lit("select 1 "), F.lit(100)).alias("text"))
    made = DB.assets_from_information_schema(
        "oracle", tables=t, views=v, columns=columns.drop("schema_name"), base="oracle://db:1521/shop", as_of=AS_OF
    )
    length = F.length(F.element_at("metadata", "view_text")).alias("text_length")
    return _listed(made).join(made.select("name", length), "name")


@query(
    "src12_hierarchy",
    f"""with {_META}, m as (select *, case when source = 'file_system' then 'system' else source end as cat from meta)
        select cat as name, 'trino_catalog' as type, 'trino://host:8080/' || cat as location, '' as columns, 'trino,catalog' as tags
          from (select distinct cat from m where cat not in ('system', 'information_schema'))
        union all select cat || '.' || schema_name, 'trino_schema', 'trino://host:8080/' || cat || '/' || schema_name, '', 'trino,schema'
          from (select distinct cat, schema_name from m where cat not in ('system', 'information_schema'))
        union all select cat || '.' || schema_name || '.' || table_name, 'trino_' || case when is_view then 'view' else 'table' end,
          'trino://host:8080/' || cat || '/' || schema_name || '/' || table_name, cols, 'trino,' || case when is_view then 'view' else 'table' end
          from m join widths using (fingerprint) where cat not in ('system', 'information_schema')""",
    ["catalog", "columns_long"],
)
def _(i):
    assets = i.catalog().withColumns(
        {
            "catalog_name": F.when(F.col("source") == "file_system", "system").otherwise(F.col("source")),
            "schema_name": _schema_of(),
            "table_name": F.col("name"),
            "table_type": F.when(F.col("type").contains("view"), "VIEW").otherwise("TABLE"),
        }
    )
    keys = ["catalog_name", "schema_name", "table_name"]
    columns = assets.select(*keys, F.explode("columns").alias("c")).select(
        *keys,
        F.col("c.ordinal").alias("ordinal"),
        F.col("c.name").alias("column_name"),
        F.col("c.type").alias("data_type"),
        F.col("c.nullable").alias("nullable"),
    )
    made = DB.hierarchy_assets(
        assets.select("catalog_name", "schema_name").distinct(),
        assets.select(*keys, "table_type"),
        columns,
        "trino",
        "trino://host:8080",
        AS_OF,
    )
    return _listed(made).drop("size").withColumn("columns", F.coalesce("columns", F.lit("")))


# --- object stores ------------------------------------------------------------------------

_DATA = r"regexp_matches(lower(key), '\.(csv|json|parquet|avro|orc|txt|tsv|xlsx|xml|yaml|yml)$')"


def _capped(where: str, cap: int) -> str:
    return f"""(select * from (select *, row_number() over (partition by bucket order by key) as rn from files {where}) where rn <= {cap})"""


@query(
    "src14_gcs_objects",
    f"""select bucket as name, 'gcs_bucket' as type, 'gs://' || bucket as location, 0 as size from (select distinct bucket from files)
        union all select bucket || '/' || key, 'gcs_object', 'gs://' || bucket || '/' || key, size from {_capped("", 1000)} where size > 1024""",
    ["files"],
)
def _(i):
    return O.object_assets(i.projection("files"), "gcs", cap=1000).select("name", "type", "location", "size")


@query(
    "src14_azure_blobs",
    rf"""select bucket as name, 'azure_blob_container' as type, 0 as size from (select distinct bucket from files)
        union all select regexp_extract(key, '([^/]*)$', 1),
          case regexp_extract(lower(key), '\.([^.]*)$', 1) when 'csv' then 'azure_csv_file' when 'json' then 'azure_json_file'
            when 'parquet' then 'azure_parquet_file' when 'xlsx' then 'azure_excel_file' when 'avro' then 'azure_avro_file'
            when 'orc' then 'azure_orc_file' else 'azure_data_file' end, size from {_capped(f"where {_DATA}", 50)}""",
    ["files"],
)
def _(i):
    return O.object_assets(i.projection("files"), "azure", cap=50).select("name", "type", "size")


@query(
    "src14_ceph_objects",
    f"""select bucket as name, 'ceph_bucket' as type, cast(sum(size) as bigint) as size from {_capped("", 100)} group by bucket
        union all select regexp_extract(key, '([^/]*)$', 1), 'ceph_object', size from {_capped("", 100)} where {_DATA}""",
    ["files"],
)
def _(i):
    return O.object_assets(i.projection("files"), "ceph", cap=100).select("name", "type", "size")


@query(
    "src14_gcs_objects_whole",
    """select bucket as name, 'gcs_bucket' as type, 0 as size from (select distinct bucket from files)
       union all select bucket || '/' || key, 'gcs_object', size from files where size > 1024""",
    ["files"],
)
def _(i):
    return O.object_assets(i.projection("files"), "gcs").select("name", "type", "size")


@query(
    "src14_ceph_objects_whole",
    rf"""select bucket as name, 'ceph_bucket' as type, cast(sum(size) as bigint) as size from files group by bucket
        union all select regexp_extract(key, '([^/]*)$', 1), 'ceph_object', size from files where {_DATA}""",
    ["files"],
)
def _(i):
    return O.object_assets(i.projection("files"), "ceph").select("name", "type", "size")


@query(
    "src15_bucket_rollup",
    f"select bucket, cast(sum(size) as bigint) as total_size, count(*) as object_count from {_capped('', 100)} group by bucket",
    ["files"],
)
def _(i):
    return O.bucket_rollup(i.projection("files"), cap=100)


@query(
    "src15_bucket_rollup_whole",
    "select bucket, cast(sum(size) as bigint) as total_size, count(*) as object_count from files group by bucket",
    ["files"],
)
def _(i):
    return O.bucket_rollup(i.projection("files"), cap=None)


# --- platform listings -----------------------------------------------------------------------

_PLATFORMS = list(N.RULES)
_PREFIX = {"F": "amq.", "O": "sys_", "P": "proj/"}


def _dump(i):
    """One listing row per order; every platform gets a share and finds the fields it reads."""
    o = i.table("orders")
    k = F.col("o_orderkey").cast("string")
    name = F.concat(
        F.element_at(F.create_map(*[F.lit(x) for kv in _PREFIX.items() for x in kv]), F.col("o_orderstatus")),
        k,
        F.when(F.col("o_orderpriority").startswith("1"), "__History").otherwise(""),
    )
    price = F.floor(F.col("o_totalprice")).cast("bigint")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    named = {
        n: name
        for n in (
            "name topic StreamName subject key display_name title displayName path object_type id job_id".split()
        )
    }
    made = {
        n: iso
        for n in "StreamCreationTimestamp create_time date_created createdDateTime createdAt".split()
    }
    fields = {
        **named,
        **made,
        "kind": F.lit("view"),
        "type": F.when(F.col("o_orderstatus") == "O", "stream").otherwise("DIRECTORY"),
        "queryable": F.col("o_orderstatus") != "F",
        "status": F.when(F.col("o_orderstatus") == "F", 404).otherwise(200),
        "messages": price,
        "length": price,
        "num_members": price,
        "total": price,
        "file_size": price,
        "modificationTime": ms,
        "created": F.floor(ms / 1000).cast("bigint"),
        "partitions": F.array(F.struct(F.array(F.lit(1), F.lit(2)).alias("replicas"))),
        "stats": F.struct(price.alias("msgInCounter"), price.alias("member_count")),
    }
    body = F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    platform = F.element_at(
        F.array(*[F.lit(p) for p in _PLATFORMS]), (F.col("o_orderkey") % len(_PLATFORMS) + 1).cast("int")
    )
    return o.select(platform.alias("platform"), F.lit("host").alias("endpoint"), body.alias("payload"))


_LAST_NAME = "regexp_extract(n, '([^/]*)$', 1)"
_ROW = f"""raw as (select {_PLATFORMS}[o_orderkey % {len(_PLATFORMS)} + 1] as platform, o_orderstatus as st,
     case o_orderstatus when 'F' then 'amq.' when 'O' then 'sys_' else 'proj/' end || o_orderkey ||
       case when o_orderpriority like '1%' then '__History' else '' end as n,
     cast(floor(o_totalprice) as bigint) as price, o_orderdate as d from orders)"""


@query(
    "src16_listings",
    f"""with {_ROW}
        select case platform when 'tableau' then 'tableau_view' when 'hdfs' then case when st = 'O' then 'hdfs_file' else 'hdfs_directory' end
            when 'kafka' then 'kafka_topic' when 'pulsar' then 'pulsar_topic' when 'kinesis' then 'kinesis_stream' when 'eventhub' then 'eventhub_hub'
            when 'pubsub' then 'pubsub_topic' when 'nats' then 'nats_subject' when 'redis' then 'redis_stream' when 'salesforce' then 'salesforce_object'
            when 'servicenow' then 'servicenow_table' when 'slack' then 'slack_channel' when 'jira' then 'jira_project' when 'hubspot' then 'hubspot_object'
            when 'zendesk' then 'zendesk_field' when 'google_analytics' then 'google_analytics_property' when 'mailchimp' then 'mailchimp_list'
            when 'workday' then 'workday_object' when 'adp' then 'adp_object' when 'quickbooks' then 'quickbooks_object' when 'teams' then 'teams_team'
            when 'power_bi' then 'powerbi_workspace' else platform end as type,
          case when platform in ('pulsar', 'pubsub') then {_LAST_NAME} when platform = 'databricks_job' then 'job_' || n else n end as name,
          case platform when 'pulsar' then 'pulsar://host/' || n when 'pubsub' then 'pubsub://host/' || {_LAST_NAME}
            when 'kafka' then 'kafka://host/' || n when 'rabbitmq_queue' then 'rabbitmq://host/' || n when 'rabbitmq_exchange' then 'rabbitmq://host/exchanges/' || n
            when 'kinesis' then 'kinesis://host/' || n when 'eventhub' then 'eventhub://host/' || n when 'servicebus_queue' then 'servicebus://host/' || n
            when 'servicebus_topic' then 'servicebus://host/' || n when 'nats' then 'nats://host/' || n when 'redis' then 'redis://host/0/' || n
            when 'salesforce' then 'salesforce://host.salesforce.com/' || n when 'servicenow' then 'servicenow://host.service-now.com/' || n
            when 'slack' then 'slack://workspace/' || n when 'jira' then 'jira://host/projects/' || n when 'hubspot' then 'hubspot://api/crm/v3/objects/' || n
            when 'zendesk' then 'zendesk://host.zendesk.com/fields/' || n when 'google_analytics' then 'ga://property/' || {_LAST_NAME}
            when 'mailchimp' then 'mailchimp://lists/' || n when 'workday' then 'workday://host/' || n when 'adp' then 'adp://api/' || n
            when 'quickbooks' then 'quickbooks://company/host/' || n when 'teams' then 'teams://team/' || n when 'tableau' then 'tableau://host/views/' || n
            when 'power_bi' then 'powerbi://workspace/' || n when 'databricks_job' then 'databricks://host/job/' || n
            when 'hdfs' then 'hdfs://host/' || n end as location,
          case when platform in ('pulsar', 'rabbitmq_queue', 'redis', 'slack', 'hubspot', 'mailchimp', 'workday', 'hdfs') then price else 0 end as size,
          case when platform in ('kinesis', 'slack', 'google_analytics', 'mailchimp', 'teams', 'tableau', 'hdfs') then {sql_ts("d")} else '{AS_OF}' end as created
        from raw
        where case platform when 'rabbitmq_exchange' then st <> 'F' when 'redis' then st = 'O'
            when 'salesforce' then st <> 'F' and n not like '%\\_\\_History' escape '\\'
            when 'servicenow' then st <> 'O' when 'hubspot' then st <> 'F' when 'workday' then st <> 'F'
            when 'databricks_notebook' then false else true end""",
)
def _(i):
    return N.normalise_listing(_dump(i), AS_OF).select(
        "type", "name", "location", "size", ts("created_date").alias("created")
    )


_LINES = """lines as (select file_id, key, size, case when file_id % 9 = 0 then 'd' else '-' end as kind from files)"""


@query(
    "src16_hdfs_ls_lines",
    f"""with {_LINES} select regexp_extract(key, '([^/]*)$', 1) as name, case kind when 'd' then 'hdfs_directory' else 'hdfs_file' end as type,
          'hdfs://nn:9000/' || key as location, size from lines""",
    ["files"],
)
def _(i):
    f = i.projection("files")
    line = F.concat(
        F.when(F.col("file_id") % 9 == 0, "drwxr-xr-x").otherwise("-rw-r--r--"),
        F.lit("   3 hive  hadoop   "),
        F.col("size").cast("string"),
        F.lit(" 2024-01-01 10:00 /"),
        "key",
    )
    lines = f.select(line.alias("line")).unionAll(f.select(F.lit("Found 3 items").alias("line")).distinct())
    return N.hdfs_ls_assets(lines, "line", "nn:9000", AS_OF).select("name", "type", "location", "size")


@query(
    "src16_ftp_list_lines",
    f"""with {_LINES} select 'my ' || file_id || '.csv' as name, 'ftp_csv_file' as type, 'ftp://h/in/my ' || file_id || '.csv' as location, size
        from lines where kind = '-'""",
    ["files"],
)
def _(i):
    f = i.projection("files")
    line = F.concat(
        F.when(F.col("file_id") % 9 == 0, "drwxr-xr-x").otherwise("-rw-r--r--"),
        F.lit(" 1 ftp ftp "),
        F.col("size").cast("string"),
        F.lit(" Jan 01 10:00 my "),
        F.col("file_id").cast("string"),
        F.lit(".csv"),
    )
    return N.ftp_list_assets(f.select(line.alias("line")), "line", "/in", "h", AS_OF).select(
        "name", "type", "location", "size"
    )


@query(
    "src16_network_files",
    r"""select regexp_extract(key, '([^/]*)$', 1) as name, 'sftp://h/' || key as location, size from files
        where regexp_matches(lower(key), '(\.csv|\.json)$')""",
    ["files"],
)
def _(i):
    listing = i.projection("files").select(F.concat(F.lit("/"), "key").alias("path"), "size", "modified_date")
    return N.network_file_assets(listing, "sftp", "h", exts=[".csv", ".json"]).select("name", "location", "size")


def _scanned(i):
    mixed = i.projection("mixed")
    origin = lambda o: mixed.filter(F.col("origin") == o)
    return O.scan_all(
        {"web": origin("pages"), "text": origin("documents"), "tables": origin("part"), "broken": None, "unasked": mixed},
        wanted=["web", "text", "tables", "broken", "unknown"],
    )


@query(
    "src17_scan_all",
    """select case origin when 'pages' then 'web' when 'documents' then 'text' else 'tables' end as connector, name, type, size from mixed""",
    ["mixed"],
)
def _(i):
    return _scanned(i).select("connector", "name", "type", "size")


@query(
    "src17_scan_summary",
    """select coalesce(c, 'total') as connector, count(*) as assets
       from (select case origin when 'pages' then 'web' when 'documents' then 'text' else 'tables' end as c from mixed) group by rollup (c)""",
    ["mixed"],
)
def _(i):
    return O.scan_summary(_scanned(i))


def _scan_pipeline(i):
    """Three connectors and one whose listing fails in a task; (root of the catalog, summary)."""
    mixed = i.projection("mixed")
    failing = i.table("region").select(F.raise_error(F.lit("store is gone")).cast("string").alias("name"))
    root = scratch_path(i.spark, "scanned")
    parts = {"web": "pages", "text": "documents", "tables": "part"}
    sources = {k: mixed.filter(F.col("origin") == o) for k, o in parts.items()}
    return root, scan_catalog(i.spark, {**sources, "broken": failing, "unasked": mixed}, root, AS_OF, [*parts, "broken"])


@query(
    "src17_scan_pipeline",
    """select coalesce(c, 'total') as connector, count(*) as assets, false as failed
       from (select case origin when 'pages' then 'web' when 'documents' then 'text' else 'tables' end as c from mixed) group by rollup (c)
       union all select 'broken', 0, true""",
    ["mixed"],
)
def _(i):
    summary = _scan_pipeline(i)[1]
    return summary.select("connector", "assets", F.col("error").isNotNull().alias("failed"))


@query(
    "src17_scanned_catalog",
    f"""select distinct md5(concat(source, '-', location, '-', name)) as fingerprint, name, source, location,
          timestamp '{AS_OF}' as last_scanned, 'CREATED' as change_type from mixed""",
    ["mixed"],
)
def _(i):
    root = _scan_pipeline(i)[0]
    log = stream_history(i.spark, root).select(F.col("asset_fingerprint").alias("fingerprint"), "change_type")
    assets = snapshots.read_snapshot(i.spark, f"{root}/assets").select("fingerprint", "name", "source", "location", "last_scanned")
    return assets.join(log, "fingerprint")


# --- sinks -----------------------------------------------------------------------------------


@query("snk1_export_json", "select fingerprint, name, owner from catalog where is_active", ["catalog"])
def _(i):
    path = scratch_path(i.spark, "export")
    sinks.export_catalog(i.catalog(), path, "json", compression="gzip")
    return i.spark.read.json(path).select("fingerprint", "name", F.col("metadata.owner").alias("owner"))


@query("snk1_export_csv", "select fingerprint, name, owner from catalog where is_active", ["catalog"])
def _(i):
    path = scratch_path(i.spark, "export")
    sinks.export_catalog(i.catalog(), path, "csv", compression="gzip")
    back = i.spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("fingerprint", "name", F.get_json_object("metadata", "$.owner").alias("owner"))


@query(
    "snk3_snapshot",
    "select fingerprint, size + 1 as size from catalog",
    ["catalog"],
)
def _(i):
    root = scratch_path(i.spark, "snapshots")
    snapshots.write_snapshot(i.catalog().select("fingerprint", "size"), root)
    first = snapshots.read_snapshot(i.spark, root)
    snapshots.write_snapshot(first.withColumn("size", F.col("size") + 1), root)
    return snapshots.read_snapshot(i.spark, root)
