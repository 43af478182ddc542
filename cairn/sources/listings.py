"""Platform listing dumps to assets.

A dump is a table (platform, endpoint, payload) with one JSON object per listed thing.
Each platform is one rule; all rules are applied in a single narrow pass, with the JSON
parsed once into a VARIANT.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.classify import network_file_type, network_tags
from cairn.functions.display import parse_iso
from cairn.functions.expr import first_case
from cairn.operators.maintenance import moment
from cairn.schema import as_assets


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("_v", f"$.{path}", kind)


def _or(c: Column, default: object) -> Column:
    return F.coalesce(c, F.lit(default))


def _last(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _count(path: str) -> Column:
    return F.greatest(F.coalesce(F.size(get(path, "array<variant>")), F.lit(0)), F.lit(0))


def _epoch_ms(path: str) -> Column:
    ms = get(path, "bigint")
    return F.when(ms > 0, F.timestamp_millis(ms))




@dataclass(frozen=True)
class Rule:
    """How one platform's listing entry becomes an asset."""

    type: str
    name: Callable[[], Column]
    location: Callable[[], Column]
    keep: Callable[[], Column] = lambda: F.lit(True)
    size: Callable[[], Column] = lambda: F.lit(0)
    created: Callable[[], Column] = lambda: F.lit(None)
    type_of: Callable[[], Column] | None = None
    source: str | None = None
    extras: dict[str, Callable[[], Column]] = field(default_factory=dict)


def _paths(*names: str, **defaults: object) -> dict[str, Callable[[], Column]]:
    out: dict[str, Callable[[], Column]] = {n: (lambda n=n: get(n)) for n in names}
    out.update({n: (lambda n=n, d=d: _or(get(n), str(d))) for n, d in defaults.items()})
    return out


def _at(template: str, *parts: Callable[[], Column]) -> Callable[[], Column]:
    """Location from a template with %s for the endpoint and each part."""
    return lambda: F.format_string(template, *[p() for p in parts])


_e = lambda: F.col("endpoint")
_name = lambda: get("name")
_id = lambda: get("id")
_topic = lambda: get("topic")
_kind = lambda: get("object_type")

RULES: dict[str, Rule] = {
    "kafka": Rule(
        "kafka_topic",
        _topic,
        _at("kafka://%s/%s", _e, _topic),
        extras={
            "partitions": lambda: _count("partitions"),
            "replication_factor": lambda: _count("partitions[0].replicas"),
        },
    ),
    "pulsar": Rule(
        "pulsar_topic",
        lambda: _last(get("topic")),
        _at("pulsar://%s/%s", _e, _topic),
        size=lambda: get("stats.msgInCounter", "bigint"),
        extras={
            "full_topic_name": _topic,
            "producers": lambda: _count("stats.producers"),
            "subscriptions": lambda: F.array_join(F.json_object_keys(get("stats.subscriptions")), ","),
            "msg_in_rate": lambda: _or(get("stats.msgInRate"), "0"),
            "msg_out_rate": lambda: _or(get("stats.msgOutRate"), "0"),
        },
    ),
    "rabbitmq_queue": Rule(
        "rabbitmq_queue",
        _name,
        _at("rabbitmq://%s/%s", _e, _name),
        size=lambda: get("messages", "bigint"),
        created=lambda: _epoch_ms("created_at"),
        source="rabbitmq",
        extras=_paths(vhost="/", messages_ready=0, messages_unacknowledged=0, consumers=0, state="unknown"),
    ),
    "rabbitmq_exchange": Rule(
        "rabbitmq_exchange",
        _name,
        _at("rabbitmq://%s/exchanges/%s", _e, _name),
        keep=lambda: ~get("name").startswith("amq."),
        source="rabbitmq",
        extras=_paths(vhost="/", type="direct", durable="false", internal="false"),
    ),
    "kinesis": Rule(
        "kinesis_stream",
        lambda: get("StreamName"),
        _at("kinesis://%s/%s", _e, lambda: get("StreamName")),
        created=lambda: parse_iso(get("StreamCreationTimestamp")),
        extras={"status": lambda: _or(get("StreamStatus"), "UNKNOWN"), "shards": lambda: _count("Shards")},
    ),
    "eventhub": Rule(
        "eventhub_hub",
        _name,
        _at("eventhub://%s/%s", _e, _name),
        created=lambda: parse_iso(get("created_at")),
        extras=_paths(partition_count=0, message_retention_in_days=0),
    ),
    "servicebus_queue": Rule(
        "servicebus_queue",
        _name,
        _at("servicebus://%s/%s", _e, _name),
        created=lambda: parse_iso(get("created_at")),
        source="servicebus",
        extras={
            "resource_type": lambda: F.lit("queue"),
            **_paths("default_message_time_to_live", max_size_in_megabytes=0),
        },
    ),
    "servicebus_topic": Rule(
        "servicebus_topic",
        _name,
        _at("servicebus://%s/%s", _e, _name),
        created=lambda: parse_iso(get("created_at")),
        source="servicebus",
        extras={
            "resource_type": lambda: F.lit("topic"),
            **_paths("default_message_time_to_live", max_size_in_megabytes=0),
        },
    ),
    "pubsub": Rule(
        "pubsub_topic",
        lambda: _last(_name()),
        _at("pubsub://%s/%s", _e, lambda: _last(_name())),
        extras={"full_name": _name},
    ),
    "nats": Rule(
        "nats_subject",
        lambda: get("subject"),
        _at("nats://%s/%s", _e, lambda: get("subject")),
        extras={
            "server_version": lambda: _or(get("server.version"), "unknown"),
            "server_id": lambda: _or(get("server.server_id"), "unknown"),
        },
    ),
    "redis": Rule(
        "redis_stream",
        lambda: get("key"),
        _at("redis://%s/%s/%s", _e, lambda: _or(get("db"), "0"), lambda: get("key")),
        keep=lambda: get("type") == "stream",
        size=lambda: get("length", "bigint"),
        source="redis_streams",
        extras=_paths(length=0, groups=0),
    ),
    "salesforce": Rule(
        "salesforce_object",
        _name,
        _at("salesforce://%s.salesforce.com/%s", _e, _name),
        keep=lambda: get("queryable", "boolean") & ~get("name").endswith("__History"),
        extras=_paths("label", "custom", "createable"),
    ),
    "servicenow": Rule(
        "servicenow_table",
        _name,
        _at("servicenow://%s.service-now.com/%s", _e, _name),
        keep=lambda: (get("name") != "") & ~get("name").startswith("sys_"),
        extras=_paths(label="", super_class=""),
    ),
    "slack": Rule(
        "slack_channel",
        _name,
        _at("slack://workspace/%s", _id),
        size=lambda: get("num_members", "bigint"),
        created=lambda: F.timestamp_seconds(get("created", "bigint")),
        extras={
            **_paths(is_private="false", is_archived="false"),
            "purpose": lambda: _or(get("purpose.value"), ""),
            "topic": lambda: _or(get("topic.value"), ""),
        },
    ),
    "jira": Rule(
        "jira_project",
        lambda: get("key"),
        _at("jira://%s/projects/%s", _e, lambda: get("key")),
        extras={
            "name": _name,
            "project_type": lambda: get("projectTypeKey"),
            "lead": lambda: _or(get("lead.displayName"), ""),
        },
    ),
    "hubspot": Rule(
        "hubspot_object",
        _kind,
        _at("hubspot://api/crm/v3/objects/%s", _kind),
        keep=lambda: get("status", "int") == 200,
        size=lambda: get("total", "bigint"),
        extras={"object_type": _kind, "api_version": lambda: F.lit("v3")},
    ),
    "zendesk": Rule(
        "zendesk_field",
        lambda: get("title"),
        _at("zendesk://%s.zendesk.com/fields/%s", _e, _id),
        created=lambda: parse_iso(get("created_at")),
        extras={"field_type": lambda: get("type"), **_paths("active", required="false")},
    ),
    "google_analytics": Rule(
        "google_analytics_property",
        lambda: get("display_name"),
        _at("ga://property/%s", lambda: _last(_name())),
        created=lambda: parse_iso(get("create_time")),
        extras={"property_id": lambda: _last(_name()), **_paths("time_zone", "currency_code")},
    ),
    "mailchimp": Rule(
        "mailchimp_list",
        _name,
        _at("mailchimp://lists/%s", _id),
        size=lambda: get("stats.member_count", "bigint"),
        created=lambda: parse_iso(get("date_created")),
        extras={"list_id": _id, **_paths(permission_reminder="")},
    ),
    "workday": Rule(
        "workday_object",
        _kind,
        _at("workday://%s/%s", _e, _kind),
        keep=lambda: get("status", "int") == 200,
        size=lambda: get("total", "bigint"),
        extras={"object_type": _kind, "api_version": lambda: F.lit("v1")},
    ),
    "adp": Rule("adp_object", _kind, _at("adp://api/%s", _kind), extras={"object_type": _kind}),
    "quickbooks": Rule(
        "quickbooks_object", _kind, _at("quickbooks://company/%s/%s", _e, _kind), extras={"object_type": _kind}
    ),
    "teams": Rule(
        "teams_team",
        lambda: get("displayName"),
        _at("teams://team/%s", _id),
        created=lambda: parse_iso(get("createdDateTime")),
        source="microsoft_teams",
        extras={"team_id": _id, **_paths(description="", visibility="")},
    ),
    "tableau": Rule(
        "tableau",
        lambda: F.coalesce(get("name"), get("id"), get("kind")),
        _at("tableau://%s/%ss/%s", _e, lambda: get("kind"), lambda: _or(get("id"), "")),
        created=lambda: parse_iso(get("createdAt")),
        type_of=lambda: F.concat(F.lit("tableau_"), get("kind")),
        extras={"owner": lambda: _or(get("owner.name"), ""), **_paths(description="")},
    ),
    "power_bi": Rule(
        "powerbi_workspace",
        _name,
        _at("powerbi://workspace/%s", _id),
        extras={"workspace_id": _id, **_paths(type="", state="")},
    ),
    "databricks_notebook": Rule(
        "databricks_notebook",
        lambda: get("path"),
        _at("databricks://%s/notebook/%s", _e, lambda: get("path")),
        keep=lambda: get("object_type") == "NOTEBOOK",
        size=lambda: get("file_size", "bigint"),
        source="databricks",
        extras=_paths(language=""),
    ),
    "databricks_job": Rule(
        "databricks_job",
        lambda: F.coalesce(get("settings.name"), F.concat(F.lit("job_"), get("job_id"))),
        _at("databricks://%s/job/%s", _e, lambda: get("job_id")),
        source="databricks",
        extras={"tasks": lambda: _count("settings.tasks"), **_paths("job_id", creator_user_name="")},
    ),
    "hdfs": Rule(
        "hdfs_file",
        _name,
        _at("hdfs://%s%s/%s", _e, lambda: F.regexp_replace(_or(get("dir"), ""), "/+$", ""), _name),
        size=lambda: get("length", "bigint"),
        created=lambda: _epoch_ms("modificationTime"),
        type_of=lambda: F.when(get("type") == "DIRECTORY", "hdfs_directory").otherwise("hdfs_file"),
        extras=_paths("owner", "group", "permission", replication=0, blockSize=0),
    ),
}

# Object kinds of platforms whose objects are a fixed list (fixed values).
FIXED_OBJECTS = {
    "hubspot": ["contacts", "companies", "deals", "tickets", "products", "line_items"],
    "workday": [
        "workers",
        "organizations",
        "positions",
        "jobs",
        "compensation",
        "benefits",
        "time_tracking",
        "payroll",
    ],
    "adp": ["workers", "payroll", "time_cards", "benefits", "positions", "organizations"],
    "quickbooks": ["customers", "vendors", "items", "accounts", "invoices", "bills", "payments", "employees"],
}


def fixed_listing(spark: SparkSession, platform: str, endpoint: str = "") -> DataFrame:
    """The listing of a platform whose objects are known beforehand."""
    kinds = F.array(*[F.lit(k) for k in FIXED_OBJECTS[platform]])
    return spark.range(1).select(
        F.lit(platform).alias("platform"), F.lit(endpoint).alias("endpoint"), F.explode(kinds).alias("k")
    ).select("platform", "endpoint", F.to_json(F.struct(F.col("k").alias("object_type"))).alias("payload"))


def _asset(platform: str, rule: Rule, as_of: Column) -> Column:
    extras = [x for k, c in rule.extras.items() for x in (F.lit(k), c().cast("string"))]
    extras = [F.lit("platform_type"), F.lit(rule.source or platform), *extras]
    return F.when(
        F.coalesce(rule.keep(), F.lit(False)),
        F.struct(
            rule.name().alias("name"),
            (rule.type_of() if rule.type_of else F.lit(rule.type)).alias("type"),
            F.lit(rule.source or platform).alias("source"),
            rule.location().alias("location"),
            F.coalesce(rule.size().cast("bigint"), F.lit(0)).cast("bigint").alias("size"),
            F.coalesce(rule.created().cast("timestamp"), as_of).alias("created_date"),
            F.map_filter(F.create_map(*extras), lambda k, v: v.isNotNull()).alias("metadata"),
        ),
    )


def normalise_listing(df: DataFrame, as_of: str | Column, platforms: list[str] | None = None) -> DataFrame:
    """Assets of a listing dump; rows of unknown platforms or dropped by a rule vanish.

    Dropped rows leave as empty arrays of a generator.  A filter on the built asset would be
    pushed below the projection and parse the JSON once per field.
    """
    picked = platforms or list(RULES)
    now = moment(as_of)
    made = first_case([(F.col("platform") == p, _asset(p, RULES[p], now)) for p in picked], F.lit(None))
    return as_assets(
        df.filter(F.col("platform").isin(picked))
        .withColumn("_v", F.try_parse_json("payload"))
        .select(F.inline(F.array_compact(F.array(made))))
    )


def zoom_assets(users: DataFrame, as_of: str | Column) -> DataFrame:
    """One asset whose size is the number of listed users."""
    return as_assets(
        users.agg(F.count("*").alias("size")).select(
            F.lit("zoom_users").alias("name"),
            F.lit("zoom_users").alias("type"),
            F.lit("zoom").alias("source"),
            F.lit("zoom://users").alias("location"),
            "size",
            moment(as_of).alias("created_date"),
        )
    )


def azure_sql_assets(servers: DataFrame, as_of: str | Column) -> DataFrame:
    """servers: server_name, databases array<string>."""
    return as_assets(
        servers.select("server_name", F.explode("databases").alias("db")).select(
            F.col("db").alias("name"),
            F.lit("azure_sql_database").alias("type"),
            F.lit("azure_sql_database").alias("source"),
            F.concat("server_name", F.lit(".database.windows.net/"), "db").alias("location"),
            moment(as_of).alias("created_date"),
            F.lit(["azure", "sql_database", "relational"]).alias("tags"),
        )
    )


def cosmos_assets(accounts: DataFrame, as_of: str | Column) -> DataFrame:
    """accounts: account_name, databases array<struct<name, containers array<string>>>."""
    return as_assets(
        accounts.select("account_name", F.explode("databases").alias("d"))
        .select("account_name", F.col("d.name").alias("db"), F.explode("d.containers").alias("container"))
        .select(
            F.concat_ws(".", "db", "container").alias("name"),
            F.lit("azure_cosmos_container").alias("type"),
            F.lit("azure_cosmos_db").alias("source"),
            F.concat("account_name", F.lit(".documents.azure.com/"), "db", F.lit("/"), "container").alias("location"),
            moment(as_of).alias("created_date"),
            F.lit(["azure", "cosmos_db", "nosql"]).alias("tags"),
        )
    )


def _fields(line: str) -> Column:
    return F.split(F.trim(F.col(line)), r"\s+")


def _at_field(parts: str, i: int) -> Column:
    """Field i of a line, null where the line is shorter."""
    return F.get(F.col(parts), F.lit(i))


def _size_field(parts: str, i: int) -> Column:
    field_ = _at_field(parts, i)
    return F.when(field_.rlike(r"^\d+$"), F.coalesce(field_.try_cast("bigint"), F.lit(0))).otherwise(F.lit(0))


def hdfs_ls_assets(lines: DataFrame, column: str, namenode: str, as_of: str | Column) -> DataFrame:
    """Assets of recursive `ls` text lines: file or directory lines with eight fields or more."""
    p = lambda i: _at_field("_p", i)
    return as_assets(
        lines.filter(F.col(column).rlike("^[d-]"))
        .withColumn("_p", _fields(column))
        .filter(F.size("_p") >= 8)
        .select(
            _last(p(7)).alias("name"),
            F.when(p(0).startswith("d"), "hdfs_directory").otherwise("hdfs_file").alias("type"),
            F.lit("hdfs").alias("source"),
            F.concat(F.lit(f"hdfs://{namenode}"), p(7)).alias("location"),
            _size_field("_p", 4).alias("size"),
            moment(as_of).alias("created_date"),
            F.create_map(F.lit("owner"), p(2), F.lit("group"), p(3), F.lit("permissions"), p(0)).alias("metadata"),
        )
    )


def ftp_list_assets(
    lines: DataFrame,
    column: str,
    directory: str,
    host: str,
    as_of: str | Column,
    exts: list[str] | None = None,
    max_mb: int | None = None,
) -> DataFrame:
    """File assets of FTP LIST text lines; the name is everything from the ninth field on."""
    name = F.array_join(F.slice("_p", F.lit(9), F.greatest(F.size("_p") - 8, F.lit(0))), " ")
    files = (
        lines.withColumn("_p", _fields(column))
        .filter(F.size("_p") >= 9)
        .select(name.alias("name"), _size_field("_p", 4).alias("size"), _at_field("_p", 0).alias("mode"))
        .filter(~F.col("name").isin(".", "..") & F.col("mode").startswith("-"))
    )
    if max_mb is not None:
        files = files.filter(F.col("size") <= max_mb * 1024 * 1024)
    if exts:
        files = files.filter(F.lower("name").rlike("(" + "|".join(e.replace(".", r"\.") for e in exts) + ")$"))
    path = F.concat(F.lit(directory.rstrip("/") + "/"), "name")
    return as_assets(
        files.select(
            "name",
            network_file_type("name", F.lit("ftp")).alias("type"),
            F.lit("ftp").alias("source"),
            F.concat(F.lit(f"ftp://{host}"), path).alias("location"),
            "size",
            moment(as_of).alias("created_date"),
            network_tags("name", path, F.lit("ftp")).alias("tags"),
            F.create_map(F.lit("permissions"), F.col("mode")).alias("metadata"),
        )
    )


def network_file_assets(
    files: DataFrame, network: str, host: str, exts: list[str] | None = None, max_mb: int | None = None
) -> DataFrame:
    """Assets of an sftp, smb, nfs or nas listing (path, size, created_date, modified_date, is_directory)."""
    rows = files
    if "is_directory" not in files.columns:
        rows = rows.withColumn("is_directory", F.lit(False))
    keep_dirs = F.lit(network == "nas")
    good = F.lit(True) if max_mb is None else F.col("size") <= max_mb * 1024 * 1024
    name = _last(F.col("path"))
    if exts:
        good = good & F.lower("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in exts) + ")$")
    return as_assets(
        rows.filter((F.col("is_directory") & keep_dirs) | (~F.col("is_directory") & good)).select(
            name.alias("name"),
            F.when(F.col("is_directory"), "directory").otherwise(network_file_type(name, F.lit(network))).alias("type"),
            F.lit(network).alias("source"),
            F.concat(F.lit(f"{network}://{host}"), "path").alias("location"),
            F.when(F.col("is_directory"), 0).otherwise(F.col("size")).alias("size"),
            *[c for c in ("created_date", "modified_date") if c in files.columns],
            network_tags(name, "path", F.lit(network)).alias("tags"),
        )
    )
