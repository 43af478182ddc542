"""Queries: file and type classification, display functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import rules
from cairn.functions import classify as C
from cairn.functions import display as D
from cairn.plans.registry import query


def _case(value: str, table: dict[str, str], default: str) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in table.items())
    return f"case {value} {whens} else '{default}' end"


def any_of(value: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({value}, '{w}')" for w in words) + ")"


_LAST = r"regexp_extract(key, '([^/]*)$', 1)"
_SUFFIX = rf"regexp_extract({_LAST}, '^.+\.([^.]+)$', 1)"
_TAIL = r"regexp_extract(lower(key), '\.([^.]*)$', 1)"


@query(
    "src3_is_data_file",
    r"select file_id, regexp_matches(lower(key), '\.(csv|json|parquet|avro|orc|txt|tsv|xlsx|xml|yaml|yml)$') as data_file from files",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", C.is_data_file("key").alias("data_file"))


@query(
    "cls1_file_type",
    f"select file_id, {_case(f'lower({_SUFFIX})', rules.FILE_TYPES, 'data_file')} as file_type from files",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", C.file_type("key").alias("file_type"))


@query(
    "cls2_network_file_type",
    f"select file_id, 'sftp_' || {_case(_TAIL, rules.NETWORK_FILE_TYPES, 'data_file')} as file_type from files",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", C.network_file_type("key", F.lit("sftp")).alias("file_type"))


@query(
    "cls3_sftp_label",
    f"select file_id, {_case(f'lower({_SUFFIX})', rules.SFTP_LABELS, 'Data File')} as label from files",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", C.sftp_file_type("key").alias("label"))


@query(
    "cls4_azure_blob_type",
    f"select file_id, {_case(_TAIL, rules.AZURE_BLOB_TYPES, 'azure_data_file')} as blob_type from files",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", C.azure_blob_type("key").alias("blob_type"))


def _parts(expr: str, allowed: list[str], label: str) -> str:
    words = ", ".join(f"'{w}'" for w in allowed)
    return f"[ '{label}' || lower(p) for p in {expr} if lower(p) in ({words}) ]"


@query(
    "cls5_file_tags",
    f"""select file_id, array_to_string(list_concat(
          case when {_SUFFIX} <> '' then ['ext_' || {_SUFFIX}] else [] end,
          {_parts("string_split(key, '/')", rules.LOCAL_CATEGORIES, "category_")},
          [case when size < 1048576 then 'size_small' when size < 104857600 then 'size_medium' else 'size_large' end]
        ), ',') as tags from files""",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", F.array_join(C.file_tags("key", "size"), ",").alias("tags"))


@query(
    "cls6_network_tags",
    f"""select file_id, array_to_string(list_concat(['smb', 'network', 'remote'],
          case when contains(key, '.') then ['ext_' || {_TAIL}] else [] end,
          {_parts("string_split(lower(key), '/')", rules.NETWORK_CATEGORIES, "category_")},
          ['remote_file', 'network_storage']), ',') as tags from files""",
    ["files"],
)
def _(i):
    return i.projection("files").select(
        "file_id", F.array_join(C.network_tags("key", "key", F.lit("smb")), ",").alias("tags")
    )


@query(
    "cls7_blob_tags",
    f"""select file_id, array_to_string(list_concat(
          case when contains(key, '.') then ['ext_' || {_TAIL}] else [] end,
          {_parts("string_split(key, '/')[:-2]", rules.BLOB_FOLDERS, "folder_")}), ',') as tags from files""",
    ["files"],
)
def _(i):
    return i.projection("files").select("file_id", F.array_join(C.blob_tags("key"), ",").alias("tags"))


@query(
    "cls8_data_classification",
    """select origin, row_id, case when contains(lower(type), 'csv') or contains(lower(type), 'excel') then 'structured'
         when contains(lower(type), 'json') or contains(lower(type), 'xml') then 'semi-structured'
         when contains(lower(type), 'table') or contains(lower(type), 'database') then 'structured'
         when contains(lower(type), 'text') or contains(lower(type), 'log') then 'unstructured'
         else 'unknown' end as class from mixed""",
    ["mixed"],
)
def _(i):
    return i.projection("mixed").select("origin", "row_id", C.data_classification("type").alias("class"))


@query(
    "cls9_data_format",
    "select row_id, case "
    + " ".join(f"when contains(lower(type), '{k}') then '{v}'" for k, v in rules.DATA_FORMATS)
    + " else 'unknown' end as data_format from kw",
    ["kw"],
)
def _(i):
    return i.projection("kw").select("row_id", C.data_format("type").alias("data_format"))


@query(
    "cls10_estimated_value",
    f"""select origin, row_id, case when {any_of("lower(name || ' ' || location)", rules.HIGH_VALUE_WORDS)} then 'high'
          when {any_of("lower(name || ' ' || location)", rules.MEDIUM_VALUE_WORDS)} or size > 1000000 then 'medium'
          else 'low' end as estimated_value
        from (select origin, row_id, name, location, size from mixed
              union all select 'kw', row_id, name, location, size from kw)""",
    ["mixed", "kw"],
)
def _(i):
    both = (
        i.projection("mixed")
        .select("origin", "row_id", "name", "location", "size")
        .unionByName(i.projection("kw").select(F.lit("kw").alias("origin"), "row_id", "name", "location", "size"))
    )
    return both.select("origin", "row_id", C.estimated_value("name", "location", "size").alias("estimated_value"))


@query(
    "cls11_technical_flags",
    f"""select 'file' as kind, file_id as id, 'unknown' as data_format, 'utf-8' as encoding,
          case when {any_of("lower(key)", rules.COMPRESSED_MARKS)} then 'compressed' end as compression,
          case when {any_of("lower(key)", rules.PARTITION_MARKS)} then 'partitioned' end as partitioning from files
        union all
        select 'table', row_id, case """
    + " ".join(f"when contains(lower(type), '{k}') then '{v}'" for k, v in rules.DATA_FORMATS)
    + f""" else 'unknown' end, 'utf-8',
          case when {any_of("lower(name)", rules.COMPRESSED_MARKS)} then 'compressed' end,
          case when {any_of("lower(location)", rules.PARTITION_MARKS)} then 'partitioned' end from kw""",
    ["files", "kw"],
)
def _(i):
    files = i.projection("files").select(
        F.lit("file").alias("kind"),
        F.col("file_id").alias("id"),
        C.technical_flags(F.lit("object"), "key", "key").alias("f"),
    )
    tables = i.projection("kw").select(
        F.lit("table").alias("kind"),
        F.col("row_id").alias("id"),
        C.technical_flags("type", "name", "location").alias("f"),
    )
    return files.unionByName(tables).select("kind", "id", "f.*")


@query(
    "cls12_key_flags",
    """select fingerprint, bool_or(ordinal = 1) as has_primary_key,
         bool_or(lower(column_name) like '%\\_id' escape '\\') as has_foreign_keys,
         cast(count(*) as integer) as column_count
       from columns_long group by fingerprint""",
    ["columns_long"],
)
def _(i):
    return i.catalog().select("fingerprint", C.key_flags("columns").alias("k")).select("fingerprint", "k.*")


@query(
    "cls13_file_facts",
    r"""select origin, row_id, case when regexp_matches(name, '^.+\.([^.]+)$')
              then '.' || regexp_extract(name, '^.+\.([^.]+)$', 1) else '' end as file_extension,
          regexp_extract(loc, '^(.*)/[^/]*$', 1) as directory
        from (select origin, row_id, regexp_extract(location || '/' || name, '([^/]*)$', 1) as name,
                     location || '/' || name as loc, type from mixed)
        where contains(lower(type), 'file')""",
    ["mixed"],
)
def _(i):
    full = i.projection("mixed").withColumns(
        {
            "path": F.concat("location", F.lit("/"), "name"),
            "metadata": F.create_map(F.lit("origin"), F.col("origin")),
        }
    )
    return (
        full.select("origin", "row_id", C.file_facts("type", "path", "metadata").alias("f"))
        .filter("f is not null")
        .select("origin", "row_id", "f.file_extension", "f.directory")
    )


@query(
    "cls14_json_extras",
    "select event_id, props->>'$.k' as k, props->>'$.missing' as missing from events",
)
def _(i):
    return i.table("events").select(
        "event_id", C.json_extra("props", "k").alias("k"), C.json_extra("props", "missing").alias("missing")
    )


@query("cls14_metadata_get", "select fingerprint, owner, description from catalog", ["catalog"])
def _(i):
    return i.catalog().select(
        "fingerprint",
        C.metadata_get("metadata", "owner").alias("owner"),
        C.metadata_get("metadata", "description").alias("description"),
    )


_STEP = (
    "(case when size < 1024 then 0 when size < 1048576 then 1 when size < 1073741824 then 2 "
    "when size < 1099511627776 then 3 else 4 end)"
)


@query(
    "fn1_format_bytes",
    f"""select row_id, case when size = 0 then '0 Bytes' else
          regexp_replace(printf('%.2f', round(size / pow(1024.0, {_STEP}), 2)), '\\.?0+$', '') || ' ' ||
          ['Bytes', 'KB', 'MB', 'GB', 'TB'][{_STEP} + 1] end as shown
        from (select row_id, size from kw union all select file_id, size from files)""",
    ["kw", "files"],
)
def _(i):
    sizes = i.projection("kw").select("row_id", "size").unionAll(i.projection("files").select("file_id", "size"))
    return sizes.select("row_id", D.format_bytes("size").alias("shown"))


@query(
    "fn2_time_ago",
    """select event_id, case when s < 60 then 'Just now'
         when s < 3600 then (s // 60) || ' minute' || case when s // 60 > 1 then 's' else '' end || ' ago'
         when s < 86400 then (s // 3600) || ' hour' || case when s // 3600 > 1 then 's' else '' end || ' ago'
         else (s // 86400) || ' day' || case when s // 86400 > 1 then 's' else '' end || ' ago' end as ago
       from (select event_id, cast(floor((epoch_us(timestamp '2024-01-30 00:00:00') - epoch_us(ts)) / 1000000.0) as bigint) as s
             from events)""",
)
def _(i):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return i.table("events").select("event_id", D.time_ago("ts", now).alias("ago"))


@query(
    "fn3_parse_iso",
    """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as parsed from events""",
)
def _(i):
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return i.table("events").select(
        "event_id", F.date_format(D.parse_iso(iso), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


