"""File, type and structure classification of assets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn import rules
from cairn.functions.expr import ColumnLike, col, first_case, has_any, lits, lookup, low, text

_NO_TAGS = "array<string>"


def suffix(name: ColumnLike) -> Column:
    """Suffix without its dot, case kept; names such as `.profile` have none."""
    last = F.regexp_extract(text(name), r"([^/]*)$", 1)
    return F.regexp_extract(last, r"^.+\.([^.]+)$", 1)


def _tail(name: ColumnLike) -> Column:
    """What follows the last dot of the lower-cased string."""
    return F.regexp_extract(low(name), r"\.([^.]*)$", 1)


def is_data_file(name: ColumnLike) -> Column:
    return low(name).rlike(r"\.(" + "|".join(rules.DATA_FILE_SUFFIXES) + ")$")


def file_type(name: ColumnLike) -> Column:
    return lookup(rules.FILE_TYPES, F.lower(suffix(name)), F.lit("data_file"))


def network_file_type(name: ColumnLike, network: ColumnLike) -> Column:
    net = col(network)
    return F.concat(net, F.lit("_"), lookup(rules.NETWORK_FILE_TYPES, _tail(name), F.lit("data_file")))


def sftp_file_type(name: ColumnLike) -> Column:
    return lookup(rules.SFTP_LABELS, F.lower(suffix(name)), F.lit("Data File"))


def azure_blob_type(name: ColumnLike) -> Column:
    return lookup(rules.AZURE_BLOB_TYPES, _tail(name), F.lit("azure_data_file"))


def size_tag(size: ColumnLike) -> Column:
    mib = 1024 * 1024
    return first_case(
        [(col(size) < mib, "size_small"), (col(size) < 100 * mib, "size_medium")],
        "size_large",
    )


def _labelled(parts: Column, allowed: list[str], label: str) -> Column:
    wanted = lits(allowed)
    return F.transform(
        F.filter(parts, lambda p: F.array_contains(wanted, F.lower(p))),
        lambda p: F.concat(F.lit(label), F.lower(p)),
    )


def file_tags(path: ColumnLike, size: ColumnLike) -> Column:
    ext = suffix(path)
    return F.concat(
        F.when(ext != "", F.array(F.concat(F.lit("ext_"), ext))).otherwise(F.array().cast(_NO_TAGS)),
        _labelled(F.split(text(path), "/"), rules.LOCAL_CATEGORIES, "category_"),
        F.array(size_tag(size)),
    )


def _extension_tag(name: ColumnLike) -> Column:
    return F.when(
        text(name).contains("."), F.array(F.concat(F.lit("ext_"), _tail(name)))
    ).otherwise(F.array().cast(_NO_TAGS))


def network_tags(name: ColumnLike, path: ColumnLike, network: ColumnLike) -> Column:
    return F.concat(
        F.array(col(network), F.lit("network"), F.lit("remote")),
        _extension_tag(name),
        _labelled(F.split(low(path), "/"), rules.NETWORK_CATEGORIES, "category_"),
        lits(["remote_file", "network_storage"]),
    )


def blob_tags(name: ColumnLike) -> Column:
    parts = F.split(text(name), "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(_extension_tag(name), _labelled(folders, rules.BLOB_FOLDERS, "folder_"))


def data_classification(type_: ColumnLike) -> Column:
    t = low(type_)
    return first_case([(has_any(t, words), label) for words, label in rules.DATA_CLASSES], "unknown")


def data_format(type_: ColumnLike) -> Column:
    t = low(type_)
    return first_case([(t.contains(key), label) for key, label in rules.DATA_FORMATS], "unknown")


def estimated_value(name: ColumnLike, location: ColumnLike, size: ColumnLike) -> Column:
    both = F.concat(low(name), F.lit(" "), low(location))
    return first_case(
        [
            (has_any(both, rules.HIGH_VALUE_WORDS), "high"),
            (has_any(both, rules.MEDIUM_VALUE_WORDS) | (F.coalesce(col(size), F.lit(0)) > 1_000_000), "medium"),
        ],
        "low",
    )


def compression(name: ColumnLike) -> Column:
    return F.when(has_any(low(name), rules.COMPRESSED_MARKS), "compressed")


def partitioning(location: ColumnLike) -> Column:
    return F.when(has_any(low(location), rules.PARTITION_MARKS), "partitioned")


def technical_flags(type_: ColumnLike, name: ColumnLike, location: ColumnLike) -> Column:
    return F.struct(
        data_format(type_).alias("data_format"),
        F.lit("utf-8").alias("encoding"),
        compression(name).alias("compression"),
        partitioning(location).alias("partitioning"),
    )


def key_flags(columns: ColumnLike) -> Column:
    c = col(columns)
    return F.struct(
        F.coalesce(F.exists(c, lambda x: F.coalesce(x["primary_key"], F.lit(False))), F.lit(False)).alias(
            "has_primary_key"
        ),
        F.coalesce(F.exists(c, lambda x: F.lower(x["name"]).endswith("_id")), F.lit(False)).alias(
            "has_foreign_keys"
        ),
        F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).alias("column_count"),
    )


def file_facts(type_: ColumnLike, location: ColumnLike, metadata: ColumnLike) -> Column:
    """Extension, directory and permissions; null unless the type is a file type."""
    ext = suffix(location)
    return F.when(
        low(type_).contains("file"),
        F.struct(
            F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("").alias("file_extension"),
            F.regexp_extract(text(location), r"^(.*)/[^/]*$", 1).alias("directory"),
            F.element_at(col(metadata), "permissions").alias("permissions"),
        ),
    )


def metadata_get(metadata: ColumnLike, key: str) -> Column:
    """An extra from a metadata map, or null."""
    return F.element_at(col(metadata), key)


def json_extra(payload: ColumnLike, key: str) -> Column:
    """A top-level extra from a JSON text, or null."""
    return F.get_json_object(col(payload), f"$.{key}")
