"""Queries: keys, upserts, history, relationships, masking."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.masking import mask_map
from cairn.operators import maintenance as M
from cairn.operators import snapshots as P
from cairn.plans.fixtures import AS_OF
from cairn.plans.registry import query
from cairn.schema import ASSETS, as_assets
from cairn.session import scratch_path
from cairn.streaming.ingest import snapshot_diff

# The catalog as it stood at the end of 1999, and a later scan of everything made since 1998
# (with grown sizes): together they cover the whole table and overlap on two years.
STOOD = "2000-01-01 00:00:00"
SCANNED = "1998-01-01 00:00:00"


def stood(i):
    return i.catalog().filter(F.col("created_date") < F.lit(STOOD).cast("timestamp")).drop("row_id", "owner_id")


def scanned(i):
    return (
        i.catalog()
        .filter(F.col("created_date") >= F.lit(SCANNED).cast("timestamp"))
        .withColumns(
            {
                "size": F.when(F.col("row_id") % 2 == 0, F.col("size") + 1).otherwise(F.col("size")),
                "created_date": F.lit("2001-01-01").cast("timestamp"),
            }
        )
        .drop("row_id", "owner_id")
    )


_STOOD = f"stood as (select * from catalog where created_date < timestamp '{STOOD}')"
_SCANNED = f"""scanned as (select * replace (case when row_id % 2 = 0 then size + 1 else size end as size,
   timestamp '2001-01-01' as created_date) from catalog where created_date >= timestamp '{SCANNED}')"""
_TS = "yyyy-MM-dd HH:mm:ss"


def ts(c):
    return F.date_format(c, _TS)


def sql_ts(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query(
    "cat1_fingerprint",
    """select origin, row_id, md5(coalesce(source, '') || '-' || coalesce(location, '') || '-' || coalesce(name, ''))
         as fingerprint from mixed""",
    ["mixed"],
)
def _(i):
    return M.with_fingerprint(i.projection("mixed")).select("origin", "row_id", "fingerprint")


@query(
    "cat2_dedupe_batch",
    f"""with seen as (select md5(bucket || '-' || event_type || '-' || 'x') as fingerprint, bucket, event_type, file_id, size,
                 modified_date from (select f.*, e.event_type from files f join events e on e.event_id = f.file_id))
        select fingerprint, arg_max(size, file_id) as size, {sql_ts("arg_min(modified_date, file_id)")} as created_date,
          {sql_ts("arg_max(modified_date, file_id)")} as modified_date, max(file_id) as seq
        from seen group by fingerprint""",
    ["files"],
)
def _(i):
    kinds = i.table("events").select(F.col("event_id").alias("file_id"), "event_type")
    batch = i.projection("files").join(kinds, "file_id").select(
        F.lit("x").alias("name"),
        F.lit("file").alias("type"),
        F.col("bucket").alias("source"),
        F.col("event_type").alias("location"),
        "size",
        F.col("modified_date").alias("created_date"),
        "modified_date",
        F.col("file_id").alias("seq"),
    )
    return M.dedupe_batch(M.with_fingerprint(batch), "seq").select(
        "fingerprint",
        "size",
        ts("created_date").alias("created_date"),
        ts("modified_date").alias("modified_date"),
        "seq",
    )


_UPSERTED = f"""with {_STOOD}, {_SCANNED}
        select coalesce(o.fingerprint, n.fingerprint) as fingerprint, coalesce(n.name, o.name) as name,
          coalesce(n.size, o.size) as size,
          {sql_ts("case when o.fingerprint is null then n.created_date else o.created_date end")} as created_date,
          {sql_ts(f"case when o.fingerprint is null then timestamp '{AS_OF}' else o.discovered_date end")} as discovered_date,
          {sql_ts(f"case when n.fingerprint is not null then timestamp '{AS_OF}' else o.last_scanned end")} as last_scanned,
          case when n.fingerprint is not null then true else o.is_active end as is_active
        from stood o full join scanned n on o.fingerprint = n.fingerprint"""


def _dated(assets):
    dates = [ts(c).alias(c) for c in ("created_date", "discovered_date", "last_scanned")]
    return assets.select("fingerprint", "name", "size", *dates, "is_active")


@query("cat3_upsert_assets", _UPSERTED, ["catalog"])
def _(i):
    return _dated(M.upsert_assets(stood(i), scanned(i), AS_OF))


def _stored(i, assets, parts: int = 8) -> str:
    """The assets as a stored catalog of its own."""
    root = scratch_path(i.spark, "stored")
    P.write_snapshot(as_assets(assets), root, parts=parts)
    return root


@query("snk3_part_upsert", _UPSERTED, ["catalog"])
def _(i):
    root, batch = _stored(i, stood(i)), as_assets(scanned(i))
    P.update_snapshot(batch, root, lambda current, part: M.upsert_assets(current, batch, AS_OF, part), ASSETS, in_order=True)
    return _dated(P.read_snapshot(i.spark, root))


def _log(df):
    return df.select(
        "asset_fingerprint",
        "change_type",
        ts("change_date").alias("change_date"),
        F.get_json_object("old_values", "$.owner").alias("old_owner"),
        F.coalesce(
            F.get_json_object("new_values", "$.owner"), F.get_json_object("new_values", "$.metadata.owner")
        ).alias("new_owner"),
    )


@query(
    "cat4_change_log",
    f"""with {_STOOD}, {_SCANNED}
        select n.fingerprint as asset_fingerprint, case when o.fingerprint is null then 'CREATED' else 'UPDATED' end as change_type,
          '{AS_OF}' as change_date, o.owner as old_owner, n.owner as new_owner
        from scanned n left join stood o on o.fingerprint = n.fingerprint""",
    ["catalog"],
)
def _(i):
    return _log(M.change_log(stood(i), scanned(i), AS_OF))


@query(
    "cat4_change_log_only_changed",
    f"""with {_STOOD}, {_SCANNED}
        select n.fingerprint as asset_fingerprint, case when o.fingerprint is null then 'CREATED' else 'UPDATED' end as change_type,
          '{AS_OF}' as change_date, o.owner as old_owner, n.owner as new_owner
        from scanned n left join stood o on o.fingerprint = n.fingerprint
        where o.fingerprint is null or o.size <> n.size""",
    ["catalog"],
)
def _(i):
    return _log(M.change_log(stood(i), scanned(i), AS_OF, only_changed=True))


_GONE = """gone as (select fingerprint from catalog where size > 400000000
                  union select md5(cast(user_id as varchar)) from events)"""

_LEFT = f"""with {_GONE}
        select fingerprint, case when fingerprint in (select fingerprint from gone) then false else is_active end as is_active
        from catalog"""


def _gone(i):
    unknown = i.table("events").select(F.md5(F.col("user_id").cast("string")).alias("fingerprint"))
    return i.catalog().filter("size > 400000000").select("fingerprint").unionAll(unknown)


@query("cat5_deactivate", _LEFT, ["catalog"])
def _(i):
    return M.deactivate(i.catalog(), _gone(i), AS_OF)[0].select("fingerprint", "is_active")


@query(
    "cat5_deactivate_log",
    f"""with {_GONE}
        select fingerprint as asset_fingerprint, 'DEACTIVATED' as change_type, '{AS_OF}' as change_date from gone""",
    ["catalog"],
)
def _(i):
    log = M.deactivate(i.catalog(), _gone(i), AS_OF)[1]
    return log.select("asset_fingerprint", "change_type", ts("change_date").alias("change_date"))


@query("snk3_part_deactivate", _LEFT, ["catalog"])
def _(i):
    root, gone = _stored(i, i.catalog()), _gone(i)
    P.update_snapshot(gone, root, lambda current: M.deactivate(current, gone, AS_OF)[0], ASSETS)
    P.expire_snapshots(i.spark, root, keep=1)
    return P.read_snapshot(i.spark, root).select("fingerprint", "is_active")


@query(
    "snk3_find",
    """select fingerprint, name, size, owner from catalog where fingerprint = (select min(fingerprint) from catalog)""",
    ["catalog"],
)
def _(i):
    key = i.catalog().agg(F.min("fingerprint")).first()[0]
    found = P.find_in_snapshot(i.spark, _stored(i, i.catalog()), key)
    return found.select("fingerprint", "name", "size", F.col("metadata.owner").alias("owner"))


@query(
    "cat6_get_by_fingerprint",
    """select fingerprint, name, size from catalog where is_active
         and fingerprint = (select min(fingerprint) from catalog where is_active)""",
    ["catalog"],
)
def _(i):
    assets = i.catalog()
    key = assets.filter("is_active").agg(F.min("fingerprint")).first()[0]
    return M.get_by_fingerprint(assets, key).select("fingerprint", "name", "size")


@query(
    "cat7_vanished",
    f"""with {_STOOD}, {_SCANNED}
        select fingerprint, source from stood where is_active and source in (select source from scanned)
          and fingerprint not in (select fingerprint from scanned)""",
    ["catalog"],
)
def _(i):
    return M.vanished(stood(i), scanned(i)).select("fingerprint", "source")


def _history(i):
    return i.projection("changes").select(
        "asset_fingerprint", "change_type", "change_date", F.lit(None).cast("string").alias("old_values"), "new_values"
    )


@query(
    "cat8_asset_history",
    f"""select asset_fingerprint, change_type, {sql_ts("change_date")} as change_date, new_values->>'$.k' as k
        from changes where asset_fingerprint = md5('7')
        order by changes.change_date desc, change_type desc, new_values desc""",
    ["changes"],
)
def _(i):
    import hashlib

    return M.asset_history(_history(i), hashlib.md5(b"7").hexdigest()).select(
        "asset_fingerprint", "change_type", ts("change_date").alias("change_date"), F.col("new_values.k").alias("k")
    )


@query(
    "cat9_purge_history",
    """select event_id from changes where change_date >= timestamp '2024-01-30' - interval 20 day""",
    ["changes"],
)
def _(i):
    return M.purge_history(i.projection("changes"), 20, "2024-01-30 00:00:00").select("event_id")


def _declared(i):
    """Edges stored so far, and a later delivery that repeats some of them with another confidence."""
    rel = i.asset_relationships()
    cut = F.lit("1999-01-01").cast("timestamp")
    stored = rel.filter(F.col("created_at") < cut)
    again = rel.filter(F.col("created_at") >= F.lit("1997-06-01").cast("timestamp")).withColumns(
        {
            "confidence": F.when(F.col("confidence") < 1, F.col("confidence") / 2),
            "description": F.lit(None).cast("string"),
        }
    )
    return stored, again


@query(
    "cat10_upsert_relationships",
    """with stored as (select id, confidence, description, created_by from asset_rel where created_at < timestamp '1999-01-01'),
         again as (select id, confidence / 2 as confidence, '' as description, 'user' as created_by from asset_rel
                   where created_at >= timestamp '1997-06-01' and confidence < 1)
       select id, round(confidence, 4) as confidence, description, created_by from again
       union all select id, round(confidence, 4), description, created_by from stored where id not in (select id from again)""",
    ["asset_rel"],
)
def _(i):
    stored, again = _declared(i)
    return M.upsert_relationships(stored, again).select(
        "id", F.round("confidence", 4).alias("confidence"), "description", "created_by"
    )


@query(
    "cat11_relationships_named",
    """select r.id, coalesce(s.name, r.source_asset) as source_name, coalesce(t.name, r.target_asset) as target_name
       from (select id, source_asset, target_asset from asset_rel union all select id, source_asset, target_asset from relationships) r
       left join catalog s on s.fingerprint = r.source_asset left join catalog t on t.fingerprint = r.target_asset""",
    ["asset_rel", "relationships"],
)
def _(i):
    ends = ["id", "source_asset", "target_asset"]
    unknown = i.projection("relationships").select(ends)  # ends that the catalog does not hold
    declared = i.asset_relationships().select(ends).unionAll(unknown)
    return M.relationships_named(declared, i.catalog()).select("id", "source_name", "target_name")


@query(
    "cat11_newest_relationships",
    f"""select id, {sql_ts("created_at")} as created_at from asset_rel
        order by asset_rel.created_at desc, id limit 50""",
    ["asset_rel"],
)
def _(i):
    return M.newest_relationships(i.asset_relationships(), 50).select("id", ts("created_at").alias("created_at"))


_DROP = "select id from relationships where relationship_type = 'joins_with' union all select 'nothing-' || n_name from nation"


def _drop(i):
    return (
        i.projection("relationships")
        .filter("relationship_type = 'joins_with'")
        .select("id")
        .unionAll(i.table("nation").select(F.concat(F.lit("nothing-"), "n_name").alias("id")))
    )


@query(
    "cat12_delete_relationships",
    f"select id from relationships where id not in ({_DROP})",
    ["relationships"],
)
def _(i):
    return M.delete_relationships(i.projection("relationships"), _drop(i))[0].select("id")


@query(
    "cat12_delete_reported",
    f"""with asked as (select distinct id from ({_DROP}))
        select id, id in (select id from relationships) as deleted from asked""",
    ["relationships"],
)
def _(i):
    return M.delete_relationships(i.projection("relationships"), _drop(i))[1]


@query(
    "cat13_relationships_of",
    """select id, case when target_asset = 'nation:7' then 'upstream' else 'downstream' end as direction from relationships
       where source_asset = 'nation:7' or target_asset = 'nation:7'""",
    ["relationships"],
)
def _(i):
    return M.relationships_of(i.projection("relationships"), "nation:7").select("id", "direction")


@query(
    "cat14_mask_map",
    """select fingerprint, owner, left(api_key, 4) || repeat('*', length(api_key) - 8) || right(api_key, 4) as api_key,
         description from catalog""",
    ["catalog"],
)
def _(i):
    m = F.col("m")
    return (
        i.catalog()
        .withColumn("m", mask_map("metadata"))
        .select(
            "fingerprint",
            F.element_at(m, "owner").alias("owner"),
            F.element_at(m, "api_key").alias("api_key"),
            F.element_at(m, "description").alias("description"),
        )
    )


@query(
    "str5_snapshot_diff",
    f"""with {_STOOD}, {_SCANNED}
        select coalesce(o.fingerprint, n.fingerprint) as fingerprint,
          case when o.fingerprint is null then 'added' when n.fingerprint is null then 'removed' else 'changed' end as change
        from stood o full join scanned n on o.fingerprint = n.fingerprint
        where o.fingerprint is null or n.fingerprint is null or o.size <> n.size""",
    ["catalog"],
)
def _(i):
    return snapshot_diff(stood(i), scanned(i))
