"""Keeping the catalog current: keys, upserts, history, relationships.

All joins are equi-joins on a key and carry no broadcast hint: Spark broadcasts a side
only when its measured size allows it, and splits skewed partitions at run time.  Groups
are reduced with partial aggregates, so a hot key is shrunk before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions.expr import ColumnLike, as_json, from_text, packed, text, unpacked

REFRESHED = ["name", "type", "source", "location", "size", "modified_date", "columns", "num_rows", "tags", "metadata"]


def moment(as_of: str | Column) -> Column:
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def fingerprint(source: ColumnLike, location: ColumnLike, name: ColumnLike) -> Column:
    return F.md5(F.concat(text(source), F.lit("-"), text(location), F.lit("-"), text(name)))


def with_fingerprint(df: DataFrame) -> DataFrame:
    """Add the key; one the asset already carries (itself or in its metadata) is kept."""
    made = fingerprint("source", "location", "name")
    carried = []
    if "fingerprint" in df.columns:
        carried.append(F.nullif(F.col("fingerprint"), F.lit("")))
    if "metadata" in df.columns:
        carried.append(F.nullif(F.element_at("metadata", "asset_fingerprint"), F.lit("")))
    return df.withColumn("fingerprint", F.coalesce(*carried, made))


def dedupe_batch(df: DataFrame, order_col: str) -> DataFrame:
    """One row per fingerprint: the last one wins, the first one's created_date stays.

    max_by/min_by are partial aggregates: a fingerprint repeated in a third of the rows
    leaves each task as a single row.
    """
    body = [c for c in df.columns if c != "fingerprint"]
    tie = F.struct(F.col(order_col), F.xxhash64(*[F.col(c).cast("string") for c in ("name", "type", "location")]))
    rolled = df.groupBy("fingerprint").agg(
        F.max_by(F.struct(*body), tie).alias("last"),
        F.min_by("created_date", tie).alias("first_created"),
    )
    return rolled.select(
        "fingerprint",
        *[F.col("first_created").alias(c) if c == "created_date" else F.col(f"last.{c}").alias(c) for c in body],
    )


def upsert_assets(current: DataFrame, batch: DataFrame, as_of: str | Column, part: Column | None = None) -> DataFrame:
    """New assets are inserted, known ones refreshed; created and discovered dates are kept.

    One full outer join on the key.  `batch` holds at most one row per fingerprint
    (see dedupe_batch).  With `part`, an expression of the key, the same rows come in the order of it and
    of the key, with it in a column `_part`: what is written by parts next need not move again.
    """
    if part is not None:
        return _upserted_in_order(current, batch, moment(as_of), part)
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    out = _refreshed(current, batch, old, new, old("fingerprint").isNull(), new("fingerprint").isNotNull(), moment(as_of))
    joined = current.alias("old").join(batch.alias("new"), old("fingerprint") == new("fingerprint"), "full_outer")
    return joined.select(F.coalesce(old("fingerprint"), new("fingerprint")).alias("fingerprint"), *out).select(current.columns)


def _refreshed(
    current: DataFrame,
    batch: DataFrame,
    old: Callable[[str], Column],
    new: Callable[[str], Column],
    is_new: Column,
    seen: Column,
    now: Column,
) -> list[Column]:
    """All columns but the key, from what the two sides hold."""
    out = []
    for name in current.columns:
        if name == "fingerprint":
            continue
        if name in REFRESHED:
            c = F.when(seen, new(name)).otherwise(old(name))
        elif name == "discovered_date":
            c = F.when(is_new, now).otherwise(old(name))
        elif name == "last_scanned":
            c = F.when(seen, now).otherwise(old(name))
        elif name == "is_active":
            c = F.when(seen, F.lit(True)).otherwise(old(name))
        elif name in batch.columns:
            c = F.when(is_new, new(name)).otherwise(old(name))
        else:
            c = old(name)
        out.append(c.alias(name))
    return out


def _flat_structs(kind: T.DataType) -> bool:
    plain = (T.StringType, T.IntegerType, T.LongType, T.BooleanType)
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    return nested and all(type(f.dataType) in plain for f in kind.elementType.fields)


def _upserted_in_order(current: DataFrame, batch: DataFrame, now: Column, part: Column) -> DataFrame:
    """The join as one order of all rows: those of a key stand together, and only what known assets keep is told across.

    A null key matches nothing, and repeated keys give every pair, as in the join.  Arrays of structs move and are
    sorted as text.
    """
    folded = {f.name: f.dataType for f in current.schema.fields if f.name in batch.columns and _flat_structs(f.dataType)}
    folded = {c: kind for c, kind in folded.items() if batch.schema[c].dataType == kind}
    kept = [c for c in current.columns if c not in [*REFRESHED, "fingerprint"]]
    stood = current.withColumn("_new", F.lit(False))
    came = batch.select([c for c in current.columns if c in batch.columns]).withColumn("_new", F.lit(True))
    is_batch, keyed = F.col("_new"), F.col("fingerprint").isNotNull()
    group = Window.partitionBy("_part", "fingerprint")
    both = stood.unionByName(came, allowMissingColumns=True)
    for c in folded:
        told, rest = as_json(c)
        both = both.withColumns({f"_text_{c}": told, c: rest})
    rows = (
        both.withColumn("_part", part)
        .repartitionByRange("_part", "fingerprint")
        .withColumn("_seen", F.bool_or("_new").over(group) & keyed)
        .withColumn("_old", F.collect_list(F.when(F.col("_seen") & ~is_batch, F.struct(*kept))).over(group))
        .filter(is_batch | ~F.col("_seen"))
        .withColumn("_old", F.explode_outer(F.when(is_batch & keyed, F.col("_old"))))
        .sortWithinPartitions("_part", "fingerprint")  # after the last step that might change it
    )

    def whole(name: str) -> Column:
        return from_text(f"_text_{name}", name, folded[name]) if name in folded else F.col(name)

    def old(name: str) -> Column:
        own = F.when(~is_batch, whole(name))
        return F.coalesce(own, F.col(f"_old.{name}")) if name in kept else own

    def new(name: str) -> Column:
        return F.when(is_batch, whole(name))

    is_new = F.when(is_batch, F.col("_old").isNull()).otherwise(~keyed)
    out = _refreshed(current, batch, old, new, is_new, is_batch & keyed, now)
    return rows.select("fingerprint", *out, "_part").select(*current.columns, "_part")


def change_log(current: DataFrame, batch: DataFrame, as_of: str | Column, only_changed: bool = False) -> DataFrame:
    """CREATED or UPDATED records for a batch.

    Every rescan is logged; with only_changed=True a known asset is logged only if a
    refreshed field differs.
    """
    old, new = current.alias("old"), batch.alias("new")
    known = F.col("old.fingerprint").isNotNull()
    joined = new.join(old, F.col("old.fingerprint") == F.col("new.fingerprint"), "left")
    if only_changed:
        same = F.lit(True)
        for name in REFRESHED:
            if name in batch.columns and name in current.columns:
                o, n = F.col(f"old.{name}"), F.col(f"new.{name}")
                if name == "metadata":
                    o, n = F.array_sort(F.map_entries(o)), F.array_sort(F.map_entries(n))
                same = same & o.eqNullSafe(n)
        joined = joined.filter(~known | ~same)
    whole = F.to_json(F.struct(*[F.col(f"new.{c}").alias(c) for c in batch.columns]))
    return joined.select(
        F.col("new.fingerprint").alias("asset_fingerprint"),
        F.when(known, "UPDATED").otherwise("CREATED").alias("change_type"),
        moment(as_of).alias("change_date"),
        F.when(known, F.to_json(F.col("old.metadata"))).alias("old_values"),
        F.when(known, F.to_json(F.col("new.metadata"))).otherwise(whole).alias("new_values"),
    )


def deactivate(assets: DataFrame, fingerprints: DataFrame, as_of: str | Column) -> tuple[DataFrame, DataFrame]:
    """(assets with the listed ones inactive, DEACTIVATED records).

    A record is written for every listed key, also for one the catalog does not hold.
    """
    listed = fingerprints.select(F.col("fingerprint").alias("gone")).distinct()
    kept = (
        assets.join(listed, F.col("fingerprint") == F.col("gone"), "left")
        .withColumn("is_active", F.when(F.col("gone").isNotNull(), F.lit(False)).otherwise(F.col("is_active")))
        .drop("gone")
    )
    log = listed.select(
        F.col("gone").alias("asset_fingerprint"),
        F.lit("DEACTIVATED").alias("change_type"),
        moment(as_of).alias("change_date"),
        F.lit(None).cast("string").alias("old_values"),
        F.lit(None).cast("string").alias("new_values"),
    )
    return kept, log


def get_by_fingerprint(assets: DataFrame, key: str) -> DataFrame:
    return assets.filter((F.col("fingerprint") == key) & F.col("is_active"))


def vanished(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Active assets of a scanned source that the scan did not return."""
    scanned = batch.select("source").distinct()
    return (
        current.filter("is_active")
        .join(scanned, "source", "left_semi")
        .join(batch.select("fingerprint"), "fingerprint", "left_anti")
    )


def asset_history(history: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Change records of one asset, newest first, JSON decoded into maps; a top-k where a limit is given."""
    decoded = "map<string,string>"
    records = history.filter(F.col("asset_fingerprint") == key).orderBy(
        F.desc("change_date"), F.desc("change_type"), F.desc("new_values")
    )
    if limit is not None:
        records = records.limit(limit)
    return records.withColumns({c: F.from_json(F.col(c), decoded) for c in ("old_values", "new_values")})


def purge_history(history: DataFrame, days: int, as_of: str | Column) -> DataFrame:
    cutoff = moment(as_of) - F.make_dt_interval(days=F.lit(days))
    return history.filter(F.col("change_date") >= cutoff)


def relationship_id(source: ColumnLike, target: ColumnLike, kind: ColumnLike) -> Column:
    return F.concat(relationship_start(text(source), text(target)), text(kind))


def relationship_start(source: ColumnLike, target: ColumnLike) -> Column:
    """What the id of a relationship begins with; null without either end."""
    return F.concat(source, F.lit("-"), target, F.lit("-"))


def upsert_relationships(current: DataFrame, new: DataFrame) -> DataFrame:
    """Replace on the same id, insert otherwise; rows without a required field are dropped.

    Within the new rows the latest created_at wins.
    """
    optional = {"description": F.lit(""), "created_by": F.lit("user")}
    ready = new.filter(
        F.col("source_asset").isNotNull()
        & F.col("target_asset").isNotNull()
        & F.col("relationship_type").isNotNull()
        & F.col("confidence").isNotNull()
    ).withColumn("id", relationship_id("source_asset", "target_asset", "relationship_type"))
    for name, default in optional.items():
        ready = ready.withColumn(name, F.coalesce(F.col(name), default) if name in new.columns else default)
    body = [c for c in current.columns if c != "id"]
    latest = (
        ready.groupBy("id")
        .agg(F.max_by(F.struct(*body), F.struct("created_at", "confidence", "description", "created_by")).alias("r"))
        .select("id", *[F.col(f"r.{c}").alias(c) for c in body])
    )
    return current.join(latest.select("id"), "id", "left_anti").select(current.columns).unionByName(latest)


def relationships_named(rel: DataFrame, assets: DataFrame) -> DataFrame:
    """Relationships with the names of both ends; an unknown end shows its id.

    Every row moves once for each end, so it moves without what can be told again: keys are packed, and an id
    that begins with its ends (see relationship_id) leaves them out.  Any other id moves whole.
    """
    ends = ["source_asset", "target_asset"]
    start = relationship_start(*ends)
    out, short, whole = rel.columns, {}, {}
    if dict(rel.dtypes).get("id") == "string":
        rest = F.substr("id", F.length(start) + 1)
        told = F.concat(start, rest) == F.col("id")
        short = {"_rest": F.when(told, rest), "id": F.when(told, None).otherwise(F.col("id"))}
        whole = {"id": F.coalesce(F.concat(start, "_rest"), "id")}
    known = assets.select(packed("fingerprint").alias("_key"), "name")
    s = known.select(F.col("_key").alias("source_asset"), F.col("name").alias("_s"))
    t = known.select(F.col("_key").alias("target_asset"), F.col("name").alias("_t"))
    return (
        rel.withColumns(short | {c: packed(c) for c in ends})
        .join(s, "source_asset", "left")
        .join(t, "target_asset", "left")
        .withColumns({c: unpacked(c) for c in ends})
        .withColumns(whole)
        .select(
            *out,
            F.coalesce("_s", "source_asset").alias("source_name"),
            F.coalesce("_t", "target_asset").alias("target_name"),
        )
    )


def newest_relationships(rel: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; with a limit this is a top-k."""
    ordered = rel.orderBy(F.desc("created_at"), "id")
    return ordered if limit is None else ordered.limit(limit)


def delete_relationships(rel: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what is left, id and whether it was found)."""
    asked = ids.select("id").distinct()
    found = asked.join(rel.select("id", F.lit(True).alias("found")), "id", "left").select(
        "id", F.coalesce("found", F.lit(False)).alias("deleted")
    )
    return rel.join(asked, "id", "left_anti"), found


def relationships_of(rel: DataFrame, key: str) -> DataFrame:
    return rel.filter((F.col("source_asset") == key) | (F.col("target_asset") == key)).withColumn(
        "direction", F.when(F.col("target_asset") == key, "upstream").otherwise("downstream")
    )
