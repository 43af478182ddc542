"""Versioned tables cut into parts: a version replaces only the parts that a change touches.

A table is a folder.  Rows are dealt to a fixed number of parts by the hash of their key, each part
is a folder of files of its own, and a version is a manifest: a small file that names the folder of each
part.  A change writes the touched parts anew, beside the old ones, and is committed when the next
manifest is put in place, which only one writer can do.  Readers see whole versions only.

    <root>/_manifests/00000002.json      the version: folder of each part, schema, last batch of each stream
    <root>/data/<write>/_part=<k>/...    the files of part k that one write made

The driver handles numbers and names of parts, never rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a new table.  A part is rewritten as a whole, so choose it to be of the size of a file.
PARTS = 16
ATTEMPTS = 5
_PART = "_part"


class Conflict(RuntimeError):
    """Another writer has changed the same parts since this one read them."""


@dataclass(frozen=True)
class Manifest:
    version: int
    tag: str
    parts: int
    key: list[str]
    schema: str
    #: Part (as text, for JSON) to the write that holds it; a part without rows is not named.
    folders: dict[str, str] = field(default_factory=dict)
    #: Stream to the last batch of it that this version holds.
    done: dict[str, int] = field(default_factory=dict)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.schema))


# --- files ------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, Path = _fs(spark, folder)
    at = Path(folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def has_files(spark: SparkSession, folder: str) -> bool:
    return bool(_names(spark, folder))


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/_manifests/{version:08d}.json"


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> bool:
    """Put the manifest in place under its version; False if that version exists.

    The file is written under another name first, so it is never seen half-written.  A rename does
    not replace an existing file, except on a local disk, where a hard link takes its place.
    """
    fs, Path = _fs(spark, root)
    draft = Path(f"{root}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(asdict(manifest)).encode()))
    out.close()
    final = Path(_manifest_path(root, manifest.version))
    if fs.getScheme() == "file":
        try:
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(draft, False)
    if not fs.exists(final) and fs.rename(draft, final):
        return True
    fs.delete(draft, False)
    return False


def manifest_versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are kept, oldest first."""
    return [int(n.split(".")[0]) for n in _names(spark, f"{root}/_manifests") if not n.startswith(".")]


def load_manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest | None:
    """The newest (or given) version; None if there is none."""
    if version is None:
        kept = manifest_versions(spark, root)
        if not kept:
            return None
        version = kept[-1]
    fs, Path = _fs(spark, root)
    stream = fs.open(Path(_manifest_path(root, version)))
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Manifest(**json.loads(raw))


def snapshot_versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(version, tag) of the versions that are kept, oldest first."""
    return [(v, load_manifest(spark, root, v).tag) for v in manifest_versions(spark, root)]


# --- parts ------------------------------------------------------------------------


def part_of(manifest: Manifest) -> Column:
    return F.pmod(F.xxhash64(*manifest.key), F.lit(manifest.parts)).cast("int")


def touched_parts(keys: DataFrame, manifest: Manifest) -> list[int]:
    """The parts that rows with these key columns belong to: at most as many numbers as there are parts."""
    return sorted(r[0] for r in keys.select(part_of(manifest).alias(_PART)).distinct().collect())


def read_parts(
    spark: SparkSession, root: str, manifest: Manifest, parts: Iterable[int] | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """The rows of the given parts (all, if None) of one version."""
    wanted = map(str, parts) if parts is not None else manifest.folders
    paths = [f"{root}/data/{manifest.folders[k]}/{_PART}={k}" for k in wanted if k in manifest.folders]
    schema = schema or manifest.struct()
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write_parts(rows: DataFrame, root: str, manifest: Manifest, touched: list[int]) -> dict[str, str | None]:
    """Part to the write that holds it now, None for a part that has no rows left.

    Rows come together by part, small parts in one task; a part larger than Spark's advisory size of a
    partition is dealt out to several tasks, each of which writes a sorted file of it.  Rows that bring
    their part are in order already, and are written as they come.
    """
    spark, write = rows.sparkSession, uuid.uuid4().hex
    if _PART not in rows.columns:
        rows = rows.withColumn(_PART, part_of(manifest)).hint("rebalance", _PART)
    (
        rows.sortWithinPartitions(_PART, *manifest.key)
        .write.partitionBy(_PART)
        .parquet(f"{root}/data/{write}")
    )
    filled = {n.split("=", 1)[1] for n in _names(spark, f"{root}/data/{write}") if n.startswith(f"{_PART}=")}
    strange = filled - set(map(str, touched))
    if strange:
        raise ValueError(f"rows of parts {sorted(strange)} in a change to parts {touched}")
    return {k: write if k in filled else None for k in map(str, touched)}


def _commit(
    spark: SparkSession, root: str, base: Manifest | None, new: Manifest, fresh: dict[str, str | None], tag: str, done: dict[str, int]
) -> int:
    """The next version: what `fresh` names, on top of the newest version.

    If others have committed since `base` was read, their parts stand; had they touched one of these
    parts, cut the table anew or made it first, this is a Conflict.
    """
    while True:
        head = load_manifest(spark, root)
        if (head is None) != (base is None):
            raise Conflict(f"{root} was made or removed by another writer")
        same_cut = head is None or (new.parts, new.key) == (head.parts, head.key)
        if head is not None:
            ours = fresh if same_cut else {**head.folders, **base.folders}
            changed = [k for k in ours if head.folders.get(k) != base.folders.get(k)]
            if changed or (head.parts, head.key) != (base.parts, base.key):
                raise Conflict(f"parts {changed} of {root} were changed by another writer")
            streams = [s for s in done if head.done.get(s) != base.done.get(s)]
            if streams:
                raise Conflict(f"streams {streams} were taken on by another writer")
        kept = head.folders if head is not None and same_cut else {}
        made = replace(
            new,
            version=head.version + 1 if head else 1,
            tag=tag,
            folders={k: w for k, w in {**kept, **fresh}.items() if w is not None},
            done={**(head.done if head else {}), **done},
        )
        if _publish(spark, root, made):
            return made.version


def _empty(schema: T.StructType, key: list[str], parts: int) -> Manifest:
    return Manifest(0, "", parts, key, schema.json())


def write_snapshot(
    df: DataFrame, root: str, tag: str = "batch", key: list[str] | None = None, parts: int | None = None
) -> int:
    """A version that holds exactly the rows of df; every part is written.

    The key is `fingerprint` where there is one, else all columns that can be hashed; a table keeps its
    key and its number of parts unless others are given.
    """
    spark = df.sparkSession
    base = load_manifest(spark, root)
    if key is None:
        plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        key = ["fingerprint"] if "fingerprint" in plain else plain
        key = base.key if base is not None and set(base.key) <= set(plain) else key
    new = _empty(df.schema, key, parts or (base.parts if base else PARTS))
    return _commit(spark, root, base, new, _write_parts(df, root, new, list(range(new.parts))), tag, {})


def read_snapshot(
    spark: SparkSession, root: str, schema: T.StructType | None = None, version: int | None = None
) -> DataFrame | None:
    """The newest (or given) version; an empty table of `schema`, or None, if there is none."""
    manifest = load_manifest(spark, root, version)
    if manifest is None:
        return spark.createDataFrame([], schema) if schema is not None else None
    return read_parts(spark, root, manifest, schema=schema)


def update_snapshot(
    keys: DataFrame,
    root: str,
    change: Callable[..., DataFrame],
    schema: T.StructType,
    tag: str = "batch",
    done: dict[str, int] | None = None,
    parts: int = PARTS,
    in_order: bool = False,
) -> int:
    """A version in which the parts of `keys` (rows with `fingerprint`) hold change(their rows); the others stay.

    change() gets all rows of those parts and returns what they are to hold; it is asked again on the
    newer rows if another writer was faster.  Nothing is written, and the newest version returned, for no keys.
    With in_order, change() also gets the expression of the part, and returns its rows sorted by part and key over
    the tasks, with the part as `_part`: they move once, not first for the change and again for their parts.
    """
    spark = keys.sparkSession
    for _ in range(ATTEMPTS):
        base = load_manifest(spark, root)
        manifest = base or _empty(schema, ["fingerprint"], parts)
        touched = touched_parts(keys, manifest)
        if not touched and not done:
            return manifest.version
        try:
            fresh = {}
            if touched:
                current = read_parts(spark, root, manifest, touched, schema)
                if in_order:
                    rows = change(current, part_of(manifest)).select(*schema.names, _PART)
                else:
                    rows = change(current).select(schema.names)
                fresh = _write_parts(rows, root, manifest, touched)
            return _commit(spark, root, base, replace(manifest, schema=schema.json()), fresh, tag, done or {})
        except Conflict:
            continue
    raise Conflict(f"{root} was changed by others in each of {ATTEMPTS} attempts")


def find_in_snapshot(spark: SparkSession, root: str, fingerprint: str) -> DataFrame:
    """The rows of one fingerprint, from the files of its part alone."""
    manifest = load_manifest(spark, root)
    if manifest is None:
        raise ValueError(f"{root} holds no version")
    one = spark.range(1).select(F.lit(fingerprint).alias("fingerprint"))
    return read_parts(spark, root, manifest, touched_parts(one, manifest)).filter(F.col("fingerprint") == fingerprint)


def expire_snapshots(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Forget all but the newest `keep` versions and delete the parts that no kept version names; how many parts went.

    Manifests go first, oldest first, so a version that can still be named is still whole.  A reader of an
    expired version fails.  Writes that were never committed are named by no manifest and stay.
    """
    if keep < 1:
        raise ValueError("at least one version is kept")
    versions = manifest_versions(spark, root)
    old = [load_manifest(spark, root, v) for v in versions[:-keep]]
    live = {(w, k) for v in versions[-keep:] for k, w in load_manifest(spark, root, v).folders.items()}
    dead = {(w, k) for m in old for k, w in m.folders.items()} - live
    fs, Path = _fs(spark, root)
    for m in old:
        fs.delete(Path(_manifest_path(root, m.version)), False)
    for write, k in sorted(dead):
        fs.delete(Path(f"{root}/data/{write}/{_PART}={k}"), True)
    for write in {w for w, _ in dead} - {w for w, _ in live}:
        fs.delete(Path(f"{root}/data/{write}"), True)
    return len(dead)
