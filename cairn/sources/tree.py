"""Listing of folder trees in tasks, one level of folders after the other.

The driver holds the roots and the number of the level, never names of files: the folders of a level
are a table, tasks list them, and what they find is written before the next level starts.  A task that
is lost lists its folders again.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.classify import suffix
from cairn.session import importable, scratch_path

FOUND = "location string, is_folder boolean, size bigint, modified_date timestamp, error string"
#: Entries in one record batch of a task.
BATCH = 4096
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)

Entry = tuple[str, bool, int | None, datetime | None]


def _moment(nanoseconds: int) -> datetime:
    """To the millisecond, as file systems of a cluster state it."""
    return EPOCH + timedelta(milliseconds=nanoseconds // 1_000_000)


def _local_entries(folder: str) -> Iterator[Entry]:
    base = folder.rstrip("/")
    with os.scandir(base.removeprefix("file:") or "/") as found:
        for e in found:
            at = f"{base}/{e.name}"
            if e.is_dir(follow_symlinks=False):
                yield at, True, None, None
                continue
            try:
                facts = e.stat()
            except FileNotFoundError:  # a link that leads nowhere, or a file removed meanwhile
                continue
            if e.is_file():
                yield at, False, facts.st_size, _moment(facts.st_mtime_ns)


def _remote_entries(folder: str) -> Iterator[Entry]:
    fs, path = pafs.FileSystem.from_uri(folder)
    base = folder.rstrip("/")
    for e in fs.get_file_info(pafs.FileSelector(path)):
        at = f"{base}/{e.base_name}"
        if e.type == pafs.FileType.Directory:
            yield at, True, None, None
        elif e.type == pafs.FileType.File:
            yield at, False, e.size, e.mtime_ns and _moment(e.mtime_ns)


def entries(folder: str) -> Iterator[Entry]:
    """What stands directly in a folder; links to folders are not followed, so a tree ends."""
    return _local_entries(folder) if folder.startswith("file:") else _remote_entries(folder)


def _visible(location: str) -> bool:
    """Names that begin with . or _ are left out, as Spark's own file sources do (but for partition folders)."""
    name = location.rsplit("/", 1)[-1]
    return not (name.startswith(".") or (name.startswith("_") and "=" not in name))


def _lister(hidden: bool, list_folder: Callable[[str], Iterator[Entry]]):
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        names = ["location", "is_folder", "size", "modified_date", "error"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for folders in batches:
            for folder in folders.column(0).to_pylist():
                try:
                    for e in list_folder(folder):
                        if hidden or _visible(e[0]):
                            rows.append((*e, None))
                        if len(rows) >= BATCH:
                            yield batch(rows)
                            rows = []
                except FileNotFoundError:  # removed since its parent was listed
                    continue
                except OSError as e:
                    rows.append((folder, True, None, None, f"{type(e).__name__}: {e}"))
        if rows:
            yield batch(rows)

    return run


def list_tree(
    spark: SparkSession,
    roots: str | list[str],
    hidden: bool = False,
    max_depth: int | None = None,
    list_folder: Callable[[str], Iterator[Entry]] = entries,
) -> DataFrame:
    """Files below the roots and folders that could not be read: (location, is_folder, size, modified_date, error).

    A folder that cannot be read is a row with its error; the others are listed all the same.  A root
    without a scheme is a local path, seen by every machine.  An empty or vanished folder gives no rows, and so
    does a root that does not exist.  Roots that are given twice are listed once; of roots inside each
    other the files come twice.  One folder's own entries are read by one task.
    """
    importable(spark)
    given = [roots] if isinstance(roots, str) else list(roots)
    named = {r.rstrip("/") if "://" in r or r.startswith("file:") else f"file:{os.path.abspath(r)}" for r in given}
    # a file: address with an authority is the same place
    plain = sorted({"file:" + r.removeprefix("file://") if r.startswith("file:///") else r for r in named})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, depth = scratch_path(spark, "tree"), 0
    folders = spark.createDataFrame([(r,) for r in plain], "location string")
    while True:
        # dealt by hash, so that a task run again gets the same folders; many tasks, as rows are few and slow
        found = folders.repartition(tasks, "location").mapInArrow(_lister(hidden, list_folder), FOUND)
        found.write.parquet(f"{out}/level={depth}")
        folders = (
            spark.read.schema(FOUND)
            .parquet(f"{out}/level={depth}")
            .filter(F.col("is_folder") & F.col("error").isNull())
            .select("location")
        )
        depth += 1
        if (max_depth is not None and depth > max_depth) or folders.isEmpty():
            break
    listed = spark.read.schema(f"{FOUND}, level int").parquet(out).drop("level")
    return listed.filter(~F.col("is_folder") | F.col("error").isNotNull())


def tree_files(
    spark: SparkSession, roots: str | list[str], exts: list[str] | None = None, max_mb: int | None = None
) -> DataFrame:
    """The columns of files.scan_files, listed in tasks, with the empty files that Spark's reader passes over.

    Folders that cannot be read are left out.
    """
    files = list_tree(spark, roots).filter(~F.col("is_folder"))
    if max_mb is not None:
        files = files.filter(F.col("size") <= max_mb * 1024 * 1024)
    if exts:
        files = files.filter(F.lower(suffix("location")).isin([e.lower().lstrip(".") for e in exts]))
    return files.select("location", "size", "modified_date")
