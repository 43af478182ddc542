"""What is new: rows whose key was never seen before, with keys kept for ever as files.

    <root>/keys/upto=<n>      keys of all batches up to n, merged
    <root>/keys/batch=<n>     keys that batch n saw first
    <root>/rows/batch=<n>     their rows
    <root>/heads/batch=<n>    the first row of each key of batch n, while it is under way
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.snapshots import _fs, _names, has_files
from cairn.sources.tree import tree_files

#: Numbered folders of keys that may stand before they are merged into one.
LOOSE = 64


def _steps(spark: SparkSession, folder: str) -> tuple[int, list[int]]:
    """The last batch in the merged keys (-1: none) and the numbers of loose ones; half-written ones do not count."""
    fs, Path = _fs(spark, folder)
    merged, loose = -1, []
    for name in _names(spark, folder):
        if fs.exists(Path(f"{folder}/{name}/_SUCCESS")):
            kind, number = name.split("=")
            if kind == "upto":
                merged = max(merged, int(number))
            else:
                loose.append(int(number))
    return merged, sorted(n for n in loose if n > merged)


def _known(spark: SparkSession, folder: str, before: int, schema) -> DataFrame | None:
    """Keys of all batches with a smaller number."""
    merged, loose = _steps(spark, folder)
    paths = ([f"{folder}/upto={merged}"] if merged >= 0 else []) + [f"{folder}/batch={n}" for n in loose if n < before]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def _merge(spark: SparkSession, folder: str, before: int, schema) -> None:
    """Loose keys into one folder, once there are many; the old folders go when the new one is whole.

    Only batches before the present one are merged: those are committed and do not come again.
    """
    merged, loose = _steps(spark, folder)
    settled = [n for n in loose if n < before]
    if len(settled) < LOOSE:
        return
    _known(spark, folder, before, schema).write.mode("overwrite").parquet(f"{folder}/upto={settled[-1]}")
    fs, Path = _fs(spark, folder)
    for gone in [f"upto={merged}", *(f"batch={n}" for n in settled)]:
        fs.delete(Path(f"{folder}/{gone}"), True)


def first_seen_batch(batch: DataFrame, number: int, root: str, key: list[str], order: list[str]) -> None:
    """Write those rows of a batch whose key no earlier batch had, one for each key, the first by `order`.

    Keys stay for ever, on disk: `root/keys` holds each once, `root/rows/batch=<n>` the rows.  Numbers rise.
    A batch that comes again with its number, after a failure, sees the keys of smaller numbers only
    and writes its folders anew, so nothing is lost or doubled.  Null keys are one key.

    A batch reads the key columns once and moves only its own keys: known ones are found by a semi-join in
    which the batch is the small side, broadcast where Spark measures it as small.
    """
    spark, keys = batch.sparkSession, f"{root}/keys"
    rest = [c for c in batch.columns if c not in key]
    first = batch.groupBy(*key).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_rest"))
    first = first.select(*key, "_rest.*")
    schema = first.select(*key).schema
    _merge(spark, keys, number, schema)
    known = _known(spark, keys, number, schema)
    heads, rows = f"{root}/heads/batch={number}", f"{root}/rows/batch={number}"
    if known is not None:
        # read three times; as files it has the partitions and the measured size of a batch, where a cached
        # table keeps a task for each shuffle partition
        first.write.mode("overwrite").parquet(heads)
        first = spark.read.schema(first.schema).parquet(heads)
        same = [F.col(f"b.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
        again = known.alias("k").join(first.select(*key).alias("b"), same, "left_semi")
        met = [F.col(f"f.{c}").eqNullSafe(F.col(f"k.{c}")) for c in key]
        first = first.alias("f").join(again.alias("k"), met, "left_anti")
    first.write.mode("overwrite").parquet(rows)
    spark.read.schema(first.schema).parquet(rows).select(*key).write.mode("overwrite").parquet(f"{keys}/batch={number}")
    if known is not None:
        fs, Path = _fs(spark, heads)
        fs.delete(Path(heads), True)


def first_seen(spark: SparkSession, root: str, schema) -> DataFrame:
    """All rows written so far, with the number of their batch; those of a batch under way do not count."""
    merged, loose = _steps(spark, f"{root}/keys")
    last = max([merged, *loose])
    if last < 0 or not has_files(spark, f"{root}/rows"):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    rows = spark.read.schema(schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows")
    return rows.withColumn("batch", F.col("batch").cast("int")).filter(F.col("batch") <= last)


def discover(spark: SparkSession, roots: str | list[str], root: str, exts: list[str] | None = None) -> int:
    """Look below the roots once more and add files not seen before, or changed since; the number of the look.

    A look that fails half-way is repeated under its number by the next call.  One process looks at a time.
    """
    merged, loose = _steps(spark, f"{root}/keys")
    number = max([merged, *loose]) + 1
    first_seen_batch(tree_files(spark, roots, exts), number, root, ["location", "modified_date"], ["size"])
    return number


def discovered(spark: SparkSession, root: str) -> DataFrame:
    """(location, modified_date, size, batch) of all looks so far."""
    return first_seen(spark, root, "location string, modified_date timestamp, size bigint")


def stream_first_seen(
    events: DataFrame, root: str, key: list[str], order: list[str], checkpoint: str | None = None
) -> StreamingQuery:
    """Run first_seen_batch for everything available in a stream.

    Spark keeps no state for it: a key is known however long ago it came, across restarts, without a watermark,
    and what a batch costs in memory does not grow with the keys.
    """
    return (
        events.writeStream.foreachBatch(lambda df, n: first_seen_batch(df, n, root, key, order))
        .option("checkpointLocation", checkpoint or f"{root}/_stream")
        .trigger(availableNow=True)
        .start()
    )
