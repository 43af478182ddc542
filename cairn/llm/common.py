"""Helpers shared by the operators: whole-column access, written cuts, row batches in tasks."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import cut_lineage, scratch_path

ROOT = str(Path(__file__).resolve().parents[2])

__all__ = ["cut", "importable", "let", "partitions", "pick", "scratch_path", "table", "text_batches"]


def importable(spark: SparkSession) -> None:
    """Lets Python workers find this package where it is a folder at the same path on every machine.

    On a cluster without such a folder, ship the package with --py-files.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, renamed: pick(df, key="doc_id", text="text").

    Anything else the input carries is left behind here, so that no extra column can clash
    with a name that an operator uses.
    """
    return df.select([df[old].alias(new) for new, old in columns.items()])


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back; executors lost later re-read the files."""
    return cut_lineage(df)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_batches(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[tuple[list, list[str]]]:
    """(keys, texts) of a task's rows (columns key, text), about most_chars code points each; null texts are empty."""
    keys: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                keys.append(key)
                texts.append(text or "")
                size += len(text or "")
                if size >= most_chars:
                    yield keys, texts
                    keys, texts, size = [], [], 0
    if keys:
        yield keys, texts
