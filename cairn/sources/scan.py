"""The scan: every connector listed, the catalog brought up to date, logged and summed up."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.maintenance import moment, with_fingerprint
from cairn.schema import ASSETS, as_assets
from cairn.session import cut_lineage
from cairn.sources.objects import scan_all
from cairn.streaming.ingest import upsert_batch

Listing = DataFrame | Callable[[], DataFrame]


def list_source(listing: Listing) -> tuple[DataFrame | None, str | None]:
    """(assets written to the shared folder, None), or (None, the reason) for a source that fails.

    A source may fail while its listing is made or while Spark runs it; either way only it is lost.
    """
    try:
        made = listing() if callable(listing) else listing
        return cut_lineage(with_fingerprint(as_assets(made))), None
    except (PySparkException, Py4JError, OSError, ValueError) as failure:
        return None, (str(failure).splitlines() or [type(failure).__name__])[0]


def scan_catalog(
    spark: SparkSession,
    sources: dict[str, Listing],
    root: str,
    as_of: str,
    wanted: list[str] | None = None,
    scan_id: int = 0,
) -> DataFrame:
    """Scan all (wanted) sources, fold what they yield into the catalog under `root`, and sum up.

    Returns connector, assets and error per source, and their total (connector "total").  An unknown
    connector is skipped.  A failing one has no assets and does not stop the others; what it had in
    the catalog stays as it was.  A repeated asset counts in the summary and is one row of the catalog.
    Scanning again under the same scan_id changes nothing.
    """
    picked = {k: v for k, v in sources.items() if wanted is None or k in wanted}
    listed = {k: list_source(v) for k, v in picked.items()}
    good = {k: assets for k, (assets, _) in listed.items() if assets is not None}
    if good:
        batch = scan_all(good)
        upsert_batch(batch.drop("connector"), scan_id, root, "modified_date", moment(as_of), stream="scan")
    else:
        batch = spark.createDataFrame([], ASSETS).withColumn("connector", F.lit(""))
    asked = spark.createDataFrame([(k, error) for k, (_, error) in listed.items()], "connector string, error string")
    counts = batch.groupBy("connector").agg(F.count(F.lit(1)).alias("assets"))
    # one row per source: as many as the caller has named
    each = asked.join(counts, "connector", "left").select(
        "connector", F.coalesce("assets", F.lit(0)).alias("assets"), "error"
    )
    total = batch.agg(F.count(F.lit(1)).alias("assets")).select(
        F.lit("total").alias("connector"), "assets", F.lit(None).cast("string").alias("error")
    )
    return each.unionByName(total)
