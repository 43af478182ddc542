"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores, BENCH_ALL=1 times every
registered query.  Each query is run to the end into a no-op sink; the value is the median of
the warm runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from cairn.plans import catalogue
from cairn.session import local_session, release_scratch

HEADLINE = [
    "src3_is_data_file",
    "src9_postgresql",
    "src12_hierarchy",
    "src14_gcs_objects",
    "src15_bucket_rollup",
    "src16_listings",
    "src17_scan_summary",
    "cls5_file_tags",
    "cls10_estimated_value",
    "cat1_fingerprint",
    "cat2_dedupe_batch",
    "cat3_upsert_assets",
    "cat4_change_log",
    "cat7_vanished",
    "cat11_relationships_named",
    "qry1_search_assets",
    "qry4_filter_assets",
    "qry5_recommend",
    "qry7_fuzzy_join",
    "agg1_catalog_statistics",
    "agg7_profile_assets",
    "agg8_profile_lineitem",
    "pii2_summary",
    "pii5_scan",
    "pii7_redact",
    "dq1_quality_metrics",
    "dq2_schema_analysis",
    "gov3_business_domain",
    "gov12_business_metadata",
    "lin3_related_assets",
    "lin6_lineage_nodes",
    "lin8_trace",
    "lin9_column_edges",
    "lin14_schema_transformations",
    "str2_stream_upsert",
    "str3_discovery_counts",
]


def timed(build, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    shared = tempfile.mkdtemp(prefix="cairn-bench-")
    spark = local_session(cpus, shared=shared)
    queries = catalogue.spark_queries()
    names = list(queries) if os.environ.get("BENCH_ALL") else HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        first = timed(queries[name], spark, sf_dir)
        warm = [timed(queries[name], spark, sf_dir) for _ in range(runs)]
        seconds[name] = round(statistics.median(warm or [first]), 3)
        print(f"{name} first {first:.2f} warm {seconds[name]:.2f}", file=sys.stderr, flush=True)
    release_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of warm runs",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
