"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node of edges (a, b); any orderable type.

    Each round ties every node to the smallest of its neighbours: first those above it, then those
    below.  Rounds are about the logarithm of the longest path; only counts and sums reach the driver.
    A node with many neighbours is a row per neighbour, joined on a key that Spark may split.
    """

    def apart(e: DataFrame) -> DataFrame:
        return e.filter("a != b").distinct()

    now, before = cut(apart(edges.select("a", "b"))), None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = apart(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now = cut(
            apart(small.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))))
        )
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
