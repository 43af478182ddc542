"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

DEGREE, BEAM, ALPHA, SHARD_ROWS = 24, 64, 1.2, 2048
BATCH = 256
#: Queries that meet a shard in one task: at most so many expected, in so many bytes.
BLOCK_ROWS, BLOCK_BYTES = 1 << 18, 64 << 20


def _squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances from each row of points (B, d) to its own rows of x (B, C, d)."""
    return ((x - points[:, None, :]) ** 2).sum(-1)


def beam_search(
    x: np.ndarray, links: np.ndarray, entry: int, queries: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the `beam` nearest points met by a greedy walk from entry, per query; -1 where fewer.

    Each step opens the nearest unopened point of every query's list and adds its unseen neighbours,
    until all points of the lists are open.
    """
    many, n = len(queries), len(x)
    beam = min(beam, n)
    ids = np.full((many, beam), -1)
    far = np.full((many, beam), np.inf, np.float32)
    opened = np.ones((many, beam), bool)
    seen = np.zeros((many, n + 1), bool)
    ids[:, 0], far[:, 0], opened[:, 0], seen[:, entry] = entry, ((x[entry] - queries) ** 2).sum(1), False, True
    seen[:, n] = True  # where a link is missing
    live = np.arange(many)
    while len(live):
        nearest = np.where(opened[live], np.inf, far[live]).argmin(1)
        opened[live, nearest] = True
        near = links[ids[live, nearest]]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        far_new = np.where(fresh, _squared(x[np.minimum(near, n - 1)], queries[live]), np.inf).astype(np.float32)
        all_far = np.concatenate([far[live], far_new], 1)
        order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
        take = np.take_along_axis
        far[live] = take(all_far, order, 1)
        ids[live] = take(np.concatenate([ids[live], near], 1), order, 1)
        opened[live] = take(np.concatenate([opened[live], ~fresh], 1), order, 1) | np.isinf(far[live])
        live = live[~opened[live].all(1)]
    return np.where(np.isinf(far), -1, ids), far


def robust_prune(x: np.ndarray, points: np.ndarray, lists: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours (B, degree) of points out of lists (B, C; n where empty), n where there are fewer.

    The nearest candidate is kept, and candidates that alpha times their distance to it is not above
    their distance to the point go; then the next nearest is kept, until none is left.
    """
    n = len(x)
    lists = np.sort(lists, 1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = n
    lists[lists == points[:, None]] = n
    vectors = x[np.minimum(lists, n - 1)]
    far = np.where(lists < n, _squared(vectors, x[points]), np.inf)
    norms = (vectors**2).sum(-1)
    between = norms[:, :, None] + norms[:, None, :] - 2 * vectors @ vectors.transpose(0, 2, 1)
    out, rows, left = np.full((len(points), degree), n), np.arange(len(points)), far.copy()
    for k in range(degree):
        best = left.argmin(1)
        some = np.isfinite(left[rows, best])
        if not some.any():
            break
        out[some, k] = lists[rows, best][some]
        left[(alpha**2 * between[rows, best] <= far) & some[:, None]] = np.inf
        left[rows, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(links (n, degree), entry point); links hold n where a point has fewer neighbours."""
    n = len(x)
    draw = np.random.default_rng(n)
    links = np.full((n, degree), n)
    if n > 1:
        start = draw.integers(0, n - 1, (n, min(degree, n - 1)))
        links[:, : start.shape[1]] = start + (start >= np.arange(n)[:, None])
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = draw.permutation(n)
    for at in range(0, n, BATCH):
        points = order[at : at + BATCH]
        met, _ = beam_search(x, links, entry, x[points], beam)
        lists = np.concatenate([np.where(met < 0, n, met), links[points]], 1)
        links[points] = robust_prune(x, points, lists, degree, alpha)
        sources = np.repeat(points, degree)
        targets = links[points].ravel()
        sources, targets = sources[targets < n], targets[targets < n]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        touched, first, counts = np.unique(targets, return_index=True, return_counts=True)
        for k in range(0, len(touched), BATCH):
            some, a, c = touched[k : k + BATCH], first[k : k + BATCH], counts[k : k + BATCH]
            back = np.full((len(some), c.max()), n)
            for row, (f, many) in enumerate(zip(a, c, strict=True)):
                back[row, :many] = sources[f : f + many]
            links[some] = robust_prune(x, some, np.concatenate([links[some], back], 1), degree, alpha)
    return links, entry


def shard_count(points: int, shard_rows: int = SHARD_ROWS) -> int:
    """The number of shards for so many vectors.

    Shards have the same size at every size of the input, since the share of neighbours that a beam finds
    falls as its graph grows: the work of a query grows with the number of shards instead.
    """
    return max(1, -(-points // shard_rows))


def block_count(queries: int, dims: int, block_rows: int = BLOCK_ROWS) -> int:
    """The number of blocks for so many queries of `dims` floats."""
    rows = max(1, min(block_rows, BLOCK_BYTES // (4 * max(1, dims))))
    return max(1, -(-queries // rows))


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a column of lists, read from its buffers."""
    parts = column.chunks
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in parts]
    lengths = [c.value_lengths().to_numpy(zero_copy_only=False) for c in parts]
    return np.concatenate(values), np.concatenate(lengths).astype(np.int64)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return _lists(column)[0].astype(kind, copy=False).reshape(len(column), -1)


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) of rows that take part: an id, and a non-zero vector of finite numbers."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        embeddings.select("vec_id", "embedding")
        .filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
        .distinct()
    )


def build_index(rows: DataFrame, copies: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct vector: shard, its `copies` smallest ids, its vector, its links, the shard's entry point.

    Equal vectors are one point: a graph cannot hold many points at distance 0 of each other, and only
    the smallest ids of a point can be among the nearest.
    """
    place = Window.partitionBy("embedding").orderBy("vec_id")
    points = cut(
        rows.withColumn("place", F.row_number().over(place))
        .filter(F.col("place") <= copies)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_list("vec_id")).alias("vec_ids"))
    )
    shards = shard_count(points.count(), shard_rows)

    def build(shard: pa.Table) -> pa.Table:
        x = _matrix(shard.column("embedding"), np.float32)
        links, entry = build_graph(x)
        ends = np.arange(0, links.size + 1, links.shape[1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(ends, links.astype(np.int32).ravel())
        return shard.append_column("links", lists).append_column("entry", pa.array(np.full(len(x), entry, np.int32)))

    dealt = points.select(
        F.size("embedding").alias("dims"),
        F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"),
        "vec_ids",
        "embedding",
    )
    return cut(
        dealt.groupBy("dims", "shard").applyInArrow(
            build, "dims int, shard int, vec_ids array<long>, embedding array<float>, links array<int>, entry int"
        )
    )


def search(
    index: DataFrame, queries: DataFrame, k: int = 10, beam: int = BEAM, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by Euclidean distance in double precision, ties to the smaller id.

    Every query walks every shard's graph of its own dimension, in a task for each shard and block of
    queries; a row with the query's own id is no candidate.  An id with several vectors counts with its nearest.
    """
    shards = index.select(F.col("dims").alias("dims"), F.col("shard").alias("shard")).distinct()
    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).withColumn(
        "dims", F.size("query")
    )
    many, dims = asked.agg(F.count(F.lit(1)), F.max("dims")).first()
    blocks = block_count(many, dims or 1, block_rows)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", "query"), F.lit(blocks)).cast("int"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.join(shards, "dims")  # the stated query set against all shards of its dimension

    def walk(points: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if points.num_rows and wanted.num_rows:
            x, links = _matrix(points.column("embedding"), np.float32), _matrix(points.column("links"), np.int32)
            ids, counts = _lists(points.column("vec_ids"))
            begins, entry = np.cumsum(counts) - counts, points.column("entry")[0].as_py()
            names = wanted.column("query_id").to_numpy()
            q = _matrix(wanted.column("query"), np.float32)
            for at in range(0, len(q), BATCH):
                met, _ = beam_search(x, links, entry, q[at : at + BATCH], beam)
                for row, found in enumerate(met, at):
                    found = found[found >= 0]
                    far = np.sqrt(((x[found].astype(np.float64) - q[row].astype(np.float64)) ** 2).sum(1))
                    c = counts[found]
                    v = ids[np.repeat(begins[found] - np.cumsum(c) + c, c) + np.arange(c.sum())]
                    d = np.repeat(far, c)
                    best = np.lexsort((v, d))
                    best = best[v[best] != names[row]][:k]
                    out.append((np.full(len(best), names[row]), v[best], d[best]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [[], [], []]
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    found = (
        graphs.groupBy("dims", "shard", "block")
        .cogroup(asked.groupBy("dims", "shard", "block"))
        .applyInArrow(walk, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k nearest rows of each row whose vec_id is divisible by `every`; see usable, build_index and search."""
    rows = usable(embeddings)
    return search(build_index(rows, k + 1, shard_rows), rows.filter(F.col("vec_id") % every == 0), k)
