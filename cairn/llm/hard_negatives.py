"""Hard negatives by threshold joins over partial inverted indexes, lowered until every window is full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut

POSITIVES, NEGATIVES = 5, 5
#: Dimensions of one posting block: a block is indexed, accumulated and pruned as a whole.
WIDTH = 8
#: Thresholds for positives, as shares of the largest product of norms, tried in turn; after the last every row counts.
LEVELS = (0.5, 0.3, 0.2, 0.1, 0.0)
#: Thresholds for negatives, as shares of the way from the smallest positive score down to the end of its window.
STEPS = (0.25, 0.6, 1.0)
#: A shard has at least so many rows, more beyond SHARDS shards, in at most so many bytes; blocks of anchors likewise.
SHARD_ROWS, SHARDS, SHARD_BYTES, BLOCK_BYTES = 4096, 256, 64 << 20, 32 << 20
#: Cells of the partial scores held at once, and pairs verified at once.
CELLS, PAIRS = 1 << 20, 1 << 16
#: Floating-point bounds are loosened by this; the scores are exact integers.
SLACK = 1e-9
LONG = (1 << 63) - 1

#: (query, row, score) of pairs.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _block_norms(x: np.ndarray) -> np.ndarray:
    """(n, blocks + 1): the norm of each row's first k blocks of WIDTH dimensions."""
    ends = np.arange(0, x.shape[1], WIDTH)
    squares = np.add.reduceat(x * x, ends, axis=1) if len(ends) else np.zeros((len(x), 0))
    return np.sqrt(np.concatenate([np.zeros((len(x), 1)), np.cumsum(squares, 1)], 1))


class Postings:
    """Rows of a shard (integers held as floats), their dimensions in order of rising energy.

    For a threshold, the leading dimensions of a row stay out of the index while their norm times that
    of the queries' stays below it: a pair that reaches the threshold also meets on an indexed one.
    """

    def __init__(self, x: np.ndarray):
        self.order = np.argsort((x * x).sum(0), kind="stable")
        self.x = x[:, self.order]
        self.norms = _block_norms(self.x)

    def norm(self, rows: np.ndarray) -> float:
        return float(self.norms[rows, -1].max(initial=0.0))

    def join(self, queries: np.ndarray, thresholds: np.ndarray, rows: np.ndarray) -> Pairs:
        """Every pair of a query and one of `rows` whose inner product reaches the query's threshold."""
        found: list[Pairs] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        step = max(1, CELLS // max(1, len(rows)))
        for at in range(0, len(queries), step):
            i, j, s = self._join(queries[at : at + step][:, self.order], thresholds[at : at + step], rows)
            found.append((i + at, j, s))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return i, j, s

    def _join(self, q: np.ndarray, t: np.ndarray, rows: np.ndarray) -> Pairs:
        blocks, q_norms = self.norms.shape[1] - 1, _block_norms(q)
        with np.errstate(divide="ignore", invalid="ignore"):
            reach = np.where(t[:, None] > 0, t[:, None] / q_norms[:, 1:], 0.0).min(0) * (1 - SLACK)
        left_out = (self.norms[rows, 1:] < reach).sum(1)
        by = np.argsort(left_out, kind="stable")
        by = by[left_out[by] < blocks] if blocks else by  # a row wholly left out reaches no threshold
        rows, left_out = rows[by], left_out[by]
        partial = np.zeros((len(q), len(rows)))
        for k in range(blocks - 1, -1, -1):
            indexed = int(np.searchsorted(left_out, k, "right"))
            dims = slice(k * WIDTH, (k + 1) * WIDTH)
            partial[:, :indexed] += q[:, dims] @ self.x[rows[:indexed], dims].T
            if k % 2 == 0 and k:
                most = q_norms[:, k, None] * (self.norms[rows[:indexed], k] * (1 + SLACK))
                live = np.ones(len(rows), bool)
                live[:indexed] = (partial[:, :indexed] + most >= t[:, None] - SLACK).any(0)
                if 4 * live.sum() <= 3 * len(rows):
                    rows, left_out, partial = rows[live], left_out[live], partial[:, live]
        rest = q_norms[:, left_out] * (self.norms[rows, left_out] * (1 + SLACK)) if left_out.any() else 0.0
        i, j = np.nonzero(partial + rest >= t[:, None] - SLACK)
        scores = partial[i, j]
        short = np.flatnonzero(left_out[j] > 0)  # candidates with dimensions that were not accumulated
        for at in range(0, len(short), PAIRS):
            part = short[at : at + PAIRS]
            scores[part] = np.einsum("ij,ij->i", q[i[part]], self.x[rows[j[part]]])
        good = scores >= t[i]
        return i[good], rows[j[good]], scores[good]


class Unbounded:
    """The same join, without an index, for integers whose products leave the range that floats hold exactly."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(object)

    def norm(self, rows: np.ndarray) -> float:
        return float("inf")

    def join(self, queries: np.ndarray, thresholds: np.ndarray, rows: np.ndarray) -> Pairs:
        found: list[Pairs] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object))]
        for k, q in enumerate(queries):
            scores = (self.x[rows] * q.astype(object)).sum(1) if self.x.shape[1] else np.zeros(len(rows), object)
            scores = np.array([min(max(int(s), -LONG), LONG) for s in scores], object)
            good = np.flatnonzero([s >= thresholds[k] for s in scores])
            found.append((np.full(len(good), k), rows[good], scores[good]))
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        return i, j, s


def _index(x: np.ndarray, q: np.ndarray) -> tuple[Postings | Unbounded, np.ndarray]:
    """The index of a shard and the queries in the numbers that suit both."""
    most = int(np.abs(x.astype(object)).max(initial=0)) if x.dtype == np.int64 else int(np.abs(x.astype(np.int64)).max(initial=0))
    most *= int(max(abs(int(q.max(initial=0))), abs(int(q.min(initial=0))))) * max(1, x.shape[1])
    if most < 1 << 53:
        return Postings(x.astype(float)), q.astype(float)
    return Unbounded(x), q


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _by_query(i: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(query, places of its pairs)."""
    by = np.argsort(i, kind="stable")
    queries, first = np.unique(i[by], return_index=True)
    yield from zip(queries.tolist(), np.split(by, first[1:]), strict=True) if len(queries) else ()


def near_same(
    ids: np.ndarray, labels: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q_labels: np.ndarray, q: np.ndarray, k: int
) -> Pairs:
    """(query, row, score): each query's k best rows of its label, not of its id; thresholds fall until k are found."""
    index, q = _index(x, q)
    out: list[Pairs] = []
    for label in np.unique(q_labels):
        rows, open_ = np.flatnonzero(labels == label), np.flatnonzero(q_labels == label)
        norms = np.sqrt((q[open_].astype(float) ** 2).sum(1)) * index.norm(rows)
        for share in (*LEVELS, None) if isinstance(index, Postings) else (None,):
            if not len(open_) or not len(rows):
                break
            t = np.full(len(open_), -np.inf) if share is None else share * norms
            i, j, s = index.join(q[open_], t, rows)
            other = ids[j] != q_ids[open_[i]]
            i, j, s = i[other], j[other], s[other]
            full = np.zeros(len(open_), bool)
            for a, places in _by_query(i):
                if len(places) >= k or share is None:
                    best = places[_best(s[places], ids[j[places]], k)]
                    out.append((np.full(len(best), open_[a]), j[best], s[best]))
                    full[a] = True
            open_, norms = open_[~full], norms[~full]
    return _joined(out)


def near_other(
    ids: np.ndarray, labels: np.ndarray, x: np.ndarray, q_labels: np.ndarray, q: np.ndarray, windows: list[list[int]], k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query, window, row, score): the k best rows of other labels in each window of each query.

    A window of a positive score p holds the scores s with 80 p <= 100 s <= 100 p.  Thresholds fall from
    just below the smallest p of a query until its windows are full or wholly seen.
    """
    index, q = _index(x, q)
    ends = [[-((-80 * p) // 100) for p in w] for w in windows]
    open_ = np.array([a for a, w in enumerate(windows) if any(p >= 0 for p in w)], np.int64)
    rows = np.arange(len(ids))
    out: list[tuple[np.ndarray, ...]] = []
    for share in STEPS:
        if not len(open_) or not len(rows):
            break
        t = []
        for a in open_:
            least = min(p for p in windows[a] if p >= 0)
            end = -((-80 * least) // 100)
            t.append(end if share == 1.0 else least - int((least - end) * share))
        exact = np.array(t, object if isinstance(index, Unbounded) else float)
        i, j, s = index.join(q[open_], exact, rows)
        other = labels[j] != q_labels[open_[i]]
        i, j, s = i[other], j[other], s[other]
        left, found = np.ones(len(open_), bool), dict(_by_query(i))
        for a, query in enumerate(open_):
            places = found.get(a, np.empty(0, np.int64))
            taken = []
            for w, p in enumerate(windows[query]):
                inside = places[(s[places] <= p) & (s[places] >= ends[query][w])] if len(places) else places
                if len(inside) < k and t[a] > ends[query][w] and p >= 0:
                    break
                best = inside[_best(s[inside], ids[j[inside]], k)]
                taken.append((np.full(len(best), query), np.full(len(best), w), j[best], s[best]))
            else:
                out += taken
                left[a] = False
        open_ = open_[left]
    return _joined(out, 4)


def _joined(parts: list[tuple[np.ndarray, ...]], width: int = 3) -> tuple[np.ndarray, ...]:
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(width))
    return tuple(np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))


# --- Spark ------------------------------------------------------------------------


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dims, v) of rows that take part, v the components as integers; labels of ids divisible by 7 moved on."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return (
        embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
        .select(
            F.col("vec_id").cast("long").alias("vec_id"),
            moved.cast("long").alias("label"),
            F.size(x).alias("dims"),
            F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v"),
        )
        .distinct()
    )


_PACKED = "keys binary, ids binary, labels binary, v binary, kind string"


def _longs(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([column.to_numpy().astype(np.int64).tobytes()], pa.binary())


def _unpack(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, ids, labels, vectors) of a packed group."""
    keys, ids, labels = (np.frombuffer(row.column(c)[0].as_py(), np.int64) for c in ("keys", "ids", "labels"))
    v = np.frombuffer(row.column("v")[0].as_py(), row.column("kind")[0].as_py())
    return keys, ids, labels, v.reshape(len(ids), -1) if len(v) else np.zeros((len(ids), 0), np.int64)


def _packed(rows: DataFrame, parts: int, part: str) -> DataFrame:
    """One row per group of equal dims and part: its ids, labels and vectors as bytes of the smallest kind that holds them.

    Parts are drawn by the hash of the whole row, so no label, id or vector makes a large one.
    """
    windows = "windows" in rows.columns

    def pack(group: pa.Table) -> pa.Table:
        values = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        kind = next(k for k in (np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
        columns = {
            "dims": group.column("dims").slice(0, 1),
            part: group.column(part).slice(0, 1),
            "keys": _longs(group.column("key")),
            "ids": _longs(group.column("vec_id")),
            "labels": _longs(group.column("label")),
            "v": pa.array([values.astype(kind).tobytes()], pa.binary()),
            "kind": pa.array([np.dtype(kind).name]),
        }
        if windows:
            columns["windows"] = pa.array([group.column("windows").to_pylist()], pa.list_(pa.list_(pa.int64())))
        return pa.table(columns)

    schema = f"dims int, {part} int, {_PACKED}" + ", windows array<array<bigint>>" * windows
    drawn = rows.withColumn(part, F.pmod("key", F.lit(parts)).cast("int"))
    return cut(drawn.groupBy("dims", part).applyInArrow(pack, schema))


def _meet(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int):
    """Every shard with every block of anchors, one pair to a group."""
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    keys = ("dims", "shard", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _first(rows: DataFrame, by: list[str], score: str, name: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), name)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _parts(many: int, row_bytes: int, least: int, most_parts: int, most_bytes: int) -> int:
    rows = max(least, min(-(-many // most_parts), most_bytes // max(1, row_bytes)))
    return max(1, -(-many // rows))


def _columns(names: list[str], arrays: tuple[np.ndarray, ...] | None) -> pa.Table:
    arrays = arrays if arrays is not None else (np.empty(0, np.int64),) * len(names)
    return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, arrays, strict=True)})


def mine(
    rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: (vec_id, label, dims, v) with integer vectors, as usable() gives them; `anchors` selects those
    to mine for.  A positive is one of the first `positives` rows of the anchor's label and another id, by
    falling inner product with the anchor, ties to the smaller id.  For each come the first `negatives`
    rows of another label whose score lies between 80 % and all of the positive's.  Vectors meet only
    those of their length.  Equal rows count once; of different rows that share an id each is an anchor.
    Scores beyond a long are held at its ends.  An anchor without positives, and a positive without
    negatives, has no rows; an empty table gives none.

    Rows are dealt to shards and anchors to blocks, both of bounded size.  In each shard, a block's
    anchors join with thresholds that start high and fall until the windows are full (near_same, near_other,
    Postings.join); of what all shards give, the best are taken by rank.
    """
    points = cut(rows.select("vec_id", "label", "dims", "v", F.xxhash64("vec_id", "label", "v").alias("key")))
    asked = points.filter(anchors)
    many, dims = points.agg(F.count(F.lit(1)), F.max("dims")).first()
    row_bytes = 8 * max(1, dims or 1)
    n_shards = _parts(many, row_bytes, shard_rows, SHARDS, SHARD_BYTES)
    n_blocks = _parts(asked.count(), row_bytes, 1, 1, BLOCK_BYTES)
    positive = ["key", "anchor_id", "positive_id", "positive_score"]
    negative = [*positive, "negative_id", "negative_score"]
    long = lambda names: ", ".join(f"{c} long" for c in names)

    def same(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not (shard.num_rows and block.num_rows):
            return _columns(positive, None)
        _, ids, labels, x = _unpack(shard)
        keys, q_ids, q_labels, q = _unpack(block)
        i, j, s = near_same(ids, labels, x, q_ids, q_labels, q, positives)
        return _columns(positive, (keys[i], q_ids[i], ids[j], s))

    def other(shard: pa.Table, block: pa.Table) -> pa.Table:
        if not (shard.num_rows and block.num_rows):
            return _columns(negative, None)
        _, ids, labels, x = _unpack(shard)
        keys, q_ids, q_labels, q = _unpack(block)
        pairs = [np.reshape(w, (-1, 2)) for w in block.column("windows")[0].as_py()]
        i, w, j, s = near_other(ids, labels, x, q_labels, q, [p[:, 1].tolist() for p in pairs], negatives)
        chosen = np.array([pairs[a][b] for a, b in zip(i.tolist(), w.tolist(), strict=True)], np.int64).reshape(-1, 2)
        return _columns(negative, (keys[i], q_ids[i], chosen[:, 0], chosen[:, 1], ids[j], s))

    shards = _packed(points, n_shards, "shard")
    met = _meet(shards, _packed(asked, n_blocks, "block"), n_shards, n_blocks).applyInArrow(same, long(positive))
    pair = F.struct("rank", F.array("positive_id", "positive_score").alias("pair"))
    windows = (
        _first(met, ["key", "anchor_id"], "positive_score", "positive_id", positives)
        .groupBy("key", F.col("anchor_id").alias("vec_id"))
        .agg(F.flatten(F.array_sort(F.collect_list(pair))["pair"]).alias("windows"))
    )
    ready = _packed(asked.join(windows, ["key", "vec_id"]), n_blocks, "block")
    found = _meet(shards, ready, n_shards, n_blocks).applyInArrow(other, long(negative))
    return _first(found, positive, "negative_score", "negative_id", negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def mine_table(embeddings: DataFrame, every: int = 100) -> DataFrame:
    """mine() for the rows of `embeddings` (vec_id, embedding, label) whose vec_id is divisible by `every`; see usable()."""
    return mine(usable(embeddings), F.col("vec_id") % every == 0)
