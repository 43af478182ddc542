"""N-gram Jaccard self-join of documents with a MinHash LSH forest and exact verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, partitions, pick
from cairn.llm.graph import components

WORDS, TREES, DEPTH, RECALL = 5, 20, 8, 0.9999
#: Documents and shingles of a cell, the unit of verification.
CELL_ROWS, CELL_SHINGLES = 128, 150_000
# Similarity 0.8 or more: shared / all >= 4 / 5.
NUMERATOR, DENOMINATOR = 4, 5


def prefix_length(trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, shortened from `depth`, at which a pair just similar enough meets in some tree this surely."""
    similarity = NUMERATOR / DENOMINATOR
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return made


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five lower-cased words; fewer words make one run."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes().__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        out = _mixed(out + h[k : k + n])
    return np.unique(out)


@lru_cache(maxsize=4)
def _factors(many: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20_240_601)
    return draw.integers(1, 1 << 63, many, np.uint64) * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, many, np.uint64)


def tree_keys(hashes: np.ndarray, trees: int, prefix: int) -> np.ndarray:
    """The place of a document in each tree: its signature's first values there, as one number."""
    a, b = _factors(trees * prefix)
    least = np.full(trees * prefix, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * a + b).min(0), out=least)
    key = np.arange(trees, dtype=np.uint64)
    for part in least.reshape(trees, prefix).T:
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


def sketches(docs: DataFrame, trees: int = TREES, prefix: int | None = None) -> DataFrame:
    """(doc_id, text_id, size, keys): text_id is a 64-bit hash of the set of shingles, the same for equal sets."""
    prefix = prefix or prefix_length(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([tree_keys(s, trees, prefix) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_id", "size", "keys"],
                )

    return pick(docs, doc_id="doc_id", text="text").mapInArrow(run, "doc_id long, text_id long, size long, keys array<long>")


def clusters(texts: DataFrame) -> DataFrame:
    """(text_id, cluster): texts that meet in a tree, directly or through others; texts that meet none are left out."""
    met = texts.select("text_id", F.explode("keys").alias("key"))
    heads = met.groupBy("key").agg(F.min("text_id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = met.join(heads.select("key", "head"), "key").select(F.col("text_id").alias("a"), F.col("head").alias("b"))
    return components(edges).select(F.col("node").alias("text_id"), F.col("root").alias("cluster"))


def _cells(members: DataFrame) -> DataFrame:
    """Every member once for each pair of cells of its cluster in which it has to be compared.

    A small cluster is one cell.  A large one is cut by size of the texts (steps of the similarity, so
    that only texts of the same or the next step can be alike) and each step by hash into cells.
    """
    step = F.floor(F.log(F.col("size")) / float(np.log(DENOMINATOR / NUMERATOR))).cast("int")
    room = lambda n, size: F.greatest(F.ceil(n / CELL_ROWS), F.ceil(size / CELL_SHINGLES)).cast("int")
    stepped = members.withColumn("step", step)
    per_step = stepped.groupBy("cluster", "step").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("sum"))
    plans = per_step.groupBy("cluster").agg(
        room(F.sum("n"), F.sum("sum")).alias("whole"),
        F.map_from_entries(F.collect_list(F.struct("step", room(F.col("n"), F.col("sum"))))).alias("split"),
    )
    s, split = F.col("step"), F.col("split")
    cell = lambda step, k: F.struct(step.alias("step"), k.cast("int").alias("cell"))
    own = F.pmod(F.xxhash64("text_id"), F.element_at(split, s)).cast("int")
    others = lambda step: F.when(
        F.element_at(split, step).isNotNull(),
        F.transform(F.sequence(F.lit(0), F.element_at(split, step) - 1), lambda k: cell(step, k)),
    ).otherwise(F.array().cast("array<struct<step:int,cell:int>>"))
    apart = F.flatten(F.array(others(s - 1), others(s), others(s + 1)))
    mine = F.when(F.col("whole") == 1, cell(F.lit(0), F.lit(0))).otherwise(cell(s, own))
    met = F.when(F.col("whole") == 1, F.array(cell(F.lit(0), F.lit(0)))).otherwise(apart)
    return (
        stepped.join(plans, "cluster")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(met))
        .select(
            "doc_id",
            "text_id",
            "copies",
            F.xxhash64("cluster", F.least("mine", "other"), F.greatest("mine", "other")).alias("task"),
            (F.col("mine") <= F.col("other")).alias("left"),
            (F.col("mine") == F.col("other")).alias("inner"),
        )
    )


def _similar(sets: list[np.ndarray], left: list[int], right: list[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places in `left` and `right` (None: within left, each pair once) of the pairs of sets alike enough, exactly."""
    order = left if right is None else left + right
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order])
    rows = np.repeat(np.arange(len(order)), sizes)
    _, column, counts = np.unique(flat, return_inverse=True, return_counts=True)
    shared = counts[column] > 1
    rows, column = rows[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    width, split = int(column.max(initial=-1)) + 1, len(left)
    a, b = slice(0, split), slice(0, split) if right is None else slice(split, None)
    both = np.zeros((len(sizes[a]), len(sizes[b])), np.float32)
    by = np.argsort(column, kind="stable")
    rows, column = rows[by], column[by]
    for at in range(0, width, 4096):
        lo, hi = np.searchsorted(column, [at, at + 4096])
        part = np.zeros((len(order), min(4096, width - at)), np.float32)
        part[rows[lo:hi], column[lo:hi] - at] = 1
        both += part[a] @ part[b].T
    alike = (NUMERATOR + DENOMINATOR) * both >= NUMERATOR * (sizes[a][:, None] + sizes[b][None, :])
    if right is None:
        alike = np.triu(alike, 1)
    return np.nonzero(alike)


FOUND = "text_id long, links long, texts long, other long"


def _verified(placed: DataFrame) -> DataFrame:
    """For each task, links of a text found there (other is null), and a spanning forest of them (other is the text tied to).

    placed: (task, left, inner, text_id, copies, hashes), a task's rows together.
    """

    def judge(rows: list[tuple]) -> list[tuple]:
        lefts = [i for i, r in enumerate(rows) if r[0]]
        rights = None if rows[0][1] else [i for i, r in enumerate(rows) if not r[0]]
        if not lefts or rights == [] or (rights is None and len(lefts) < 2):
            return []
        x, y = _similar([np.frombuffer(r[4], np.uint64) for r in rows], lefts, rights)
        first, second = np.array(lefts)[x], np.array(lefts if rights is None else rights)[y]
        copies = np.array([r[3] for r in rows])
        links = np.zeros(len(rows), np.int64)
        np.add.at(links, first, copies[second])
        np.add.at(links, second, copies[first])
        texts = np.bincount(np.concatenate([first, second]), minlength=len(rows))
        root = list(range(len(rows)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = [(rows[i][2], int(links[i]), int(texts[i]), None) for i in np.flatnonzero(texts)]
        for i, j in zip(first.tolist(), second.tolist(), strict=True):
            if (p := top(i)) != (q := top(j)):
                root[q] = p
                out.append((rows[j][2], 0, 0, rows[i][2]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def done() -> pa.RecordBatch:
            columns = list(zip(*judge(rows), strict=True)) or [[]] * 4
            names = [x.split()[0] for x in FOUND.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    if rows and row[0] != task:
                        yield done()
                        rows = []
                    task = row[0]
                    rows.append(row[1:])
        if rows:
            yield done()

    many = partitions(placed.sparkSession)
    return placed.repartition(many, "task").sortWithinPartitions("task").mapInArrow(run, FOUND)


def _with_hashes(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """placed (doc_id, text_id, ...) with the shingles of its text; a doc_id met twice counts with the text meant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                sets = [shingles(t or "").tobytes() for t in part.column(1).to_pylist()]
                wanted = part.column(0).to_pylist()
                kept = [xxhash.xxh64_intdigest(s) - (1 << 63) == w for s, w in zip(sets, wanted, strict=True)]
                both = pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["text_id", "hashes"])
                yield both.filter(pa.array(kept))

    texts = pick(docs, id="doc_id", text="text")
    wanted = placed.select("doc_id", F.col("text_id").alias("wanted"))
    # Texts always move by key: the ids wanted grow with the input, so no plan may send them to every task.
    sets = texts.hint("merge").join(wanted, texts["id"].eqNullSafe(wanted["doc_id"])).select("wanted", "text")
    return sets.mapInArrow(run, "text_id long, hashes binary").dropDuplicates(["text_id"])


def similarity_classes(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    Two documents are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or
    more; n_links counts a document's linked others, class_id is the smallest doc_id reachable over
    links.  Documents with equal sets of shingles are one text for all that follows, so copies are never
    paired.  Texts whose signatures share a long enough prefix in a tree meet in a cluster, and in a
    cluster every pair of texts that can be alike is verified exactly, cell against cell.

    A null text is empty; texts without words are copies of each other.  A row without doc_id takes
    part, and gives a class its id only if no other row can.  Repeated rows are copies.
    """
    read = cut(sketches(docs, trees))
    texts = cut(
        read.groupBy("text_id").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), "size", "keys")).alias("first"),
            F.count(F.lit(1)).alias("copies"),
        ).select("text_id", "copies", "first.doc_id", "first.size", "first.keys")
    )
    members = texts.drop("keys").join(clusters(texts), "text_id")
    placed = cut(_cells(members))
    hashes = _with_hashes(docs, placed.select("doc_id", "text_id").distinct())
    found = cut(_verified(placed.join(hashes, "text_id").select("task", "left", "inner", "text_id", "copies", "hashes")))
    links = found.filter("other is null").groupBy("text_id").agg(F.sum("links").alias("links"))
    tied = components(found.filter("other is not null").select(F.col("text_id").alias("a"), F.col("other").alias("b")))
    ids = texts.select(F.col("text_id").alias("node"), F.col("doc_id").alias("first"))
    least = tied.join(ids, "node").groupBy("root").agg(F.min("first").alias("class_id"))
    named = tied.join(least, "root").select(F.col("node").alias("text_id"), "class_id")
    known = (
        texts.select("text_id", "copies", F.col("doc_id").alias("first"))
        .join(named, "text_id", "left")
        .join(links, "text_id", "left")
        .select(
            "text_id",
            F.coalesce("class_id", "first").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    return read.select("doc_id", "text_id").join(known, "text_id").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, trees: int = TREES) -> DataFrame:
    """The documents whose doc_id is the smallest of their class, with all their columns.

    Rows of one doc_id are one document, of which one row stays; rows without a doc_id all stay.
    """
    kept = similarity_classes(docs, trees).filter("doc_id = class_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rows.select(docs.columns).unionAll(docs.filter("doc_id is null"))
