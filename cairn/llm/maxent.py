"""Language-model scores from a hashed maximum-entropy model over classes of words.

P(word | history) = P(class | history) P(subclass | class, word before) P(word | subclass).  A word's
class is hashed from its ending, its subclass from the whole word.  The first factor is log-linear in
hashed features of the word before (n-gram), of the one before that (skip), and of both together; the
second in the word before; the third is the smoothed share of the word in its subclass.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.chunks import answered, ask, packed, unpacked
from cairn.llm.common import cut, partitions, pick, text_batches

HISTORIES, CLASSES, SUBCLASSES, PAIRS, BLOCKS = 256, 32, 32, 4096, 16
ROUNDS, SMOOTH, FOLDS = 12, 0.1, 10
END = b"\n"  # stands for the end of a text; no word holds white space
LEAVES = CLASSES * SUBCLASSES


def held_out(key: int | None) -> bool:
    """Whether a document is kept from training; one without an id counts as the empty text."""
    return zlib.crc32(b"" if key is None else str(key).encode()) % FOLDS == 0


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split()


@lru_cache(maxsize=200_000)
def places(word: bytes) -> tuple[int, int]:
    """(bucket as history, subclass within all classes)."""
    leaf = zlib.crc32(word[-2:]) % CLASSES * SUBCLASSES + zlib.crc32(word) // 7 % SUBCLASSES
    return zlib.crc32(word if len(word) < 5 else word[-3:]) % HISTORIES, leaf


_PAIR = (np.arange(HISTORIES)[:, None] * 8191 + np.arange(HISTORIES)[None, :] * 127) % 65_521 % PAIRS


@dataclass
class Weights:
    bias: np.ndarray  # class
    before: np.ndarray  # history, class
    skip: np.ndarray  # history two back, class
    pair: np.ndarray  # hashed pair of histories, class
    inner: np.ndarray  # history, class, subclass


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(-1, keepdims=True)
    return x - np.log(np.exp(x).sum(-1, keepdims=True))


def class_logs(w: Weights, rows: slice = slice(None)) -> np.ndarray:
    """log P(class | word before, the one before that), for some of the words before."""
    return _log_softmax(w.bias + w.before[rows, None] + w.skip[None] + w.pair[_PAIR[rows]])


class _Codes(dict):
    """A number for each distinct word, in the order met; the end of a text has number 0."""

    def __init__(self) -> None:
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = made = len(self)
        return made


@dataclass
class Tokens:
    words: list[bytes]  # distinct, the end first
    at: np.ndarray  # place of each token's word in `words`, ends included
    before: np.ndarray  # bucket of the word before
    two: np.ndarray  # bucket of the one before that
    leaf: np.ndarray  # subclass
    sizes: np.ndarray  # tokens of each document


def _histories(docs: list[list[bytes]]) -> Tokens:
    """All tokens of some documents; places are worked out once for each distinct word."""
    codes, sizes = _Codes(), np.array([len(d) + 1 for d in docs])
    flat = chain.from_iterable(chain(d, (END,)) for d in docs)
    at = np.fromiter(map(codes.__getitem__, flat), np.int64, int(sizes.sum()))
    bucket, leaf = np.array([places(w) for w in codes]).T
    end = bucket[:1]
    before = np.concatenate([end, bucket[at[:-1]]])
    two = np.concatenate([end, before[:-1]])
    two[np.cumsum(sizes)[:-1]] = end  # a document's first word has nothing before it
    return Tokens(list(codes), at, before, two, leaf[at], sizes)


def _sum_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds up packed arrays by some columns, one array in memory at a time."""
    names = [*by, "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for *now, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if total is not None and now != key:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, [*key, packed(total)], strict=True))], batch.schema)
                    total = None
                key, mine = now, unpacked(raw)
                total = mine if total is None else total + mine
        if total is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, [*key, packed(total)], strict=True))], schema_of(by))

    def schema_of(by: list[str]) -> pa.Schema:
        return pa.schema([*((c, pa.int32()) for c in by), ("counts", pa.binary())])

    wide = partitions(rows.sparkSession, BLOCKS)
    spread = rows.select(*names).repartition(wide, *by).sortWithinPartitions(*by)
    return spread.mapInArrow(run, ", ".join([*(f"{c} int" for c in by), "counts binary"]))


def class_counts(docs: DataFrame) -> DataFrame:
    """(block, counts): how often each class and subclass follows each history in the training documents.

    A task counts all its documents into one array and sends it in blocks of histories.
    """
    wide, sub = HISTORIES * HISTORIES * CLASSES, HISTORIES * LEAVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, any_rows = np.zeros(wide, np.int64), np.zeros(sub, np.int64), False
        for keys, texts in text_batches(batches, 1 << 21):
            train = [words_of(t) for k, t in zip(keys, texts, strict=True) if not held_out(k)]
            if not train:
                continue
            any_rows = True
            t = _histories(train)
            for total, at in (
                (first, (t.before * HISTORIES + t.two) * CLASSES + t.leaf // SUBCLASSES),
                (second, t.before * LEAVES + t.leaf),
            ):
                found, counts = np.unique(at, return_counts=True)
                total[found] += counts
        if any_rows:
            both = [x.reshape(BLOCKS, -1) for x in (first, second)]
            raw = [packed(np.concatenate([a, b])) for a, b in zip(*both, strict=True)]
            salt = zlib.crc32(raw[0]) % 64
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(raw, pa.binary())],
                names=["block", "salt", "counts"],
            )

    counted = docs.mapInArrow(run, "block int, salt int, counts binary")
    return cut(_sum_counts(_sum_counts(counted, ["block", "salt"]), ["block"]))


def _split(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    flat, rows = unpacked(raw), HISTORIES // BLOCKS
    k = rows * HISTORIES * CLASSES
    return flat[:k].reshape(rows, HISTORIES, CLASSES), flat[k:].reshape(rows, CLASSES, SUBCLASSES)


def start(counts: DataFrame) -> tuple[Weights, float]:
    """Weights from smoothed shares of single features, and the number of training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                joint, inner = _split(raw)
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "sums": packed((joint.sum(1), joint.sum(0), inner))}],
                    pa.schema([("block", pa.int32()), ("sums", pa.binary())]),
                )

    rows = HISTORIES // BLOCKS
    before, skip = np.zeros((HISTORIES, CLASSES)), np.zeros((HISTORIES, CLASSES))
    inner = np.zeros((HISTORIES, CLASSES, SUBCLASSES))
    for r in counts.mapInArrow(run, "block int, sums binary").collect():
        mine, theirs, subs = unpacked(r["sums"])
        at = slice(r["block"] * rows, (r["block"] + 1) * rows)
        before[at], skip, inner[at] = mine, skip + theirs, subs
    total = before.sum()
    share = (before.sum(0) + 1) / (total + CLASSES)

    def lift(n: np.ndarray, base: np.ndarray, weight: float) -> np.ndarray:
        return np.log((n + weight * base) / (n.sum(-1, keepdims=True) + weight) / base)

    subs = inner.sum(0)
    sub_share = (subs + 1) / (subs.sum(1, keepdims=True) + SUBCLASSES)
    return (
        Weights(
            np.log(share),
            0.7 * lift(before, share, 20),
            0.5 * lift(skip, share, 20),
            np.zeros((PAIRS, CLASSES)),
            np.log(sub_share) + lift(inner, sub_share, 20),
        ),
        total,
    )


def train(counts: DataFrame, rounds: int = ROUNDS) -> Weights:
    """Adaptive gradient rounds on the whole training likelihood; each task gives the gradient of its histories.

    The sum of gradients (a fixed number of weights) is all that meets on the driver.
    """
    w, total = start(counts)
    if not total:
        return w
    rows = HISTORIES // BLOCKS
    seen = [np.full_like(x, 1e-8) for x in (w.bias, w.before, w.skip, w.pair)]
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], w: Weights = w) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    at = slice(block * rows, (block + 1) * rows)
                    joint, _ = _split(raw)
                    off = joint - joint.sum(-1, keepdims=True) * np.exp(class_logs(w, at))
                    pair = np.zeros((PAIRS, CLASSES))
                    np.add.at(pair, _PAIR[at].ravel(), off.reshape(-1, CLASSES))
                    yield pa.RecordBatch.from_pylist(
                        [{"block": block, "sums": packed((off.sum(1), off.sum(0), pair))}],
                        pa.schema([("block", pa.int32()), ("sums", pa.binary())]),
                    )

        before, skip, pair = np.zeros_like(w.before), np.zeros_like(w.skip), np.zeros_like(w.pair)
        for r in counts.mapInArrow(run, "block int, sums binary").collect():
            mine, theirs, both = unpacked(r["sums"])
            before[r["block"] * rows : (r["block"] + 1) * rows] = mine
            skip, pair = skip + theirs, pair + both
        new = []
        for x, step, past in zip(
            (w.bias, w.before, w.skip, w.pair), (before.sum(0), before, skip, pair), seen, strict=True
        ):
            step = step / total - 1e-6 * x
            past += step**2
            new.append(x + 0.15 * step / np.sqrt(past))
        w = Weights(*new, w.inner)
    return w


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    Both scores are log10 probabilities of the whole text with its end: base_score of a smoothed unigram
    model, score of the maximum-entropy model, both learned from the documents not held out.  A null
    text is empty (its end alone is scored); repeated rows count as often as they stand there.
    """
    rows = pick(docs, key=key, text=text)

    def words(keys: list, texts: list[str]) -> dict[bytes, int]:
        counts: Counter = Counter()
        others: set[bytes] = {END}
        for k, t in zip(keys, texts, strict=True):
            if held_out(k):
                others.update(words_of(t))
            else:
                counts.update(words_of(t))
                counts[END] += 1
        return {**dict.fromkeys(others, 0), **counts}

    def answer(lists: list[tuple[list, np.ndarray]]) -> tuple[list[bytes], list[int]]:
        table: Counter = Counter()
        for mine, counts in lists:
            for w, n in zip(mine, counts.tolist(), strict=True):
                table[w] += n
        sums = np.zeros((2, LEAVES), np.int64)
        for w, n in table.items():
            if n:
                leaf = places(w)[1]
                sums[0, leaf] += n
                sums[1, leaf] += 1
        return [packed(np.array([table[w] for w in mine], np.int64)) for mine, _ in lists], sums.ravel().tolist()

    answers = cut(ask(rows, words, answer))
    summed = answers.select(F.posexplode("sums").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(2 * LEAVES, np.int64)
    for r in summed:
        flat[r["at"]] = r["n"]
    in_leaf, kinds = flat.reshape(2, LEAVES)
    total, distinct = int(in_leaf.sum()), int(kinds.sum())
    weights = train(class_counts(rows), rounds)
    weights = Weights(*(x.astype(np.float32) for x in (weights.bias, weights.before, weights.skip, weights.pair, weights.inner)))

    def finish(keys: list, texts: list[str], known: dict) -> Iterable[pa.RecordBatch]:
        t = _histories([words_of(x) for x in texts])
        before, leaf, sizes = t.before, t.leaf, t.sizes
        counts = np.fromiter(map(known.__getitem__, t.words), np.int64, len(t.words))[t.at]
        base = np.log10((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        inner = _log_softmax(weights.inner).reshape(HISTORIES, LEAVES)
        logs = class_logs(weights)[before, t.two, leaf // SUBCLASSES].astype(float) + inner[before, leaf]
        own = np.log10((counts + SMOOTH) / (in_leaf + SMOOTH * (kinds + 1))[leaf])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array([held_out(k) for k in keys]),
                pa.array(sizes, pa.int64()),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                pa.array([total] * len(keys), pa.int64()),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(logs / np.log(10) + own, starts)),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return answered(rows, answers, words, lambda raw, n: unpacked(raw).tolist(), finish, schema)
