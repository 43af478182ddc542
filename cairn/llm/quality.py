"""Document quality from overlapping heuristic labellers, their accuracies found by expectation-maximisation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import cut, pick

LABELLERS = ["symbols", "capitals", "repeats", "bars", "variety", "sentences", "function_words", "size", "word_length"]
SAMPLE, BUCKETS = 10_000, 1 << 12
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it was for on are with as be at this or by from an not "
    "le la les de des du et en un une que qui dans pour pas sur est au "
    "der die das und ist von zu den mit auf für ein eine nicht dem im sich "
    "el los las y con por para una del se no su al lo".split()
)
_SYMBOLS = re.compile(r"([^\w\s])\1+$")
_SHAPES = [(re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[^\W\dA_]+"), "a"), (re.compile(r"\d+"), "9")]

# What is known of a word, in the bits above its hashed shape.
SYMBOL, CAPITAL, BAR, STOP, FUNCTION = (1 << k for k in range(16, 21))


def word_facts(word: str) -> int:
    shape = word
    for pattern, sign in _SHAPES:
        shape = pattern.sub(sign, shape)
    letters = [c for c in word if c.isalpha()]
    return (
        zlib.crc32(shape.encode("utf-8", "surrogatepass")) % BUCKETS
        | SYMBOL * bool(_SYMBOLS.search(word))
        | CAPITAL * (len(letters) > 1 and all(c.isupper() for c in letters))
        | BAR * (word.strip("|") == "")
        | STOP * (word[-1] in ".?,;:")
        | FUNCTION * (word.lower().strip(".,;:!?") in FUNCTION_WORDS)
    )


class _Facts(dict):
    """word_facts by word; emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = made = word_facts(word)
        return made


def read_text(text: str, facts: dict[str, int]) -> tuple[str, np.ndarray, np.ndarray, int]:
    """(votes, features, their values, words): a vote is 0 bad, 1 good or - none, for each of LABELLERS.

    A text without words gets one vote, "bad" of the size labeller.
    """
    words = text.split()
    n = len(words)
    if not n:
        return "-" * 7 + "0-", np.array([BUCKETS]), np.ones(1), 0
    known = np.fromiter(map(facts.__getitem__, words), np.int64, n)
    repeats = sum(map(eq, words, words[1:])) / n
    variety = len(set(words)) / n**0.8
    share = {k: np.count_nonzero(known & k) / n for k in (SYMBOL, CAPITAL, BAR, STOP, FUNCTION)}
    length = sum(map(len, words)) / n

    def vote(bad: bool, good: bool) -> str:
        return "0" if bad else "1" if good else "-"

    votes = "".join(
        [
            vote(share[SYMBOL] > 0.25, share[SYMBOL] < 0.05),
            vote(share[CAPITAL] > 0.4, share[CAPITAL] < 0.1),
            vote(repeats > 0.25, repeats < 0.05),
            vote(share[BAR] > 0.15, share[BAR] < 0.02),
            vote(n >= 50 and variety < 0.5, n >= 50 and variety > 1),
            vote(n >= 15 and share[STOP] < 0.02, 0.03 < share[STOP] < 0.6),
            vote(n >= 30 and share[FUNCTION] < 0.02, share[FUNCTION] > 0.06),
            vote(n < 2, n >= 20),
            vote(not 2 <= length <= 15, 3 <= length <= 10),
        ]
    )
    shapes, counts = np.unique(known % BUCKETS, return_counts=True)
    extra = [BUCKETS, BUCKETS + 1, BUCKETS + 2]
    values = [1.0, repeats, min(variety, 1.5) if n >= 50 else 1.5]
    return votes, np.concatenate([shapes, extra]), np.concatenate([np.sqrt(counts / n), values]), n


@dataclass(frozen=True)
class Model:
    """accuracies: P(vote | bad), P(vote | good) for each labeller; posteriors by vote pattern; weights of the scorer."""

    prior: float
    accuracies: np.ndarray
    posteriors: dict[str, float]
    weights: np.ndarray

    def score(self, features: np.ndarray, values: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[features] @ values, -50, 50))))


def label_model(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Expectation-maximisation over counts of vote patterns, begun from the share of good votes."""
    if not patterns:
        return 0.5, np.full((2, len(LABELLERS), 2), 0.5), {}
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], float)
    votes = np.array([["01-".index(c) for c in p] for p in names])
    hot = np.eye(3)[votes][:, :, :2]  # pattern, labeller, vote; an abstention tells nothing
    good, bad = (votes == 1).sum(1), (votes == 0).sum(1)
    posterior = np.where(bad, 0.1, (good + 0.5) / (good + bad + 1))
    for _ in range(rounds):
        both = np.stack([1 - posterior, posterior])
        weight = both * counts
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        accuracies = np.einsum("kp,pjv->kjv", weight, hot) + 0.5
        accuracies /= accuracies.sum(2, keepdims=True)
        logs = np.einsum("pjv,kjv->kp", hot, np.log(accuracies)) + np.log([[1 - prior], [prior]])
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return float(prior), accuracies, dict(zip(names, posterior.tolist(), strict=True))


def train_scorer(rows: list[tuple[list[int], list[float], float]], rounds: int = 300) -> np.ndarray:
    """Logistic weights for (features, values, wanted probability) by adaptive gradient steps."""
    weights = np.zeros(BUCKETS + 3)
    if not rows:
        return weights
    cols = np.concatenate([r[0] for r in rows]).astype(int)
    vals = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    want, total = np.array([r[2] for r in rows]), np.full(len(weights), 1e-8)
    bad = max(1e-3, float((1 - want).sum()))
    scale = np.where(want < 0.5, min(10.0, max(1.0, want.sum() / bad)), 1.0)
    for _ in range(rounds):
        got = 1 / (1 + np.exp(-np.bincount(of, weights[cols] * vals, len(rows))))
        step = np.bincount(cols, ((got - want) * scale)[of] * vals, len(weights)) / len(rows) + 1e-5 * weights
        total += step**2
        weights -= 0.3 * step / np.sqrt(total)
    return weights


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Facts()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [read_text(t or "", facts) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([r[0] for r in rows]),
                        pa.array([r[1].astype(np.int32) for r in rows], pa.list_(pa.int32())),
                        pa.array([r[2].astype(np.float32) for r in rows], pa.list_(pa.float32())),
                    ],
                    names=["key", "votes", "features", "amounts"],
                )

    return docs.mapInArrow(run, "key long, votes string, features array<int>, amounts array<float>")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Labeller accuracies from the votes on all documents; the scorer from about `sample` of them, drawn by hash of doc_id.

    There are at most 3 patterns for each of nine votes to the ninth power, so their counts fit the
    driver.  An empty table gives a model that scores every document 0.5.
    """
    read = cut(_features(pick(docs, key="doc_id", text="text")))
    patterns = {r["votes"]: r["count"] for r in read.groupBy("votes").count().collect()}
    prior, accuracies, posteriors = label_model(patterns)
    step = 1 << 20
    share = min(step, round(step * sample / max(1, sum(patterns.values()))))
    drawn = read.filter(F.pmod(F.xxhash64("key", "votes"), F.lit(step)) < share).limit(2 * sample)
    rows = drawn.select("features", "amounts", "votes").collect()
    weights = train_scorer([(r["features"], r["amounts"], posteriors[r["votes"]]) for r in rows])
    return Model(prior, accuracies, posteriors, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (probability of good), keep (score of 0.5 or more), votes and posterior of every document.

    A null text is empty; a text without words is not kept.  Repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Facts()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [read_text(t or "", facts) for t in part.column(1).to_pylist()]
                scores = [model.score(f, v) if n else 0.0 for _, f, v, n in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(scores, pa.float64()),
                        pa.array([s >= 0.5 for s in scores]),
                        pa.array([r[0] for r in rows]),
                        pa.array([model.posteriors.get(r[0]) for r in rows], pa.float64()),
                        pa.array([r[3] for r in rows], pa.int64()),
                    ],
                    names=["doc_id", "score", "keep", "votes", "posterior", "n_words"],
                )

    schema = "doc_id long, score double, keep boolean, votes string, posterior double, n_words long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the scorer keeps, with all their columns."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        facts = _Facts()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = (read_text(t or "", facts) for t in part.column(place).to_pylist())
                kept = [n > 0 and model.score(f, v) >= 0.5 for _, f, v, n in rows]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, fit(docs, sample))
