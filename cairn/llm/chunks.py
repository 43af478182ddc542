"""Facts about words that live in another table, brought to the texts without a row per word.

Joining every word of every text with a table of words would shuffle the corpus many times over.
Here a task packs its rows into chunks (a few MB of text) and sends the distinct words of a chunk,
split by hash into shards, to where each distinct word of the corpus is handled once.  The answers,
in the order of the words sent, come back by (chunk, shard) and meet the chunk again.

A chunk is named by a digest of what is in it.  Both sides are computed from the same rows, so the
input has to be stable: files, or a table written before (common.cut).
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import partitions, pick, text_batches

CHUNK_CHARS = 6_000_000

#: Distinct words (text or bytes) of a chunk with a count each, from its keys and texts.
Words = Callable[[list, list[str]], dict]
#: Answers to all lists of one shard: from (words, counts) of each chunk, one answer each, and sums to keep for the shard.
Shard = Callable[[list[tuple[list, np.ndarray]]], tuple[list[bytes], list[int]]]
#: Rows of a chunk from its keys, texts and the answer of each word.
Finish = Callable[[list, list[str], dict[str, object]], Iterable[pa.RecordBatch]]


def packed(data: object) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(data, protocol=5))


def unpacked(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def _named(keys: list, texts: list[str]) -> str:
    facts = [(k, len(t), zlib.crc32(t.encode("utf-8", "surrogatepass"))) for k, t in zip(keys, texts, strict=True)]
    return hashlib.md5(pickle.dumps(facts, protocol=5)).hexdigest()


def by_shard(words: Iterable, shards: int) -> list[list]:
    """Words by shard, each list in the order given."""
    out: list[list] = [[] for _ in range(shards)]
    for w in words:
        out[zlib.crc32(w if isinstance(w, bytes) else w.encode("utf-8", "surrogatepass")) % shards].append(w)
    return out


def ask(docs: DataFrame, words: Words, answer: Shard, shards: int | None = None) -> DataFrame:
    """(chunk, shard, answers, sums) for docs (key, text), each distinct word handled in one place.

    sums stands in one row of each shard and is empty in the others.
    """
    shards = shards or partitions(docs.sparkSession, 64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, CHUNK_CHARS):
            counts, name = words(keys, texts), _named(keys, texts)
            lists = [
                (i, packed((some, np.fromiter((counts[w] for w in some), np.int64, len(some)))))
                for i, some in enumerate(by_shard(counts, shards))
                if some
            ]
            if lists:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(lists)),
                        pa.array([i for i, _ in lists], pa.int32()),
                        pa.array([x for _, x in lists], pa.binary()),
                    ],
                    names=["chunk", "shard", "words"],
                )

    def handle(sent: pa.Table) -> pa.Table:
        answers, sums = answer([unpacked(x) for x in sent.column("words").to_pylist()])
        return pa.table(
            {
                "chunk": sent.column("chunk"),
                "shard": sent.column("shard"),
                "answers": pa.array(answers, pa.binary()),
                "sums": pa.array([sums] + [[]] * (len(answers) - 1), pa.list_(pa.int64())),
            }
        )

    sent = pick(docs, key="key", text="text").mapInArrow(send, "chunk string, shard int, words binary")
    return sent.groupBy("shard").applyInArrow(handle, "chunk string, shard int, answers binary, sums array<long>")


def answered(
    docs: DataFrame, answers: DataFrame, words: Words, read: Callable[[bytes, int], list], finish: Finish, schema: str,
    shards: int | None = None,
) -> DataFrame:
    """finish() on each chunk of docs with what `ask` found; read(raw, n) gives the n answers of a list."""
    shards = shards or partitions(docs.sparkSession, 64)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_batches(batches, CHUNK_CHARS):
            yield pa.RecordBatch.from_arrays(
                [pa.array([_named(keys, texts)]), pa.array([packed((keys, texts))], pa.binary())],
                names=["chunk", "rows"],
            )

    def meet(rows: pa.Table, found: pa.Table) -> pa.Table:
        by = dict(zip(found.column("shard").to_pylist(), found.column("answers").to_pylist(), strict=True))
        out: list[pa.RecordBatch] = []
        for raw in rows.column("rows").to_pylist():
            keys, texts = unpacked(raw)
            known: dict[str, object] = {}
            for i, some in enumerate(by_shard(words(keys, texts), shards)):
                if some:
                    if i not in by:
                        raise ValueError("the input changed between two reads; write it to a table first")
                    known.update(zip(some, read(by[i], len(some)), strict=True))
            out += finish(keys, texts, known)
        if not out:
            raise ValueError("the input changed between two reads; write it to a table first")
        return pa.Table.from_batches(out)

    sides = pick(docs, key="key", text="text").mapInArrow(whole, "chunk string, rows binary")
    return (
        sides.groupBy("chunk")
        .cogroup(answers.select("chunk", "shard", F.col("answers")).groupBy("chunk"))
        .applyInArrow(meet, schema)
    )
