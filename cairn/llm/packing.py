"""Best-fit packing planned over the histogram of lengths, not over documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.bpe import encode_text
from cairn.llm.common import cut, partitions, pick, text_batches

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
END_ID = 2
PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long, tie int"


def token_pieces(
    docs: DataFrame, size: int = 1024, vocabulary: str = VOCABULARY, rank_file: str = RANKS, end_id: int = END_ID
) -> DataFrame:
    """Pieces of at most `size` ids of each document (ids of its text, then end_id).

    A null text is empty and gives one piece of one id.  A longer document is cut into pieces of
    exactly `size`, the first of them taking the remainder.  Repeated rows give repeated pieces; tie
    (a checksum of all ids) only orders rows of equal doc_id.
    """

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        for keys, texts in text_batches(batches, 1 << 20):
            rows: list[tuple] = []
            for key, text in zip(keys, texts, strict=True):
                raw = encode_text(text, vocabulary, rank_file) + end
                n, tie = len(raw) // 4, zlib.crc32(raw) & 0x7FFFFFFF
                start, stop, k = 0, n % size or min(n, size), 0
                while start < n:
                    rows.append((key, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop]), tie))
                    start, stop, k = stop, stop + size, k + 1
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "tie"],
            )

    return pick(docs, key="doc_id", text="text").mapInArrow(cut_up, PIECE_TYPE)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, copies, copies per sequence, first sequence, offset).

    Sequences filled alike are one group (first sequence, how many, filled so far).  A length goes to
    the groups with the least room that still takes it, as often as it fits, and then to new sequences.
    """
    groups: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, how many)
    placed, opened = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        kept: list[tuple[int, tuple[int, int]]] = []
        while left:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                first, room = opened, size
                many = -(-left // (size // length))
                opened += many
            else:
                first, many = groups[room].pop()
                if not groups[room]:
                    del groups[room]
            fit = room // length
            full, rest = min(many, left // fit), 0
            if full < many:
                rest = left - full * fit
            copies = full * fit + rest
            placed.append((length, rank, copies, fit, first, size - room))
            if full:
                kept.append((room - fit * length, (first, full)))
            if rest:
                kept.append((room - rest * length, (first + full, 1)))
            if (unused := many - full - (rest > 0)) > 0:
                kept.append((room, (first + full + (rest > 0), unused)))
            rank, left = rank + copies, left - copies
        for room, group in kept:
            if room:
                groups.setdefault(room, []).append(group)
    return placed


def pack(pieces: DataFrame, size: int = 1024) -> DataFrame:
    """sequence_id and offset for each piece; in as few sequences as best fit over all lengths finds.

    Only the histogram (at most `size` lengths) and the plan made from it meet on the driver.  A piece
    takes the slot of its rank within its length.  Ranks are counted in buckets of about the square
    root of a length's count, so no length, however common, is ranked in one task.  An empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    pieces = cut(pieces)
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(
        [(*p, at) for p in plan(counts, size) for at in range(0, p[2], 100_000)] or [],
        "length long, first long, copies long, fit long, sequence long, filled long, at long",
    )
    wide = partitions(spark)
    slots = (
        slots.repartition(wide)
        .withColumn("step", F.explode(F.sequence("at", F.least(F.col("at") + 99_999, F.col("copies") - 1))))
        .select(
            "length",
            (F.col("first") + F.col("step")).alias("rank"),
            (F.col("sequence") + F.floor(F.col("step") / F.col("fit"))).alias("sequence_id"),
            (F.col("filled") + (F.col("step") % F.col("fit")) * F.col("length")).alias("offset"),
        )
    )
    buckets = spark.createDataFrame(
        [(k, max(1, min(n // 64, int(n**0.5) * 2))) for k, n in counts.items()] or [], "length long, many long"
    )
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "tie"), F.col("many"))
    )
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("length", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "tie")
    ranked = (
        dealt.withColumn("row", F.row_number().over(inside))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("row") - 1)
    )
    # There is a slot for each piece, though the plan they come from is small: they move by key.
    return ranked.join(slots.hint("merge"), ["length", "rank"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, size: int = 1024) -> DataFrame:
    return pack(token_pieces(docs, size), size)
