"""BPE encoding through a table of distinct words, and decoding through the id-to-piece table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.bpe import encode_words, exact, pieces, words_of
from cairn.llm.chunks import answered, ask, packed, unpacked
from cairn.llm.common import pick

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def _distinct(keys: list, texts: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for text in texts:
        out.update(dict.fromkeys(words_of(text)[1:], 1))
    return out


def encode(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    rank_file: str = RANKS,
    key: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """n_tokens, digests of the ids and of the decoded text (and the ids themselves) for each document.

    Texts are split into words (bpe.words_of); each distinct word of the corpus is encoded in one
    place, and its ids come back to every chunk of documents by position in the list of words sent.
    Ids turn into text again by looking each up in the table of pieces, whose size is fixed.  A null or
    empty text has no ids; repeated rows give repeated rows.
    """

    def answer(lists: list[tuple[list, np.ndarray]]) -> tuple[list[bytes], list[int]]:
        table: dict[str, int] = {}
        for words, _ in lists:
            table.update(dict.fromkeys(words, 0))
        ids = encode_words(list(table), vocabulary, rank_file)
        of = dict(zip(table, ids, strict=True))
        out = []
        for words, _ in lists:
            mine = [of[w] for w in words]
            flat = np.frombuffer(b"".join(mine), "<u4")
            out.append(packed((np.fromiter((len(x) // 4 for x in mine), np.uint32, len(mine)), flat.astype(np.uint16))))
        return out, []

    def read(raw: bytes, n: int) -> list[bytes]:
        counts, flat = unpacked(raw)
        ids = flat.astype("<u4").tobytes()
        ends = (4 * np.cumsum(counts, dtype=np.int64)).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def finish(keys: list, texts: list[str], known: dict[str, object]) -> Iterable[pa.RecordBatch]:
        table, rows = pieces(vocabulary), []
        for k, t in zip(keys, texts, strict=True):
            words = words_of(t)
            raw = (exact(words[0], vocabulary) if words[0] else b"") + b"".join(map(known.__getitem__, words[1:]))
            ids = np.frombuffer(raw, "<u4")
            decoded = b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")
            rows.append((k, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), raw))
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *map(pa.array, columns[2:4])]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in columns[4]], pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = pick(docs, key=key, text=text)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return answered(rows, ask(rows, _distinct, answer), _distinct, read, finish, schema)
