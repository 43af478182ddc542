"""Byte-level BPE ids of whole texts and of their words, inside a task.

A text is cut where the tokenizer's own word pattern always breaks, so the ids of the text are the ids
of the pieces in a row: before every single space between two other characters and, in texts with
no other white space, before every single line break too.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

END = "<|endoftext|>"
NEWLINE_ID = 198
_BREAK_ID = NEWLINE_ID.to_bytes(4, "little")
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_ODD_SPACE = re.compile(r"[^\S ]")
_LOOSE = ("  ", " \n", "\n ", "\n\n")


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine; a path stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: str) -> list[str]:
    """The pieces of a text.

    A piece after the first that begins with a line break stands for itself; any other had a space
    before it, which is left out.
    """
    ends = text[:1] + text[-1:]
    if ends.strip() != ends or any(x in text for x in _LOOSE) or not text.replace("\n", "-").isprintable():
        return _BREAK.split(text)
    return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(vocabulary_path(path))
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=2)
def ranks(path: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(path), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def encode_words(words: list[str], vocabulary: str, rank_file: str) -> list[bytes]:
    """The ids of each piece after a text's first, as little-endian unsigned 32-bit integers.

    Plain pieces go through the merge ranks in one call, parted by line breaks, which the word pattern
    keeps as tokens of their own; pieces with other white space or a special token go one by one.
    """
    out: list[bytes] = [b""] * len(words)
    plain = [i for i, w in enumerate(words) if not (_ODD_SPACE.search(w, w[:1] == "\n") or END in w)]
    for at in range(0, len(plain), 4096):
        some = plain[at : at + 4096]
        lines = (f"{w[1:]}\n" if w[:1] == "\n" else f" {w}\n" for w in map(words.__getitem__, some))
        flat = np.array(ranks(rank_file).encode_ordinary("".join(lines)), dtype="<u4")
        ends = np.flatnonzero(flat == NEWLINE_ID).tolist()
        if len(ends) != len(some):
            raise ValueError("a piece has a line break inside")
        raw, start = flat.tobytes(), 0
        for i, end in zip(some, ends, strict=True):
            ids = raw[4 * start : 4 * end]
            out[i] = _BREAK_ID + ids if words[i][:1] == "\n" else ids
            start = end + 1
    done = set(plain)
    for i, w in enumerate(words):
        if i not in done:
            out[i] = exact(w if w[:1] == "\n" else " " + w, vocabulary)
    return out


def exact(text: str, vocabulary: str) -> bytes:
    return array("I", tokenizer(vocabulary).encode(text, add_special_tokens=False).ids).tobytes()


def encode_text(text: str, vocabulary: str, rank_file: str) -> bytes:
    """The ids of a whole text; the merge ranks give what the tokenizer gives, unless the text names a special token."""
    if END in text:
        return exact(text, vocabulary)
    return ranks(rank_file).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> list[bytes]:
    """The bytes of each id, by the public byte-to-character table of byte-level vocabularies."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shown = {chr(b): b for b in kept}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}
    made = tokenizer(vocabulary)
    special = {i: t.content.encode() for i, t in made.get_added_tokens_decoder().items()}
    return [
        special[i] if i in special else bytes(shown[c] for c in made.id_to_token(i))
        for i in range(made.get_vocab_size(with_added_tokens=True))
    ]
