"""Personal data in texts: fixed patterns, and a skip-chain conditional random field that adds what they miss."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import pick

KINDS = ["email", "ip", "card", "phone"]
SAMPLE_DOCS, SAMPLE_TOKENS, CERTAIN, ROUNDS = 20_000, 200_000, 0.9, 12

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ACTIVE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_TRIM = "\"'`,;:!?()[]{}<>*#$%&|="

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and kind.

    A local part always reaches back from its @ to the first other character or the last match, and
    digits of an address or a card to the start of their run, so no place is tried twice.
    """
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _ACTIVE.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


_GROUPS = {"digits": 9, "dots": 5, "length": 6, "before": 4, "after": 4, "flags": 12}
_STARTS = dict(zip(_GROUPS, np.cumsum([0, *_GROUPS.values()]).tolist(), strict=False))
N_FEATURES = sum(_GROUPS.values())


def token_features(token: str, before: str, after: str) -> list[int]:
    """Places of the features that hold for a token, out of N_FEATURES."""
    core = token.strip(_TRIM)
    digits = sum("0" <= c <= "9" for c in core)
    parts = core.rstrip(".").split(".")
    quad = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts)
    flags = [
        True,
        "@" in core,
        "@" in core and "." in core.partition("@")[2],
        core[:1] == "+" or token[:1] == "+",
        "(" in token or ")" in token,
        "-" in core,
        any(c.isalpha() for c in core),
        quad,
        "=" in token or "/" in token,
        bool(core) and all(c in "0123456789-.()+ " for c in core),
        core[:1].isdigit(),
        digits == len(core),
    ]

    def side(word: str) -> int:
        return 0 if not word else 1 if _ACTIVE.search(word) else 2 if word[-1:] in ":=" else 3

    return [
        _STARTS["digits"] + _bucket(digits, (1, 2, 4, 5, 8, 10, 14, 20)),
        _STARTS["dots"] + _bucket(core.count("."), (1, 2, 3, 4)),
        _STARTS["length"] + _bucket(len(core), (3, 6, 11, 16, 30)),
        _STARTS["before"] + side(before),
        _STARTS["after"] + side(after),
        *(_STARTS["flags"] + k for k, held in enumerate(flags) if held),
    ]


@dataclass
class Field:
    """The random field of one text over its tokens with a digit or an @; all others are fixed as none of the kinds.

    chain: pairs of neighbouring tokens.  skips: pairs of distant tokens that are alike (the same
    word, address name or digits), each linked to the next of its like only, so a token repeated many
    times costs as many links as it has places.
    """

    places: list[tuple[int, int]]
    features: list[list[int]]
    fixed_before: list[bool]
    fixed_after: list[bool]
    chain: list[tuple[int, int]]
    skips: list[tuple[int, int]]


def field_of(text: str) -> Field:
    made = Field([], [], [], [], [], [])
    if not _ACTIVE.search(text):
        return made
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    last, seen = -2, {}
    for i, (start, end, token) in enumerate(tokens):
        if not _ACTIVE.search(token):
            continue
        node = len(made.places)
        before = tokens[i - 1][2] if i else ""
        after = tokens[i + 1][2] if i + 1 < len(tokens) else ""
        made.places.append((start, end))
        made.features.append(token_features(token, before, after))
        if last == i - 1:
            made.chain.append((node - 1, node))
        made.fixed_before.append(last != i - 1)
        made.fixed_after.append(not _ACTIVE.search(after))
        word = token.strip(_TRIM + ".").lower()
        keys = {word, "".join(c for c in word if c.isdigit())[-7:]}
        if "@" in word:
            keys.add(word.partition("@")[0])
        near = set()
        for key in keys:
            if len(key) > 5:
                if key in seen and (seen[key], node) not in made.chain[-1:]:
                    near.add((seen[key], node))
                seen[key] = node
        made.skips += sorted(near)
        last = i
    return made


@dataclass(frozen=True)
class Weights:
    unary: np.ndarray  # feature, label
    chain: np.ndarray  # label, next label
    skip: np.ndarray  # label shared by both ends


def token_labels(places: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    """0 or 1 + kind of the first span that overlaps each token."""
    ordered = sorted(spans)
    starts = [s for s, _, _ in ordered]
    reach = np.maximum.accumulate([e for _, _, e in ordered]).tolist() if ordered else []
    out = []
    for start, end in places:
        k = bisect_left(reach, start + 1)
        hit = next((s for s in ordered[k : bisect_left(starts, end)] if s[2] > start), None)
        out.append(1 + hit[1] if hit else 0)
    return out


EXAMPLE = "features array<int>, before int, after int, skips array<int>, label int"


def examples(docs: DataFrame) -> DataFrame:
    """A row per token of the field: its features, its neighbours' labels (of the fixed patterns) and its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                f = field_of(text or "")
                if not f.places:
                    continue
                labels = token_labels(f.places, base_spans(text))
                before, after, skips = [0] * len(labels), [0] * len(labels), [[0] * 5 for _ in labels]
                for a, b in f.chain:
                    before[b], after[a] = labels[a], labels[b]
                for a, b in f.skips:
                    skips[a][labels[b]] += 1
                    skips[b][labels[a]] += 1
                columns = [f.features, before, after, skips, labels]
                names = [x.split()[0] for x in EXAMPLE.split(", ")]
                types = [pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
                )

    return docs.select("text").mapInArrow(run, EXAMPLE)


def train(rows: list, rounds: int = 300) -> Weights:
    """Weights of greatest pseudo-likelihood: each token given the labels of its neighbours."""
    unary, chain, skip = np.zeros((N_FEATURES, 5)), np.zeros((5, 5)), np.ones(5)
    if not rows:
        return Weights(unary, chain, skip)
    x = np.zeros((len(rows), N_FEATURES))
    x[np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.concatenate([r[0] for r in rows])] = 1
    before, after, label = (np.array([r[k] for r in rows]) for k in (1, 2, 4))
    alike = np.array([r[3] for r in rows], float)
    # Each token twice, once with half of its features hidden, so that neighbours and likes have a say.
    x = np.concatenate([x, x * (np.random.default_rng(0).random(x.shape) < 0.5)])
    before, after, label, alike = (np.concatenate([a, a]) for a in (before, after, label, alike))
    hot, prior, later = np.eye(5)[label], np.eye(5)[before], np.eye(5)[after]
    totals = [np.full_like(w, 1e-6) for w in (unary, chain, skip)]
    for _ in range(rounds):
        logits = x @ unary + chain[before] + chain[:, after].T + alike * skip
        p = np.exp(logits - logits.max(1, keepdims=True))
        off = (p / p.sum(1, keepdims=True) - hot) / len(x)
        steps = [x.T @ off, prior.T @ off + off.T @ later, (alike * off).sum(0)]
        for w, step, total in zip((unary, chain, skip), steps, totals, strict=True):
            step += 1e-4 * (w - (w is skip))  # without evidence likes pull by 1, all else by 0
            total += step**2
            w -= 0.2 * step / np.sqrt(total)
        np.clip(skip, 0, 4, out=skip)  # likeness never speaks against a shared label
    return Weights(unary, chain, skip)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_tokens: int = SAMPLE_TOKENS) -> Weights:
    """Trains on the fixed patterns' labels in about sample_docs documents, drawn by hash of doc_id, at most sample_tokens tokens."""
    step = 1 << 20
    share = min(step, round(step * sample_docs / max(1, docs.count())))
    drawn = docs.select("doc_id", "text").filter(F.pmod(F.xxhash64("doc_id"), F.lit(step)) < share)
    return train(examples(drawn).limit(sample_tokens).collect())


def beliefs(fields: list[Field], weights: Weights, rounds: int = ROUNDS) -> np.ndarray:
    """Label probabilities of all tokens of some fields, by damped loopy message passing on all of them at once."""
    sizes = [len(f.places) for f in fields]
    total, shift = sum(sizes), np.cumsum([0, *sizes])
    if not total:
        return np.zeros((0, 5))
    flat = [k for f in fields for k in f.features]
    owner = np.repeat(np.arange(total), [len(k) for k in flat])
    local = np.zeros((total, 5))
    np.add.at(local, owner, weights.unary[np.concatenate(flat)])
    local += np.where([[b] for f in fields for b in f.fixed_before], weights.chain[0], 0)
    local += np.where([[b] for f in fields for b in f.fixed_after], weights.chain[:, 0], 0)
    chain = [(a + s, b + s) for f, s in zip(fields, shift, strict=False) for a, b in f.chain]
    skips = [(a + s, b + s) for f, s in zip(fields, shift, strict=False) for a, b in f.skips]
    pairs = np.array(chain + skips, int).reshape(-1, 2)
    shared = np.diag(weights.skip)
    forth = np.array([weights.chain] * len(chain) + [shared] * len(skips)).reshape(-1, 5, 5)
    source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    table = np.concatenate([forth, forth.transpose(0, 2, 1)])
    m = len(pairs)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    sent = np.zeros((2 * m, 5))
    for _ in range(rounds if m else 0):
        belief = local.copy()
        np.add.at(belief, target, sent)
        out = (belief[source] - sent[back])[:, :, None] + table
        top = out.max(1)
        new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
        sent = 0.5 * sent + 0.5 * (new - new.max(1, keepdims=True))
    np.add.at(local, target, sent)
    p = np.exp(local - local.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, field: Field, belief: np.ndarray, base: list[Span]) -> list[Span]:
    """Runs of neighbouring tokens that are surely of one kind and touch no span of the fixed patterns."""
    out: list[Span] = []
    taken = token_labels(field.places, base)
    linked, last = {b for _, b in field.chain}, 0
    for i, (start, end) in enumerate(field.places):
        k = int(belief[i].argmax())
        if not k or belief[i, k] < CERTAIN or taken[i]:
            last = 0
            continue
        while start < end and text[start] in _TRIM and text[start] != "(":
            start += 1
        while end > start and text[end - 1] in _TRIM + "." and text[end - 1] != ")":
            end -= 1
        if start < end:
            if last == k and i in linked:
                out[-1] = (out[-1][0], k - 1, end)
            else:
                out.append((start, k - 1, end))
            last = k
    return out


def find(texts: list[str], weights: Weights) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the fixed patterns, all spans) of each text."""
    base, fields = [base_spans(t) for t in texts], [field_of(t) for t in texts]
    belief, at, out = beliefs(fields, weights), 0, []
    for text, spans, f in zip(texts, base, fields, strict=True):
        mine = belief[at : at + len(f.places)]
        at += len(f.places)
        out.append((spans, sorted({*spans, *added_spans(text, f, mine, spans)})))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            yield batch.slice(at, 128)


def detect(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, spans of the fixed patterns counted by kind, their digest, all spans, and how many the field added.

    A null or empty text has no spans; repeated rows give repeated rows; null ids stay null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            found = find([t or "" for t in part.column(1).to_pylist()], weights)
            counts = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]),
                    pa.array([written(spans) for _, spans in found]),
                    pa.array([len(spans) - len(base) for base, spans in found], pa.int64()),
                ],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    schema = (
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )
    rows = pick(docs, doc_id="doc_id", text="text")
    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first, and what is left of the next."""
    out, at = [], 0
    for start, kind, end in spans:
        if end > at:
            out += [text[at : max(at, start)], f"[{KINDS[kind]}]"]
            at = end
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, weights: Weights) -> DataFrame:
    """All documents with their columns, personal data in the text masked and n_chars (where there is one) counted anew."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            texts = part.column(place).to_pylist()
            found = find([t or "" for t in texts], weights)
            new = [t if t is None else masked(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
            columns = list(part.columns)
            columns[place] = pa.array(new, part.schema.field(place).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                old = columns[k].to_pylist()
                sizes = [n if a == b else len(b) for n, a, b in zip(old, texts, new, strict=True)]
                columns[k] = pa.array(sizes, part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)
