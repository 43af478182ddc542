"""Operators on documents against brute force, on awkward rows and on an empty table."""

import hashlib
import math
import re
import struct
import zlib
from array import array
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import bpe, codec, maxent, near, order_minhash, packing, pii_crf, quality

VOCABULARY = "byte_bpe_50k.json"


def ids(text):
    return bpe.tokenizer(VOCABULARY).encode(text or "", add_special_tokens=False).ids


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(params=["sample", "awkward"])
def docs(request, spark, sf_dir, awkward):
    return documents(spark, sf_dir) if request.param == "sample" else awkward


PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 14 <= len(digits) <= 19 and pii_crf.luhn(digits))
                or (kind == 3 and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.mark.parametrize(
    "text",
    [
        "a@b.c@d.e x@y@z.com .@-.- a@b a@b. @a.b q.w+1@h-1.co.uk.",
        "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1..2.3.4 1.2.3",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 11111111 378282246310005x",
        "+1 (499) 555-6503 +49 30 1234 +1+2025550123 +1(202)555-0123- (202) 555-0123",
        "9" * 3000 + ".1.1.1 " + "a" * 3000 + "@ " + "+" * 100,
        "",
    ],
)
def test_fixed_patterns(text):
    assert pii_crf.base_spans(text) == plain_spans(text)


def test_field_spreads_labels_to_alike_tokens(spark, sf_dir):
    weights = pii_crf.fit(documents(spark, sf_dir))
    [(base, spans)] = pii_crf.find(["call +1 (499) 555-6503 now or just (499) 555-6503 later"], weights)
    assert set(base) <= set(spans) and pii_crf.find(["no data in 3 words. page 12"], weights) == [([], [])]
    field = pii_crf.field_of("id 555-6503x a 555-6503x b 555-6503x")
    assert field.skips == [(0, 1), (1, 2)]
    strong = pii_crf.Weights(weights.unary * 0, weights.chain * 0, weights.skip * 0 + 3)
    strong.unary[field.features[0], 4] += 2
    lone = pii_crf.beliefs([field], pii_crf.Weights(strong.unary, strong.chain, weights.skip * 0))
    assert (pii_crf.beliefs([field], strong)[:, 4] >= lone[:, 4]).all()


def test_personal_data(docs):
    weights = pii_crf.fit(docs)
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    rows = pii_crf.detect(docs, weights).collect()
    assert len(rows) == sum(texts.values())
    want = Counter((k, hashlib.sha256(pii_crf.written(plain_spans(t or "")).encode()).hexdigest()) for k, t in texts.elements())
    assert Counter((r.doc_id, r.base_sha256) for r in rows) == want
    masked = pii_crf.mask(docs, weights)
    assert masked.columns == docs.columns and masked.count() == docs.count()


def test_codec(docs):
    want = Counter()
    for r in docs.collect():
        made = ids(r.text)
        back = bpe.tokenizer(VOCABULARY).decode(made, skip_special_tokens=False)
        raw = array("I", made).tobytes()
        want[(r.doc_id, len(made), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert Counter(map(tuple, codec.encode(docs).collect())) == want


def test_packing(docs):
    rows = packing.pack_documents(docs, 1024).collect()
    full = Counter()
    for r in docs.collect():
        made = [*ids(r.text), 2]
        stops = [0, *range(len(made) % 1024 or min(1024, len(made)), len(made), 1024), len(made)]
        for k, (a, b) in enumerate(zip(stops, stops[1:], strict=False)):
            full[(r.doc_id, k, a, b - a, zlib.crc32(array("I", made[a:b]).tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == full
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / 1024 + 1


@pytest.mark.parametrize("counts", [{}, {5: 3}, {10: 1, 6: 7, 4: 7, 3: 2}, {7: 100, 3: 99, 1: 5}, {1: 25}])
def test_plan_fills_every_slot_once(counts):
    placed = packing.plan(counts, 10)
    filled, ranks = {}, Counter()
    for length, first, copies, fit, sequence, offset in placed:
        for step in range(copies):
            assert first + step == ranks[length]
            ranks[length] += 1
            filled.setdefault(sequence + step // fit, []).append((offset + step % fit * length, length))
    assert ranks == Counter(counts)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10


def test_language_model(docs):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]
    rows, counts = docs.select("doc_id", "text").collect(), Counter()
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 10 == 0
    for k, t in rows:
        if not held(k):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for k, t in rows:
        mine = tokens(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine)
        want[(k, held(k), len(mine), sum(counts[w] > 0 for w in mine), n, round(base, 3))] += 1
    got = maxent.score(docs, rounds=2).collect()
    assert Counter((*r[:5], round(r.base_score, 3)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_language_model_is_a_distribution_and_beats_the_unigram(spark, sf_dir):
    got = [r for r in maxent.score(documents(spark, sf_dir)).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def shingle_set(text):
    w = (text or "").lower().split()
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_copies(docs):
    rows = [(r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    alike = lambda a, b: a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) > 0
    links = [[j for j in range(len(rows)) if j != i and alike(rows[i][1], rows[j][1])] for i in range(len(rows))]
    want = Counter()
    for i in range(len(rows)):
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in reach:
                    reach.add(j)
                    todo.append(j)
        want[(rows[i][0], min((rows[j][0] for j in reach if rows[j][0] is not None), default=None), len(links[i]))] += 1
    assert Counter(map(tuple, near.similarity_classes(docs).collect())) == want
    kept = near.one_of_each(docs)
    firsts = {c for _, c, _ in want if c is not None}
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == firsts and kept.columns == docs.columns


def test_large_clusters_are_cut_into_cells(spark, monkeypatch):
    """A cluster far above the size of a cell keeps every link; no pair is seen twice."""
    monkeypatch.setattr(near, "CELL_ROWS", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: 199 - k % 7], f"x{k}", *base[199 - k % 7 :]])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    got = {r.doc_id: (r.class_id, r.n_links) for r in near.similarity_classes(docs).collect()}
    assert got == {k: (0, 59) for k in range(60)}


def hashes_differ(a, b):
    return sum(x != y for x, y in zip(a.split(","), b.split(","), strict=True))


def test_fingerprints(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter()
    for i, (k, t) in enumerate(rows):
        half, after = len(t) // 2, rows[(i + 1) % len(rows)][1]
        want[(k, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest())] += 1
    got = order_minhash.fingerprints(docs).collect()
    assert Counter(r[:3] for r in got) == want
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_fingerprints_follow_order(spark):
    words = [f"w{i}" for i in range(400)]
    swapped = [*words[200:], *words[:200]]
    mixed = [*words[:390], *words[:10]]
    texts = [" ".join(x) for x in (words, mixed, swapped, words[::-1])]
    made = spark.createDataFrame([(t,) for t in texts], "text string").select(order_minhash.fingerprint(F.col("text")))
    own, near_copy, turned, reverse = (r[0] for r in made.collect())
    assert hashes_differ(own, near_copy) < hashes_differ(own, turned) < hashes_differ(own, reverse) + 1


def unthinned(occurrences, bins=order_minhash.BINS, per_bin=order_minhash.PER_BIN):
    def value(b):
        mine = sorted((r.v, r.at) for r in occurrences if r.v % bins == b)[:per_bin]
        seed = 42
        for _, v in sorted((at, v) for v, at in mine):
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
        return f"{seed >> 32:08x}" if mine else "-"

    return ",".join(map(value, range(bins)))


def test_fingerprints_of_long_texts_are_those_of_all_occurrences(spark, monkeypatch):
    texts = [" ".join(f"w{i * 7919 % 100_003}" for i in range(n)) for n in (1000, 1020, 1030, 1100, 3000, 5000)]
    texts.append(" ".join(f"w{i % 700}" for i in range(2500)))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    want = [unthinned(r[0]) for r in df.select(order_minhash.occurrences(order_minhash.shingles(F.col("text")))).collect()]
    made = lambda: [r[0] for r in df.select(order_minhash.fingerprint(F.col("text"))).collect()]
    assert made() == want
    monkeypatch.setattr(order_minhash, "SMALLEST", 64)  # most bins lack occurrences at first
    assert made() == want


def test_quality(spark, sf_dir, awkward):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # at 200 documents there are too few bad ones of each sort to learn from
    docs = documents(spark, sf_dir)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = quality.classify(docs).collect()
    known = [(labels[r.doc_id], r.keep) for r in rows if r.doc_id in labels]
    assert sum(q == k for q, k in known) >= 0.97 * len(known)
    model = quality.fit(docs)
    got = quality.score(awkward, model).collect()
    assert len(got) == awkward.count() and not any(r.keep for r in got if r.doc_id in (4, 5, 7))
    kept = quality.keep_good(awkward, model)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.keep)


def test_shape_is_that_of_the_whole_word():
    shape = lambda w: quality.word_facts(w) % quality.BUCKETS
    assert shape("日本語" * 20 + "。12") == shape("日。9") != shape("日")
    assert shape("x" * 60) == shape("x") != shape("x" * 60 + "{}")


def test_label_model_finds_the_reliable_labellers():
    import numpy as np

    draw, counts = np.random.default_rng(0), Counter()
    for _ in range(4000):
        truth = int(draw.random() < 0.8)
        votes = [truth if draw.random() < a else 1 - truth for a in (0.95, 0.9, 0.9, 0.85, 0.6, 0.6, 0.55)]
        counts["".join(map(str, votes)) + "--"] += 1
    prior, accuracies, _ = quality.label_model(counts)
    assert abs(prior - 0.8) < 0.05 and accuracies[1, 0, 1] > 0.9 and accuracies[1, 6, 1] < 0.7


def test_empty_table(empty):
    weights, model = pii_crf.fit(empty), quality.fit(empty)
    for made in (
        pii_crf.detect(empty, weights),
        pii_crf.mask(empty, weights),
        codec.encode(empty),
        packing.pack_documents(empty),
        maxent.score(empty),
        near.similarity_classes(empty),
        near.one_of_each(empty),
        order_minhash.fingerprints(empty),
        quality.score(empty, model),
        quality.keep_good(empty, model),
    ):
        assert made.count() == 0
