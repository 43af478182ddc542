"""Hard negatives against brute force: joins, ties, useless rows, several shards, large numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hard_negatives as H

ROWS = "vec_id long, embedding array<float>, label int, key string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)


def expected(rows, every=100):
    rows = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, y in rows}
    out = []
    for a, label, v in rows:
        if a % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w, strict=True)), i, y) for i, y, w in rows if i != a and len(w) == len(v)]
        scored.sort()
        for p, i, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and -80 * p <= -100 * s[0] <= -100 * p][:5]
            out += [(a, i, rank, n[1], -p, -n[0]) for rank, n in enumerate(inside, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_rows", [64, 4096])
def test_negatives_of_the_sample(spark, sf_dir, shard_rows):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = H.usable(df)
    got = found(H.mine(rows, F.col("vec_id") % 20 == 0, shard_rows=shard_rows))
    assert got == expected([(r.vec_id, r.embedding, r.label) for r in df.collect()], 20)


def test_ties_repeats_and_useless_rows(spark):
    draw = np.random.default_rng(4)
    good = [(i, draw.normal(size=12).astype(np.float32).tolist(), int(i % 3)) for i in range(120)]
    same = [(1000 + i, [0.5] * 12, i % 2) for i in range(60)]
    more = [(2000, [0.0] * 12, 1), (2001, [1.0, 2.0], 1), (2100, [1.0, 2.0], 0), (2003, [1.0, 2.0], 0), (2200, [], 1), (2201, [], 2), (2202, [], 1)]
    bad = [(3000, None, 1), (3100, [1.0, None], 1), (3200, [float("nan")] * 12, 1), (3300, [float("inf")] * 12, 1), (3400, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows = [*good, *same, *more]
    assert found(H.mine_table(table(spark, [*rows, *bad, good[0], good[5]]))) == expected(rows)
    assert H.mine_table(table(spark, [])).count() == 0
    assert H.mine_table(table(spark, bad)).count() == 0


def test_numbers_beyond_doubles(spark):
    rows = [(0, [3e5, 1.0], 1), (1, [3e5, 2.0], 1), (2, [3e5, 1.5], 2), (3, [2.9e5, 7.0], 2), (4, [3e5, 2.5], 2)]
    assert found(H.mine_table(table(spark, rows))) == expected(rows)
    huge = [(0, [3e30, 1.0], 1), (1, [3e30, 2.0], 1), (2, [3e30, 1.5], 2)]
    assert [r[5] for r in found(H.mine_table(table(spark, huge)))] == [H.LONG]


def test_join_finds_every_pair_and_leaves_dimensions_out():
    draw = np.random.default_rng(6)
    for dims in (1, 7, 8, 40):
        x = np.floor(draw.normal(size=(300, dims)) * 90 * np.linspace(0.1, 2, dims))
        q = np.floor(draw.normal(size=(20, dims)) * 90)
        index, scores = H.Postings(x), q @ x.T
        for share in (0.0, 0.3, 0.9, -np.inf):
            t = np.full(20, share * scores.max()) if share > -1 else np.full(20, -np.inf)
            i, j, s = index.join(q, t, np.arange(300))
            want = {(a, b): scores[a, b] for a, b in zip(*np.nonzero(scores >= t[:, None]), strict=True)}
            assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), s, strict=True)) == want
