import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import topk


def brute(rows, k, every):
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, u) in enumerate(whole):
        if q % every == 0:
            found = [(-sum(a * b for a, b in zip(u, v)), i) for n, (i, v) in enumerate(whole) if n != at and len(v) == len(u)]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e7])
def test_as_by_brute_force(spark, scale, monkeypatch):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 0.2) * scale for _ in range(16)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(2000 + i, [rng.choice([0.0, 1.0]) for _ in range(16)]) for i in range(40)] + [(3000 + i, [0.0] * 16) for i in range(5)]
    rows += [(5, [9.0] * 16), (None, [1.0] * 16), (4000, None), (4001, []), (4002, [None] * 16), (4003, [float("nan")] * 16), (4004, [float("inf")] + [0.0] * 15), (4005, [1.0, 2.0]), (4010, [3.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 5 == 0, k=7, shard_rows=90, query_rows=30)
    assert sorted(map(tuple, got.collect())) == brute(rows, 7, 5)


def test_pruning_keeps_ties_and_blocks(monkeypatch):
    monkeypatch.setattr(topk, "_BLOCK", 16)
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (300, 12)) * (rng.random((300, 12)) < 0.3)
    ids = rng.permutation(300)
    q, q_ids = v[:40].astype(float), ids[:40]
    numbers = np.arange(300)
    for floor in (None, np.array([sorted(v @ v[i])[-9] for i in range(40)])):
        row, found, score = topk.search(q, (numbers[:40], q_ids), v.astype(float), (numbers, ids), 5, floor)
        for i in range(40):
            s = v @ v[i]
            want = sorted((-s[j], ids[j]) for j in range(300) if j != i)[:5]
            assert [(-a, ids[b]) for a, b in zip(score[row == i], found[row == i])] == want


def test_terms_of_small_bounds_are_not_traversed(monkeypatch):
    rng = np.random.default_rng(2)
    v = np.round(rng.normal(size=(4000, 32)) * 60 * 0.9 ** np.arange(32))
    seen, sums = [], topk._sums
    monkeypatch.setattr(topk, "_sums", lambda q, p: seen.append(q.any(axis=0).sum()) or sums(q, p))
    numbers = np.arange(4000)
    row, found, score = topk.search(v[:64], (numbers[:64], numbers[:64]), v, (numbers, numbers), 5)
    for i in range(64):
        want = sorted((-s, j) for j, s in enumerate(v @ v[i]) if j != i)[:5]
        assert [(-a, b) for a, b in zip(score[row == i], found[row == i])] == want
    assert seen[0] == 32 and max(seen[1:]) < 24


def test_rows_that_repeat_a_vec_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 1.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 7, 7) for r in rows], "vec_id long, embedding array<double>, number long, query_id long")
    for shard_rows in (2, 100):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=shard_rows).collect())) == brute(rows, 20, 20)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (20, [0.25, 0.5]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == [(0, 1, 7, 64 * 64 + 32 * 64), (0, 2, 20, 16 * 64 + 32 * 32), (20, 1, 7, 16 * 64 + 32 * 64), (20, 2, 0, 16 * 64 + 32 * 32)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
