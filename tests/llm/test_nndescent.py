import math

import numpy as np
import pytest

from quantloom.llm import nndescent
from quantloom.llm.common import stored

SCHEMA = "vec_id long, embedding array<float>, label int, node string, grp string"


def brute(rows, tau=0.93):
    ok = [i is not None and lab is not None and bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links = [set() for _ in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if f else None for (_, v, _), f in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= tau:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec_id, len(links[i]), low, vec_id is not None and vec_id == low))
    return sorted(out, key=repr)


def groups(rng, n, spread, d=16):
    base = rng.normal(size=d)
    base /= np.linalg.norm(base)
    return [(base + rng.normal(size=d) * spread / math.sqrt(d)).tolist() for _ in range(n)]


@pytest.mark.parametrize("leaf", [16, 512])
def test_as_by_brute_force(spark, leaf):
    rng = np.random.default_rng(leaf)
    vectors = [(rng.normal(size=16).tolist(), int(rng.integers(3))) for _ in range(150)]
    for n, spread in ((60, 0.1), (40, 0.3), (30, 0.33), (2, 0.1), (2, 0.2), (5, 0.25)):
        label = int(rng.integers(3))
        vectors += [(v, label) for v in groups(rng, n, spread)]
    vectors += [(vectors[0][0], vectors[0][1])] * 20 + [([2 * x for x in vectors[1][0]], vectors[1][1]), (vectors[2][0], 7)]
    rows = [(i, v, label) for i, (v, label) in enumerate(rng.permutation(np.array(vectors, object)).tolist())]
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [None] * 16, 1), (1004, [1.0] * 16, None), (None, [1.0] * 16, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(4)
    out = nndescent.near_duplicates(df, leaf=leaf, trees=4, rounds=1 if leaf > 100 else 2)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_counts_in_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v, 1) for i, v in enumerate(groups(rng, 90, 0.38, 8) + groups(rng, 30, 0.05, 8))]
    df = spark.createDataFrame([(0, f"1:8", v, 1, i) for i, v, _ in rows], "x int, grp string, vector array<float>, w long, vec_id long")
    nodes = stored(df.selectExpr("vec_id as node", "grp", "vector", "w", "vec_id as low"), "n")
    labels = nodes.selectExpr("node", "0L as component")
    got = dict(map(tuple, nndescent.link_counts(nodes, labels, 0.93, block=16).collect()))
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert got == dict(enumerate(want.tolist()))


def test_audit_sees_missing_links(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, "g:8", v) for i, v in enumerate(groups(rng, 20, 0.05, 8))], "node long, grp string, vector array<float>")
    half = df.selectExpr("node", "cast(node % 2 as long) as component")
    share, seen = nndescent.audit(df, half, 0.93, 100, 0)
    assert seen == 2 and abs(share - 9 / 19) < 1e-9


def test_audit_is_not_outweighed_by_a_large_group(spark):
    rng = np.random.default_rng(5)
    vectors = groups(rng, 300, 0.05, 16) + [v for _ in range(40) for v in groups(rng, 2, 0.05, 16)]
    df = spark.createDataFrame([(i, "g:16", v) for i, v in enumerate(vectors)], "node long, grp string, vector array<float>").repartition(5)
    found = df.where("node < 300 or node >= 340").selectExpr("node", "if(node < 300, 0, node - node % 2) as component")
    share, _ = nndescent.audit(df, found, 0.93, 200, 0)
    assert 0.85 < share < 0.93  # 40 of 380 nodes have a link that was not found
    assert nndescent.audit(df, df.selectExpr("node", "if(node < 300, 0, node - node % 2) as component"), 0.93, 200, 0)[0] == 1


def test_short_recall_ends_in_an_exact_finish(spark):
    rng = np.random.default_rng(6)
    rows = [(i, v, i % 2) for i, v in enumerate([v for _ in range(60) for v in groups(rng, 3, 0.3, 16)])]
    df = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA)
    out = nndescent.near_duplicates(df, leaf=2, trees=1, rounds=1, k=1, attempts=1, recall=1.01)
    assert sorted(map(tuple, out.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert nndescent.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
