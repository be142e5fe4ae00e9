import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quantloom.llm import simhash
from quantloom.llm.common import components, sifted, stored


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


def test_fingerprints():
    rng = random.Random(5)
    texts = [None, "", " \t\x0b", "One", "Two Words", "ÄÖ Été x y\x1cz a b", "a b c d"]
    texts += [" ".join(rng.choices("alpha Beta gamma delta".split(), k=rng.randint(1, 300))) for _ in range(60)] + ["w " * 60_000]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("leaf_rows, task_rows", [(8, 65536), (40, 20), (10_000, 50)])
def test_links_as_by_brute_force(spark, leaf_rows, task_rows):
    rng = random.Random(leaf_rows)
    fps = [rng.getrandbits(64) for _ in range(150)] + [0, 1, 3, 7]
    while len(fps) < 420:
        x = rng.choice(fps)
        for _ in range(rng.choice((1, 2, 3))):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    want = brute_components(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, node long").repartition(3)
    got = dict(map(tuple, components(simhash.link_fingerprints(nodes, 2, leaf_rows, 64, task_rows)).collect()))
    assert [got.get(i, i) for i in range(len(fps))] == want


def test_dense_groups_link_as_without_shortcuts():
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(2)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = [flip(centres[0], rng.randint(0, 4)) for _ in range(2600)] + [flip(centres[1], rng.randint(0, 6)) for _ in range(300)] + [rng.getrandbits(64) for _ in range(200)]
    rng.shuffle(fps)
    points = np.array(fps, np.uint64)
    a, b = simhash.spanning_links(points, np.ones(len(points), bool), 6)
    forest = simhash.Forest(len(points))
    rows = np.arange(len(points))
    simhash.near_pairs(points, rows, rows, 6, forest.link, rng)
    forest.merge()
    got = rows.copy()
    got[a] = b
    assert (got == forest.label).all() and np.bincount(got).max() >= 2600


def test_rings_and_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 64)
    monkeypatch.setattr(simhash, "_FLUSH", 50)
    rng = random.Random(2)
    ball = {sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(300)}
    fps = list(ball | {rng.getrandbits(64) for _ in range(200)})
    home = np.array([rng.random() < 0.8 for _ in fps])
    a, b = simhash.spanning_links(np.array(fps, np.uint64), home, 2)
    label = list(range(len(fps)))
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = sorted((label[x], label[y]))
        label = [x if z == y else z for z in label]
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (home[i] or home[j]) and (fps[i] ^ fps[j]).bit_count() <= 2 and want[i] != want[j]:
                x, y = sorted((want[i], want[j]))
                want = [x if z == y else z for z in want]
    assert label == want


def test_documents(spark):
    rows = [(9, "same old words here"), (4, "Same old  words HERE"), (7, None), (5, ""), (None, "same old words here"), (4, "Same old  words HERE"), (8, "x" * 99_999)]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, fp int, node string")
    out = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    fp = lambda t: f"{brute_fingerprint(t):016x}"
    want = [(9, fp(rows[0][1]), 4), (4, fp(rows[0][1]), 4), (4, fp(rows[0][1]), 4), (7, "0" * 16, 5), (5, "0" * 16, 5), (None, fp(rows[0][1]), None), (8, fp("x" * 99_999), 8)]
    assert out == sorted(want, key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_long_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 200)] + [(300, 300), (401, 400), (400, 401)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 200)} | {401: 400}
    assert got == want


def near_copies(rng, n_base=40):
    """Documents, and for pairs of them the similarity of their sets of five-word shingles."""
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(400)]
    texts = []
    for _ in range(n_base):
        base = rng.choices(words, k=rng.choice((30, 120, 400)))
        texts.append(" ".join(base))
        for _ in range(rng.choice((0, 0, 1, 3))):
            copy = list(base)
            for _ in range(rng.choice((0, 1, 2, 5))):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            texts.append("  ".join(copy))
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    return texts, lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])


@pytest.mark.parametrize("leaf_rows, task_rows", [(16, 32768), (2048, 25)])
def test_similar_documents_as_by_brute_force(spark, leaf_rows, task_rows):
    rng = random.Random(9)
    texts, similarity = near_copies(rng, 90)
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, size string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.groups_of_similar(docs, leaf_rows=leaf_rows, task_rows=task_rows).collect()}
    pairs = [(similarity(i, j), got[i] == got[j]) for i in range(len(texts)) for j in range(i)]
    sure = [same for s, same in pairs if s >= 0.86]
    assert len(sure) > 20 and sum(sure) >= 0.98 * len(sure)
    assert not any(same for s, same in pairs if s < 0.5)


def test_similar_documents_of_neighbouring_bands(spark):
    rng = random.Random(21)
    texts, pairs = [], []
    for _ in range(400):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(150, 330))]
        pairs.append(len(texts))
        texts += [" ".join(base), " ".join(base[: round(len(base) * rng.uniform(0.88, 0.95))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    nodes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(n), b.column(0)], ["wide", "size", "node"]) for b in batches for w, n in [simhash.wide_fingerprints(b.column(1).to_pylist())]), "wide binary, size long, node long")
    # within unlimited reach no pair is lost, whichever of the two lies inside
    links = simhash.similar_links(stored(nodes, "nodes"), 0.8, trees=1, reach=64, leaf_rows=16)
    got = dict(map(tuple, components(links).collect()))
    assert [i for i in pairs if got.get(i + 1) != i] == []


def test_sets_decide(spark):
    """A text with words appended is a near-copy exactly when its set of shingles is similar enough."""
    texts, want = [], []
    for o in range(24):
        for n, more in ((4, 1), (5, 1), (6, 1), (3, 1), (40, 10), (40, 11), (80, 20), (80, 22)):
            base = [f"w{o}x{n}x{more}x{i}" for i in range(n + 4)]
            want += [] if n / (n + more) < 0.8 else [len(texts)]
            texts += [" ".join(base), " ".join(base + [f"t{i}" for i in range(more)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.component_id for r in simhash.groups_of_similar(docs).collect()}
    assert [i for i in range(0, len(texts), 2) if got[i + 1] == i] == want


def test_dense_groups_are_confirmed_in_blocks(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:k] + [f"x{n}"] + base[k + 1 :]) for n in range(90) for k in [rng.randrange(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = spark.createDataFrame([(i, 0) for i in range(1, 90)], "node long, component long")
    links = simhash.confirmed_links(docs, groups, 0.8, 5, task_shingles=2000)
    got = dict(map(tuple, components(links).collect()))
    sets = [{" ".join(w[i : i + 5]) for i in range(56)} for w in map(str.split, texts)]
    label = list(range(90))
    for i in range(90):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert [got.get(i, i) for i in range(90)] == label


def test_recall_in_deep_trees(spark):
    """Pairs of similarity 0.8 to 0.88 in leaves of 8 rows, so that most borders lie within few bits of a pair."""
    rng = random.Random(31)
    texts, pairs = [], []
    for _ in range(800):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(rng.randint(100, 140))]
        n = len(base) - 4
        cut = rng.randint(math.ceil(0.06 * n), math.floor(0.11 * n))  # words of an end, replaced
        copy = base[: len(base) - cut] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(cut)]
        assert 0.8 <= (n - cut) / (n + cut) < 0.89
        pairs.append(len(texts))
        texts += [" ".join(base), " ".join(copy)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in simhash.groups_of_similar(docs, leaf_rows=8).collect()}
    assert sum(got[i + 1] == i for i in pairs) >= 0.995 * len(pairs)


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(3, "same old words here"), (1, "Same old  words HERE"), (2, None), (7, " "), (None, "same old words here"), (None, None), (1, "Same old  words HERE"), (9, long), (8, long + " end"), (4, "quite other words")]
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, component_id string, n int")
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 2, 8, 4, None, None], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_rows_sent_grow_as_the_nodes(spark):
    """In deep trees as in flat ones a node goes to a bounded number of leaves, in rows of 32 bytes of fingerprint."""
    rng = np.random.default_rng(3)
    n = 3000
    rows = [(rng.bytes(8 * simhash.WIDE), 200, i, rng.integers(-(2**62), 2**62, simhash.BANDS).tolist()) for i in range(n)]
    nodes = stored(spark.createDataFrame(rows, "wide binary, size long, node long, keys array<bigint>"), "nodes")
    for leaf_rows in (1000, 8):
        sent = simhash.sent_to_leaves(nodes, n, 0.8, trees=2, reach=4, leaf_rows=leaf_rows, sample_rows=1024, task_rows=32768, copies=6).selectExpr("tree", "octet_length(wide) AS width", "guest").toArrow().to_pandas()
        assert set(sent["width"]) == {8 * simhash.THIN}
        assert (sent["tree"] == 2).sum() == simhash.BANDS * n
        for tree in (0, 1):
            assert n <= (~sent["guest"][sent["tree"] == tree]).sum() <= 6.6 * n


def test_keys_alone_bring_pairs_together():
    rng, met = random.Random(17), 0
    for _ in range(1500):
        base = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(94)]
        copy = base[:-10] + ["".join(rng.choices("abcdefgh", k=6)) for _ in range(10)]  # 80 of 100 shingles
        keys = simhash.sketches([" ".join(base), " ".join(copy)])[2]
        met += bool((keys[0] == keys[1]).any())
    assert met == 1500


def test_sifted_passes_all_and_few_others(spark):
    ids = spark.range(0, 40_000, 7).selectExpr("id * 1000003 - 9 AS doc_id")
    docs = spark.range(40_000).selectExpr("IF(id = 5, NULL, id * 1000003 - 9) AS doc_id", "'x' AS text")
    out = sifted(docs, "doc_id", ids)
    assert out.columns == ["doc_id", "text", "__among"] and out.count() == 40_000
    assert out.join(ids, "doc_id").where("not __among").isEmpty()
    assert out.where("__among").count() < 1.1 * ids.count() + 0.06 * 40_000
    assert not out.where("__among is null").count() and sifted(docs, "doc_id", ids.limit(0)).where("__among").isEmpty()


def test_what_stored_shuffled_goes_at_once(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    before = files()
    stored(spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count(), "counts")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
