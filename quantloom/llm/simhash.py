"""SimHash near-duplicates, exactly, by a vantage-point tree over the distinct fingerprints.

Equal fingerprints are one node, so copies cost nothing. A routing tree, fitted on a bounded sample, parts
the fingerprints by their Hamming distance d to a vantage point into d <= m and d > m. Every fingerprint
lives in one leaf, and is sent as a query to those other leaves whose distances its own cannot exclude by
the triangle bound. Each leaf finds its pairs by vantage rings: rings more than max_bits apart hold none.
A leaf returns a spanning forest of its links, never all pairs; components join the leaves' forests.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, sifted, stored, table

_BLOCK = 1 << 20  # pairs compared at once
_HELD = 50_000  # shingles whose bits are unpacked at once
_FLUSH = 1 << 21  # links held before they are merged into labels


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: XXH64 with seed 42 of the shingles of lower-cased (A-Z) words."""
    out = np.zeros(len(texts), np.uint64)
    rows, hashes, sizes, held = [], [], [], 0

    def bits_of(parts) -> np.ndarray:
        return np.unpackbits(np.concatenate(parts).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)

    def flush():
        n = np.array(sizes)
        counts = np.add.reduceat(bits_of(hashes), np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
        hashes.clear(), sizes.clear(), rows.clear()

    for i, text in enumerate(texts):
        w = (text or "").encode("utf-8").lower().split()
        if not w:
            continue
        shingles = iter([b" ".join(w)]) if len(w) < words else map(b" ".join, zip(*(islice(w, k, None) for k in range(words))))
        n = max(1, len(w) - words + 1)
        if n > _HELD:  # a long text's counts add up piece by piece
            counts = np.zeros(64, np.int64)
            for _ in range(0, n, _HELD):
                counts += bits_of([np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, _HELD), repeat(42)), np.uint64)]).sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * counts > n).view(">u8").astype(np.uint64)[0]
            continue
        hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n))
        sizes.append(n)
        rows.append(i)
        held += n
        if held > _HELD:
            flush()
            held = 0
    if rows:
        flush()
    return out


def fingerprint_documents(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp long). Null and wordless texts have fingerprint zero."""

    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(texts), 256):
                fp = fingerprints(texts.slice(at, 256).to_pylist(), words).view(np.int64)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(at, 256), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- the tree

Node = tuple  # (vantage point, m, inner, outer), or a leaf's number as (n,)


def distances(points: np.ndarray, vantage) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def routing_tree(sample: np.ndarray, leaves: int, seed: int = 7) -> Node:
    """A tree of as many leaves, split at the median distance of the sample's points in each node."""
    rng, numbers = random.Random(seed), iter(range(leaves))

    def build(points: np.ndarray, n: int) -> Node:
        if n <= 1:
            return (next(numbers),)
        points = points if len(points) >= 32 else sample
        best = None
        for vantage in rng.sample(points.tolist(), min(8, len(points))):
            d = distances(points, vantage)
            m = int(np.median(d))
            shared = np.mean(np.abs(d - m) <= 1) + abs(np.mean(d <= m) - 0.5)
            if best is None or shared < best[0]:
                best = (shared, vantage, m, d)
        _, vantage, m, d = best
        return (vantage, m, build(points[d <= m], n - n // 2), build(points[d > m], n // 2))

    return build(sample, leaves)


def routes(tree: Node, points: np.ndarray, max_bits: int):
    """(leaf, rows, whether they live there) for all leaves that the points overlap."""
    found = []

    def walk(node: Node, rows: np.ndarray, home: np.ndarray):
        if not len(rows):
            return
        if len(node) == 1:
            found.append((node[0], rows, home))
            return
        vantage, m, inner, outer = node
        d = distances(points[rows], vantage)
        # a pair across the border is found by its inner point, as a query in the outer part
        into = np.where(home, d <= m, d - max_bits <= m)
        walk(inner, rows[into], home[into])
        out = d + max_bits > m
        walk(outer, rows[out], (home & (d > m))[out])

    walk(tree, np.arange(len(points)), np.ones(len(points), bool))
    return found


class Forest:
    """Labels of linked rows; links are merged in blocks, so that dense groups need no more memory."""

    def __init__(self, n: int):
        self.label, self.held, self.n_held = np.arange(n), [], 0

    def link(self, a: np.ndarray, b: np.ndarray):
        apart = self.label[a] != self.label[b]
        if apart.any():
            self.held.append((a[apart], b[apart]))
            self.n_held += int(apart.sum())
            if self.n_held > _FLUSH:
                self.merge()

    def merge(self):
        if not self.held:
            return
        a, b = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n_held = [], 0
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
        self.label = label


def gather_round(points: np.ndarray, rows: np.ndarray, max_bits: int, link, forest: Forest, rng: random.Random, pivots: int = 12):
    """Links rows to some of them that lie within max_bits: a dense group is then one component in a few passes,
    and near_pairs() leaves out what is in one component already."""
    for _ in range(pivots if len(rows) > 2048 else 0):
        forest.merge()
        label = forest.label[rows]
        values, counts = np.unique(label, return_counts=True)
        # beside the largest component, for what is in it needs no further link to itself
        outside = rows[label != values[counts.argmax()]] if len(values) > 1 else rows[:0]
        if not len(outside):
            break
        pivot = rng.choice(outside)
        near = rows[distances(points[rows], points[pivot]) <= max_bits]
        near = near[near != pivot]
        if len(near):
            link(np.full(len(near), pivot), near)
    forest.merge()


def near_pairs(points: np.ndarray, a: np.ndarray, b: np.ndarray, max_bits: int, link, rng: random.Random, forest: Forest | None = None):
    """Calls link(rows, rows) with all pairs of rows a and b (or of a and itself) within max_bits; with a forest,
    less those within the component that holds most of the rows."""
    same = a is b
    if forest is not None and len(a) * len(b) > 1 << 16:
        forest.merge()
        of_a, of_b = forest.label[a], forest.label[b]
        values, counts = np.unique(of_a if same else np.concatenate([of_a, of_b]), return_counts=True)
        if counts.max() * 4 > counts.sum():
            most = values[counts.argmax()]
            in_a, out_a, in_b, out_b = a[of_a == most], a[of_a != most], b[of_b == most], b[of_b != most]
            if same:
                parts = [(in_a, out_a), (out_a, out_a)]
            else:
                parts = [(in_a, out_b), (out_a, in_b), (out_a, out_b)]
            for x, y in parts:
                if len(x) and len(y):
                    near_pairs(points, x, y, max_bits, link, rng)
            return
    if len(a) * len(b) <= 4 * _BLOCK:
        step = max(1, _BLOCK // max(1, len(b)))
        for at in range(0, len(a), step):
            own = a[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[own][:, None] ^ points[b][None, :]) <= max_bits)
            if same:
                i, j = i[j > i + at], j[j > i + at]
            if len(i):
                link(own[i], b[j])
        return
    rings = None
    for _ in range(8):
        vantage = points[rng.choice(a)] ^ np.uint64(rng.getrandbits(64) if rings is not None else 0)
        da = distances(points[a], vantage)
        db = da if same else distances(points[b], vantage)
        rings = [a[da == d] for d in range(65)], [b[db == d] for d in range(65)]
        if max(map(len, rings[0])) < 0.5 * len(a) or max(map(len, rings[1])) < 0.5 * len(b):
            break
    else:  # no vantage point parts these: in halves, which ends in blocks
        h = len(a) // 2 if len(a) >= len(b) else len(b) // 2
        if same:
            x, y = a[:h], a[h:]
            near_pairs(points, x, x, max_bits, link, rng)
            near_pairs(points, y, y, max_bits, link, rng)
            near_pairs(points, x, y, max_bits, link, rng)
        elif len(a) >= len(b):
            near_pairs(points, a[:h], b, max_bits, link, rng)
            near_pairs(points, a[h:], b, max_bits, link, rng)
        else:
            near_pairs(points, a, b[:h], max_bits, link, rng)
            near_pairs(points, a, b[h:], max_bits, link, rng)
        return
    for d in range(65):
        for e in range(d if same else max(0, d - max_bits), min(64, d + max_bits) + 1):
            x, y = rings[0][d], rings[0 if same else 1][e]
            if len(x) and len(y):
                near_pairs(points, x, x if same and d == e else y, max_bits, link, rng)


def spanning_links(points: np.ndarray, home: np.ndarray, max_bits: int, own=None, p: int = 0, q: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows linked to another row, and the row that stands for their component."""
    forest, rng = Forest(len(points)), random.Random(len(points))
    own = np.zeros(len(points), np.int64) if own is None else own
    gather_round(points, np.arange(len(points)), max_bits, forest.link, forest, rng)
    for a, b in pairs_of_blocks(home, own, p, q):
        near_pairs(points, a, b, max_bits, forest.link, rng, forest)
    forest.merge()
    rows = np.flatnonzero(forest.label != np.arange(len(points)))
    return rows, forest.label[rows]


def in_blocks(sent: DataFrame, leaf: list[str], rows: int, weight: str = "1") -> DataFrame:
    """Adds p, q and own: leaves of over rows rows (by weight), as dense groups make, are dealt to pairs of blocks, each pair
    a group of its own; a row goes to all pairs of its block own. Other leaves are the one pair (0, 0)."""
    large = stored(sent.groupBy(*leaf).agg(F.sum(F.expr(weight).cast("long")).alias("n")).where(F.col("n") > rows), "large")
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        return sent.withColumns({"p": zero, "q": zero, "own": zero})
    dealt = sent.join(large.select(*leaf, F.ceil(2 * F.col("n") / rows).alias("b")), leaf, "left")
    own = F.when(F.col("b").isNull(), zero).otherwise(F.pmod(F.xxhash64("node"), F.col("b")))
    others = F.when(F.col("b").isNull(), F.array(zero)).otherwise(F.sequence(zero, F.col("b") - 1))
    dealt = dealt.withColumn("own", own).select(*sent.columns, "own", F.explode(others).alias("other"))
    return dealt.select(*sent.columns, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own")


def pairs_of_blocks(home: np.ndarray, own: np.ndarray, p: int, q: int, guest: np.ndarray | None = None):
    """The pairs of row sets that a group compares: members with members, and members with queries. Guests are
    members and queries too, but are compared with rows that are no guests only."""
    guest = np.zeros(len(home), bool) if guest is None else guest
    sides = [np.flatnonzero(own == x) for x in ((p,) if p == q else (p, q))]
    member, query, guest_member, guest_query = ([x[(home[x] == h) & (guest[x] == g)] for x in sides] for g in (False, True) for h in (True, False))
    if p == q:
        out = [(member[0], member[0])]
    else:
        out = [(member[0], member[1])]
    for i, j in ((0, 0),) if p == q else ((0, 1), (1, 0)):
        out += [(member[i], query[j]), (member[i], guest_member[j]), (member[i], guest_query[j]), (query[i], guest_member[j])]
    return [(a, b) for a, b in out if len(a) and len(b)]


def link_fingerprints(nodes: DataFrame, max_bits: int = 2, leaf_rows: int = 8192, sample_rows: int = 16384, task_rows: int = 65536) -> DataFrame:
    """Links among nodes (fp, node), fp distinct: (a, b) nodes that span the same components as all pairs
    within max_bits. The routing tree is fitted on sample_rows fingerprints at most; every one is indexed. No
    task holds many more rows than task_rows."""
    n = nodes.count()
    spark = nodes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    sample = np.array([r.fp for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(sample_rows).collect()], np.int64)
    tree = routing_tree(sample.view(np.uint64), -(-n // leaf_rows))

    def send(batches):
        for batch in batches:
            fp, node = (np.asarray(c) for c in batch.columns)
            for leaf, rows, home in routes(tree, fp.view(np.uint64), max_bits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), leaf)), pa.array(fp[rows]), pa.array(node[rows]), pa.array(home)],
                    ["leaf", "fp", "node", "home"],
                )

    def search(leaf: pa.Table) -> pa.Table:
        node = np.asarray(leaf["node"])
        points = np.ascontiguousarray(np.asarray(leaf["fp"])).view(np.uint64)
        own, p, q = np.asarray(leaf["own"]), leaf["p"][0].as_py(), leaf["q"][0].as_py()
        a, b = spanning_links(points, np.asarray(leaf["home"]), max_bits, own, p, q)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    sent = nodes.select("fp", "node").mapInArrow(send, "leaf long, fp long, node long, home boolean")
    sent = in_blocks(sent, ["leaf"], task_rows)
    return sent.groupBy("leaf", "p", "q").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2, **parameters) -> DataFrame:
    """documents(doc_id, text, ...) -> (doc_id, fingerprint, component_id), a row for each row.

    Rows with a null doc_id get their fingerprint and no component; repeated rows and copies are one node.
    """
    rows = stored(fingerprint_documents(docs, words), "fingerprints")
    nodes = stored(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    found = components(link_fingerprints(nodes, max_bits, **parameters))
    labelled = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(labelled, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


# ---------------------------------------------------------------- similarity of shingle sets

WIDE = 16  # words of 64 bits
THIN = 4  # words that travel where candidates are found

BANDS, BAND = 20, 3  # keys of a set, and the least hashes in each


def sketches(texts: list[str | None], words: int = 5) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
    """Of each text's set of shingles: its 1024-bit SimHash, its size, BANDS keys, each of BAND least hashes, and
    the sorted hashes themselves. Texts without words have zeros and no hashes."""
    out, sizes, keys, sets = [bytes(8 * WIDE)] * len(texts), np.zeros(len(texts), np.int64), np.zeros((len(texts), BANDS), np.uint64), [b""] * len(texts)
    salts = np.random.default_rng(42).integers(0, 2**64, WIDE, np.uint64, endpoint=False)
    for i, text in enumerate(texts):
        w = (text or "").encode("utf-8").lower().split()
        if not w:
            continue
        shingles = {b" ".join(w)} if len(w) < words else set(map(b" ".join, zip(*(w[k:] for k in range(words)))))
        n = sizes[i] = len(shingles)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
        hashes.sort()
        count, least = np.zeros(64 * WIDE, np.int32), np.full(4 * WIDE, 2**32 - 1, np.uint32)
        for at in range(0, n, 4096):
            h = hashes[at : at + 4096, None] ^ salts
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
            count += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint16)
            least[: 2 * WIDE] = np.minimum(least[: 2 * WIDE], h.view(np.uint32).min(axis=0))
            h *= np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
            least[2 * WIDE :] = np.minimum(least[2 * WIDE :], h.view(np.uint32).min(axis=0))
        out[i], sets[i] = np.packbits(2 * count > n).tobytes(), hashes.tobytes()
        for j in least[: BANDS * BAND].reshape(BANDS, BAND).T.astype(np.uint64):
            keys[i] = (keys[i] ^ j) * np.uint64(0x9E3779B97F4A7C15)
            keys[i] ^= keys[i] >> np.uint64(29)
    return out, sizes, keys.view(np.int64), sets


def wide_fingerprints(texts: list[str | None], words: int = 5) -> tuple[list[bytes], np.ndarray]:
    """1024-bit SimHash of each text's set of shingles, and the set's size; zeros for texts without words."""
    return sketches(texts, words)[:2]


def bits_for(similarity: float) -> float:
    """The share of bits in which sets of this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@lru_cache
def shares(similarity: float, largest: int = 128) -> np.ndarray:
    """The share of bits in which sets of this similarity are expected to differ at most, by the size of the
    smaller set: exact up to largest, where a majority's ties tell, and the last place holds for all beyond."""
    at_least = lambda n: np.cumsum([math.comb(n, x) / 2**n for x in range(n, -1, -1)])[::-1]
    tails = [np.append(at_least(n), 0.0) for n in range(largest + 1)]

    def set_bits(n: int, k: int) -> np.ndarray:  # P(a set of n has the bit | c of the k common ones have it)
        need = np.clip(n // 2 + 1 - np.arange(k + 1), 0, n - k + 1)
        return tails[n - k][need]

    out = np.zeros(largest + 1)
    for n in range(1, largest + 1):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            k = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if k <= n:
                weight = np.array([math.comb(k, c) / 2**k for c in range(k + 1)])
                a, b = set_bits(n, k), set_bits(m, k)
                out[n] = max(out[n], float(weight @ (a * (1 - b) + b * (1 - a))))
    out[largest] = max(out[largest // 2 :].max(), bits_for(similarity))
    return out


def bit_limits(similarity: float, bits: int, errors: float = 3.3) -> np.ndarray:
    """How many of so many bits candidates differ in at most, by the smaller set's size: so many standard errors
    more than expected. What follows compares the sets themselves."""
    share = shares(similarity)
    return np.ceil(bits * share + errors * np.sqrt(bits * share * (1 - share))).astype(np.int64)


def reach_within(tree: Node, points: np.ndarray, reach: int, copies: float) -> int:
    """The widest reach, up to the one given, within which the points enter so many leaves each on average."""
    entered = lambda r: sum(len(rows) for _, rows, _ in routes(tree, points, r))
    return next((r for r in range(reach, 0, -1) if entered(r) <= copies * len(points)), 0)


def sent_to_leaves(nodes: DataFrame, n: int, similarity: float, trees: int, reach: int, leaf_rows: int, sample_rows: int, task_rows: int, copies: float) -> DataFrame:
    """A row for each leaf that one of the n nodes enters, of the trees and, as tree number trees, of the keys."""
    word = lambda wide: np.frombuffer(b"".join(wide), "<u8").reshape(-1, THIN)
    thin = F.substring("wide", 1, 8 * THIN).alias("wide")
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(sample_rows).select(thin, "size").toArrow()
    points, band_of = word(sample["wide"].to_pylist())[:, 0], lambda size: np.floor(np.log(np.maximum(size, 1)) / -math.log(similarity)).astype(np.int64)
    # as many leaves as the fullest band of sizes needs
    fullest = np.unique(band_of(np.asarray(sample["size"])), return_counts=True)[1].max() / sample.num_rows
    forest = [routing_tree(points, max(1, math.ceil(n * fullest / leaf_rows)), seed) for seed in range(trees)]
    # the rows that travel would grow faster than the nodes, as borders do; where keys see to the pairs, reach gives way
    within = [reach_within(tree, points, reach, copies) if "keys" in nodes.columns else reach for tree in forest]

    def send(batches):
        for batch in batches:
            wide, size, node = (batch.column(c) for c in range(3))
            first, band = word(wide.to_pylist())[:, 0], band_of(np.asarray(size))
            for t, tree in enumerate(forest):
                for leaf, rows, home in routes(tree, first, within[t]):
                    for up in (False, True):  # in the band of larger sets, a guest: at home there too, for the inner point of a pair across a border may be the larger set
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), t)), pa.array(band[rows] + up), pa.array(np.full(len(rows), leaf)), wide.take(pa.array(rows)), size.take(pa.array(rows)), node.take(pa.array(rows)), pa.array(home), pa.array(np.full(len(rows), up)), pa.array(np.zeros(len(rows), np.int64))],
                            ["tree", "band", "leaf", "wide", "size", "node", "home", "guest", "key"],
                        )

    schema = "tree long, band long, leaf long, wide binary, size long, node long, home boolean, guest boolean, key long"
    sent = nodes.select(thin, "size", "node").mapInArrow(send, schema)
    if "keys" in nodes.columns:
        keyed = nodes.select(thin, "size", "node", F.posexplode("keys").alias("band", "key"))
        tasks = max(1, -(-4 * n // task_rows))
        sent = sent.unionByName(
            keyed.select(
                F.lit(trees).cast("long").alias("tree"), F.col("band").cast("long").alias("band"), F.pmod("key", F.lit(tasks)).cast("long").alias("leaf"),
                "wide", "size", "node", F.lit(True).alias("home"), F.lit(False).alias("guest"), "key",
            )
        )
    return sent


def similar_links(nodes: DataFrame, similarity: float, trees: int = 2, reach: int = 4, leaf_rows: int = 2048, sample_rows: int = 16384, task_rows: int = 32768, copies: float = 6) -> DataFrame:
    """Links (a, b) among nodes (wide, size, node and, if there, keys) that span the components of candidates:
    pairs whose first 256 bits differ in no more than bit_limits() allows, within four standard errors.

    Sets so similar differ in size by that factor at most: the distance from the empty set is the first
    vantage point's, and bounds exactly. Of 64 bits such pairs differ in so many that no triangle bound
    excludes a branch; a point therefore enters the branches that lie within reach of it only, in several
    trees, and what that loses grows with their depth. Sets that share a key meet as well, whatever the number
    of nodes: of pairs of similarity s that is 1 - (1 - s ** BAND) ** BANDS, all but one in 1.7 million at 0.8.
    With keys, a tree's reach is the widest up to reach in which a node enters as many of its leaves as copies
    on average, so that the rows that travel grow as the nodes do.
    """
    n = nodes.count()
    spark = nodes.sparkSession
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    word = lambda wide: np.frombuffer(b"".join(wide), "<u8").reshape(-1, THIN)
    near, thin_near = bit_limits(similarity, 64), bit_limits(similarity, 64 * THIN, 4)

    def search(leaf: pa.Table) -> pa.Table:
        node, home, key = (np.asarray(leaf[c]) for c in ("node", "home", "key"))
        wide, size = word(leaf["wide"].to_pylist()), np.asarray(leaf["size"])
        own, p, q = np.asarray(leaf["own"]), leaf["p"][0].as_py(), leaf["q"][0].as_py()
        found, last = Forest(len(node)), len(near) - 1

        def link(a, b):
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                least = np.minimum(size[x], size[y])
                fits = least >= similarity * np.maximum(size[x], size[y]) - 1e-9
                x, y, least = x[fits], y[fits], least[fits]
                ok = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int32) <= thin_near[np.minimum(least, last)]
                found.link(x[ok], y[ok])

        first, rng = np.ascontiguousarray(wide[:, 0]), random.Random(len(node))
        if leaf["tree"][0].as_py() < trees:
            widest = int(near[np.unique(np.minimum(size, last))].max())
            gather_round(first, np.arange(len(node)), widest, link, found, rng)
            for a, b in pairs_of_blocks(home, own, p, q, np.asarray(leaf["guest"])):
                near_pairs(first, a, b, widest, link, rng, found)
        else:  # rows of equal keys
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
            sizes = np.diff(np.append(starts, len(order)))
            few = np.repeat(sizes <= 64, sizes)
            for d in range(1, min(64, int(sizes.max()))):
                i = np.flatnonzero(few[d:] & (key[order[d:]] == key[order[:-d]]))
                if not len(i):
                    break
                link(order[i], order[i + d])
            for start, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
                rows = order[start : start + m]
                widest = int(near[np.unique(np.minimum(size[rows], last))].max())
                gather_round(first, rows, widest, link, found, rng)
                for a, b in pairs_of_blocks(np.ones(len(node), bool)[rows], own[rows], p, q):
                    a_ = rows[a]
                    near_pairs(first, a_, a_ if a is b else rows[b], widest, link, rng, found)
        found.merge()
        rows = np.flatnonzero(found.label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[rows]), "b": pa.array(node[found.label[rows]])})

    sent = sent_to_leaves(nodes, n, similarity, trees, reach, leaf_rows, sample_rows, task_rows, copies)
    sent = in_blocks(sent, ["tree", "band", "leaf"], task_rows)
    return sent.groupBy("tree", "band", "leaf", "p", "q").applyInArrow(search, "a long, b long")


def confirmed_links(docs: DataFrame, groups: DataFrame, similarity: float, words: int, task_shingles: int = 1 << 23) -> DataFrame:
    """Links (a, b) among doc_ids that span the components of pairs that are so similar by the sets themselves, of
    groups (node, component) of candidates. No task holds many more than task_shingles."""

    def run(batches):
        for batch in batches:
            component, node, texts = batch.columns
            for at in range(0, len(texts), 256):
                wide, sizes, _, sets = sketches(texts.slice(at, 256).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [component.slice(at, 256), node.slice(at, 256), pa.array(wide, pa.binary()), pa.array(sizes), pa.array(sets, pa.binary())],
                    ["component", "node", "wide", "size", "shingles"],
                )

    def search(group: pa.Table) -> pa.Table:
        node, size = np.asarray(group["node"]), np.asarray(group["size"])
        wide = np.frombuffer(b"".join(group["wide"].to_pylist()), "<u8").reshape(-1, WIDE)
        sets = [np.frombuffer(x, np.uint64) for x in group["shingles"].to_pylist()]
        found, last = Forest(len(node)), len(near) - 1

        def alike(x: int, y: int) -> bool:
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            return common >= similarity * (size[x] + size[y] - common) - 1e-9

        def link(a, b):
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                least = np.minimum(size[x], size[y])
                open_ = least >= similarity * np.maximum(size[x], size[y]) - 1e-9
                open_ &= np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int32) <= wide_near[np.minimum(least, last)]
                x, y = x[open_], y[open_]
                while len(x):  # one pair of each set of linked rows is compared, until none is left that could link more
                    apart = found.label[x] != found.label[y]
                    x, y = x[apart], y[apart]
                    if not len(x):
                        break
                    _, one = np.unique(np.maximum(found.label[x], found.label[y]), return_index=True)
                    ok = np.array([alike(i, j) for i, j in zip(x[one].tolist(), y[one].tolist())], bool)
                    found.link(x[one][ok], y[one][ok])
                    found.merge()
                    x, y = np.delete(x, one), np.delete(y, one)

        first, rng = np.ascontiguousarray(wide[:, 0]), random.Random(len(node))
        widest = int(near[np.unique(np.minimum(size, last))].max())
        gather_round(first, np.arange(len(node)), widest, link, found, rng)
        for a, b in pairs_of_blocks(np.ones(len(node), bool), np.asarray(group["own"]), group["p"][0].as_py(), group["q"][0].as_py()):
            near_pairs(first, a, b, widest, link, rng, found)
        rows = np.flatnonzero(found.label != np.arange(len(node)))
        return pa.table({"a": pa.array(node[rows]), "b": pa.array(node[found.label[rows]])})

    near, wide_near = bit_limits(similarity, 64), bit_limits(similarity, 64 * WIDE)
    members = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    texts = sifted(docs.select("doc_id", "text"), "doc_id", members.select("node")).where("__among").join(members.hint("merge"), F.col("doc_id") == F.col("node")).select("component", "node", "text")
    sets = texts.mapInArrow(run, "component long, node long, wide binary, size long, shingles binary")
    sets = sets.groupBy("component", "node", "wide", "size").agg(F.min("shingles").alias("shingles"))
    sets = in_blocks(stored(sets, "shingles"), ["component"], task_shingles, "size + 64")
    return sets.groupBy("component", "p", "q").applyInArrow(search, "a long, b long")


def groups_of_similar(docs: DataFrame, similarity: float = 0.8, words: int = 5, **parameters) -> DataFrame:
    """(doc_id, text) -> (doc_id, component_id, n), a row for each doc_id that is not null: the smallest doc_id
    of its group of near-duplicates, by the sets of shingles themselves, and how many rows have the doc_id. Rows that repeat a doc_id are one
    document; texts without words are one group."""

    def run(batches):
        for batch in batches:
            doc_ids, texts = batch.columns
            for at in range(0, len(texts), 256):
                wide, sizes, keys, _ = sketches(texts.slice(at, 256).to_pylist(), words)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, 256), pa.array(wide, pa.binary()), pa.array(sizes), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "wide", "size", "keys"]
                )

    rows = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, wide binary, size long, keys array<bigint>")
    rows = stored(rows, "wide")
    nodes = stored(rows.groupBy("wide", "size").agg(F.min("doc_id").alias("node"), F.min("keys").alias("keys")), "nodes")
    candidates = components(similar_links(nodes, similarity, **parameters))
    found = components(confirmed_links(docs, candidates, similarity, words))
    labelled = nodes.join(found, "node", "left").select("wide", "size", F.coalesce("component", "node").alias("component_id"))
    out = rows.join(labelled, ["wide", "size"]).groupBy("doc_id")
    out = stored(out.agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "groups")
    dropped(rows)
    dropped(nodes)
    return out


def one_of_each(docs: DataFrame, similarity: float = 0.8, words: int = 5, **parameters) -> DataFrame:
    """The documents, of the same columns, less all but the smallest doc_id of each group of near-duplicates.

    Of rows that repeat a doc_id one stays; rows with a null doc_id all stay.
    """
    rows = groups_of_similar(docs, similarity, words, **parameters)
    # nothing bounds the list of those that go: it is never broadcast, and only the texts that may be on it travel
    gone = rows.where("component_id < doc_id").select("doc_id")
    marked = sifted(docs, "doc_id", gone)
    out = marked.where("__among").select(*docs.columns).join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    out = marked.where("not __among").select(*docs.columns).unionByName(out)
    if rows.where("n > 1").isEmpty():
        return out
    once = out.where("doc_id is not null").dropDuplicates(["doc_id"])
    return once.unionByName(out.where("doc_id is null"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
