"""Near-duplicate embeddings by NN-descent.

Vectors that are equal, of one label, are one node. Neighbour lists begin in the leaves of random-projection
trees; then neighbours of a node are compared with one another, and what is nearer than the lists' ends
enters them, for some rounds. A list that holds links only is saturated, and is enlarged. Every link met joins components. An audit compares sampled nodes, some of each found component and
some of none, with all others. While recall is short more trees are planted; if it stays short, the vectors of
a group are compared block by block.

Links are counted in components, never listed: members within half the threshold's angle of their centre
are linked to one another by the triangle inequality; the others are compared block by block.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, dropped, stored, table
from .simhash import Forest, in_blocks
from .topk import valid

log = logging.getLogger(__name__)
_BITS = 40  # of a tree's code


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow column, all of one size, as unit rows in doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    flat = np.concatenate([np.asarray(c.flatten()) for c in chunks]).astype(np.float64)
    rows = flat.reshape(sum(map(len, chunks)), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True, initial=1e-300)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(node, grp, vector, w, low): distinct vectors of a group, how many rows have them, their least vec_id."""
    nodes = rows.groupBy("grp", "vector").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("low"))
    return stored(nodes.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")


def _planted(nodes: DataFrame, trees: range, sample: dict) -> DataFrame:
    """(node, grp, vector, codes): a code of hyperplanes' sides for each tree. The planes go through the
    medians of a bounded sample of each size of vector."""

    def run(batches):
        for batch in batches:
            node, grp, vector, size = batch.columns
            sizes = np.asarray(size)
            codes = np.zeros((len(sizes), len(trees)), np.int64)
            for n in np.unique(sizes):
                at = np.flatnonzero(sizes == n)
                x = matrix(vector.take(pa.array(at)))
                for j, tree in enumerate(trees):
                    planes = np.random.default_rng([tree, int(n)]).normal(size=(int(n), _BITS))
                    middle = np.median(sample[int(n)] @ planes, axis=0)
                    codes[at, j] = (x @ planes > middle) @ (1 << np.arange(_BITS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays(
                [node, grp, vector, pa.array(list(codes), pa.list_(pa.int64()))], ["node", "grp", "vector", "codes"]
            )

    kind = nodes.schema["vector"].dataType.simpleString()
    chosen = nodes.select("node", "grp", "vector", F.size("vector").alias("size"))
    return chosen.mapInArrow(run, f"node long, grp string, vector {kind}, codes array<bigint>")


def _leaves(nodes: DataFrame, trees: range, tau: float, k: int, leaf: int, sample: dict) -> DataFrame:
    """(u, v, s, link): each node's k nearest in each of its leaves, and links that span the leaves' components."""
    planted = stored(_planted(nodes, trees, sample), "planted")
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / leaf))).cast("int")
    depths = planted.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).select("grp", F.least(depth, F.lit(_BITS)).alias("depth"))
    coded = planted.join(depths, "grp").select("grp", "node", "vector", "depth", F.posexplode("codes").alias("tree", "code"))
    coded = coded.withColumn("leaf", F.expr(f"shiftright(code, {_BITS} - depth)"))
    # leaves that stay large, for their vectors lie close together, are dealt to several tasks
    large = coded.groupBy("grp", "tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 4 * leaf)
    parts = F.coalesce(F.ceil(F.col("n") / (2 * leaf)), F.lit(1))
    coded = coded.join(large, ["grp", "tree", "leaf"], "left")
    coded = coded.withColumn("part", F.pmod(F.xxhash64("node", "tree"), parts.cast("long")))

    def search(group: pa.Table) -> pa.Table:
        node, x = np.asarray(group["node"]), matrix(group["vector"])
        n, forest, out = len(node), Forest(len(node)), []
        for at in range(0, n, 1024):
            s = x[at : at + 1024] @ x.T
            m = len(s)
            s[np.arange(m), at + np.arange(m)] = -2
            i, j = np.nonzero(s >= tau)
            forest.link(i + at, j)
            best = np.argpartition(-s, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (m, 1))
            score = np.take_along_axis(s, best, axis=1)
            row, column = np.nonzero(score > -2)
            out.append((node[at + row], node[best[row, column]], score[row, column]))
        forest.merge()
        row = np.flatnonzero(forest.label != np.arange(n))
        u, v, s = (np.concatenate([o[c] for o in out]) for c in range(3))
        return pa.table(
            {
                "u": pa.array(np.concatenate([u, node[row]])),
                "v": pa.array(np.concatenate([v, node[forest.label[row]]])),
                "s": pa.array(np.concatenate([s, np.ones(len(row))])),
                "link": pa.array(np.concatenate([np.zeros(len(u), bool), np.ones(len(row), bool)])),
            }
        )

    keyed = coded.select("grp", "tree", "leaf", "part", "node", "vector")
    return stored(keyed.groupBy("grp", "tree", "leaf", "part").applyInArrow(search, "u long, v long, s double, link boolean"), "leaves")


def _nearest(pairs: DataFrame, tau: float, k: int, enlarged: int) -> DataFrame:
    """(u, v, s): each node's k nearest of the pairs, or enlarged many where the first k are links all."""
    pairs = pairs.groupBy("u", "v").agg(F.max("s").alias("s"))
    nth = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    pairs = pairs.withColumn("nth", nth).where(F.col("nth") <= enlarged)
    saturated = F.min(F.when(F.col("nth") == k, F.col("s"))).over(W.partitionBy("u")) >= tau
    return pairs.withColumn("full", saturated).where((F.col("nth") <= k) | F.col("full")).select("u", "v", "s")


def _descend(nodes: DataFrame, lists: DataFrame, tau: float, k: int) -> DataFrame:
    """(u, v, s) of the pairs of each node's neighbours, and neighbours in reverse, that would enter a list."""
    ends = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("end"))
    ends = ends.select(F.col("u").alias("node"), F.when(F.col("n") >= k, F.col("end")).otherwise(-2.0).alias("end"))
    nearest = F.row_number().over(W.partitionBy("v").orderBy(F.desc("s"), "u"))
    back = lists.withColumn("nth", nearest).where(F.col("nth") <= k).select(F.col("v").alias("u"), F.col("u").alias("v"))
    around = lists.select("u", "v").unionByName(back).distinct()
    vectors = nodes.select("node", "vector").join(ends, "node", "left").select(F.col("node").alias("v"), "vector", F.coalesce("end", F.lit(-2.0)).alias("end"))
    members = around.join(vectors, "v").select("u", "v", "end", F.size("vector").alias("size"), "vector")
    members = members.repartition("u").sortWithinPartitions("u", "v")

    def compare(u, v, end, x):
        found = []
        for d in range(1, len(u)):
            i = np.flatnonzero(u[:-d] == u[d:])
            if not len(i):
                break
            s = np.einsum("ij,ij->i", x[i], x[i + d])
            for a, b in ((i, i + d), (i + d, i)):
                enters = s > end[a]
                found.append((v[a][enters], v[b][enters], s[enters]))
        if not found:
            return None
        a, b, s = (np.concatenate([f[c] for f in found]) for c in range(3))
        _, one = np.unique(np.column_stack([a, b]), axis=0, return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(a[one]), pa.array(b[one]), pa.array(s[one])], ["u", "v", "s"])

    def run(batches):
        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            u, size = np.asarray(held["u"]), np.asarray(held["size"])
            cut = int(np.searchsorted(u, u[-1]))  # the last node's neighbours may go on in the next batch
            if cut:
                yield from whole(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None:
            yield from whole(held)

    def whole(t):
        u, v, end, size = (np.asarray(t[c]) for c in ("u", "v", "end", "size"))
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            out = compare(u[at], v[at], end[at], matrix(t["vector"].take(pa.array(at))))
            if out is not None:
                yield out

    return members.mapInArrow(run, "u long, v long, s double")


def audit(nodes: DataFrame, labels: DataFrame, tau: float, rows: int, seed: int) -> tuple[float, int]:
    """The share of linked nodes' links that lie in one component, each node counting alike, and how many nodes
    with links it rests on.

    Half of the rows, chosen by a hash, are the least of a component each, so that large ones do not outweigh
    the others, and half are nodes without a link so far: those that have one count as found for nothing, as
    often as such nodes are.
    """
    marked = nodes.join(labels.withColumnRenamed("component", "c"), "node", "left")
    marked = stored(marked.select("node", "grp", "vector", "c", F.xxhash64("node", F.lit(seed)).alias("dice")), "marked")
    one = marked.where("c is not null").groupBy("c").agg(F.min_by(F.struct("node", "grp", "vector"), F.struct("dice", "node")).alias("r"), F.count(F.lit(1)).alias("members"))
    linked = one.orderBy(F.xxhash64("c", F.lit(seed)), "c").limit(rows // 2).select("r.*", "c", "members")
    alone = marked.where("c is null").orderBy("dice", "node").limit(rows // 2).select("node", "grp", "vector", "c", F.lit(1).cast("long").alias("members"))
    n_linked, n_alone = (marked.where(x).count() for x in ("c is not null", "c is null"))
    chosen = linked.unionByName(alone).toArrow()
    if not chosen.num_rows:
        return 1.0, 0
    of: dict[str, list[int]] = {}
    for i, g in enumerate(chosen["grp"].to_pylist()):
        of.setdefault(g, []).append(i)
    label = np.array([-1 if x is None else x for x in chosen["c"].to_pylist()])
    own = {g: (np.array(at), np.asarray(chosen["node"])[at], label[at], matrix(chosen["vector"].take(pa.array(at)))) for g, at in of.items()}
    total = chosen.num_rows

    def run(batches):
        true, found = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            node, grp = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            c = np.array([-1 if x is None else x for x in batch.column(3).to_pylist()])
            places: dict[str, list[int]] = {}
            for i, g in enumerate(grp):
                if g in own:
                    places.setdefault(g, []).append(i)
            for g, at in places.items():
                ids, nodes_, c_, x_ = own[g]
                for some in range(0, len(at), 4096):
                    part = at[some : some + 4096]
                    hit = (matrix(batch.column(2).take(pa.array(part))) @ x_.T >= tau) & (node[part][:, None] != nodes_[None, :])
                    true[ids] += hit.sum(axis=0)
                    found[ids] += (hit & (c[part][:, None] == c_[None, :]) & (c_ >= 0)[None, :]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total)), pa.array(true), pa.array(found)], ["i", "true", "found"])

    sums = marked.select("node", "grp", "vector", "c").mapInArrow(run, "i long, true long, found long").groupBy("i").agg(F.sum("true").alias("t"), F.sum("found").alias("f")).toArrow()
    i, t, f = (np.asarray(sums[c]) for c in ("i", "t", "f"))
    in_one = label[i] >= 0
    dropped(marked)
    rate = lambda at: float((f[at] / np.maximum(t[at], 1))[t[at] > 0].mean()) if (t[at] > 0).any() else 1.0
    missed = n_alone * float((t[~in_one] > 0).mean()) if (~in_one).any() else 0.0
    have = n_linked + missed
    return (rate(in_one) * n_linked / have if have else 1.0), int((t > 0).sum())


def block_links(nodes: DataFrame, tau: float, block: int = 4096) -> DataFrame:
    """Links (u, v) that span the components of all pairs of a group: blocks against blocks, each pair a task."""
    sent = in_blocks(nodes.select("grp", "node", "vector"), ["grp"], 2 * block)

    def search(group: pa.Table) -> pa.Table:
        node, own, x = np.asarray(group["node"]), np.asarray(group["own"]), matrix(group["vector"])
        p, q, forest = group["p"][0].as_py(), group["q"][0].as_py(), Forest(group.num_rows)
        a = np.flatnonzero(own == p)
        b = a if p == q else np.flatnonzero(own == q)
        for at in range(0, len(a), 1024):
            i, j = np.nonzero(x[a[at : at + 1024]] @ x[b].T >= tau)
            forest.link(a[at + i], b[j])
        forest.merge()
        row = np.flatnonzero(forest.label != np.arange(len(node)))
        return pa.table({"u": pa.array(node[row]), "v": pa.array(node[forest.label[row]])})

    return sent.groupBy("grp", "p", "q").applyInArrow(search, "u long, v long")


def link_counts(nodes: DataFrame, labels: DataFrame, tau: float, block: int = 1024) -> DataFrame:
    """(node, n): how many rows, others than the node's own, are linked to it within its component."""
    half = math.acos(tau) / 2 - 1e-6
    members = nodes.join(labels, "node").select("component", "node", "w", "vector", F.size("vector").alias("size"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("vector", lambda x: x.cast("double") / norm)
    members = stored(members.withColumn("unit", unit), "members")
    dims = members.agg(F.max("size").alias("n")).first().n or 0
    if not dims:
        return nodes.sparkSession.createDataFrame([], "node long, n long")
    centre = members.groupBy("component").agg(*(F.sum(F.col("unit")[i]).alias(f"c{i}") for i in range(dims)))
    # written, so that both sides of the join are plain exchanges and a large component's rows may be dealt out
    centre = stored(centre.select("component", F.array(*(F.col(f"c{i}") for i in range(dims))).alias("centre")), "centre")
    with_centre = members.join(centre, "component")
    dot = F.aggregate(F.zip_with("unit", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    length = F.sqrt(F.aggregate("centre", F.lit(0.0), lambda a, x: a + F.coalesce(x * x, F.lit(0.0))))
    cosine = F.least(F.lit(1.0), dot / length)
    outer = F.coalesce(F.acos(cosine) > half, F.lit(True))
    placed = stored(with_centre.select("component", "node", "w", "vector", outer.alias("outer")), "placed")
    sums = placed.groupBy("component").agg(
        F.sum(F.when(F.col("outer"), 0).otherwise(F.col("w"))).alias("inner_w"),
        F.sum(F.when(F.col("outer"), 1).otherwise(0)).alias("n_outer"),
        F.sum(F.when(F.col("outer"), 0).otherwise(1)).alias("n_inner"),
    )
    sums = stored(sums.withColumns({"b_outer": F.ceil(F.col("n_outer") / block), "b_inner": F.ceil(F.col("n_inner") / block)}), "sums")
    known = placed.join(sums.select("component", "inner_w"), "component").select(
        "node", F.when(F.col("outer"), F.col("w") - 1).otherwise(F.col("inner_w") - 1).alias("n")
    )
    # blocks of outer members against all blocks: an outer one goes to all pairs of its block, an inner one to the outer blocks
    unsure = placed.join(sums.where("n_outer > 0"), "component")
    hashed = F.xxhash64("node")
    own = F.when(F.col("outer"), F.pmod(hashed, F.col("b_outer"))).otherwise(F.col("b_outer") + F.pmod(hashed, F.greatest(F.col("b_inner"), F.lit(1))))
    others = F.when(F.col("outer"), F.sequence(F.lit(0).cast("long"), F.col("b_outer") + F.col("b_inner") - 1)).otherwise(
        F.sequence(F.lit(0).cast("long"), F.col("b_outer") - 1)
    )
    unsure = unsure.withColumn("own", own).select("component", "node", "w", "vector", "own", F.explode(others).alias("other"))
    keyed = unsure.select("component", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "w", "vector")

    def count(group: pa.Table) -> pa.Table:
        node, w, own = (np.asarray(group[c]) for c in ("node", "w", "own"))
        x, p, q = matrix(group["vector"]), group["p"][0].as_py(), group["q"][0].as_py()
        n = np.zeros(len(node), np.int64)
        a = np.flatnonzero(own == p)
        b = a if p == q else np.flatnonzero(own == q)
        for at in range(0, len(a), 1024):
            i = a[at : at + 1024]
            hit = x[i] @ x[b].T >= tau
            if p == q:
                hit[np.arange(len(i)), at + np.arange(len(i))] = False
            n[i] += hit @ w[b]
            if p != q:
                n[b] += w[i] @ hit
        return pa.table({"node": pa.array(node), "n": pa.array(n)})

    verified = keyed.groupBy("component", "p", "q").applyInArrow(count, "node long, n long")
    return known.unionByName(verified).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(
    rows: DataFrame,
    tau: float = 0.93,
    k: int = 8,
    trees: int = 6,
    rounds: int = 2,
    leaf: int = 512,
    sample_rows: int = 2048,
    audit_rows: int = 1024,
    recall: float = 0.995,
    attempts: int = 3,
) -> DataFrame:
    """(vec_id, embedding, label) -> vec_id, n_links, component_id, kept, a row for each row.

    Rows are compared when their labels and sizes are equal. Those with a null vec_id or label, or a vector
    that is null, empty, zero or holds null or non-finite components, have no links and are their own
    component. Repeated rows are vectors of their own. sample_rows place the trees' planes of each size of
    vector, and audit_rows measure recall; every row is indexed, and every link within a component counts.
    """
    rows = rows.select("vec_id", "label", F.col("embedding").alias("vector"))
    fits = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    grp = F.concat_ws(":", F.col("label").cast("string"), F.size("vector").cast("string"))
    rows = rows.withColumn("grp", F.when(F.coalesce(fits, F.lit(False)), grp))
    nodes = nodes_of(rows.where("grp is not null"))
    sample: dict[int, np.ndarray] = {}
    sizes = [r.n for r in nodes.select(F.size("vector").alias("n")).distinct().collect()]
    for n in sizes:
        some = nodes.where(F.size("vector") == n).orderBy(F.xxhash64("node"), "node").limit(sample_rows)
        sample[n] = matrix(some.select("vector").toArrow()["vector"])
    pairs = links = None
    for attempt in range(attempts):
        got = _leaves(nodes, range(attempt * trees, (attempt + 1) * trees), tau, k, leaf, sample)
        fresh = got.where("not link").select("u", "v", "s")
        pairs = fresh if pairs is None else pairs.unionByName(fresh)
        links = got.where("link").select("u", "v") if links is None else links.unionByName(got.where("link").select("u", "v"))
        lists = stored(_nearest(pairs, tau, k, k), "lists")
        for age in range(rounds):
            more = stored(_descend(nodes, lists, tau, k), "descent")
            fresh = more.where(F.col("s") >= tau).select("u", "v")
            links = links.unionByName(fresh)
            old, lists = lists, stored(_nearest(lists.unionByName(more), tau, k, k << min(age + 1, 2)), "lists")
            dropped(old)
            if age > 0 and fresh.count() <= 0.001 * links.count():
                break
        links = links.unionByName(lists.where(F.col("s") >= tau).select("u", "v"))
        labels = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
        # the roots of components are members too
        whole = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
        share, seen = audit(nodes, whole, tau, audit_rows, attempt)
        log.info("NN-descent, attempt %d: recall %.4f over %d nodes with links", attempt, share, seen)
        if share >= recall:
            break
        pairs = lists
    else:
        log.warning("NN-descent: recall %.4f after %d attempts; all vectors of a group are compared", share, attempts)
        links = links.unionByName(block_links(nodes, tau))
        labels = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    roots = labels.select(F.col("component").alias("node"), "component").distinct()
    counts = link_counts(nodes, labels.unionByName(roots), tau)
    of_node = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = stored(of_node.groupBy("component").agg(F.min("low").alias("component_id")), "lowest")
    of_node = of_node.join(lowest, "component").join(counts, "node", "left")
    of_node = of_node.select("grp", "vector", "component_id", F.coalesce("n", F.col("w") - 1).alias("n_links"))
    out = rows.join(of_node, ["grp", "vector"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
