"""Exact top-k by inner product of whole-number vectors, by MaxScore.

A dimension is a query's term, and a shard holds its vectors' postings term by term; the largest contribution
that a term can make in a shard is its bound. A query's terms of least bounds, whose bounds together stay
within a share of the query's current threshold, are non-essential. Queries with like essential terms go
together: the postings of the terms that some of them finds essential are traversed for a block of vectors at
once; the other terms are probed, largest bounds first, only for vectors that still may reach the threshold.
Each query's first threshold comes from one shard and travels with it to all; shards return what reaches it,
their top k at most, which are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored, table

_BLOCK = 2048  # vectors of a shard traversed at once
_GROUP = 128  # queries that traverse together
_SHARE = 0.25  # of a threshold that non-essential terms' bounds may reach: beyond, too many vectors stay competitive


def valid(vector: Column) -> Column:
    """Not null, and all components finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False)) & (F.size(vector) > 0)


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(query row, id's row, score) of each query's k highest inner products that reach its floor, ties to the
    smaller of ids, rows of its own number left out; ids and query_ids are (number of the row, vec_id). All are
    whole numbers; they are computed in the least type that holds them exactly."""
    n_queries = len(queries)
    big = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    kind = np.float32 if big < 2**24 else np.float64 if big < 2**53 else np.int64
    queries, postings = queries.astype(kind), np.ascontiguousarray(vectors.T.astype(kind))
    high, low = np.maximum(postings.max(axis=1), 0), np.minimum(postings.min(axis=1), 0)
    bounds = np.maximum(queries * high, queries * low)
    order = np.argsort(bounds, axis=1, kind="stable")  # least first
    below = np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    none = np.iinfo(np.int64).min // 4 if kind is np.int64 else -np.inf
    threshold = np.full(n_queries, none, kind)
    if floor is not None:
        threshold = np.maximum(threshold, floor.astype(kind)) if kind is np.int64 else np.where(floor > np.iinfo(np.int64).min // 4, floor, none).astype(kind)
    out = []
    # queries whose largest terms are alike traverse the same postings
    alike = np.lexsort((order[:, -2] if order.shape[1] > 1 else order[:, -1], order[:, -1]))
    for g in range(0, n_queries, _GROUP):
        own = alike[g : g + _GROUP]
        row, at, score = _traverse(queries[own], query_ids[0][own], postings, ids, k, threshold[own], below[own], place[own], none)
        out.append((own[row], at, score))
    row, at, score = (np.concatenate([o[c] for o in out]) for c in range(3))
    return row, at, score.astype(np.int64)


def _sums(queries: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Inner products, of the terms that some of the queries has."""
    terms = np.flatnonzero(queries.any(axis=0))
    if len(terms) == len(postings):
        return queries @ postings
    return queries[:, terms] @ postings[terms]


def _traverse(queries, own, postings, ids, k, threshold, below, place, none):
    n, (numbers, vec_ids) = len(queries), ids
    held_row, held_at, held_score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, queries.dtype)
    rows = np.arange(n)
    reach = lambda count: np.where(count > 0, below[rows, np.maximum(count - 1, 0)], 0)
    for at in range(0, postings.shape[1], _BLOCK):
        block = postings[:, at : at + _BLOCK]
        n_rest = (below <= np.where(threshold > 0, threshold * _SHARE, 0)[:, None]).sum(axis=1)
        n_rest[threshold <= none] = 0
        partial = _sums(np.where(place < n_rest[:, None], 0, queries), block)
        unknown = threshold <= none
        if unknown.any() and block.shape[1] > k + 1:  # scores are whole here; one may be of the query's own row
            threshold[unknown] = np.partition(partial[unknown], -k - 1, axis=1)[:, -k - 1]
        least = (threshold - reach(n_rest))[:, None]
        row, column = np.nonzero(partial >= least)
        score, upper = partial[row, column], n_rest
        # probe the rest in halves of falling bounds, while the vector is competitive
        while len(row) and upper.any():
            lower = upper // 2
            probed = np.where((place < upper[:, None]) & (place >= lower[:, None]), queries, 0)
            for some in range(0, len(row), 1 << 15):
                r, c = row[some : some + (1 << 15)], column[some : some + (1 << 15)]
                score[some : some + (1 << 15)] += np.einsum("ij,ji->i", probed[r], block[:, c])
            fine = score + reach(lower)[row] >= threshold[row]
            row, column, score, upper = row[fine], column[fine], score[fine], lower
        other = numbers[at + column] != own[row]
        held_row = np.concatenate([held_row, row[other]])
        held_at = np.concatenate([held_at, at + column[other]])
        held_score = np.concatenate([held_score, score[other]])
        if not len(row):
            continue
        best = np.lexsort((numbers[held_at], vec_ids[held_at], -held_score, held_row))
        held_row, held_at, held_score = held_row[best], held_at[best], held_score[best]
        nth = np.arange(len(held_row)) - np.searchsorted(held_row, rows)[held_row]
        kth = nth == k - 1
        threshold[held_row[kth]] = held_score[kth]
        held_row, held_at, held_score = held_row[nth < k], held_at[nth < k], held_score[nth < k]
    return held_row, held_at, held_score


def _blocks(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """One row for each (size of vectors, block): the rows' numbers, their vec_ids and floor(64 x), as bytes."""

    def pack(group: pa.Table) -> pa.Table:
        flat = pa.concat_arrays([c.flatten() for c in group["vector"].chunks])
        values = np.floor(64 * np.asarray(flat).astype(np.float64)).reshape(group.num_rows, -1)
        values = values.astype("<f4") if np.abs(values).max(initial=0) < 2**24 else values
        return pa.table(
            {
                "size": pa.array([values.shape[1]], pa.int32()),
                name: pa.array([group[name][0].as_py()], pa.int64()),
                "ids": pa.array([np.stack([np.asarray(group["number"]), np.asarray(group["vec_id"])]).astype("<i8").tobytes()], pa.binary()),
                "values": pa.array([values.tobytes()], pa.binary()),
            }
        )

    rows = rows.select(F.size("vector").alias("size"), block.alias(name), "number", "vec_id", "vector")
    return rows.groupBy("size", name).applyInArrow(pack, f"size int, {name} long, ids binary, values binary")


def _unpacked(size: int, ids: bytes, values: bytes):
    ids = np.frombuffer(ids, "<i8").reshape(2, -1)
    return ids, np.frombuffer(values, "<f4" if len(values) == 4 * size * ids.shape[1] else "<f8").reshape(-1, size)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 16384, query_rows: int = 4096, shard_bytes: int = 1 << 25) -> DataFrame:
    """(vec_id, embedding) -> (query_id, rank, vec_id, score): for each row that is a query, the k others of the
    same size with the highest inner product of floor(64 x).

    Rows that repeat a vec_id are rows of their own: each is a query if its vec_id is one, and the others are
    candidates of it; the results of queries that share a vec_id come under that query_id alike. Null ids take
    no part, nor do vectors that are null, empty or hold null or non-finite components. Scores beyond a long are
    undefined. Shards and blocks of queries hold so many rows, or about shard_bytes, at most.
    """
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    rows = stored(rows.select(F.monotonically_increasing_id().alias("number"), "vec_id", "vector"), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("vector")).alias("dims")).first()
    n, n_queries, most = sizes.n, sizes.q or 0, max(1, shard_bytes // (8 * (sizes.dims or 1)))
    # shards are for memory and, while there are few vectors, for parallel work
    shards = max(-(-n // min(shard_rows, most)), min(16, -(-n // 1024)), 1)
    blocks = max(1, -(-n_queries // min(query_rows, most)))
    by_hash = lambda parts, salt: F.pmod(F.xxhash64("number", F.lit(salt)), F.lit(parts).cast("long"))
    postings = _blocks(rows, by_hash(shards, 1), "shard")
    queries = _blocks(rows.where(is_query), by_hash(blocks, 2), "block").withColumnsRenamed({"ids": "q_ids", "values": "q_values"})
    if shards > 1:
        postings, queries = stored(postings, "postings"), stored(queries, "queries")

    def floors(batches):
        """The k-th score of each query in one shard: a bound that holds in all."""
        for batch in batches:
            for size, block, q_ids, q_values, ids, values in zip(*(c.to_pylist() for c in batch.columns)):
                (q_ids, q), (ids, v) = _unpacked(size, q_ids, q_values), _unpacked(size, ids, values)
                floor = np.full(len(q), np.iinfo(np.int64).min // 4, "<i8")
                for at in range(0, len(q), 512):
                    row, _, score = search(q[at : at + 512], q_ids[:, at : at + 512], v, ids, k)
                    full = np.bincount(row, minlength=0)
                    least = np.full(len(full), np.iinfo(np.int64).max)
                    np.minimum.at(least, row, score)
                    floor[at + np.flatnonzero(full >= k)] = least[full >= k]
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([block], pa.int64()), pa.array([floor.tobytes()], pa.binary())], ["size", "block", "floor"])

    def run(batches):
        for batch in batches:
            for size, q_ids, q_values, floor, ids, values in zip(*(c.to_pylist() for c in batch.columns)):
                (q_ids, q), (ids, v) = _unpacked(size, q_ids, q_values), _unpacked(size, ids, values)
                floor = np.frombuffer(floor, "<i8") if floor else None
                for at in range(0, len(q), 512):
                    row, found, score = search(q[at : at + 512], q_ids[:, at : at + 512], v, ids, k, None if floor is None else floor[at : at + 512])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[0, at + row]), pa.array(q_ids[1, at + row]), pa.array(ids[1, found]), pa.array(score)], ["number", "query_id", "vec_id", "score"]
                    )

    # a stated query set against all rows: each block of queries is sent to each shard
    if shards > 1:
        first = queries.join(postings.where("shard = 0").drop("shard").hint("merge"), "size")
        first = first.select("size", "block", "q_ids", "q_values", "ids", "values").mapInArrow(floors, "size int, block long, floor binary")
        queries = queries.join(first.hint("merge"), ["size", "block"], "left")
    else:
        queries = queries.withColumn("floor", F.lit(None).cast("binary"))
    queries = queries.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    pairs = queries.join(postings.hint("merge"), ["size", "shard"])
    found = pairs.select("size", "q_ids", "q_values", "floor", "ids", "values").mapInArrow(run, "number long, query_id long, vec_id long, score long")
    best = W.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS number, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.number <> c.number AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
