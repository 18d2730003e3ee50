"""Exact top-k inner products by block-at-a-time pruning.

Components are terms with integer weights.  A block is a range of documents with its forward
index (the weights of its members) and the largest and smallest weight of each term.  A query
bounds a block by the sum of its own weights times the fitting extreme, orders the blocks of a
shard by that bound, and scores them until the next bound falls below its k-th score.

Blocks are built where the rows lie.  Within a shard the documents are ordered by their
likeness to a few of its own vectors, so that a block's extremes are narrow.  Queries go to the
shards in chunks: (chunk, shard) pairs are the unit of work, both of bounded size.

Weights are ``floor(scale * x)``.  Vectors that are null or hold null or non-finite components
take no part, nor do rows with a null id.  Shorter vectors are filled up with zeros.  Rows with
the query's own id are no candidates; rows that repeat an id are candidates each, and queries
each with a list of its own.  Scores beyond 64 bits are cut off at the largest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.llm.common import blob, table, written

QUERY_NAME = "op7_topk"
K = 20
SCALE = 64
BLOCK = 256
SHARD = 16384
CHUNK = 4096
PIVOTS = 32


def _matrix(batch, dims: int, scale: int) -> np.ndarray:
    column = batch.column("v")
    offs = column.offsets.to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(offs)
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(offs[:-1] - offs[0], lengths)] = np.floor(scale * values)
    return out


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; as Python integers where doubles would round."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1) < 2.0 ** 53:
        return q @ x.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q).dot(whole(x).T)


def _shards(dims: int, scale: int):
    def build(batches):
        seq = TaskContext.get().partitionId() << 32
        ids, rows, have = [], [], 0

        def shard():
            i, m = np.concatenate(ids), np.concatenate(rows)
            likeness = m @ m[:: max(1, len(m) // PIVOTS)][:PIVOTS].T
            order = np.lexsort((-likeness.max(axis=1, initial=0), likeness.argmax(axis=1)))
            return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([len(i)]), pa.array([blob(i[order])]), pa.array([blob(m[order])])], ["shard", "n", "ids", "weights"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, SHARD - have)
                ids.append(part.column("id").to_numpy())
                rows.append(_matrix(part, dims, scale))
                have += part.num_rows
                at += part.num_rows
                if have == SHARD:
                    yield shard()
                    ids, rows, have, seq = [], [], 0, seq + 1
        if have:
            yield shard()

    return build


def search_shard(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, block: int = BLOCK):
    """(query row, id, score) of the k best in one shard for each query."""
    cut = np.arange(0, len(x), block)
    high, low = np.maximum.reduceat(x, cut), np.minimum.reduceat(x, cut)
    # bounds may round up by an ulp or so at any size; the slack keeps them bounds
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    bound += np.abs(bound) * 1e-9 + np.abs(q).sum(axis=1)[:, None] * np.abs(x).max(initial=0) * 1e-12
    turn = np.argsort(-bound, axis=1, kind="stable")
    best_s = [np.zeros(0, np.float64)] * len(q)
    best_i = [np.zeros(0, np.int64)] * len(q)
    kth = np.full(len(q), -np.inf)
    alive = np.arange(len(q))
    for step in range(len(cut)):
        b = turn[alive, step]
        go = bound[alive, b] >= kth[alive]
        alive, b = alive[go], b[go]
        if not len(alive):
            break
        for one in np.unique(b):
            mine = alive[b == one]
            part = slice(int(cut[one]), int(cut[one]) + block)
            ids = x_ids[part]
            scores = _scores(q[mine], x[part])
            good = (scores >= kth[mine][:, None]) & (ids != q_ids[mine][:, None])
            for n in np.flatnonzero(good.any(axis=1)).tolist():
                row, keep = int(mine[n]), good[n]
                s = np.concatenate([best_s[row], scores[n, keep]])
                i = np.concatenate([best_i[row], ids[keep]])
                if len(s) > k:
                    first = np.lexsort((i, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k])
                    s, i = s[first], i[first]
                best_s[row], best_i[row] = s, i
                if len(s) == k:
                    kth[row] = min(s)
    lengths = [len(s) for s in best_s]
    scores = [max(-(1 << 63), min((1 << 63) - 1, int(v))) for s in best_s for v in s]
    return np.repeat(np.arange(len(q)), lengths), np.concatenate([np.zeros(0, np.int64), *best_i]), np.array(scores, np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row of ``queries``."""
    value = F.col(vector_col).cast("array<double>")
    clean = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        value, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    pick = lambda df: df.where(F.coalesce(clean, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), value.alias("v"))
    x, q = pick(vectors), pick(queries)
    dims = x.agg(F.max(F.size("v"))).first()[0] or 0
    dims = max(dims, q.agg(F.max(F.size("v"))).first()[0] or 0, 1)
    schema = "shard long, n long, ids binary, weights binary"
    shards = written(x.mapInArrow(_shards(dims, scale), schema), "shards")
    n_queries = q.count()
    chunks = max(1, -(-n_queries // CHUNK))
    chunk = F.pmod(F.xxhash64("id", "v"), F.lit(chunks)).cast("int")
    asked = written(q.withColumn("chunk", chunk).withColumn("row", F.monotonically_increasing_id()), "queries")

    # every (slot, chunk) pair meets once: blocks of the stated queries against blocks of all rows
    slots = max(1, shards.count())
    pairs = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asking = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        if left.num_rows and right.num_rows:
            q_ids, rows = right.column("id").to_numpy(), right.column("row").to_numpy()
            weights = _matrix(right.combine_chunks().to_batches()[0], dims, scale)
            for shard_ids, shard_weights in zip(left.column("ids"), left.column("weights")):
                ids = np.frombuffer(shard_ids.as_py(), np.int64)
                m = np.frombuffer(shard_weights.as_py()).reshape(len(ids), dims)
                which, found, score = search_shard(weights, q_ids, m, ids, k)
                out.append((rows[which], q_ids[which], found, score))
        return pa.table([np.concatenate(c) for c in zip(*out)], names=["row", "query_id", "vec_id", "score"])

    found = pairs.groupBy("slot", "chunk").cogroup(asking.groupBy("slot", "chunk")).applyInArrow(search, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.w, b.w), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
