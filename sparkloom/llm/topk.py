"""Exact top-k search: tiled matrix products of queries and shards, partial selection per
tile, and tree merging of per-query top lists.

Queries are dealt to rounds and go through the candidates one round after the other.  A
round holds at most about ``ROUND_QUERIES`` vectors and ``ROUND_BYTES``; it is broadcast, its
lists are written, and it is dropped before the next comes, so that neither the driver nor
an executor ever holds more than one round, however many queries there are.  A task keeps
one top list per query of the round and emits it once, and two levels of windows merge the
lists of all tasks.

Defined cases
  * a vector that is null, is empty, or holds a null or non-finite component takes no part,
    and neither does a row without an id;
  * rows that repeat are candidates each; a query id that repeats is one query (its
    smallest vector), and every row of that id counts as the query's own;
  * vectors of unequal length are compared as if padded with zeros;
  * equal scores go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, written

ROUND_QUERIES, ROUND_BYTES = 65_536, 64 << 20
TILE_ROWS = 4_096
TILE_QUERIES = 512
ABSENT = np.int64(-(2**63) + 1)
NO_ID = np.int64(2**63 - 1)
EXACT = 2.0**52


def quantised(embedding: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    return F.when(F.coalesce(good, F.lit(False)) & (F.size(embedding) > 0), whole)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """List column to a dense int64 matrix, rows padded with zeros."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    values = np.asarray(column.values, dtype=np.int64)[offsets[0] : offsets[-1]]
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == lengths[0]).all() and width in (None, lengths[0]):
        return values.reshape(len(lengths), -1)
    width = max(width or 0, int(lengths.max(initial=0)))
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], lengths)] = values
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: BLAS doubles while every sum fits 52 bits, else whole numbers."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, int(ABSENT) + 1, 2**63 - 1).astype(np.int64)


def tile_top(ids_q: np.ndarray, a: np.ndarray, ids: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k of one tile for each query: scores and ids, best first; ABSENT where fewer."""
    order = np.argsort(ids, kind="stable")
    ids, b = ids[order], b[order]
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b))
    scores = _products(a, b)
    first, last = np.searchsorted(ids, ids_q, "left"), np.searchsorted(ids, ids_q, "right")
    for row in np.nonzero(last > first)[0]:
        scores[row, first[row] : last[row]] = ABSENT
    n = len(ids)
    if n > k:
        # position breaks ties to the smaller id, so that one partial selection is exact
        if float(np.abs(scores, where=scores != ABSENT, out=np.zeros_like(scores)).max(initial=0)) * n < 2.0**62:
            key = np.where(scores == ABSENT, ABSENT, scores * n + (n - 1 - np.arange(n)))
            pick = np.argpartition(key, n - k, axis=1)[:, n - k :]
        else:
            pick = np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)[:, :k]
        scores, ids = np.take_along_axis(scores, pick, 1), ids[pick]
    else:
        ids = np.broadcast_to(ids, scores.shape)
    return scores, np.where(scores == ABSENT, NO_ID, ids)


def merge_top(s1, i1, s2, i2, k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate([s1, s2], 1), np.concatenate([i1, i2], 1)
    best = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


def _pack(batches):
    for batch in batches:
        ids, m = np.asarray(batch.column(0), dtype=np.int64), matrix(batch.column(1))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(ids)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([m.tobytes()], pa.binary())})


def _scan(k: int, round_):
    def run(batches):
        from pyspark import TaskContext

        ids_q, a = round_.value
        scores, ids = np.full((len(ids_q), k), ABSENT), np.full((len(ids_q), k), NO_ID)

        def tile(held):
            nonlocal scores, ids
            cand = np.concatenate([x for x, _ in held])
            width = max(m.shape[1] for _, m in held)
            b = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for _, m in held])
            for at in range(0, len(ids_q), TILE_QUERIES):
                cut = slice(at, at + TILE_QUERIES)
                s, i = tile_top(ids_q[cut], a[cut], cand, b, k)
                scores[cut], ids[cut] = merge_top(scores[cut], ids[cut], s, i, k)

        held, n = [], 0
        for batch in batches:
            held.append((np.asarray(batch.column(0), dtype=np.int64), matrix(batch.column(1))))
            n += len(held[-1][0])
            if n >= TILE_ROWS:
                tile(held)
                held, n = [], 0
        if n:
            tile(held)
        part = TaskContext.get().partitionId()
        for at in range(0, len(ids_q), 8192):
            s, i = scores[at : at + 8192].ravel(), ids[at : at + 8192].ravel()
            q = np.repeat(ids_q[at : at + 8192], k)
            there = i != NO_ID
            yield pa.RecordBatch.from_pydict({"query_id": pa.array(q[there]), "vec_id": pa.array(i[there]), "score": pa.array(s[there]), "branch": pa.array(np.full(int(there.sum()), part % 16, np.int64))})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "vector", round_queries: int = ROUND_QUERIES) -> DataFrame:
    """The k best partners of each query row among all rows of ``vectors``.

    ``vectors`` holds a long id and an array<long>; the result has query_id, rank (from 1),
    vec_id and score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), is_query.alias("q")).where("id is not null and v is not null and size(v) > 0")
    queries = written(rows.where("q").groupBy("id").agg(F.min("v").alias("v")), "queries")
    count, width = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    rounds = max(1, -(-count // round_queries), -(-count * (width or 0) * 8 // ROUND_BYTES))
    blocks = queries.withColumn("round", F.pmod(F.xxhash64("id"), F.lit(rounds)))
    candidates, lists = rows.select("id", "v"), []

    def best(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)

    for r in range(rounds if count else 0):
        held = blocks.where(F.col("round") == r).select("id", "v").mapInArrow(_pack, "n long, ids binary, vectors binary").collect()  # one round
        if not held:
            continue
        assert sum(x.n for x in held) <= 2 * round_queries, "a round of queries is far over its bound"
        ids_q = np.concatenate([np.frombuffer(x.ids, np.int64) for x in held])
        parts = [np.frombuffer(x.vectors, np.int64).reshape(x.n, -1) for x in held]
        width = max(p.shape[1] for p in parts)
        a = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts])
        del held, parts
        shared = spark.sparkContext.broadcast((ids_q, a))
        found = candidates.mapInArrow(_scan(k, shared), "query_id long, vec_id long, score long, branch long")
        lists.append(written(best(best(found, "query_id", "branch"), "query_id").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "top"))
        shared.destroy()
    if not lists:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = lists[0]
    for more in lists[1:]:
        found = found.unionAll(more)
    return found


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` against the rows whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select("vec_id", quantised(F.col("embedding")).alias("vector"))
    return exact_top_k(vectors, F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), q AS (SELECT vec_id AS query_id, min(vector) AS vector FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT query_id, v.vec_id, CAST(list_sum(list_transform(range(1, len(v.vector) + 1), lambda i: v.vector[i] * q.vector[i])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> query_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
