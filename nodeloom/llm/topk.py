"""Exact top-k inner-product search.

Method: tiled matrix products of queries and shards, partial selection per tile
and tree merging of the per-query top lists. The queries are taken in blocks of at
most about ``QUERY_BLOCK`` vectors, which is the proven bound of what is broadcast;
the candidates are never shuffled, each partition is a shard. A shard keeps ``k``
rows per query, so what is shuffled is queries x shards x k small rows, merged first
within groups of shards and then over the groups.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

QUERY_BLOCK = 2048
TILE = 2048
MERGE_GROUPS = 64
#: Query blocks whose shard lists are written out together, to bound the size of one plan.
BLOCKS_PER_WRITE = 16

_NONE = np.iinfo(np.int64).min
_LISTS = "query_id long, vec_id long, score long, shard int"


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as an integer matrix; shorter vectors are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    if len(values) == width * len(lengths):
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _fit(rows: np.ndarray, width: int) -> np.ndarray:
    return rows[:, :width] if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def tile_top(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (score, id) of one tile for each query: higher scores first, then smaller ids; a row with the query's own id is left out."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    width = max(queries.shape[1], rows.shape[1])
    queries, rows = _fit(queries, width), _fit(rows, width)
    n, kept = len(ids), min(k, len(ids))
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * width
    own = ids[None, :] == query_ids[:, None]
    if bound * (n + 1) < 2**52:
        # score and place in one exact float: all keys of a query differ, so partial selection needs no care for ties
        score = queries.astype(np.float64) @ rows.T.astype(np.float64)
        key = score * n + np.arange(n - 1, -1, -1)
        key[own] = -np.inf
        at = np.argpartition(-key, kept - 1, axis=1)[:, :kept]
        score = score.astype(np.int64)
    else:
        score = queries @ rows.T
        at = np.stack([np.lexsort((np.arange(n), -score[i], own[i]))[:kept] for i in range(len(queries))]) if len(queries) else np.zeros((0, kept), np.int64)
    top, top_ids = np.take_along_axis(score, at, 1), ids[at]
    gone = np.take_along_axis(own, at, 1)
    top[gone], top_ids[gone] = _NONE, np.iinfo(np.int64).max
    return top, top_ids


def merge_top(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """One node of the merge tree."""
    score, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, ~score), axis=-1)[:, :k]  # ~x falls as x rises, without overflow
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def _shard_lists(block, k: int):
    def search(batches):
        query_ids, queries = block.value
        top = (np.full((len(query_ids), 0), _NONE, np.int64), np.zeros((len(query_ids), 0), np.int64))
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(batch.column(1))
            for at in range(0, len(ids), TILE):
                top = merge_top(top, tile_top(queries, query_ids, rows[at : at + TILE], ids[at : at + TILE], k), k)
        found = top[0] != _NONE
        n = int(found.sum())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.broadcast_to(query_ids[:, None], found.shape)[found], pa.int64()),
                pa.array(top[1][found], pa.int64()),
                pa.array(top[0][found], pa.int64()),
                pa.array(np.full(n, TaskContext.get().partitionId()), pa.int32()),
            ],
            ["query_id", "vec_id", "score", "shard"],
        )

    return search


def _best(lists: DataFrame, k: int, *keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_top_k(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Return (query_id, rank, vec_id, score): the k rows of ``base`` with the highest integer inner product for each query.

    Both inputs have (vec_id long, vector array<long>). Ties go to the smaller
    vec_id. Rows without an id or a vector take no part. A row with the query's own
    id is no candidate; queries that repeat an id count once, with one of their vectors, while
    repeated candidates each take a place. Vectors of unequal length are padded with
    zeros; an empty vector scores 0. Empty tables give an empty result.
    """
    spark = base.sparkSession
    whole = F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
    base = base.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>")).where(whole)
    queries = queries.select(F.col("vec_id").cast("long"), F.col("vector").cast("array<long>")).where(whole)
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    lists: list[DataFrame] = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()
        ids, first = np.unique(part.column(0).to_numpy().astype(np.int64), return_index=True)
        block = spark.sparkContext.broadcast((ids, _matrix(part.column(1))[first]) if len(ids) else (ids, np.zeros((0, 0), np.int64)))
        lists.append(base.mapInArrow(_shard_lists(block, k), _LISTS))
        if len(lists) == BLOCKS_PER_WRITE and b + 1 < blocks:
            lists = [common.store(_union(lists), "topk")[0]]
    merged = _best(_union(lists), k, "query_id", F.pmod("shard", F.lit(MERGE_GROUPS))).drop("rank")
    return _best(merged, k, "query_id").select("query_id", "rank", "vec_id", "score")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def quantized(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, vector): each component x as floor(scale * x); rows with null or non-finite components are left out."""
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & good)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("vector"))
    )


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantized(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
