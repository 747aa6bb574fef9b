"""Nearest neighbours by a block matrix join.

Queries and candidates are dealt into blocks; every query block meets every candidate block in a task of its own. A task
rounds both sides to int8, takes one product of the two tiles, and turns it into distances whose error is bounded by the
rounding errors of the two vectors. A pair survives if its lower bound is not above the k-th smallest upper bound of its query;
survivors are recomputed in double precision. Heaps keep the k best of each tile, and the tiles' lists are merged per query.
No pair can be lost, so the result is exact.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.vectors import matrix, usable, vectors


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, the scale of each vector, the squared length of its codes and the length of what rounding took."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    wide = codes.astype(np.float64)
    return codes, scale, (wide**2).sum(axis=1), np.linalg.norm(x - wide * scale[:, None], axis=1)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The k nearest rows of one block for each query of another."""
    a, sa, na, ea = rounded(queries)
    b, sb, nb, eb = rounded(rows)
    kind = np.float32 if queries.shape[1] <= 1000 else np.float64  # products of codes stay exact integers
    product = (a.astype(kind) @ b.astype(kind).T).astype(np.float64)
    square = (sa**2 * na)[:, None] + (sb**2 * nb)[None, :] - 2 * sa[:, None] * sb[None, :] * product
    about = np.sqrt(np.maximum(square, 0))
    wide = ea[:, None] + eb[None, :] + 1e-6 * (about + sa[:, None] * 127 + sb[None, :] * 127)
    low, high = about - wide, about + wide
    own = query_ids[:, None] == ids[None, :]
    low[own] = high[own] = np.inf
    most = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
    q, c = np.nonzero((low <= most[:, None]) & ~own)
    exact = np.zeros(len(q))
    for d in range(queries.shape[1]):  # components in order, as a plain loop adds them
        exact += (queries[q, d] - rows[c, d]) ** 2
    exact = np.sqrt(exact)
    out, ends = [], np.searchsorted(q, np.arange(len(queries) + 1))
    for i in range(len(queries)):
        s = slice(ends[i], ends[i + 1])
        out += [(int(query_ids[i]), int(v), float(d)) for d, v in heapq.nsmallest(k, zip(exact[s], ids[c[s]]))]
    return out


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, block: int = 4096, query_block: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each query by Euclidean distance, ties to the smaller id.

    Vectors that are null, empty or zero, or hold a null or non-finite component, take no part, nor do rows without a
    ``vec_id``. Vectors are compared with those of their own dimension. Of rows that share a ``vec_id`` the smallest vector
    counts. A query has fewer rows if there are fewer candidates; an empty table gives no rows; other columns are left out.
    """
    own = vectors(embeddings).where(usable("embedding") & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    asked = own.where(is_query)
    n, m = own.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-m // query_block))
    dealt = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    rows = own.withColumn("cb", dealt(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    wanted = asked.withColumn("qb", dealt(query_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = tile(left.vec_id.to_numpy(), matrix(left.embedding), right.vec_id.to_numpy(), matrix(right.embedding), k) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    key = ["dim", "qb", "cb"]
    found = wanted.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 10)


SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d
) WHERE rank <= 10
"""
