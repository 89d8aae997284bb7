"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each component of the vectors is a list sorted by value.  For a query, every list is read from the end that
the query's sign favours, all to the same depth, and what is read adds to its vector's known score.  A component not read yet
contributes at most what its list shows next (upper bound) and at least what the list's far end holds (lower
bound).  Reading stops once no outsider, a vector that no list has shown, can reach the k-th best lower bound; the
scores of the vectors shown that still can are then resolved in whole integers.

Candidates and queries are dealt into blocks by row, whatever their ids; a task sorts the lists of one candidate block once and reads
them for each query of one query block, and the k best of the blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.shared import keep, table
from keyloom.session import ship

CANDIDATES, QUERIES = 4096, 1024  # rows of a block, about
SCALE = 1024


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """``floor(1024 * x)`` of each component; vectors that are null or hold a null, NaN or infinity take no part."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("long"))
    return vectors.where(usable & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), F.size("embedding").alias("dim"))


def read_lists(order: np.ndarray, lists: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The vectors that may be among the k best for a query, and the depth to which the lists were read.

    ``lists`` are the sorted components, ascending, and ``order`` says whose they are; ``own`` marks vectors that are no candidates."""
    n = len(order)
    used = np.flatnonzero(q)
    w = q[used].astype(float)
    up = w > 0
    far = np.where(up, lists[0, used], lists[-1, used]) * w  # what the far ends contribute
    known, seen = np.zeros(n), np.zeros((n, len(used)), dtype=bool)
    columns, depth, step = np.arange(len(used)), 0, max(2 * k, n // 16)
    while True:
        stop = min(n, depth + step)
        places = np.where(up, n - 1 - np.arange(depth, stop)[:, None], np.arange(depth, stop)[:, None])
        shown = order[places, used]
        np.add.at(known, shown.ravel(), (lists[places, used] * w).ravel())
        seen[shown, columns] = True
        depth, step = stop, 2 * step
        if depth == n:
            return np.flatnonzero(~own), depth
        edge = lists[np.where(up, n - 1 - depth, depth), used] * w  # what the lists show next
        missing = (~seen).astype(float)
        upper, lower = known + missing @ edge, known + missing @ far
        lower[own] = -np.inf
        bar = np.partition(lower, n - min(k, n))[n - min(k, n)]
        slack = 1e-9 * (np.abs(w) @ np.abs(lists[[0, -1]][:, used]).max(axis=0) + 1)  # bounds are doubles; scores never are
        outside = ~seen.any(axis=1) & ~own
        if not outside.any() or edge.sum() < bar - slack:
            return np.flatnonzero((upper >= bar - slack) & ~outside & ~own), depth


def block_top_k(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of at most k vectors of one block."""
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    for query_id, query in zip(query_ids.tolist(), q, strict=True):
        left, _ = read_lists(order, lists, query, ids == query_id, k)
        scores = x[left] @ query
        if len(left) > k:
            best = np.lexsort((ids[left], -scores))[:k]
            left, scores = left[best], scores[best]
        yield query_id, ids[left], scores


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """The k highest inner products of each query with all other vectors.

    Input: ``vec_id``, ``embedding``; other columns are ignored.  ``is_query`` is a condition on ``vec_id``.  Output: ``query_id``,
    ``rank`` from 1, ``vec_id``, ``score``; fewer than k rows if there are fewer candidates; ties go to the smaller
    id.

    Vectors that are null, hold null or non-finite components, or have no id take no part.  Vectors of
    different lengths are never compared.  Every row is a candidate, but for those with the query's own id.  Rows that
    share an id need not share a vector: each may be among the k, and queries of one id are answered together, by
    the k highest products of any of them.  An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    rows = keep(integer_vectors(vectors).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    c_blocks, q_blocks = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(n_queries / QUERIES))

    def dealt(df: DataFrame, own: int, other: int, tag: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("row", F.lit(5)), F.lit(own)).cast("int")
        all_others = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        c, q = (all_others, mine) if tag else (mine, all_others)
        return df.select("vec_id", "v", "dim", c.alias("c_block"), q.alias("q_block"), F.lit(tag).alias("asks"))

    both = dealt(rows, c_blocks, q_blocks, False).unionByName(dealt(rows.where(is_query), q_blocks, c_blocks, True))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy(dtype=bool)
        dim = int(block["dim"].iloc[0])
        pick = lambda part: (part["vec_id"].to_numpy(), np.stack(part["v"].to_list()).reshape(len(part), dim).astype(np.int64))
        found = []
        if asks.any() and not asks.all():
            for query_id, ids, scores in block_top_k(*pick(block[~asks]), *pick(block[asks]), k):
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    pairs = c_blocks * q_blocks
    best = both.repartition(max(pairs, 1), "c_block", "q_block", "dim").groupBy("c_block", "q_block", "dim").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op9_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


#: Every pair in plain SQL.
OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
