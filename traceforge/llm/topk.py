"""Exact inner-product search by pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Rows of a query block and of a candidate block, pivots, bounds evaluated at once.
QUERY_BLOCK, ROW_BLOCK, PIVOTS, STEP = 1024, 4096, 32, 256
FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int = 256) -> Column:
    """Components as ``floor(scale * x)``; null if the vector or a component is null, NaN or infinite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _best_by_bound(queries: np.ndarray, rows: np.ndarray, pivots: np.ndarray, ids, own, k: int):
    """Yields each query's positions of its best ``k`` rows, ties to smaller id.

    Distances to the pivots bound a row's distance to a query from below, by the
    largest difference over all pivots, and so its inner product from above.
    Rows are evaluated in the order of this bound until it falls under the
    k-th score; distances are at most a few units off by rounding, hence the slack.
    """
    q, r, p = (m.astype(np.float64) for m in (queries, rows, pivots))
    square = lambda m: np.einsum("ij,ij->i", m, m)
    far = lambda m: np.sqrt(np.maximum(square(m)[:, None] + square(p)[None] - 2 * m @ p.T, 0))
    row_far, query_far, row_square, query_square = far(r), far(q), square(r), square(q)
    slack = 1 + 1e-9 * (row_square.max(initial=0) + query_square.max(initial=0))
    for i in range(len(q)):
        low = np.zeros(len(r))
        for j in range(p.shape[0]):
            np.maximum(low, np.abs(row_far[:, j] - query_far[i, j]), out=low)
        bound = (row_square + query_square[i] - low * low) / 2 + slack
        bound[ids == own[i]] = -np.inf
        order = np.argsort(-bound, kind="stable")
        order = order[: int(np.count_nonzero(bound > -np.inf))]
        at, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for begin in range(0, len(order), STEP):
            if len(at) == k and bound[order[begin]] < score[-1]:
                break
            fresh = order[begin : begin + STEP]
            at = np.concatenate((at, fresh))
            score = np.concatenate((score, rows[fresh] @ queries[i]))
            best = np.lexsort((ids[at], -score))[:k]
            at, score = at[best], score[best]
        yield at, score


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products.

    Components become integers first (``quantised``), so scores are exact and
    equal on every machine; ties go to the smaller id, a vector is never its own
    result. Rows without an id, and vectors that are null or hold a null or
    non-finite component, take no part. Rows that repeat an id count once, with
    the smallest vector. Vectors of different length are never compared.

    Queries and rows are dealt into blocks of bounded size; every pair of blocks
    is one group, which returns at most ``k`` rows a query, and a last step
    ranks those. The pivots are a fixed number of rows by hash of the id.
    """
    rows = (
        vectors.select(
            F.col(id_column).cast("long").alias("vec_id"), quantised(F.col(vector)).alias("v"), is_query.alias("asked")
        )
        .where("vec_id is not null and v is not null")
        .groupBy("vec_id")
        .agg(F.min("v").alias("v"), F.bool_or("asked").alias("asked"))
    )
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("v").collect()]
    total, asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    row_blocks, query_blocks = -(-total // ROW_BLOCK) or 1, -(-asked // QUERY_BLOCK) or 1
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    size = F.size("v").alias("size")
    left = rows.where("asked").select(size, block(query_blocks).alias("q"), numbers(row_blocks).alias("r"), "vec_id", "v")
    right = rows.select(size, numbers(query_blocks).alias("q"), block(row_blocks).alias("r"), "vec_id", "v")

    def search(queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(candidates):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, r = (np.array(f["v"].tolist(), np.int64).reshape(len(f), -1) for f in (queries, candidates))
        same = [p for p in pivots if len(p) == q.shape[1]]
        ids, own = candidates["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
        found = [*_best_by_bound(q, r, np.array(same, np.int64).reshape(len(same), q.shape[1]), ids, own, k)]
        return pd.DataFrame(
            {
                "query_id": np.repeat(own, [len(at) for at, _ in found]),
                "vec_id": np.concatenate([ids[at] for at, _ in found]),
                "score": np.concatenate([score for _, score in found]),
            }
        )

    keys = ["size", "q", "r"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
