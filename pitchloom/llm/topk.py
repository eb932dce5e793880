"""Exact top-k search by exhaustive term-at-a-time accumulation.

Components become integers floor(256 * x). Rows are dealt into blocks by a hash, queries and candidates each into their own, and
every pair of blocks is one group: there each query's nonzero components are the terms, and each term
scatters weight * value over its posting list into a dense integer score array of the block. A partial selection keeps the ``k`` best candidates of each query in the
block; the parts are merged by one shuffle by query. Every query meets every candidate, and no group holds more than a block of each.

Order: higher score, then smaller vec_id. A query's own row is no candidate; rows that repeat its vec_id aren't either.
Vectors that are null or hold null or non-finite components take no part. Vectors of different lengths are compared over the
components both have. Rows that repeat a vec_id take part each; repeated query rows are
asked once per distinct vector and give their rows each. Scores are exact: where a block's components are so large that 64 bits might not
hold a sum, Python's integers take over; a score among the best that does not fit the long column raises. Empty tables give
empty results; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
EVERY = 50
SCALE = 256
QUERY_BLOCK = 8_192
CANDIDATE_BLOCK = 8_192


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with integer components, without the vectors that take no part."""
    usable = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False)) & F.col("vec_id").isNotNull()
    scale = lambda x: F.when(F.abs(x) < 2.0**44, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE)  # larger ones are whole already
    return vectors.where(usable).select("vec_id", F.transform("embedding", lambda x: scale(x.cast("double"))).alias("v"))


def _matrix(rows, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best candidates: higher score, then smaller id; partition selection keeps all ties of the k-th score."""
    places = np.flatnonzero(ids != own)
    if len(places) > k:
        held = scores[places]
        bar = np.partition(held, len(places) - k)[len(places) - k] if held.dtype != object else sorted(held)[-k]
        places = places[scores[places] >= bar]
    if scores.dtype == object:
        return np.array(sorted(places, key=lambda p: (-scores[p], ids[p]))[:k], np.int64)
    return places[np.lexsort((ids[places], -scores[places]))][:k]


def scan(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of a block for each query of a block, term at a time."""
    ids = candidates["vec_id"].to_numpy(np.int64)
    width = max([0, *map(len, candidates["v"])])
    dense, asked = _matrix(candidates["v"].tolist(), width), [v[:width] for v in queries["v"]]
    most = np.abs(dense).max(initial=0) * max([0.0, *(np.abs(v).max(initial=0) for v in asked)]) * max(width, 1)
    whole = most < 2.0**62
    dense = dense.astype(np.int64) if whole else np.array([int(x) for x in dense.ravel()], object).reshape(dense.shape)
    postings = []
    for t in range(width):
        column = np.ascontiguousarray(dense[:, t])
        docs = np.flatnonzero(column)
        postings.append((docs, column[docs]) if 2 * len(docs) < len(column) else (slice(None), column))
    out = []
    for own, row, vector in zip(queries["vec_id"], queries["row"], asked, strict=True):
        scores = np.zeros(len(ids), np.int64 if whole else object)
        for t, weight in enumerate(map(int, vector)):
            if weight:
                docs, values = postings[t]
                scores[docs] += weight * values
        for p in best(scores, ids, own, k):
            out.append((own, row, ids[p], scores[p]))
    if not whole and any(abs(x[3]) >= 2**63 for x in out):
        raise OverflowError("a score does not fit 64 bits")
    return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose vec_id is divisible by ``every``."""
    rows = scaled(vectors).withColumn("row", F.monotonically_increasing_id())
    asked = rows.where(F.col("vec_id") % every == 0)
    n, n_asked = rows.count(), asked.count()
    n_blocks, n_asked_blocks = -(-n // CANDIDATE_BLOCK) or 1, -(-n_asked // QUERY_BLOCK) or 1

    def spread(df, own, blocks, other, others):
        """Each row in its own block, once for each block of the other side."""
        block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")
        return df.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left = spread(asked, "q", n_asked_blocks, "c", n_blocks).groupBy("q", "c")
    right = spread(rows, "c", n_blocks, "q", n_asked_blocks).groupBy("q", "c")
    parts = left.cogroup(right).applyInPandas(lambda q, c: scan(q, c, k), "query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
