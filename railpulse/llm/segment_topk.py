"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into equal segments (padded with zeros), and each segment is
represented by its mean m and deviation s, scaled by the root of its length.  For
two vectors the distance of these statistics never exceeds their own distance:

    |q - c|^2  >=  sum over segments of  length * ((mq - mc)^2 + (sq - sc)^2)

and as statistics keep a vector's norm, (|q|^2 + |c|^2 - bound) / 2, the product of
the statistics, is never below the inner product.  Levels go from coarse to fine
(segments of 16, 8, 4 components, say); a candidate whose bound is below a query's
threshold is dropped, and exact products are computed for the survivors alone.

Blocks, thresholds and defined results for odd vectors: see ``vector_blocks``.  Rows
that share an id with a query are not its candidates.  Scores are sums of integers
and exact: where they could leave the 53 bits of a double, Python integers are
used.  An empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm import vector_blocks

LEVELS = (16, 8, 4)
#: Below this share of surviving pairs, pairs are evaluated one by one instead of all.
SPARSE = 0.2


def statistics(x: np.ndarray, length: int) -> np.ndarray:
    """Scaled means and deviations of the segments of each row."""
    pad = -x.shape[1] % length
    seg = np.pad(x, ((0, 0), (0, pad))).reshape(len(x), -1, length)
    return np.concatenate([seg.mean(axis=2), seg.std(axis=2)], axis=1) * np.sqrt(length)


def _products(q: np.ndarray, c: np.ndarray, alive: np.ndarray, dense: bool) -> np.ndarray:
    """Products of the alive pairs, -inf elsewhere."""
    if dense:
        return np.where(alive, q @ c.T, -np.inf)
    out = np.full(alive.shape, -np.inf)
    i, j = np.nonzero(alive)
    for k in range(0, len(i), 1 << 16):
        a, b = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
        out[a, b] = np.einsum("ij,ij->i", q[a], c[b])
    return out


def score_block(c: np.ndarray, cids: np.ndarray, k: int):
    known = {}  # statistics of the candidates

    def score(q: np.ndarray, ids: np.ndarray, least: np.ndarray):
        alive = np.ones((len(q), len(c)), bool)
        if np.isfinite(least).any():
            room = 1e-9 * (1 + np.abs(q).max() * np.abs(c).max() * q.shape[1])  # of rounding
            for length in LEVELS:
                dense = alive.mean() > SPARSE
                if length not in known:
                    known[length] = statistics(c, length)
                alive &= _products(statistics(q, length), known[length], alive, dense) >= (least - room)[:, None]
                if not alive.any():
                    return
        if np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2**52:
            scores = _products(q, c, alive, alive.mean() > SPARSE)
        else:  # exact in Python's integers; such scores are rounded to a double only for their order
            scores = np.where(alive, (q.astype(object) @ c.astype(object).T).astype(np.float64), -np.inf)
        for i in range(len(q)):
            found = vector_blocks.best(scores[i], cids, ids[i], k, max(least[i], -1e308))
            if len(found[0]):
                yield i, found

    return score


def top_products(vectors: DataFrame, is_query: Column, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score (long) over floor(scale * component)."""
    rows = vector_blocks.valid(vectors)
    found = vector_blocks.search(rows, is_query, lambda x: np.floor(scale * x), score_block, k)
    return found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
