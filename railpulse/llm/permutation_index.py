"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table: ``pivots`` of a bounded sample of ``sample`` rows,
those with the smallest hash of their id.  A vector is represented by its
``length`` nearest pivots, in order of nearness.  The index of a block of vectors
posts (vector, place) in the inverted file of each of these pivots.

A query reads the files of its own pivots.  With places counted from 0 and a pivot
that is not among the ``length`` nearest at place ``length``, the footrule distance
of two representations is

    length * (length + 1) - 2 * sum over common pivots of (length - larger place)

so summing over the postings is enough to rank a block by footrule.  The best
``share`` of the block (``least_rerank`` at least) are then ranked by the cosine of
the original vectors in double precision, and the k best of all blocks remain.
Every vector is indexed; only the pivots come from a sample.

The recall against brute force on the test tables is in the README and is tested.
Blocks and odd vectors: see ``vector_blocks``; zero vectors take no part, and rows
that share an id with a query are not its candidates.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railpulse.llm import vector_blocks
from railpulse.session import materialize

PIVOTS = 512
LENGTH = 128
SHARE = 0.3
LEAST_RERANK = 64
SAMPLE = 4096
#: Ranges of the hash that the rows are counted by, a power of two.
RANGES = 4096


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """At most ``pivots`` different directions from a sample of at most ``sample`` rows, far ones first."""
    order = F.xxhash64("vec_id", F.lit(11))
    # counts of ranges of the hash tell which ones hold the sample, so that no more is ordered, and only the sample is sent
    ranges = rows.groupBy(F.shiftright(order, 64 - RANGES.bit_length() + 1).alias("r")).agg(F.count("*").alias("n")).collect()
    last, n = None, 0
    for r in sorted(ranges, key=lambda r: r["r"]):
        if n >= sample:
            break
        last, n = r["r"], n + r["n"]
    low = rows.withColumn("h", order).where(F.shiftright("h", 64 - RANGES.bit_length() + 1) <= F.lit(last)) if ranges else rows.withColumn("h", order)
    taken = sorted(materialize(low.orderBy("h", "vec_id").limit(sample), "sample").collect(), key=lambda r: (r["h"], r["vec_id"]))
    x = unit(np.array([r["v"] for r in taken], np.float64)) if taken else np.empty((0, 1))
    chosen, nearest = [], np.full(len(x), -2.0)
    at = 0
    while len(chosen) < min(pivots, len(x)):
        chosen.append(at)
        # every other pivot is simply the next of the sample: groups of near copies get several
        nearest = np.maximum(nearest, x @ x[at])
        nearest[at] = 2
        at = int(np.argmin(nearest)) if len(chosen) % 2 else int(np.argmax(nearest < 2))
    return x[chosen]


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The numbers of each row's nearest pivots in order; ties go to the smaller number."""
    return np.argsort(-(unit(x) @ pivots.T), axis=1, kind="stable")[:, :length]


class Index:
    """Inverted files over the rows of a block."""

    def __init__(self, x: np.ndarray, pivots: np.ndarray, length: int):
        near = nearest_pivots(x, pivots, length)
        self.n, self.length = len(x), near.shape[1]
        order = np.argsort(near.ravel(), kind="stable")
        self.row = np.repeat(np.arange(len(x)), self.length)[order]
        self.place = np.tile(np.arange(self.length), len(x))[order]
        self.first = np.searchsorted(near.ravel()[order], np.arange(len(pivots) + 1))

    def footrule(self, near: np.ndarray) -> np.ndarray:
        """The footrule distance of every row of the block to a query's nearest pivots."""
        common = np.zeros(self.n)
        a, b = self.first[near], self.first[near + 1]
        n = b - a
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        common += np.bincount(self.row[at], weights=self.length - np.maximum(self.place[at], np.repeat(np.arange(self.length), n)), minlength=self.n)
        return self.length * (self.length + 1) - 2 * common


def scorer(pivots: np.ndarray, length: int = LENGTH, share: float = SHARE, least_rerank: int = LEAST_RERANK):
    def block(c, cids, k):
        index = Index(c, pivots, length)
        rerank = min(len(c), max(least_rerank, k + 1, int(np.ceil(share * len(c)))))
        norm = np.linalg.norm(c, axis=1)

        def score(q, ids, least):
            near, own = nearest_pivots(q, pivots, length), np.linalg.norm(q, axis=1)
            for i in range(len(q)):
                at = np.argpartition(index.footrule(near[i]), rerank - 1)[:rerank] if rerank < len(c) else np.arange(len(c))
                cosine = (c[at] @ q[i]) / (norm[at] * own[i])
                found = vector_blocks.best(cosine, cids[at], ids[i], k, least[i])
                if len(found[0]):
                    yield i, found

        return score

    return block


def neighbours(vectors: DataFrame, is_query: Column, k: int, pivots: int = PIVOTS, length: int = LENGTH, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): the k nearest found of each query."""
    rows = vector_blocks.valid(vectors).where(F.exists("v", lambda c: c != 0))
    chosen = choose_pivots(rows, pivots)
    return vector_blocks.search(rows, is_query, lambda x: x, scorer(chosen, length, share), k)
