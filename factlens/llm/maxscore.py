"""Operator 4: exact top-k inner products by MaxScore.

Each dimension is a query term, and its posting list in a shard is the rows' values there, in row order. With m the smallest
(for a negative query weight: the largest) value of a list, q * x = q * m + |q| * |x - m|: a fixed part and a part from 0 to
the term's bound. Terms in ascending order of bound are non-essential as long as their bounds together cannot lift a row that
has nothing else to the query's k-th best score so far. Only the essential terms' lists are traversed; the rows that could
still win with all the bounds left are probed in the other lists, PROBED terms at a time, largest bounds first, and are given
up once they cannot. Shards are merged by a ranking of each query's k best of every shard.

The first shard's k-th best scores go to all other shards as the scores to beat, so these split their terms and give up rows
from the start. Shards hold about SHARD_ROWS rows and query blocks BLOCK_QUERIES queries; one task scores one block against
one shard. Rows come in ascending id order within a shard, so of equal scores the earlier one stands; rows that reach the
score to beat are kept, for they may have the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable, written

SHARD_ROWS, BLOCK_QUERIES, STRIDE, PROBED = 8192, 4096, 2048, 8


class Postings:
    """A shard's posting lists: one row of values a term, and its smallest and largest value."""

    def __init__(self, rows: np.ndarray, kind: type):
        self.lists = np.ascontiguousarray(rows.T.astype(kind))
        self.low, self.high = self.lists.min(axis=1), self.lists.max(axis=1)

    def add(self, q: np.ndarray, terms: np.ndarray, start: int, stop: int, places: np.ndarray | None = None) -> np.ndarray:
        """Sum of these terms' parts: of all rows from start to stop, or of those at places (counted from start)."""
        if places is None or 2 * len(places) > stop - start:
            score = q[terms] @ self.lists[terms, start:stop]
            return score if places is None else score[places]
        return q[terms] @ self.lists[terms[:, None], start + places]


def _best(score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Where the k best are (score descending, then place), in that order."""
    at = np.arange(len(score))
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((place[at], -score[at]))[:k]]


def query_topk(post: Postings, q: np.ndarray, skip: np.ndarray, k: int, theta: float = -np.inf, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, int]:
    """Row places and scores of the query's k best rows that are not at the places of skip, and how many (row, term) values were read. Rows under theta may be left out."""
    n, read = post.lists.shape[1], 0
    fixed, bound = np.where(q >= 0, q * post.low, q * post.high), np.abs(q) * (post.high - post.low)
    order = np.argsort(bound, kind="stable")
    reach = np.concatenate([[0], np.cumsum(bound[order])])  # what the first terms can add together
    base = fixed.sum()
    hr, hs = np.empty(0, np.int64), np.empty(0, post.lists.dtype)
    for start in range(0, n, stride):
        stop = min(start + stride, n)
        m = int(np.searchsorted(reach, theta - base, side="left")) - 1 if theta > base else 0  # base + reach[m] < theta
        essential = order[m:]
        score = post.add(q, essential, start, stop) + fixed[order[:m]].sum() if len(essential) else np.full(stop - start, base)
        read += len(essential) * (stop - start)
        alive = np.flatnonzero(score + reach[m] >= theta)
        score = score[alive]
        while m and len(alive):
            terms = order[max(m - PROBED, 0) : m]
            score = score + post.add(q, terms, start, stop, alive) - fixed[terms].sum()
            read += len(terms) * len(alive)
            m = max(m - PROBED, 0)
            ok = score + reach[m] >= theta
            alive, score = alive[ok], score[ok]
        hr, hs = np.concatenate([hr, alive + start]), np.concatenate([hs, score])
        own = np.isin(hr, skip, invert=True)
        hr, hs = hr[own], hs[own]
        best = _best(hs, hr, k)
        hr, hs = hr[best], hs[best]
        if len(hs) == k:
            theta = max(theta, hs[-1])
    return hr, hs, read


def shard_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, theta: np.ndarray | None = None, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, score) of the k best rows for each query; integer vectors, rows in ascending id order."""
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(queries.shape[1], 1)
    if largest >= 2**51:
        raise OverflowError("components are too large for exact products")
    kind = np.float32 if largest < 2**22 else np.float64
    post = Postings(rows, kind)
    first, after = np.searchsorted(row_ids, query_ids, side="left"), np.searchsorted(row_ids, query_ids, side="right")
    found = [query_topk(post, q, np.arange(a, b), k, -np.inf if theta is None else theta[i], stride)[:2] for i, (q, a, b) in enumerate(zip(queries.astype(kind), first, after, strict=True))]
    counts = [len(r) for r, _ in found]
    return np.repeat(np.arange(len(queries)), counts), np.concatenate([r for r, _ in found]), np.concatenate([s for _, s in found])


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: float = 64.0) -> DataFrame:
    """id and v = floor(scale * x) of each vector that has no null and only finite components."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: F.floor(F.lit(float(scale)) * e.cast("double")).cast("long")).alias("v"))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20, *, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates, both sides as from integer_vectors().

    Ties go to the smaller id; candidates with the query's id are left out. A query without candidates has no row. Vectors of
    unequal length are compared as if the shorter had zeros after it. Repeated candidates each count; repeated queries each
    get their own rows only if their ids differ. Without queries or candidates the result is empty. Components so large that
    a score might pass 2**51 raise OverflowError, as the products would not be exact.
    """
    importable(candidates.sparkSession)
    candidates, queries = written(candidates, "vectors"), written(queries.dropDuplicates(["id"]), "queries")
    shards, blocks = max(1, math.ceil(candidates.count() / shard_rows)), max(1, math.ceil(queries.count() / block_queries))
    # Shards and blocks of equal size at any distribution of ids: round robin by a hash of the id.
    c = candidates.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    q = queries.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0, np.int64)})
        dims = max(left["v"].map(len).max(), right["v"].map(len).max(), 1)

        def matrix(v: pd.Series) -> np.ndarray:
            out = np.zeros((len(v), dims), np.int64)
            for i, x in enumerate(v):
                out[i, : len(x)] = x
            return out

        left = left.sort_values("id", kind="stable")
        ids, qids = left["id"].to_numpy(), right["id"].to_numpy()
        theta = right["theta"].fillna(-np.inf).to_numpy(np.float64)
        a, b, s = shard_topk(matrix(right["v"]), qids, matrix(left["v"]), ids, k, theta)
        return pd.DataFrame({"query_id": qids[a], "vec_id": ids[b], "score": s.astype(np.int64)})

    def scored(c: DataFrame, q: DataFrame, first: int, last: int) -> DataFrame:
        c = c.where(F.col("s").between(first, last)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        q = q.withColumn("s", F.explode(F.sequence(F.lit(first), F.lit(last))))
        return c.groupBy("s", "b").cogroup(q.groupBy("s", "b")).applyInPandas(score, "query_id long, vec_id long, score long")

    found = scored(c, q.withColumn("theta", F.lit(None).cast("double")), 0, 0)
    if shards > 1:
        found = written(found, "first-shard")
        beat = found.groupBy(F.col("query_id").alias("id")).agg(F.min("score").cast("double").alias("theta"), F.count("*").alias("n")).where(F.col("n") == k)
        found = found.unionByName(scored(c, q.join(beat.drop("n"), "id", "left"), 1, shards - 1))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
