"""Exact top-k inner products without random access.

Every dimension is a list of the candidates, sorted by their component. For a query, each list is read from the end that gives
the largest products, and nothing is looked up by candidate. After a depth, a candidate's score is known in part: the lower
bound adds the worst that the unread lists can hold, the upper bound what stands at their heads. Candidates whose upper bound is below
the k-th best lower bound cannot qualify; when no unread candidate can, reading stops and the final scores of the rest are resolved from
the lists.

Queries and candidates meet in blocks. A task reads one block of queries and then candidate blocks one after the other, with the
thresholds found so far; the bounds of a whole block are a few matrix products. Scores are whole numbers, exact in float32 or float64 as
their size needs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix, packed
from .common import partitions, prepared, stored

QUERY_BLOCK, CANDIDATE_BLOCK, SLICES = 512, 8192, 12
DEPTHS = (0.25, 0.6)  # parts of each list that are read before bounds are compared


def whole_numbers(vector: Column, factor: int = 64) -> Column:
    """floor(factor * x) of every component as a 64-bit number; null for a vector that is null or holds null or non-finite
    components. Numbers and scores beyond 64 bits stay at the limit."""
    x = F.transform(vector, lambda v: F.floor(v.cast("double") * factor))
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), x)


def bounded_search(q: np.ndarray, c: np.ndarray, k: int, floor: np.ndarray, barred: tuple[np.ndarray, np.ndarray]):
    """Pairs (query row, candidate row, score) among which every query's best k are, but for those below ``floor``, the score that its
    k-th best has already. ``q`` and ``c`` are whole numbers; ``barred`` are pairs that do not count."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    kind = np.float32 if top < 2**23 else np.float64 if top < 2**52 else object
    if kind is object:
        scores = q.astype(object) @ c.astype(object).T
        good = (scores >= floor[:, None]).astype(bool)
        good[barred] = False
        row, col = np.nonzero(good)
        limit = 2**63 - 1
        return row, col, np.array([max(-limit, min(limit, int(s))) for s in scores[row, col]], np.int64)
    q, c = q.astype(kind), c.astype(kind)
    n = len(c)
    alive = np.ones((len(q), n), bool)
    alive[barred] = False
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    order = np.sort(c, axis=0)
    place = np.empty(c.shape, np.int32)
    np.put_along_axis(place, np.argsort(c, axis=0, kind="stable").astype(np.int32), np.arange(n, dtype=np.int32)[:, None], 0)
    active = np.arange(len(q))
    for depth in (int(n * d) for d in DEPTHS):
        if depth == 0 or len(active) == 0:
            continue
        high, low = place >= n - depth, place < depth  # read from the top for positive weights, from the bottom for negative ones
        p, m = plus[active], minus[active]
        known = p @ np.where(high, c, 0).T + m @ np.where(low, c, 0).T
        unread_high, unread_low = (~high).astype(kind), (~low).astype(kind)
        upper = known + (p * order[n - depth - 1]) @ unread_high.T + (m * order[depth]) @ unread_low.T
        lower = known + (p * order[0]) @ unread_high.T + (m * order[-1]) @ unread_low.T
        if n > k:
            lower[~alive] = -np.inf
            floor = floor.copy()
            floor[active] = np.maximum(floor[active], np.partition(lower, n - k, axis=1)[:, n - k])
        can = alive & (upper >= floor[active, None])
        rest = can.any(axis=1)
        active, alive = active[rest], can[rest]
        if alive.sum() < 0.02 * alive.size:
            break
    if len(active) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if alive.sum() < 0.02 * alive.size:  # few are left: resolve them alone
        row, col = np.nonzero(alive)
        scores = np.einsum("ij,ij->i", q[active[row]], c[col])
    else:
        every = q[active] @ c.T
        row, col = np.nonzero(alive & (every >= floor[active, None]))
        scores = every[row, col]
    return active[row], col, scores.astype(np.int64)


def _best(query, vec, score, k):
    """The best k of each query, ties to the smaller id."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
    keep = rank < k
    return query[keep], vec[keep], score[keep]


class _Asked:
    """One block of queries with the best that was found so far."""

    def __init__(self, ids, tags, numbers, k):
        self.ids, self.tags, self.q, self.k = ids, tags, numbers, k
        self.best = (np.zeros(0, np.int64),) * 3
        self.floor = np.full(len(ids), -np.inf)

    def meet(self, ids, numbers):
        own = np.flatnonzero(np.isin(ids, self.ids))
        at, col = np.nonzero(self.ids[:, None] == ids[own])
        place, col, score = bounded_search(self.q, numbers, self.k, self.floor, (at, own[col]))
        self.best = _best(np.r_[self.best[0], place], np.r_[self.best[1], ids[col]], np.r_[self.best[2], score], self.k)
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, self.best[0], self.best[2])
        self.floor = np.where(np.bincount(self.best[0], minlength=len(self.ids)) >= self.k, worst, -np.inf)

    def result(self):
        place, vec, score = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[place]), pa.array(self.tags[place]), pa.array(vec), pa.array(score)], ["query_id", "tag", "vec_id", "score"])


def _search(k):
    def run(batches):
        group, asked = None, []  # the queries of a pair come before its candidates, one block for each vector length
        for batch in batches:
            for row in batch.to_pylist():
                if row["pair"] != group:
                    yield from (a.result() for a in asked)
                    group, asked = row["pair"], []
                ids, tags, numbers = matrix(row, "<i8")
                if row["kind"] == 0:
                    asked.append(_Asked(ids, tags, numbers, k))
                else:
                    for a in asked:
                        if a.q.shape[1] == numbers.shape[1]:
                            a.meet(ids, numbers)
        yield from (a.result() for a in asked)

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` that the condition ``queries`` picks, the ``k`` other rows of
    largest inner product of whole numbers floor(factor * x), all if there are fewer; ties go to the smaller key.

    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows with a null key; vectors of
    different lengths are not compared. Rows that share a key are candidates of their own, but no candidates of their key's query; equal
    query rows are one query, and one key with two vectors has two lists. Other columns are not looked at.
    """
    spark = prepared(vectors.sparkSession)
    rows = (vectors.select(F.col(key).cast("bigint").alias("id"), whole_numbers(F.col(vector), factor).alias("x"), F.coalesce(queries, F.lit(False)).alias("q"))
            .filter("id IS NOT NULL AND x IS NOT NULL AND size(x) > 0").withColumn("tag", F.xxhash64("x")))
    rows = stored(rows, "vectors")
    asked = rows.filter("q").select("id", "tag", "x").dropDuplicates(["id", "tag"])
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    dealt = asked.withColumn("key", F.pmod(F.xxhash64("id", "tag"), F.lit(n_blocks)))
    q_blocks = packed(dealt.repartition(n_blocks, "key").sortWithinPartitions("key", F.size("x")), 4 * QUERY_BLOCK, "<i8")
    c_blocks = packed(rows.withColumn("key", F.lit(0).cast("bigint")), CANDIDATE_BLOCK, "<i8")
    # each query block meets the candidate blocks of each slice in one place
    left = q_blocks.select(F.col("key").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"), F.lit(0).alias("kind"), "ids", "tags", "numbers")
    right = c_blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("qb"), F.pmod(F.xxhash64("ids"), F.lit(SLICES)).alias("slice"), F.lit(1).alias("kind"), "ids", "tags", "numbers")
    pairs = left.union(right).withColumn("pair", F.concat_ws(":", "qb", "slice"))
    tasks = partitions(spark, n_blocks * SLICES, 4)
    found = (pairs.repartition(tasks, "pair").sortWithinPartitions("pair", "kind").select("pair", "kind", "ids", "tags", "numbers")
             .mapInArrow(_search(k), "query_id bigint, tag bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
