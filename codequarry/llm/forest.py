"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

Trees are fitted on a bounded sample: each inner node projects on a random direction and splits at the sample's median. Every row
is then indexed, that is, dealt to its leaf in each tree. A query walks all trees at once through one priority queue: the branch
whose worst margin so far is best is followed next, and leaves are taken until ``probes`` are. Rows of the taken leaves are compared
exactly, in double precision on the original vectors.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import matrix, packed
from .common import prepared, stored

TREES, LEAF_ROWS, SAMPLE = 8, 400, 32_768  # the sample's bound; an inner node needs MIN_SAMPLE rows of it to split
MIN_SAMPLE = 32
PROBE_SHARE, LEAST_PROBES = 0.12, 24  # leaves taken, of all leaves of the forest
BLOCK = 4096
SEED = 20_240_501


def usable(vector: Column) -> Column:
    """Doubles of a vector; null where it is null, empty, zero or holds null or non-finite components."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.when(F.coalesce(fine, F.lit(False)), x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit(sample: np.ndarray, depth: int, trees: int = TREES, seed: int = SEED) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """Of each tree and level, the directions and the thresholds of its nodes."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        leaf, levels = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            w = rng.standard_normal((1 << level, sample.shape[1]))
            w /= np.sqrt((w * w).sum(axis=1, keepdims=True))
            side = np.einsum("ij,ij->i", sample, w[leaf])
            order = np.lexsort((side, leaf))
            cuts = np.searchsorted(leaf[order], np.arange((1 << level) + 1))
            middle = np.array([np.median(side[order[a:b]]) if b > a else 0.0 for a, b in zip(cuts[:-1], cuts[1:])])
            levels.append((w, middle))
            leaf = 2 * leaf + (side > middle[leaf])
        forest.append(levels)
    return forest


def leaves(forest, x: np.ndarray) -> np.ndarray:
    """Leaf of each unit vector in each tree."""
    out = np.zeros((len(x), len(forest)), np.int64)
    for t, levels in enumerate(forest):
        for w, middle in levels:
            side = np.einsum("ij,ij->i", x, w[out[:, t]])
            out[:, t] = 2 * out[:, t] + (side > middle[out[:, t]])
    return out


def search(forest, x: np.ndarray, probes: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the leaves to look into, best first, for one unit vector."""
    sides = [[w @ x - middle for w, middle in levels] for levels in forest]
    queue = [(-np.inf, t, 0, 0) for t in range(len(forest))]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < probes:
        worst, t, level, node = heapq.heappop(queue)
        if level == len(forest[t]):
            found.append((t, node))
            continue
        side = sides[t][level][node]
        heapq.heappush(queue, (max(worst, side), t, level + 1, 2 * node))
        heapq.heappush(queue, (max(worst, -side), t, level + 1, 2 * node + 1))
    return found


def _vectors(batch, column: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors, by vector length."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = {}
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out[int(n)] = rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]
    return out


def _index(held, probes: int | None):
    """(key, id, tag, x): a row for each tree with the leaf it is in, or for each leaf to look into."""

    def run(batches):
        forest, n_leaves, width = held.value
        for batch in batches:
            for n, (rows, x) in _vectors(batch, 2).items():
                if n != width:
                    continue
                unit = _unit(x)
                if probes is None:
                    place = np.repeat(np.arange(len(rows)), len(forest))
                    keys = (leaves(forest, unit) + np.arange(len(forest)) * n_leaves).ravel()
                else:
                    found = [[t * n_leaves + leaf for t, leaf in search(forest, v, probes)] for v in unit]
                    place = np.repeat(np.arange(len(rows)), [len(f) for f in found])
                    keys = np.array([k for f in found for k in f], np.int64)
                at = pa.array(rows[place])
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at)], ["key", "id", "tag", "x"])

    return run


HELD = 200_000  # rows of a task that wait to be combined


def _best(query, tag, vec, score, k):
    """The best k candidates of each query, each candidate once, ties to the smaller id."""
    if len(query) == 0:  # a vector alone in its leaves
        return query, tag, vec, score
    by = np.lexsort((-score, vec, tag, query))
    query, tag, vec, score = query[by], tag[by], vec[by], score[by]
    first = np.r_[True, (query[1:] != query[:-1]) | (tag[1:] != tag[:-1]) | (vec[1:] != vec[:-1])]
    query, tag, vec, score = query[first], tag[first], vec[first], score[first]
    by = np.lexsort((vec, -score, tag, query))
    query, tag, vec, score = query[by], tag[by], vec[by], score[by]
    starts = np.flatnonzero(np.r_[True, (query[1:] != query[:-1]) | (tag[1:] != tag[:-1])])
    near = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)])) < k
    return query[near], tag[near], vec[near], score[near]


def _rerank(k: int):
    """Exact scores of a leaf's rows for its queries. What a task finds is combined before it leaves: a query's best k of all
    leaves that the task has met."""

    def leaf(row):
        q_ids, q_tags, q = matrix(row, "<f8", "q_")
        ids, _, x = matrix(row, "<f8")
        size = np.sqrt((x * x).sum(axis=1))
        once = len(np.unique(ids)) == len(ids)
        for i in range(len(q)):
            # sums run along a row in one fixed order, so equal vectors have equal scores
            score = (x * q[i]).sum(axis=1) / (size * np.sqrt((q[i] * q[i]).sum()))
            score[ids == q_ids[i]] = -np.inf
            near = np.flatnonzero(score > -np.inf)
            if once and len(near) > 4 * k:
                near = near[score[near] >= np.partition(score[near], len(near) - k)[len(near) - k]]
            yield np.full(len(near), q_ids[i]), np.full(len(near), q_tags[i]), ids[near], score[near]

    def run(batches):
        held, size = [], 0

        def combined():
            best = _best(*(np.concatenate(c) for c in zip(*held)), k)
            return [best], len(best[0])

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["query_id", "tag", "vec_id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                for found in leaf(row):
                    held.append(found)
                    size += len(found[0])
                    if size > HELD:
                        held, size = combined()
                        if size > HELD // 2:  # more queries than fit: these rows go as they are
                            yield out()
                            held, size = [], 0
        if held:
            held, size = combined()
            yield out()

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that the condition ``queries`` picks, the ``k`` other rows of largest cosine that
    the forest finds (all candidates if there are fewer), nearest first, ties to the smaller key.

    A forest is fitted for each vector length on the SAMPLE rows of least key hash that have it, and indexes every row of that length; vectors
    of different lengths have no cosine. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
    rows with a null key. Rows that share a key count once for a query, with their best score, and are no candidates of their key's query; one key with two vectors
    has two lists. Other columns are not looked at.
    """
    spark = prepared(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), usable(F.col(vector)).alias("x"), F.coalesce(queries, F.lit(False)).alias("q")).filter("id IS NOT NULL AND x IS NOT NULL")
    rows = stored(rows.withColumn("tag", F.xxhash64("x")), "vectors")
    sizes = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).orderBy("width").collect()
    found = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    for r in sizes:
        same = rows if len(sizes) == 1 else rows.filter(F.size("x") == r["width"])
        found = found.union(_of_length(same, r["width"], r["n"], k, probe_share))
    return found


def _of_length(rows: DataFrame, width: int, total: int, k: int, probe_share: float) -> DataFrame:
    """``nearest`` among the ``total`` rows (id, tag, x, q) of one length."""
    spark = rows.sparkSession
    unit = _unit(np.array([r.x for r in rows.orderBy(F.xxhash64("id", "tag"), "id").limit(SAMPLE).select("x").collect()]))
    depth = max(0, min(int(np.ceil(np.log2(max(total / LEAF_ROWS, 1)))), int(np.log2(max(len(unit) / MIN_SAMPLE, 1)))))
    n_leaves = 1 << depth
    held = spark.sparkContext.broadcast((fit(unit, depth), n_leaves, width))  # TREES * n_leaves directions, bounded by the sample
    probes = max(LEAST_PROBES, int(np.ceil(probe_share * TREES * n_leaves)))

    schema = "key bigint, id bigint, tag bigint, x array<double>"
    distinct = rows.dropDuplicates(["id", "tag"])
    members = distinct.select("id", "tag", "x").mapInArrow(_index(held, None), schema)
    # a leaf is dealt in parts, so that copies of one vector do not fill one task
    part = F.pmod(F.xxhash64("id", "tag"), F.lit(max(1, total * TREES // (BLOCK * n_leaves * TREES))))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = members.withColumn("part", part).repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    asked = distinct.filter("q").select("id", "tag", "x").mapInArrow(_index(held, probes), schema)
    a = asked.withColumn("part", F.pmod(F.xxhash64("id", "tag"), F.lit(8))).repartition(tasks, "key", "part").sortWithinPartitions("key", "part")
    q_blocks = packed(a, 256, "<f8").select("key", F.col("ids").alias("q_ids"), F.col("tags").alias("q_tags"), F.col("numbers").alias("q_numbers"))
    pairs = packed(m, BLOCK, "<f8").join(q_blocks, "key")
    near = pairs.mapInArrow(_rerank(k), "query_id bigint, tag bigint, vec_id bigint, score double")
    once = near.groupBy("query_id", "tag", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
