"""Connected components of edge tables, and names joined to rows when a few names hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored

HOT_NAMES = 1000


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(x, y)``: the label is the smallest node reachable. Least labels are passed
    along edges and then followed once, until nothing changes; each round is a stored table, which the round after the
    next deletes. Repeated edges and loops change nothing; without edges the result is empty."""
    scratch = Scratch(edges.sparkSession)
    both = scratch.put(edges.select("x", "y").union(edges.select("y", "x")).distinct(), "edges")
    labels = scratch.put(both.groupBy(F.col("x").alias("node")).agg(F.least(F.col("x"), F.min("y")).alias("label")), "labels")
    while True:
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        near = (both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("other")), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("other").alias("other")))
        far = labels.join(jump, "label").join(near, "node")
        new = scratch.put(far.select("node", F.least("next", "other").alias("new"), "label"), "labels")
        moved = new.filter(F.col("new") != F.col("label")).limit(1).count()
        if not moved:
            out = stored(new.select("node", F.col("new").alias("label")), "labels")
            scratch.clear()
            return out
        scratch.drop(labels)
        labels = scratch.put(new.select("node", F.col("new").alias("label")), "labels")
        scratch.drop(new)


def named(rows: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``names``, which has each ``key`` once, with ``n``, its number of rows. A key of at least a thousandth of
    all rows would be one task of a join; there are at most 1,000 such keys, so these names are broadcast, and the rest is joined by
    key. Null keys match each other; rows without a name stay out."""
    total = names.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * HOT_NAMES >= max(total, HOT_NAMES * HOT_NAMES)
    extra = [c for c in names.columns if c not in (key, "n")]
    pick = lambda part: part.select(F.col(key).alias("_key"), *extra)
    hot = F.broadcast(pick(names.filter(often)))
    same = lambda right: rows[key].eqNullSafe(right["_key"])
    few = rows.join(hot, same(hot)).drop("_key")
    rest = rows.join(hot, same(hot), "left_anti")
    cold = pick(names.filter(~often))
    return few.unionByName(rest.join(cold, rest[key].eqNullSafe(cold["_key"])).drop("_key"))
