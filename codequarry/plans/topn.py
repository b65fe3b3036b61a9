"""Capped selections that hold up when one repo owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, spread: list[str],
          rank: str = "pos") -> DataFrame:
    """First ``n`` rows of every key. Each key is first cut inside ``SALTS`` hash slices of the
    ``spread`` columns (with Spark's per-task group limit before the shuffle), so the final
    window sees at most ``SALTS * n`` rows of any key."""
    slice_of = F.pmod(F.xxhash64(*spread), F.lit(SALTS))
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    cut = (df.withColumn("_slice", slice_of)
           .withColumn("_rank", F.row_number().over(inner)).filter(F.col("_rank") <= n)
           .drop("_slice", "_rank"))
    return cut.withColumn(rank, F.row_number().over(outer)).filter(F.col(rank) <= n)


def until_nth(df: DataFrame, key: str, order: Column, weight: Column, n: int, spread: list[str]) -> DataFrame:
    """Per key, the order value at which the running sum of a positive ``weight`` reaches ``n``.
    Keys that never reach it have no row. At most ``n`` rows per key can matter."""
    first = top_n(df.filter(weight > 0).select(key, order.alias("_at"), weight.alias("_w"), *spread),
                  [key], [F.col("_at")], n, spread, rank="_r")
    running = F.sum("_w").over(Window.partitionBy(key).orderBy("_r"))
    return (first.withColumn("_sum", running).filter(F.col("_sum") >= n)
            .groupBy(key).agg(F.min("_at").alias("stop_at")))
