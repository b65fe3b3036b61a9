"""Mix sources to target weights with hash-threshold histograms.

Each document has a hash. A source's budget is met by all documents below a threshold of that hash: sizes are summed by
source and hash bucket, a running sum over the buckets finds the one the budget ends in, and only that bucket is divided
again, level by level, until single hash values are left. Documents are then kept by comparing their hash with their
source's threshold; nothing is sorted, and a rerun takes the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepared, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # the mix holds 3/2 of all words
MOST = 2  # a source, and so a document, counts this often at most
BITS, LEVEL_BITS = 60, 12


def size_of(text: Column) -> Column:
    """Words of a text: positions where one begins. Null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """(name, source_size, target): ``sizes`` holds (source, size). One row per source; null is the last source.

    Weights repeat along the sources in code-point order. Targets share SHARE of all words by weight; a target above MOST times its
    source's size stops there, and the excess goes to the others by weight until none is above. Sources are raised in the
    order of size per weight, so one running sum finds where that ends.
    """
    num, den = SHARE
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))
    weighted = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), place.cast("int") + 1).cast("bigint"))
    # with level = (share - capped sizes) / open weights, a source is capped when MOST * size < level * weight
    rise = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = (weighted.withColumn("total", F.sum("source_size").over(every))
         .withColumn("stopped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
         .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         # all in whole numbers: den * MOST * size * open < (num * total - den * MOST * stopped) * weight
         .withColumn("rest", F.col("total") * num - F.col("stopped") * (den * MOST))
         .withColumn("capped", F.col("source_size") * (den * MOST) * F.col("open") < F.col("rest") * F.col("weight")))
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"), "rest", "open"))).over(every)
    level = w.withColumn("first", first)
    target = F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double")).otherwise(
        (F.col("weight") * F.col("first.rest")).cast("double") / (F.col("first.open") * den).cast("double"))
    return level.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _hash(key: Column) -> Column:
    """60 bits of a digest of the key; a null key hashes like an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("bigint")


def _thresholds(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, repeats, threshold) from stored rows (source, size, h)."""
    goals = stored(targets(rows), "targets").withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    # budget: what is left for one more time; start: hashes below it are in
    state = goals.select("source", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"), F.lit(0).cast("bigint").alias("start"))
    for shift in range(BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        above = shift + LEVEL_BITS
        part = rows.select("source", "h", "size")
        if above < BITS:  # only documents of the bucket where the budget ends
            part = _same_source(part, state).filter(F.shiftright("h", above) == F.shiftright("start", above))
        bucket = F.shiftright("h", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))
        histogram = part.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
        run = Window.partitionBy("source").orderBy("bucket")
        sums = _same_source(histogram.withColumn("upto", F.sum("words").over(run)), state)
        fits = F.col("upto") <= F.col("budget")
        # buckets that fit are in; the next one, if any, is divided further
        found = (sums.groupBy("source", "budget", "start")
                 .agg(F.max(F.when(fits, F.col("upto"))).alias("used"), F.min(F.when(~fits, F.col("bucket"))).alias("bucket")))
        found = found.select("source", (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"),
                             (F.col("start") + F.shiftleft(F.coalesce("bucket", F.lit(1 << LEVEL_BITS)).cast("bigint"), shift)).alias("start"))
        # a source that had no document left to divide keeps its state
        names = found.select(F.col("source").alias("_f"))
        state = stored(found.unionByName(state.join(names, F.col("source").eqNullSafe(F.col("_f")), "left_anti")), "thresholds")
    return _same_source(goals, state.select("source", F.col("start").alias("threshold")))


def _prepared_rows(docs: DataFrame, text: str, source: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), size_of(F.col(text).cast("string")).alias("size"), _hash(F.col(key)).alias("h"))


def _times() -> Column:
    return (F.col("repeats") + F.when((F.col("h") < F.col("threshold")) & (F.col("repeats") < MOST), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per input row: ``key``, size, source_size, target, taken.

    ``taken`` is size times the whole repeats that the target holds (at most MOST), and once more for the documents
    below the source's threshold: as many as fit in the rest of the target in hash order, so a source misses its target
    by less than the documents of one hash value. Null or blank texts have size 0 and take 0. A null source is a source of its
    own, the last; rows that share a key share a hash and go in or stay out together, null keys as well. Other columns
    are not looked at. An empty table gives no rows.
    """
    prepared(docs.sparkSession)
    rows = stored(_prepared_rows(docs, text, source, key), "sizes")
    out = _same_source(rows, _thresholds(rows))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * _times()).cast("bigint").alias("taken"))


def resample(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts without words weigh nothing and stay once."""
    prepared(docs.sparkSession)
    goals = _thresholds(stored(_prepared_rows(docs, text, source, key), "sizes"))
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(source).cast("string").alias("source"), size_of(F.col(text).cast("string")).alias("size"), _hash(F.col(key)).alias("h"))
    times = F.when(F.col("size") > 0, _times()).otherwise(1)
    copies = _same_source(held, goals).select("row", F.explode(F.array_repeat(F.lit(1), times)))
    return copies.select("row.*")


def _same_source(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("source", "_s")
    return left.join(right, left["source"].eqNullSafe(right["_s"])).drop("_s")

