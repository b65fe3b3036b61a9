"""Connected groups under Jaccard similarity of word 5-gram sets: a blocked sparse matrix product.

Documents are rows, n-grams are columns. The columns are dealt into hash blocks; a block multiplies its
slice of the incidence matrix with itself, that is, it brings together the documents of each column. Only
columns a pair of sets of these sizes must share are kept: with similarity t or more, two sets share one of the
first n - ceil(t n) + 1 columns under any common order, so each document enters only these, rarest first.

Groups, not all pairs, are wanted. Sets that are equal are one class. Two first passes compare each class with one other
for each of its least n-grams; classes joined by links collapse into one group, and columns with a single group left are
done. What remains is multiplied out: the overlaps of each class with each other group are counted over their leading columns, then, where
these are enough, with each class of the group; pairs with fewer than sets of these sizes must share there are discarded, and the full sets
are compared for the others, the likeliest links first, until no pair of different groups is left, so that no link between different texts
is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bitmap, partitions, prepared, stored
from .graph import components, named
from .words import hashed_words, mix, shingles

HINTS = 1 << 18  # most frequent n-grams that order the columns; the order decides speed only, never a result
FILTER_BITS = 1 << 24  # bitmap of classes to fetch; when it fills up, more sets are moved, none is lost
_BLOCK = 700_000  # n-grams that a task holds at once
_COPIES = 100_000  # classes that a task remembers
LEAST = 6  # least n-grams by which classes are first brought together


def _class_key(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _sets(batch, width):
    for _, words, _, _ in hashed_words(batch.column(batch.num_columns - 1), lower=True):
        yield shingles(words, width)


_SCAN = "doc_id bigint, tag bigint, n bigint, cls binary, least array<bigint>, gram bigint, seen bigint"


def _scan(width):
    """Per document its set size and class; besides, its least n-grams; besides, n-grams that recur within _BLOCK n-grams."""

    def run(batches):
        held, size, met = [], 0, set()

        def recurring():
            grams, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= 2
            k = int(often.sum())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())),
                 pa.array(grams[often].view(np.int64)), pa.array(seen[often])], ["doc_id", "tag", "n", "cls", "least", "gram", "seen"])

        for batch in batches:
            ns, keys, least = [], [], []
            for grams in _sets(batch, width):
                ns.append(len(grams))
                key = _class_key(grams)
                keys.append(key)
                least.append(grams[:LEAST].view(np.int64).tolist())
                if key not in met:  # copies say nothing of what different texts share
                    held.append(grams)
                    size += len(grams)
                    met.add(key)
                if size > _BLOCK:
                    yield recurring()
                    held, size, met = [], 0, set()
            k = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(least, pa.list_(pa.int64())),
                 pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], ["doc_id", "tag", "n", "cls", "least", "gram", "seen"])
        if held:
            yield recurring()

    return run


def _prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _alone(n: int, num: int, den: int) -> bool:
    """Whether a set of this size links with equal ones only: with one n-gram more or less on either side the bound fails."""
    return den * n < num * (n + 1) and den * (n - 1) < num * n


def _rarity(grams, order):
    hints, seen = order
    if len(hints) == 0:
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(hints, grams), len(hints) - 1)
    return np.where(hints[at] == grams, seen[at], 0)


def _deal(order, width, num, den, blocks):
    """The leading columns of each document, packed by column block. A column that is known to recur needs no
    partner search, so its entries are spread by document instead of meeting in one task."""

    def run(batches):
        hints, seen = order.value, set()
        for batch in batches:
            out = {"block": [], "cls": [], "n": [], "k": [], "grams": []}
            parts = []
            if len(seen) > _COPIES:  # a class that is dealt again is met once all the same
                seen.clear()
            for grams in _sets(batch, width):
                key = _class_key(grams)
                if key is None or key in seen or _alone(len(grams), num, den):
                    continue
                seen.add(key)
                often = _rarity(grams, hints)
                first = np.lexsort((grams, often))[:_prefix_length(len(grams), num, den)]
                lead, known = grams[first], often[first] > 0
                block = (mix(lead) % np.uint64(blocks)).astype(np.int64)
                block[known] = int.from_bytes(key[:4], "little") % blocks
                parts.append((key, len(grams), lead, block))
            if not parts:
                continue
            doc = np.repeat(np.arange(len(parts)), [len(p[2]) for p in parts])
            lead, block = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            by = np.lexsort((doc, block))
            doc, lead, block = doc[by], lead[by], block[by]
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, k = np.unique(doc[a:b], return_counts=True)
                out["block"].append(int(block[a]))
                out["cls"].append(b"".join(parts[i][0] for i in own))
                out["n"].append(np.array([parts[i][1] for i in own], np.uint32).tobytes())
                out["k"].append(k.astype(np.uint32).tobytes())
                out["grams"].append(lead[a:b].tobytes())
            yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("cls", "n", "k", "grams")]))

    return run


def _meet(order):
    """Entries of one column block whose column holds two classes or more."""

    def entries(keys, ns, grams, pick):
        return pa.RecordBatch.from_arrays(
            [pa.array(grams[pick].view(np.int64)), pa.array([k.tobytes() for k in keys[pick]], pa.binary()), pa.array(ns[pick].astype(np.int64))],
            ["gram", "cls", "n"])

    def run(batches):
        hints, dealt = order.value, set()
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                k = np.frombuffer(row["k"], np.uint32)
                own = np.frombuffer(row["cls"], np.uint64).reshape(-1, 2)
                keys = np.repeat(own, k, axis=0)
                ns, grams = np.repeat(np.frombuffer(row["n"], np.uint32), k), np.frombuffer(row["grams"], np.uint64)
                known = _rarity(grams, hints) > 0
                if known.any():
                    # all known columns of a class are in this block: of its copies in other batches, one brings them
                    at = np.repeat(np.arange(len(own)), k)
                    new = np.zeros(len(own), bool)
                    for i in np.unique(at[known]):
                        key = own[i].tobytes()
                        new[i] = key not in dealt
                        dealt.add(key)
                    if (once := known & new[at]).any():
                        yield entries(keys, ns, grams, once)
                held.append((keys[~known], ns[~known], grams[~known]))
        if not held:
            return
        keys, ns, grams = (np.concatenate(x) for x in zip(*held))
        del held
        by = np.lexsort((keys[:, 1], keys[:, 0], grams))
        keys, ns, grams = keys[by], ns[by], grams[by]
        if len(grams) < 2:
            return
        same_gram = grams[1:] == grams[:-1]
        same = np.r_[False, same_gram & (keys[1:] == keys[:-1]).all(axis=1)]
        keys, ns, grams = keys[~same], ns[~same], grams[~same]
        again = grams[1:] == grams[:-1]
        shared = np.r_[again, False] | np.r_[False, again]
        for a in range(0, len(grams), 100_000):
            part = np.zeros(len(grams), bool)
            part[a:a + 100_000] = shared[a:a + 100_000]
            if part.any():
                yield entries(keys, ns, grams, part)

    return run


def _bit(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True) % FILTER_BITS


def _place(key: str):
    """The column's bit as ``_bit`` has it."""
    return F.pmod(F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("bigint"), F.lit(FILTER_BITS))


def _picked(wanted):
    """The stored sets that the bitmap lets through."""

    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            at = np.frombuffer(b"".join(k[:8] for k in batch.column(0).to_pylist()), ">i8").astype(np.int64) % FILTER_BITS
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _fetch(wanted, width):
    """The sets of the classes that the bitmap lets through, about once for each task."""

    def run(batches):
        bits, seen = wanted.value, set()
        for batch in batches:
            found = {}
            if len(seen) > _COPIES:
                seen.clear()
            for grams in _sets(batch, width):
                key = _class_key(grams)
                if key is not None and key not in seen and bits[(b := _bit(key)) >> 3] >> (b & 7) & 1:
                    found[key] = grams.tobytes()
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["cls", "grams"])

    return run


def _linked(num, den):
    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("gx"), batch.column("gy"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if den * shared >= num * (len(x) + len(y) - shared):
                    keep.append(i)
            yield batch.select(["x", "y"]).take(pa.array(keep, pa.int64()))

    return run


def _labelled(docs: DataFrame, text: str, key: str, width: int, num: int, den: int) -> DataFrame:
    """(doc_id, tag, n, cls, label, component_id) of every row; ``tag`` is a hash of the text, ``label`` names the group and is
    null, like ``component_id``, for an empty set."""
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    scratch = Scratch(spark)
    scan = stored(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("tag"), F.col(text).cast("string").alias("text"))
                  .mapInArrow(_scan(width), _SCAN), "scan")
    rows = scan.filter("n IS NOT NULL").select("doc_id", "tag", "n", "cls")
    often = (scan.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("seen").alias("seen"))
             .orderBy(F.desc("seen"), "gram").limit(HINTS).toArrow())
    hints = often["gram"].to_numpy().astype(np.int64).view(np.uint64)
    by = np.argsort(hints)
    order = spark.sparkContext.broadcast((hints[by], often["seen"].to_numpy().astype(np.int64)[by]))  # HINTS pairs at most

    total = rows.agg(F.sum(F.expr(f"n - ({num} * n) div {den} + 1"))).first()[0] or 0
    blocks = partitions(spark, total, _BLOCK)
    dealt = texts.mapInArrow(_deal(order, width, num, den, blocks), "block bigint, cls binary, n binary, k binary, grams binary")
    met = scratch.put(dealt.repartition(blocks, "block").mapInArrow(_meet(order), "gram bigint, cls binary, n bigint"), "entries")
    entries = scratch.put(_able(met, num, den), "able")
    scratch.drop(met)

    involved = scratch.put(entries.groupBy("cls").agg(F.count("*").alias("d")), "involved")
    wanted = spark.sparkContext.broadcast(bitmap(involved.select(_place("cls")), FILTER_BITS))
    sets = scratch.put(texts.mapInArrow(_fetch(wanted, width), "cls binary, grams binary").groupBy("cls").agg(F.min("grams").alias("grams")), "sets")

    tried = None

    def links(pairs):
        """Of pairs (x, y) of classes, those that link; pairs that have been tried are left out. Only the sets of classes on a side are moved
        to that side."""
        nonlocal tried
        pairs = pairs.select("x", "y").distinct()
        pairs = scratch.put(pairs if tried is None else pairs.join(tried, ["x", "y"], "left_anti"), "tried")
        tried = pairs if tried is None else tried.union(pairs)

        def side(c):
            bits = spark.sparkContext.broadcast(bitmap(pairs.select(_place(c)), FILTER_BITS))
            return sets.mapInArrow(_picked(bits), "cls binary, grams binary").select(F.col("cls").alias(c), F.col("grams").alias(f"g{c}"))

        met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "gx", "gy")
        return scratch.put(met.mapInArrow(_linked(num, den), "x binary, y binary"), "links")

    fits = f"{den} * least(nx, ny) >= {num} * greatest(nx, ny)"
    least = scan.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("n").alias("n"), F.min("least").alias("least"))
    least = scratch.put(least.join(involved, "cls").select("cls", "n", "least", (F.col("d") / F.col("n")).alias("share")), "least")
    found = links(_stars(least, None).filter(fits))
    label = components(found)
    found = scratch.put(found.union(links(_stars(least, label).filter(fits))), "links")
    label = components(found)
    pairs = scratch.put(_products(entries, label, fits, num, den), "pairs")
    for few in (1, 4, None):  # likeliest links first: what they join need not be compared any more
        found = scratch.put(found.union(links(_apart(pairs, label, few))), "links")
        label = components(found)
    scratch.clear()
    classes = rows.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    classes = classes.join(label.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    classes = stored(classes, "classes")
    smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    names = stored(classes.withColumnRenamed("n", "copies").join(smallest, "label").select("cls", F.col("copies").alias("n"), "label", "component_id"), "names")
    texts_of = named(rows.filter("cls IS NOT NULL"), names, "cls")
    blank = rows.filter("cls IS NULL").withColumn("label", F.lit(None).cast("binary")).withColumn("component_id", F.lit(None).cast("bigint"))
    return texts_of.unionByName(blank).select("doc_id", "tag", "n", "cls", "label", "component_id")


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles`` and ``component_id``, the smallest ``key`` reachable by links.

    Two rows link when den * |A & B| >= num * |A | B| for their sets of distinct ``width``-word runs over words in
    which A-Z are lower-cased. A text with fewer words has the whole sequence as its only run; a null or blank text
    has an empty set, links with nothing and is its own component. Repeated rows are rows of one class. A null key
    is never the smallest; a component of null keys only has a null id. Other columns are not looked at.
    """
    found = _labelled(docs, text, key, width, num, den)
    return found.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"),
                        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest ``key`` stays (null keys last, then by a hash
    of the text), and of equal rows one. Rows with an empty set are no copies of anything and all stay."""
    found = stored(_labelled(docs, text, key, width, num, den), "groups")
    first = found.filter("label IS NOT NULL").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("m"))
    lead = first.select(F.col("m.doc_id").alias("_d"), F.col("m.tag").alias("_t"))
    blank = found.filter("label IS NULL").select(F.col("doc_id").alias("_d"), F.col("tag").alias("_t")).distinct()
    rows = docs.withColumn("_key", F.col(key).cast("bigint")).withColumn("_tag", F.xxhash64(F.col(text).cast("string")))
    same = rows["_key"].eqNullSafe(F.col("_d")) & (rows["_tag"] == F.col("_t"))
    once = rows.join(lead, same, "left_semi").dropDuplicates(["_key", "_tag"])
    return once.unionByName(rows.join(blank, same, "left_semi")).select(docs.columns)


def _able(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries of classes that may link with something. A class can share no more leading columns than it has entries. One with enough for
    a partner of its own size stays; one with fewer stays if a column holds a class of a size for which the entries of both are enough."""
    d = entries.groupBy("cls", "n").agg(F.count("*").alias("d"))
    d = stored(d.withColumn("high", F.expr(f"d >= {_need('n', 'n', num, den)}")), "counts")
    low = entries.join(d.filter("NOT high").select("cls", "d"), "cls").select(F.col("gram").alias("gx"), F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("d").alias("dx"))
    every = entries.join(d.select("cls", "d"), "cls")
    met = F.expr(f"gx = gram AND x <> cls AND {den} * least(n, nx) >= {num} * greatest(n, nx) AND least(d, dx) >= {_need('n', 'nx', num, den)}")
    able = d.filter("high").select("cls").union(low.join(every, met).select(F.col("x").alias("cls")).distinct())
    return entries.join(able, "cls", "left_semi")


def _stars(least: DataFrame, label: DataFrame | None) -> DataFrame:
    """(x, nx, y, ny): each class with the centre of each of its least n-grams. The centre is the class with most leading columns that
    others share, for its size: of near copies the one with the fewest changes, which links with those that do not link with each other.
    With labels, a hash picks it, and only classes of other groups than the centre's are met. Pairs with few least n-grams in common are left
    to the products."""
    rows = least if label is None else least.join(label.withColumnRenamed("node", "cls"), "cls", "left")
    rows = rows.withColumn("grp", F.col("cls") if label is None else F.coalesce("label", "cls")).withColumn("gram", F.explode("least"))
    rank = F.struct(-F.col("share"), F.xxhash64("cls")) if label is None else F.xxhash64("cls")
    centre = (rows.groupBy("gram").agg(F.min_by(F.struct("cls", "n", "grp", F.col("least").alias("own")), rank).alias("y"), F.min("grp").alias("a"), F.max("grp").alias("b"))
              .filter("a <> b").drop("a", "b"))
    met = rows.join(centre, "gram").filter(f"grp <> y.grp AND size(array_intersect(least, y.own)) >= least(n, y.n, {LEAST // 2})")
    first = F.col("cls") < F.col("y.cls")
    side = lambda own, other: F.when(first, own).otherwise(other)
    return met.select(side(F.col("cls"), F.col("y.cls")).alias("x"), side(F.col("n"), F.col("y.n")).alias("nx"),
                      side(F.col("y.cls"), F.col("cls")).alias("y"), side(F.col("y.n"), F.col("n")).alias("ny"))


def _need(a: str, b: str, num: int, den: int) -> str:
    """Leading columns that linked sets of sizes ``a`` and ``b`` share at least. The one whose leading columns end earlier has all those it
    shares among the other's: ceil(num (a + b) / (num + den)) - ceil(num max(a, b) / den) + 1 of them."""
    return f"(ceil({num} * ({a} + {b}) / {num + den}) - ceil({num} * greatest({a}, {b}) / {den}) + 1)"


def _products(entries: DataFrame, label: DataFrame, fits: str, num: int, den: int) -> DataFrame:
    """Pairs (x, y) of classes in different groups that share as many leading columns as sets that link must: each column is
    multiplied with itself, and the products are counted by pair. Before that each class of the smaller group is counted with the larger group as
    a whole, one row a column whatever the group's size: a class that shares too few columns with all of the group's classes together
    links with none of them. Of the other groups, columns of more than half of a group's classes count for all of its classes at first; only
    the columns of fewer are multiplied out, and only of pairs that have enough so, it is looked up which of the former they lack."""
    held = entries.select("cls", "n").distinct().join(label.withColumnRenamed("node", "cls"), "cls", "left")
    held = stored(held.select("cls", "n", F.coalesce("label", "cls").alias("grp")), "held")
    sizes = held.join(held.groupBy("grp").agg(F.count("*").alias("weight")), "grp").select("cls", "grp", "weight")
    lists = entries.join(sizes, "cls").select("gram", "cls", "n", "grp", "weight")
    several = lists.groupBy("gram").agg(F.min("grp").alias("a"), F.max("grp").alias("b")).filter("a <> b").select("gram")
    lists = stored(lists.join(several, "gram", "left_semi"), "lists")
    mine = lists.select("gram", F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("grp").alias("gx"), F.col("weight").alias("wx"))
    whole = lists.groupBy("gram", "grp", "weight").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("c"))
    whole = whole.withColumn("most", F.expr("2 * c > weight"))
    beside = f"gx <> grp AND struct(wx, gx) < struct(weight, grp) AND {den} * high >= {num} * nx AND {num} * low <= {den} * nx"
    some = lambda which: F.collect_list(F.when(F.expr(which), F.col("gram")))
    near = mine.join(whole, "gram").filter(beside).groupBy("x", "nx", "grp").agg(
        F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"), F.count_if("most").alias("base"),
        some("NOT most").alias("few"), some("most AND c < weight").alias("lacking"))
    near = near.withColumn("low", F.expr(f"greatest(low, ceil({num} * nx / {den}))")).withColumn("high", F.expr(f"least(high, floor({den} * nx / {num}))"))
    # of all sizes between, the outermost need fewest columns, up to one by which the second term is rounded
    near = near.filter(f"low <= high AND shared >= least({_need('nx', 'low', num, den)}, {_need('nx', 'high', num, den)}) - 1")
    near = stored(near.select("x", "nx", "grp", "base", "few", "lacking"), "near")
    need = _need("nx", "ny", num, den)
    theirs = lists.select("gram", F.col("cls").alias("y"), F.col("n").alias("ny"), "grp")
    few = near.select("x", "nx", "base", "grp", F.explode("few").alias("gram")).join(theirs, ["gram", "grp"]).filter(fits)
    few = few.groupBy("x", "nx", "y", "ny", "grp", "base").agg(F.count("*").alias("more")).filter(f"base + more >= {need}")
    kinds = held.select("grp", F.col("n").alias("ny")).distinct()
    base = near.select("x", "nx", "base", "grp").join(kinds, "grp").filter(f"{fits} AND base >= {need}")
    base = base.join(held.select("grp", F.col("n").alias("ny"), F.col("cls").alias("y")), ["grp", "ny"]).withColumn("more", F.lit(0).cast("bigint"))
    able = few.unionByName(base).groupBy("x", "nx", "y", "ny", "grp", "base").agg(F.sum("more").alias("more"))
    able = stored(able, "able")
    asked = able.select("x", "y", "grp").join(near.select("x", "grp", F.explode("lacking").alias("gram")), ["x", "grp"]).select("x", "y", "gram")
    lack = asked.join(theirs.select("gram", "y"), ["gram", "y"], "left_anti").groupBy("x", "y").agg(F.count("*").alias("less"))
    counted = able.join(lack, ["x", "y"], "left").withColumn("shared", F.expr("base + more - coalesce(less, 0)")).filter(f"shared >= {need}")
    return counted.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), (F.col("shared") / F.greatest("nx", "ny")).alias("share"))


def _apart(pairs: DataFrame, label: DataFrame, few: int | None) -> DataFrame:
    """Pairs (x, y) of different groups; with ``few``, for each class only so many of those with which it shares most columns."""
    known = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    left = (pairs.join(known("x"), "x", "left").join(known("y"), "y", "left")
            .select("x", "y", "share", F.coalesce("lx", "x").alias("gx"), F.coalesce("ly", "y").alias("gy")).filter("gx <> gy"))
    if few is not None:
        of = lambda c: Window.partitionBy(c).orderBy(F.desc("share"), "x", "y")
        left = left.withColumn("a", F.row_number().over(of("x"))).withColumn("b", F.row_number().over(of("y"))).filter((F.col("a") <= few) | (F.col("b") <= few))
    return left.select("x", "y")
