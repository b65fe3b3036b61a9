"""Duplicate passages by relative Lempel-Ziv parsing over word sequences.

Each document is cut, at places that depend on its words alone, into phrases of consecutive windows (``width`` words each): windows
whose smallest hash of ``seed`` words is the same one. Equal passages are thus cut alike wherever they stand. The
distinct phrases with the first document of each are the reference, dealt into blocks by phrase digest, and every document is
factored against all of them: a phrase that an earlier document has is one factor, copied whole. Where a factor ends, passages can
go on inside a phrase that as a whole is new; these phrases are checked window by window against the windows of all others.
Windows found either way are joined to spans, and their words go.

A window is compared by 64 bits of hash of its words and by its anchor, 64 bits of another hash of some of them; phrases by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, prepared, stored
from .words import hashed_words, mix, runs

SEED = 16  # words of the anchors that place the cuts
LONGEST = 64  # windows of a phrase
_COPIES = 200_000  # phrases that a task remembers
FILTER_BITS = 1 << 26  # bitmap of anchors that recur; when it fills up, more phrases are looked up, none is lost


def _anchors(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """For each window, the least hash of ``seed`` words in it."""
    least = mix(runs(words, seed))
    span, done = width - seed + 1, 1
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if span > done:
        least = np.minimum(least[:done - span], least[span - done:])
    return least


def _recurring(width, seed):
    """(doc_id, anchors of the document)."""

    def run(batches):
        for batch in batches:
            ids, found = batch.column(0), [np.zeros(0, np.int64)] * batch.num_rows
            for row, words, _, _ in hashed_words(batch.column(1)):
                if len(words) >= width:
                    found[row] = np.unique(_anchors(words, width, seed)).view(np.int64)
            values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, values], ["doc_id", "anchors"])

    return run


def _bit(anchor: np.ndarray) -> np.ndarray:
    return (anchor % np.uint64(FILTER_BITS)).astype(np.int64)


def _cut(words, known, width, seed):
    """(place, anchor, digest, windows) of the phrases whose anchors the bitmap lets through."""
    anchor = _anchors(words, width, seed)
    bit = _bit(anchor)
    found = known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
    if not found.any():
        return
    windows = runs(words, width)
    cuts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if found[a]:
            for c in range(a, b, LONGEST):
                data = windows[c:min(b, c + LONGEST)].tobytes()
                yield c, int(anchor[a].view(np.int64)), hashlib.blake2b(data + anchor[a].tobytes(), digest_size=16).digest(), data


def _phrases(bits, width, seed):
    """(doc_id, tag, at, size, anchor, digest) of phrases whose anchor may recur."""

    def run(batches):
        known = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            ids, tags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[row], tags[row], at, len(data) // 8, anchor, digest) for row, words, _, _ in hashed_words(batch.column(2))
                    if len(words) >= width and ids[row] is not None for at, anchor, digest, data in _cut(words, known, width, seed)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "tag", "at", "size", "anchor", "digest"])

    return run


def _windows(bits, width, seed):
    """(digest, windows) of phrases whose anchor may stand in several phrases, about once for each task."""

    def run(batches):
        known, seen = np.frombuffer(bits.value, np.uint8), set()
        for batch in batches:
            found = {}
            if len(seen) > _COPIES:
                seen.clear()
            for row, words, _, _ in hashed_words(batch.column(1)):
                if len(words) >= width and batch.column(0)[row].is_valid:
                    for _, _, digest, data in _cut(words, known, width, seed):
                        if digest not in seen:
                            seen.add(digest)
                            found[digest] = data
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "windows"])

    return run


def duplicate_windows(docs: DataFrame, width: int = 50, seed: int = SEED) -> DataFrame:
    """(doc_id, tag, at, size): runs of ``size`` windows from word ``at``, each of which also starts in a document with a smaller
    doc_id. ``docs`` has doc_id, tag (which tells rows of one doc_id apart) and text."""
    spark = prepared(docs.sparkSession)
    seed = min(seed, width)
    place = F.col("a").bitwiseAND(F.lit(FILTER_BITS - 1))
    anchors = docs.select("doc_id", "text").mapInArrow(_recurring(width, seed), "doc_id bigint, anchors array<bigint>")
    again = (anchors.select("doc_id", F.explode("anchors").alias("a")).groupBy("a")
             .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"))
    held = spark.sparkContext.broadcast(bitmap(again.select(place), FILTER_BITS))  # FILTER_BITS / 8 bytes, whatever the data

    phrases = stored(docs.select("doc_id", "tag", "text").mapInArrow(_phrases(held, width, seed), "doc_id bigint, tag bigint, at int, size int, anchor bigint, digest binary"), "phrases")
    reference = stored(phrases.groupBy("digest", "anchor", "size").agg(F.min("doc_id").alias("first")), "reference")

    # phrases that are new as a whole: which of their windows stand in another phrase of an earlier document? Equal windows have equal anchors,
    # so only phrases whose anchor another phrase has too are opened
    mixed = stored(reference.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "mixed")
    several = spark.sparkContext.broadcast(bitmap(mixed.withColumnRenamed("anchor", "a").select(place), FILTER_BITS))
    opened = docs.select("doc_id", "text").mapInArrow(_windows(several, width, seed), "digest binary, windows binary").groupBy("digest").agg(F.min("windows").alias("windows"))

    @F.arrow_udf("array<bigint>")
    def numbers(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [np.frombuffer(v, np.int64) for v in column.to_pylist()]
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))

    single = stored(reference.join(mixed, "anchor", "left_semi").select("digest", "first", "anchor").join(opened, "digest"), "opened")
    single = single.select("digest", "first", "anchor", F.posexplode(numbers("windows")).alias("i", "w"))
    earliest = single.groupBy("w", "anchor").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").select("w", "anchor", "least")
    inside = (single.join(earliest, ["w", "anchor"]).filter("least < first").groupBy("digest").agg(F.array_sort(F.collect_set("i")).alias("inside")))
    index = reference.select("digest", "first").join(inside, "digest", "left")

    factors = phrases.select("doc_id", "tag", F.col("at").cast("bigint").alias("at"), "size", "digest").join(index, "digest")
    whole = F.when(F.col("doc_id") > F.col("first"), F.array(F.struct(F.col("at").alias("at"), F.col("size").cast("bigint").alias("size"))))
    part = F.transform(F.coalesce("inside", F.array().cast("array<int>")), lambda i: F.struct((F.col("at") + i).alias("at"), F.lit(1).cast("bigint").alias("size")))
    return factors.select("doc_id", "tag", F.explode(F.coalesce(whole, part)).alias("f")).select("doc_id", "tag", "f.at", "f.size")


def remove(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 50, out: str = "kept") -> DataFrame:
    """All columns, ``out`` (the kept words, joined by one space), n_words and n_removed.

    A word goes if a window of ``width`` consecutive words over it also starts in a row with a smaller key; windows are judged on the
    input. Words are runs of characters other than space and 0x09-0x0D, case kept. Null, blank and shorter texts lose nothing.
    Rows with one key are no reference for each other; a row with a null key is none for any other and loses nothing. The three columns
    replace columns of these names.
    """
    tag = F.xxhash64(F.col(text).cast("string"))
    windows = duplicate_windows(docs.select(F.col(key).cast("bigint").alias("doc_id"), tag.alias("tag"), F.col(text).cast("string").alias("text")), width)
    spans = windows.groupBy("doc_id", "tag").agg(F.collect_set(F.struct("at", "size")).alias("_spans"))
    rows = docs.withColumn("_tag", tag)
    spans = spans.withColumnRenamed("doc_id", "_key").withColumnRenamed("tag", "_tag2")
    joined = rows.join(spans, (F.col(key).cast("bigint") == F.col("_key")) & (F.col("_tag") == F.col("_tag2")), "left").drop("_key", "_tag", "_tag2")
    done = _kept(width)(F.col(text).cast("string"), F.col("_spans.at"), F.col("_spans.size"))
    return (joined.withColumn("_done", done).withColumn(out, F.col("_done.kept")).withColumn("n_words", F.col("_done.n_words"))
            .withColumn("n_removed", F.col("_done.n_removed")).drop("_done", "_spans"))


def _kept(width: int):
    @F.arrow_udf("struct<kept: string, n_words: bigint, n_removed: bigint>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ats, sizes in batches:
            kept, n_words, n_removed = [""] * len(texts), [0] * len(texts), [0] * len(texts)
            values = texts.to_pylist()
            for row, _, starts, ends in hashed_words(texts):
                n = len(starts)
                gone = np.zeros(n + 1, np.int64)
                if ats[row].is_valid:
                    first = np.array(ats[row].as_py(), np.int64)
                    last = first + np.array(sizes[row].as_py(), np.int64) + (width - 1)
                    np.add.at(gone, first, 1)
                    np.add.at(gone, np.minimum(last, n), -1)
                stay = np.flatnonzero(np.cumsum(gone[:n]) == 0)
                raw = (values[row] or "").encode()
                kept[row] = b" ".join([raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist())]).decode()
                n_words[row], n_removed[row] = n, n - len(stay)
            yield pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["kept", "n_words", "n_removed"])

    return run

