"""SimHash near-duplicates by anchor points of a covering code.

A fingerprint has a bit wherever more than half the hashes of a text's word shingles have it. The anchors are the words of a Hamming
code of 31 bits, whose covering radius is 1: every 31-bit string is within 1 of an anchor. Two fingerprints that differ in at most
``t`` bits differ in at most t // 2 bits in one of their two 31-bit halves; some string lies midway between these halves, within
ceil((t // 2) / 2) of both, and its anchor lies within 1 of it. So a fingerprint is copied, half by half, to every anchor within the
covering radius plus that part of the threshold, and each link is found at an anchor: 16 copies a half for t = 4, where the whole
threshold on both sides would need 156. Fingerprints of one anchor are compared in all 64 bits.

Equal fingerprints are one row before anything is copied. An anchor's fingerprints are searched breadth first, each against those not yet
reached, so that n near copies give n - 1 links and about n comparisons, not all pairs. An anchor with more fingerprints than ``most``
is passed on unread and compared in pairs of slices by many tasks.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, memo, partitions, prepared, stored
from .graph import components, named

PARITY = 5
HALF = (1 << PARITY) - 1  # bits of a code word
_STEP = 1 << 16


def fingerprint(text: bytes | None, width: int, seed: int) -> int:
    words = (text or b"").lower().split()  # of bytes: A-Z only, at space and 0x09-0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[-1:] if n == 1 else ends[width - 1:]
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _STEP):
        spans = zip(first[a:min(a + _STEP, n)].tolist(), last[a:a + _STEP].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[i:j], seed) for i, j in spans], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int, seed: int):
    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(1)], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("<i8"))], ["doc_id", "fp"])

    return run


def _patterns(reach: int) -> list[np.ndarray]:
    """For each syndrome the ways to change at most ``reach`` bits that lead from a word of that syndrome to an anchor."""
    held = memo("code patterns")
    if reach not in held:
        by = [[] for _ in range(HALF + 1)]
        for k in range(reach + 1):
            for places in itertools.combinations(range(1, HALF + 1), k):
                syndrome = pattern = 0
                for p in places:
                    syndrome ^= p
                    pattern |= 1 << (p - 1)
                by[syndrome].append(pattern)
        held[reach] = [np.array(p, np.uint64) for p in by]
    return held[reach]


def _syndrome(words: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words), np.uint64)
    for k in range(PARITY):
        mask = np.uint64(sum(1 << (p - 1) for p in range(1, HALF + 1) if p >> k & 1))
        out |= (np.bitwise_count(words & mask).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
    return out


def anchors(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fingerprint) for every anchor within reach of either half; an anchor's number says which half it is of."""
    patterns = _patterns(1 + -(-(bits // 2) // 2))
    keys, owners = [], []
    for half in range(2):
        words = fps >> np.uint64(HALF * half) & np.uint64((1 << HALF) - 1)
        syndromes = _syndrome(words)
        for s in range(HALF + 1):
            mine = syndromes == s
            if mine.any():
                keys.append((words[mine][:, None] ^ patterns[s][None, :] | np.uint64(half << HALF)).ravel())
                owners.append(np.repeat(fps[mine], len(patterns[s])))
    return np.concatenate(keys), np.concatenate(owners)


def _anchored(bits: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys, owners = anchors(batch.column(0).to_numpy().view("<u8"), bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view("<i8")), pa.array(owners.view("<i8"))], ["anchor", "fp"])

    return run


def _forest(fps: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect whatever is within ``bits`` of each other, breadth first."""
    rest, links = fps, []
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            near = front.pop()
            at = near[0]
            if len(near) > 1:
                front.append(near[1:])
            close = np.bitwise_count(rest ^ at) <= bits
            if close.any():
                met, rest = rest[close], rest[~close]
                links.append((np.full(len(met), at), met))
                front.append(met)
    return links


_FOUND = "x bigint, y bigint, anchor bigint"


def _compare(bits: int, most: int | None):
    """Links among the fingerprints of each anchor; rows come sorted by anchor. Those of an anchor with more than ``most`` are passed on
    as (fingerprint, null, anchor)."""

    def table(x, y, anchor):
        whole = pa.nulls(len(x), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x.view("<i8")), whole if y is None else pa.array(y.view("<i8")),
                                           whole if anchor is None else pa.array(np.full(len(x), anchor, np.int64))], ["x", "y", "anchor"])

    def groups(keys, fps):
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes = np.diff(cuts)
        two = cuts[:-1][sizes == 2]
        pair = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= bits]
        links = [(fps[pair], fps[pair + 1])]
        for a, n in zip(cuts[:-1][sizes > 2], sizes[sizes > 2]):
            links += _forest(fps[a:a + n], bits)
        return table(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]), None)

    def run(batches):
        keys, fps, over = np.zeros(0, "<i8"), np.zeros(0, "<u8"), None
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy().view("<u8")))
            if over is not None:
                n = int((keys == over).sum())
                if n:
                    yield table(fps[:n], None, over)
                    keys, fps = keys[n:], fps[n:]
                over = over if not len(keys) else None
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last:
                yield groups(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if most is not None and len(keys) > most:
                over = int(keys[0])
                yield table(fps, None, over)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield groups(keys, fps)

    return run


def links(prints: DataFrame, bits: int = 4, most: int = 1 << 16) -> DataFrame:
    """(x, y): links that connect all fingerprints of ``prints(fp)``, each there once, that are linked; stored."""
    spark = prepared(prints.sparkSession)
    scratch = Scratch(spark)
    parts = partitions(spark, prints.count() * 32, 2_000_000)
    copies = prints.select("fp").mapInArrow(_anchored(bits), "anchor bigint, fp bigint")
    dealt = lambda df: df.repartition(parts, "anchor").sortWithinPartitions("anchor")
    found = scratch.put(dealt(copies).mapInArrow(_compare(bits, most), _FOUND), "anchored")
    over = found.filter("anchor IS NOT NULL").select("anchor", F.col("x").alias("fp"))
    pairs = found.filter("anchor IS NULL").select("x", "y")
    size = over.groupBy("anchor").agg(F.expr(f"count(*) div {most} + 2").alias("s"))
    if size.limit(1).count():
        sliced = over.join(size, "anchor").withColumn("i", F.expr("pmod(xxhash64(fp), s)"))
        other = sliced.withColumn("j", F.expr("explode(filter(sequence(0L, s - 1), j -> j <> i))"))
        again = other.select(F.xxhash64("anchor", F.least("i", "j"), F.greatest("i", "j")).alias("anchor"), "fp")
        pairs = pairs.union(dealt(again).mapInArrow(_compare(bits, None), _FOUND).select("x", "y"))
    out = stored(pairs.distinct(), "links")
    scratch.clear()
    return out


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, bits: int = 4, seed: int = 42, most: int = 1 << 16) -> DataFrame:
    """One row per input row: ``key``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest ``key`` reachable by links.

    Words are runs of anything but space and 0x09-0x0D, with A-Z in lower case; shingles are ``width`` words joined by one space, repeats
    included, hashed by XXH64 with ``seed``. A text with fewer words has the whole sequence as its shingle; a null or blank one has the
    fingerprint zero, which links like any other. Repeated rows, ties and equal texts have one fingerprint and one component. A null key
    is never the smallest; a component of null keys only has a null id. Other columns are not looked at. An empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    prints = stored(texts.mapInArrow(_fingerprints(width, seed), "doc_id bigint, fp bigint"), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    label = components(links(classes, bits, most)).select(F.col("node").alias("fp"), "label")
    classes = classes.join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    names = stored(classes.join(smallest, "label").select("fp", "n", "component_id"), "names")
    out = named(prints, names, "fp")
    return out.select(F.col("doc_id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
