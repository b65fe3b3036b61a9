"""Vectors compressed to one byte a part: product quantisation by integer k-means, exact, with norm-of-sum bounds.

Every vector is cut into parts, each part position has its codebook, and every round assigns each part to the nearest entry and then moves
the entries. A row keeps, for each part, its entry, a lower bound on the distance to all other entries, and the round in which that
bound was measured. All codebooks of earlier rounds are retained, so that a bound of round T loses just the true net displacement of
the entries from T to now, not the sum of their moves round by round. Where the distance to the own entry, which is always computed,
is strictly below what is left of the bound, the part stays where it is without looking at other entries; else all entries are
scanned anew, ties going to the lower index, and the bound gets a new stamp.

One bound a part is kept, not one an entry: state is as large as the vector itself. A round is one pass over stored rows; what comes back
to the driver is one sum a codebook component, added up by Spark, however many rows there are. Distances are integers and exact.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prepared, stored
from .graph import named

_STATE = "vec_id bigint, label {label}, x binary, code binary, low binary, stamp binary, error bigint, cell int, sums array<bigint>"
_BLOCK = 4096  # rows whose distances are held at once


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts begin and end: equal ones if the length allows it, else as equal as possible."""
    return [(length * p // parts, length * (p + 1) // parts) for p in range(parts)]


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances; int64, or float64 where all terms are whole numbers below 2**53."""
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def _scan(x: np.ndarray, entries: np.ndarray):
    """Nearest entry, its squared distance, and a float below the distance to any other entry."""
    code, own, low = (np.empty(len(x), t) for t in (np.uint8, np.int64, np.float32))
    for a in range(0, len(x), _BLOCK):
        d = _distances(x[a:a + _BLOCK], entries)
        at, rows = d.argmin(axis=1), np.arange(len(d))
        code[a:a + _BLOCK], own[a:a + _BLOCK] = at, d[rows, at]
        if len(entries) > 1:
            d[rows, at] = np.iinfo(np.int64).max if d.dtype.kind == "i" else np.inf
            low[a:a + _BLOCK] = np.nextafter(np.sqrt(d.min(axis=1)).astype(np.float32), np.float32(-1))
        else:
            low[a:a + _BLOCK] = np.inf
    return code, own, low


def net_shifts(history: list[np.ndarray]) -> np.ndarray:
    """[round, entry]: the largest net displacement from that round's codebook to the newest, over all entries but this one."""
    moved = np.sqrt(np.array([((history[-1] - old).astype(np.float64) ** 2).sum(axis=1) for old in history]))
    out = np.zeros_like(moved)
    if moved.shape[1] > 1:
        first = moved.argmax(axis=1)
        rows = np.arange(len(moved))
        top = moved[rows, first]
        moved[rows, first] = -1
        out[:] = top[:, None]
        out[rows, first] = moved.max(axis=1)
    return out


def reassign(x, code, low, stamp, history, tally=None):
    """The state of one part position under the newest codebook; only rows whose bound does not hold are scanned."""
    entries, now = history[-1], len(history) - 1
    diff = x - entries[code]
    own = (diff * diff).sum(axis=1).astype(np.int64)
    shift = net_shifts(history)[stamp, code]
    open_ = ~(np.sqrt(own.astype(np.float64)) * (1 + 1e-12) + 1e-6 < low.astype(np.float64) - shift * (1 + 1e-12))
    if tally is not None:
        tally.append((int(open_.sum()), len(open_)))
    if open_.any():
        code, low, stamp = code.copy(), low.copy(), stamp.copy()
        code[open_], own[open_], low[open_] = _scan(x[open_], entries)
        stamp[open_] = now
    return code, own, low, stamp


def _round(history, bounds, kind, last):
    """One pass: the state under the newest codebook, and unless it is the ``last`` pass the sums of each entry's parts."""
    parts, now = len(bounds), len(history) - 1
    books = [[h[p].astype(kind) for h in history] for p in range(parts)]

    def run(batches):
        sums = [np.zeros((len(books[p][-1]), b - a + 1), np.int64) for p, (a, b) in enumerate(bounds)]
        label_type = None
        for batch in batches:
            n, label_type = batch.num_rows, batch.column("label").type
            if n == 0:
                continue
            if now == 0:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            else:
                old = [np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(n, -1)
                       for c, t in (("x", "<i8"), ("code", np.uint8), ("low", "<f4"), ("stamp", np.uint8))]
                x = old[0]
            code, low, stamp = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32), np.full((n, parts), now, np.uint8)
            error = np.zeros(n, np.int64)
            for p, (a, b) in enumerate(bounds):
                mine = x[:, a:b].astype(kind)
                if now == 0:
                    code[:, p], own, low[:, p] = _scan(mine, books[p][0])
                else:
                    code[:, p], own, low[:, p], stamp[:, p] = reassign(mine, old[1][:, p], old[2][:, p], old[3][:, p], books[p])
                error += own
                if not last:
                    np.add.at(sums[p], code[:, p], np.column_stack((np.ones(n, np.int64), x[:, a:b])))
            pack = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            gone = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), gone if last else pack(x.astype("<i8")), pack(code), gone if last else pack(low.astype("<f4")),
                 gone if last else pack(stamp), pa.array(error), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.int64()))], _NAMES)
        if not last:
            cells = np.cumsum([0] + [len(s) for s in sums])
            rows = [(int(cells[p]) + e, s[e]) for p, s in enumerate(sums) for e in np.flatnonzero(s[:, 0])]
            if rows:
                k = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(k, pa.int64()), pa.nulls(k, label_type), *[pa.nulls(k, pa.binary())] * 4, pa.nulls(k, pa.int64()),
                     pa.array([c for c, _ in rows], pa.int32()), pa.array([s.tolist() for _, s in rows], pa.list_(pa.int64()))], _NAMES)

    return run


_NAMES = ["vec_id", "label", "x", "code", "low", "stamp", "error", "cell", "sums"]


def _moved(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Every entry at the floor of its parts' mean; an unused one where it was."""
    totals = (sums.select("cell", F.posexplode("sums").alias("at", "v")).groupBy("cell", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
              .filter("at > 0").join(sums.groupBy("cell").agg(F.sum(F.expr("sums[0]")).alias("n")), "cell").collect())
    out, cell = [b.copy() for b in books], np.cumsum([0] + [len(b) for b in books])
    for r in totals:
        p = int(np.searchsorted(cell, r["cell"], "right")) - 1
        out[p][r["cell"] - cell[p], r["at"] - 1] = int(r["v"]) // r["n"]
    return out


def _one_length(kept: DataFrame, length: int, most: int, parts: int, size: int, rounds: int):
    """(vec_id, label, code, error), stored, and the codebooks of the vectors of one length."""
    bounds = cuts(length, parts)
    kind = np.float64 if 8 * length * most * most < 2 ** 53 else np.int64
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(size).select("x").collect()
    first = np.array([r["x"] for r in seeds], np.int64).reshape(len(seeds), length)
    history = [[first[:, a:b] for a, b in bounds]]
    schema = _STATE.format(label=kept.schema["label"].dataType.simpleString())
    scratch, state, held = Scratch(kept.sparkSession), kept, None
    for _ in range(rounds):
        new = scratch.put(state.mapInArrow(_round(history, bounds, kind, False), schema), "state")
        if held is not None:
            scratch.drop(held)
        history.append(_moved(history[-1], new.filter("cell IS NOT NULL").select("cell", "sums")))
        held, state = new, new.filter("cell IS NULL").select("vec_id", "label", "x", "code", "low", "stamp")
    coded = stored(state.mapInArrow(_round(history, bounds, kind, True), schema).select("vec_id", "label", "code", "error"), "codes")
    scratch.clear()
    return coded, history[-1]


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, size: int = 64,
             rounds: int = 2, scale: int = 256) -> tuple[DataFrame, dict[int, list[np.ndarray]]]:
    """(codes, codebooks). ``codes`` has one row per vector that is not null and holds neither nulls nor non-finite components: ``key``,
    ``label``, ``length``, ``code`` (binary, one byte a part), ``error`` (squared distance to the entries) and ``label_error`` (errors of all
    rows of the label, nulls together). ``codebooks`` has for each vector length the entries of each part.

    Components become floor(scale * x). Codebooks start as the parts of the ``size`` smallest keys (null keys last, equal keys by vector;
    all rows if there are fewer) and move ``rounds`` times. Repeated rows count as often as they are there. Vectors of each length have
    codebooks of their own; a length that ``parts`` does not divide is cut as evenly as possible, so some parts may be empty. Vectors
    whose squared distances could pass 2**62 raise ValueError before any round. An empty table gives no rows. Other columns are not
    looked at.
    """
    if not 1 <= size <= 256 or parts < 1 or not 0 <= rounds <= 255:
        raise ValueError("size must be between 1 and 256, parts at least 1 and rounds between 0 and 255")
    spark = prepared(vectors.sparkSession)
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), x.alias("x")).filter(F.coalesce(sound, F.lit(False)))
    widest = F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0.0))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.max(widest).alias("most")).orderBy("length").collect()
    for r in lengths:
        if 4 * max(r["length"], 1) * (r["most"] * scale + 1) ** 2 >= 2.0 ** 62:
            raise ValueError("components are too large for squared distances in 64 bits")
    kept = rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("x"))
    books, out = {}, spark.createDataFrame([], f"vec_id bigint, label {kept.schema['label'].dataType.simpleString()}, length int, code binary, error bigint")
    for r in lengths:
        coded, books[r["length"]] = _one_length(kept.filter(F.size("x") == r["length"]), r["length"], int(r["most"] * scale) + 1, parts, size, rounds)
        out = out.unionByName(coded.withColumn("length", F.lit(r["length"])))
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return named(out, sums, "label").select(F.col("vec_id").alias(key), F.col("label").alias(label), "length", "code", "error", "label_error"), books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
