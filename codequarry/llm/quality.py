"""Quality by compression: which labelled text does a document compress better with?

One zstandard dictionary is built from good and one from bad labelled text. A text is cut into chunks, all of them, and each is
compressed with both dictionaries. The normalised difference of the summed sizes, with the share that is left of the text,
becomes a probability by logistic regression on other labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import memo, prepared, table

CHUNK = 2048  # bytes that are compressed at a time
DICTIONARY_BYTES, LEVEL = 110_000, 3
SHRINK = 200  # bytes by which sizes are smoothed, so that short texts stay near the middle
# bounds of the labelled sample: documents of each class for the dictionaries, of each class for the calibration, chunks of each
DICTIONARY_DOCS, CALIBRATION_DOCS, SAMPLE_CHUNKS = 1500, 4000, 4


@dataclass
class Model:
    good: bytes
    bad: bytes
    mean: list[float]
    scale: list[float]
    weights: list[float]


def _chunks(data: bytes) -> list[bytes]:
    return [data[i:i + CHUNK] for i in range(0, len(data), CHUNK)]


def _sample_chunks(text: str) -> list[bytes]:
    found = _chunks(text.encode())
    return found if len(found) <= SAMPLE_CHUNKS else [found[i * len(found) // SAMPLE_CHUNKS] for i in range(SAMPLE_CHUNKS)]


def _compressor(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = memo("quality compressors")
    if dictionary not in held:
        if len(held) > 7:
            held.clear()
        data = zstandard.ZstdCompressionDict(dictionary)
        data.precompute_compress(LEVEL)
        held[dictionary] = zstandard.ZstdCompressor(dict_data=data, level=LEVEL, write_content_size=False, write_dict_id=False)
    return held[dictionary]


def _sizes(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """Bytes with the good dictionary, bytes with the bad one, bytes of the text."""
    by_good, by_bad = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        chunks = _chunks(text.encode()) if text else []
        out[i] = sum(len(by_good.compress(c)) for c in chunks), sum(len(by_bad.compress(c)) for c in chunks), sum(map(len, chunks))
    return out


def _features(sizes: np.ndarray) -> np.ndarray:
    good, bad, size = sizes.T
    difference = (bad - good) / (bad + good + SHRINK)
    left = (bad + good + SHRINK) / (2 * size + SHRINK)
    return np.stack([np.ones_like(left), difference, left, left * left, difference * left], axis=1)


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def trains(key: Column) -> Column:
    """Rows that a model may learn from: CRC-32 of the key as text, modulo 3, is not 1."""
    return F.crc32(key.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """Learn from labelled documents for which ``trains`` holds.

    The sample is bounded: of each class the DICTIONARY_DOCS + CALIBRATION_DOCS keys of least hash, SAMPLE_CHUNKS chunks of each for
    the dictionaries and whole texts for the calibration. There each class weighs as much as all its labels do, so that the share of
    good ones does not depend on the bounds. Keys that are null, or labelled null or both ways, are left
    out; of documents that share a key, one text counts. Without labels of both classes every score is 1.
    """
    prepared(docs.sparkSession)
    votes = (labels.select(F.col(key).cast("bigint").alias("k"), F.col(label).cast("int").alias("y")).filter("k IS NOT NULL AND y IN (0, 1)")
             .filter(trains(F.col("k"))).groupBy("k").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("k", "y"))
    most = DICTIONARY_DOCS + CALIBRATION_DOCS
    chosen = [[r.k for r in votes.filter(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most).collect()] for y in (0, 1)]
    if not chosen[0] or not chosen[1]:
        return Model(b"", b"", [0.0] * 5, [1.0] * 5, [50.0, 0, 0, 0, 0])
    eligible = votes.join(docs.select(F.col(key).cast("bigint").alias("k")).distinct(), "k")  # labels without a document are no part of the share
    counted = {r.y: r.n for r in eligible.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = [(k, y, i) for y in (0, 1) for i, k in enumerate(chosen[y])]
    split = [min(DICTIONARY_DOCS, -(-len(c) // 2)) for c in chosen]
    spark = docs.sparkSession
    keys = F.broadcast(spark.createDataFrame(place, "k bigint, y int, at int"))  # 2 * most rows at most
    texts = (docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("string").alias("t")).join(keys, "k")
             .groupBy("k", "y", "at").agg(F.min("t").alias("t")))

    @F.arrow_udf("array<binary>")
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([_sample_chunks(t or "") for t in column.to_pylist()], pa.list_(pa.binary()))

    first = F.col("at") < F.when(F.col("y") == 1, split[1]).otherwise(split[0])
    texts = texts.cache()
    samples = texts.filter(first).select("y", "at", pieces("t").alias("c")).collect()
    samples.sort(key=lambda r: (r.y, r.at))
    bad, good = (_dictionary([bytes(c) for r in samples if r.y == y for c in r.c]) for y in (0, 1))

    @F.arrow_udf("array<double>")
    def sizes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(_sizes(column.to_pylist(), good, bad).tolist(), pa.list_(pa.float64()))

    rest = texts.filter(~first).select("y", "at", sizes("t").alias("s")).collect()
    texts.unpersist()
    rest.sort(key=lambda r: (r.y, r.at))
    if len({r.y for r in rest}) < 2:
        return Model(good, bad, [0.0] * 5, [1.0] * 5, [0.0, 20.0, 0, 0, 0])
    y = np.array([r.y for r in rest])
    # classes keep the share that they have among all labels, however many of each are sampled; the weights add up to the sample
    weight = np.array([counted[0] / (y == 0).sum(), counted[1] / (y == 1).sum()])[y]
    return _calibrated(good, bad, np.array([r.s for r in rest]), y.astype(float), weight * len(y) / weight.sum())


def _calibrated(good: bytes, bad: bytes, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    x = _features(sizes)
    mean = np.average(x, axis=0, weights=weight)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=weight))
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z, w = (x - mean) / scale, np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = z.T @ (z * (weight * p * (1 - p))[:, None]) + 0.01 * np.eye(len(w))
        w += np.linalg.solve(curve, z.T @ (weight * (y - p)) - 0.01 * w)
    return Model(good, bad, mean.tolist(), scale.tolist(), w.tolist())


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """All columns and ``out``, the probability that a text is good, from its whole text. Null and empty texts have the score of no
    evidence: difference 0, nothing compressed. ``out`` replaces a column of that name."""
    held = prepared(docs.sparkSession).sparkContext.broadcast(model)  # two dictionaries and a few numbers

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for column in batches:
            x = _features(_sizes(column.to_pylist(), m.good, m.bad))
            z = ((x - np.array(m.mean)) / np.array(m.scale)) @ np.array(m.weights)
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(out, scores(F.col(text).cast("string")))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rated = score(docs.select("doc_id", "text"), fit(docs, labels))
    return rated.select("doc_id", F.coalesce(~trains(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, out="_quality").filter("_quality >= 0.5").drop("_quality")
