"""Rows of a key packed into blocks of vectors, so that Spark moves blocks and tasks work on matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "key bigint, ids binary, tags binary, numbers binary"


def _pack(size: int, kind: str):
    """Consecutive rows (key, id, tag, numbers) of one key and one vector length, at most ``size`` in a block."""

    def run(batches):
        key, ids, tags, numbers = None, [], [], []

        def block():
            return pa.RecordBatch.from_pydict({"key": [key[0]], "ids": [np.array(ids, "<i8").tobytes()], "tags": [np.array(tags, "<i8").tobytes()],
                                               "numbers": [b"".join(numbers)]})

        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype(kind))
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            for i, (k, row, tag) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                mine = flat[ends[i - 1] if i else 0:ends[i]].tobytes()
                if ids and (key != (k, len(mine)) or len(ids) == size):
                    yield block()
                    ids, tags, numbers = [], [], []
                key = (k, len(mine))
                ids.append(row)
                tags.append(tag)
                numbers.append(mine)
        if ids:
            yield block()

    return run


def packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """``rows`` has key, id, tag and x (an array); rows of one key should follow each other."""
    return rows.select("key", "id", "tag", "x").mapInArrow(_pack(size, kind), SCHEMA)


def matrix(row: dict, kind: str, at: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, tags = np.frombuffer(row[f"{at}ids"], "<i8"), np.frombuffer(row[f"{at}tags"], "<i8")
    return ids, tags, np.frombuffer(row[f"{at}numbers"], kind).reshape(len(ids), -1)
