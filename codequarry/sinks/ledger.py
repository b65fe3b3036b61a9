"""Append-only logs that cannot fork.

A log is a folder. An append first stages its rows in a folder of their own; Spark's committer sees to it that tasks which are repeated or
given up leave one copy. Then one record, named by the version that the append continues, is created and must not exist yet: of two
writers that read the same version one commits, and the other gets ``Conflict`` and leaves nothing to be read. Readers see what
committed records name, so an append is there as a whole or not at all.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit


class Conflict(RuntimeError):
    """Another writer has committed since the version that an append was to continue."""


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Make a file that must not exist; of several that try, one succeeds."""
    files, place = _files(spark, path)
    if files.getScheme() == "file":
        local = place.toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError as exc:
            raise Conflict(path) from exc
        with os.fdopen(handle, "w") as out:
            out.write(text)
        return
    try:
        out = files.create(place, False)
    except Exception as exc:
        if files.exists(place):
            raise Conflict(path) from exc
        raise
    out.write(bytearray(text.encode()))
    out.close()


def _records(spark: SparkSession, path: str) -> list[dict]:
    """What was committed, in order; a record that is still being written ends the list."""
    out = []
    files, _ = _files(spark, path)
    while True:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{len(out):012d}.json")
        if not files.exists(place):
            return out
        text = spark.read.text(place.toString(), wholetext=True).first()
        if text is None or not text[0].endswith("}\n"):
            return out
        out.append(json.loads(text[0]))


def version(spark: SparkSession, path: str) -> int:
    """How many appends have been committed."""
    return len(_records(spark, path))


def read(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The committed rows, those of the first ``at`` appends if a number is given. ValueError if there is no such version or no row yet."""
    records = _records(spark, path)
    if at is not None and not 0 <= at <= len(records) or not records[:at]:
        raise ValueError("the log has no such version")
    return spark.read.schema(records[0]["schema"]).parquet(*(f"{path}/{r['rows']}" for r in records[:at]))


def append(df: DataFrame, path: str, expected: int, notes: dict | None = None) -> int:
    """Add the rows of ``df`` to the log at version ``expected``; returns the new version, raises ``Conflict`` if the log has gone on."""
    spark, rows = df.sparkSession, f"rows-{uuid.uuid4().hex}"
    if "pos" not in df.columns:
        raise ValueError("a log needs its order column 'pos'")
    df.write.parquet(f"{path}/{rows}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    try:
        _create(spark, f"{path}/commits/{expected:012d}.json", json.dumps({"rows": rows, "schema": schema, **(notes or {})}) + "\n")
    except Conflict:
        files, place = _files(spark, f"{path}/{rows}")
        files.delete(place, True)
        raise
    return expected + 1


def extend(records: DataFrame, path: str, expected: int | None = None) -> int:
    """Chain records (as for ``operators.audit.append``) onto the audit log at ``path`` and commit them. Each commit leaves a table of where every
    repo's chain stands, so an append reads that and the new records, not the log."""
    spark = records.sparkSession
    known = _records(spark, path)
    at = len(known) if expected is None else expected
    if at > len(known):
        raise ValueError("the log has no such version")
    if at < len(known):
        raise Conflict(path)  # known before anything is chained; a writer that commits meanwhile is found out below
    tails = None if at == 0 else spark.read.schema("repo string, n_entries bigint, last_hash string").parquet(f"{path}/{known[at - 1]['tails']}")
    place = f"tails-{uuid.uuid4().hex}"
    staged = f"staged-{uuid.uuid4().hex}"
    audit.append(records, tails).write.parquet(f"{path}/{staged}")
    new = spark.read.schema("repo string, pos bigint, raw string").parquet(f"{path}/{staged}")
    last = new.groupBy("repo").agg(F.max_by("raw", "pos").alias("raw"), F.max("pos").alias("pos"))
    state = last.select("repo", F.col("pos").alias("n_entries"), F.regexp_extract("raw", '"entryHash":"([0-9a-f]{64})"\\}$', 1).alias("last_hash"))
    if tails is not None:
        state = state.unionByName(tails.join(last, "repo", "left_anti"))
    state.write.parquet(f"{path}/{place}")
    try:
        _create(spark, f"{path}/commits/{at:012d}.json", json.dumps({"rows": staged, "schema": "repo string, pos bigint, raw string", "tails": place}) + "\n")
    except Conflict:
        for left in (staged, place):
            files, folder = _files(spark, f"{path}/{left}")
            files.delete(folder, True)
        raise
    return at + 1
