"""Hash-chained audit logs: verify in parallel, extend with an ordered fold."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import params
from ..functions import audit as fa
from ..plans.topn import top_n


def verify(log: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Per repo: entry_count, first_invalid_seq, chain_valid, status.

    One log may be most of the table, so no window spans a repo. Ranges of ``chunk`` positions are
    checked on their own: neighbours must name each other, and ``seq`` must rise by one. A range
    is then one row, and the rows of a repo are linked: does the first entry name the last of the
    range before, and does its ``seq`` follow from the number of entries so far? The log is read
    once and its short columns are shuffled once."""
    params.int_in(chunk, 1, 10_000_000, "chunk", optional=False)
    c = F.col
    inside = Window.partitionBy("repo", "range").orderBy("pos")
    rows = fa.entries(log).drop("raw").withColumn("sound", c("sound") & ~c("corrupt")).withColumn("range", F.floor(c("pos") / chunk))
    rows = (rows.withColumn("k", F.row_number().over(inside)).withColumn("before", F.lag("hash").over(inside))
            .withColumn("base", c("seq") - c("k")).withColumn("base1", F.first("base").over(inside)))
    wrong = ~c("sound") | ((c("k") > 1) & ~c("names").eqNullSafe(c("before"))) | c("base").isNull() | ~c("base").eqNullSafe(c("base1"))
    ranges = rows.groupBy("repo", "range").agg(
        F.count("*").alias("n"), F.min(F.when(wrong, c("k"))).alias("bad_k"), F.max(F.when(c("k") == 1, c("base1"))).alias("base1"),
        F.max(F.when(c("k") == 1, c("names"))).alias("names1"), F.max(F.struct("k", "hash")).alias("last"))
    order = Window.partitionBy("repo").orderBy("range")  # one row per range
    linked = ranges.withColumn("offset", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    linked = linked.withColumn("enter", F.lag("last.hash").over(order))
    joint = c("names1").eqNullSafe(c("enter")) & c("base1").eqNullSafe(c("offset"))
    first_bad = c("offset") + F.when(~joint, F.lit(1)).otherwise(c("bad_k"))
    out = linked.groupBy("repo").agg(F.sum("n").alias("entry_count"), F.min(first_bad).alias("first_invalid_seq"))
    valid = c("first_invalid_seq").isNull()
    return out.withColumn("chain_valid", valid).withColumn("status", F.when(valid, "ok").otherwise("fail"))


def tail(log: DataFrame, n: int = 50) -> DataFrame:
    """The last entries of each log, ``back`` = 1 for the newest."""
    params.int_in(n, 1, params.NO_LIMIT, "n", optional=False)
    entries = fa.entries(log).select("repo", "pos", "raw", "corrupt")
    return top_n(entries, ["repo"], [F.desc("pos")], n, ["pos"], rank="back")


def rejected(records: DataFrame) -> DataFrame:
    """The records that ``append`` passes over: no JSON object, or one that brings a name which the log writes itself."""
    return records.filter(~fa.loggable("record"))


def append(records: DataFrame, tails: DataFrame | None = None) -> DataFrame:
    """Chain records(repo, ord, timestamp_utc, record) onto each repo's log.

    ``record`` is the JSON text of an object; ``tails(repo, n_entries, last_hash)`` is the state of
    the logs so far. Every hash needs the one before it, so a repo's records form one ordered
    stream; all parsing and canonical text is prepared in parallel first, and the fold only
    splices, hashes and passes rows on, holding one state per repo. Records that cannot be logged are
    passed over; ``rejected`` lists them. Returns (repo, pos, raw)."""
    types = dict(records.dtypes)
    # dealt out first, so that records in few and large parts of files are not prepared by few tasks
    ready = records.select("repo", "ord", "timestamp_utc", "record").repartition("ord").mapInArrow(
        _prepare, f"repo {types['repo']}, ord {types['ord']}, stamp string, inner string, head string, mid string, rest string")
    if tails is not None:
        ready = ready.join(tails.select("repo", "n_entries", "last_hash"), "repo", "left")
    else:
        ready = ready.withColumn("n_entries", F.lit(0)).withColumn("last_hash", F.lit(None).cast("string"))
    ready = ready.withColumn("n_entries", F.coalesce("n_entries", F.lit(0)).cast("bigint"))
    ordered = ready.repartition("repo").sortWithinPartitions("repo", "ord")
    return ordered.mapInArrow(_chain, f"repo {types['repo']}, pos bigint, raw string")


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stamps = batch.column("timestamp_utc").to_pylist()
        parts = [fa.record_parts(r, t) for r, t in zip(batch.column("record").to_pylist(), stamps)]
        keep = pa.array([p is not None for p in parts], pa.bool_())
        columns = list(zip(*((fa.as_given(t), *p) for t, p in zip(stamps, parts) if p is not None))) or [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("repo").filter(keep), batch.column("ord").filter(keep), *(pa.array(c, pa.string()) for c in columns)],
                                         ["repo", "ord", "stamp", "inner", "head", "mid", "rest"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    repo, n, last, prev = object(), 0, None, "null"
    for batch in batches:
        pos, raw = [], []
        for name, _, stamp, inner, head, mid, rest, n_entries, last_hash in zip(*(c.to_pylist() for c in batch.columns)):
            if name != repo:
                repo, n, last = name, n_entries, last_hash
                prev = json.dumps(last)
            n += 1
            last = fa.entry_hash(last, f"{head}{prev}{mid}{n}{rest}")
            pos.append(n)
            raw.append(f'{{"seq":{n},"timestampUtc":{stamp},"prevHash":{prev}{"," if inner else ""}{inner},"entryHash":"{last}"}}')
            prev = f'"{last}"'
        yield pa.RecordBatch.from_arrays([batch.column("repo"), pa.array(pos, pa.int64()), pa.array(raw, pa.string())], ["repo", "pos", "raw"])


def log_state(log: DataFrame) -> DataFrame:
    """repo, n_entries, last_hash: what ``append`` needs to continue the logs."""
    last = F.max(F.struct("pos", F.when(~F.col("corrupt"), F.from_json(F.concat(F.lit('{"h":'), "hash", F.lit("}")), "h string")["h"]).alias("h")))
    return fa.entries(log).groupBy("repo").agg(F.count("*").alias("n_entries"), last.alias("l")).select("repo", "n_entries", F.col("l.h").alias("last_hash"))


def latest_sessions(sessions: DataFrame) -> DataFrame:
    """sessions(repo, session_id, pos, ...): the latest record of each session."""
    rest = [x for x in sessions.columns if x not in ("repo", "session_id", "pos")]
    newest = sessions.groupBy("repo", "session_id").agg(F.max(F.struct("pos", *rest)).alias("s"))
    return newest.select("repo", "session_id", "s.*")
