"""Canonical form and hashing of audit entries.

The canonical form is JSON as Python's ``json`` module prints it: keys in order of code points, no spaces, raw Unicode, integers of any size
digit by digit, other numbers as the shortest text that reads back as the same double. Built-in functions cannot give it: variants
turn ``1.0`` and ``1e22`` into decimals, the JVM of Java 17 does not print the shortest digits, and maps order keys by UTF-16. So one
Arrow pass takes each line apart once, and everything after it works on short typed columns.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

GENESIS = "GENESIS"


def loads(text: str):
    """The JSON value of ``text``; ValueError if it is none. A repeated key has its last value."""
    try:
        return json.loads(text)
    except RecursionError as exc:
        raise ValueError("nested too deeply") from exc


# made once: json.dumps makes an encoder a call
dumps = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode
as_given = json.JSONEncoder(separators=(",", ":"), ensure_ascii=False).encode


def entry_hash(previous: str | None, body: str) -> str:
    return hashlib.sha256(f"{previous or GENESIS}|{body}".encode()).hexdigest()


def _canonical(texts: pa.Array) -> pa.Array:
    def one(text):
        try:
            return None if text is None else dumps(loads(text)).encode().decode()
        except ValueError:  # no JSON, or a lone surrogate, which has no bytes
            return None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def canonical(text: str | Column) -> Column:
    """The canonical form of a JSON text; null where the text is null or no JSON."""
    return F.arrow_udf(_canonical, StringType())(text)


ENTRY = [("raw", pa.string()), ("corrupt", pa.bool_()), ("seq", pa.int64()), ("names", pa.string()), ("hash", pa.string()), ("sound", pa.bool_())]


def entry(line: str):
    """(raw, corrupt, seq, names, hash, sound) of a log line, or None where there is no entry: blank lines and JSON that is no object.

    ``names`` and ``hash`` are prevHash and entryHash as JSON, null if absent or null; ``seq`` is null if it is no whole number; ``sound``
    says whether the hash fits the body and the predecessor that the entry names."""
    line = line.strip()
    if not line:
        return None
    try:
        found = loads(line)
    except ValueError:
        return line, True, None, None, None, False
    if not isinstance(found, dict):
        return None
    seq, names, stored = found.get("seq"), found.get("prevHash"), found.pop("entryHash", None)
    try:
        own = entry_hash(names, dumps(found)) if names is None or isinstance(names, str) else None
        shown = [None if v is None else dumps(v) for v in (names, stored)]
        "".join(s for s in shown if s).encode()
    except ValueError:
        own, shown = None, [None, None]
    whole = isinstance(seq, (int, float)) and abs(seq) < 1 << 62 and seq == int(seq)
    return line, bool(found.get("corrupt")), int(seq) if whole else None, *shown, own is not None and stored == own


def entries(log: DataFrame, every_line: bool = False) -> DataFrame:
    """log(repo, pos, raw) -> repo, pos, next if the log has it, and the columns of ``entry``, in one pass, for tables and streams. With
    ``every_line`` lines without an entry stay, with nulls."""
    types = dict(log.dtypes)
    places = [c for c in ("repo", "pos", "next") if c in types]
    names = [*places, *(n for n, _ in ENTRY)]
    nothing = (None,) * len(ENTRY)

    def run(batches):
        for batch in batches:
            found = [entry(line or "") for line in batch.column("raw").to_pylist()]
            if every_line:
                found = [f or nothing for f in found]
            keep = pa.array([f is not None for f in found], pa.bool_())
            columns = list(zip(*(f for f in found if f is not None))) or [()] * len(ENTRY)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in places), *(pa.array(c, t) for c, (_, t) in zip(columns, ENTRY))], names)

    schema = ", ".join(f"{c} {types[c]}" for c in places)
    return log.select(*places, "raw").mapInArrow(
        run, f"{schema}, raw string, corrupt boolean, seq bigint, names string, hash string, sound boolean")


# fixed values: the names that a log writes itself
RESERVED = ("seq", "timestampUtc", "prevHash", "entryHash")


def record_parts(text: str | None, timestamp: str | None):
    """(inner, head, mid, rest): the record's members as they are logged, and the canonical body around the values of prevHash and seq. None
    where the record cannot be logged: no JSON object, a name that the log writes, no UTF-8."""
    try:
        record = loads(text or "")
        if not isinstance(record, dict) or any(name in record for name in RESERVED):
            return None
        inner = as_given(record)[1:-1]
        record["timestampUtc"] = timestamp
        shown = {name: f"{dumps(name)}:{dumps(value)}" for name, value in record.items()} | {"prevHash": '"prevHash":\0', "seq": '"seq":\0'}
        head, mid, rest = ("{" + ",".join(shown[name] for name in sorted(shown)) + "}").split("\0")
        (inner + head + mid + rest).encode()
    except ValueError:
        return None
    return inner, head, mid, rest


def _loggable(records: pa.Array) -> pa.Array:
    return pa.array([record_parts(r, "") is not None for r in records.to_pylist()], pa.bool_())


def loggable(record: str | Column) -> Column:
    """Whether a record can be logged."""
    return F.arrow_udf(_loggable, BooleanType())(record)


def json_field(variant: Column, name: str) -> Column:
    """A top-level field as JSON text; SQL null when it is absent or JSON null."""
    return F.nullif(F.to_json(F.try_variant_get(variant, f"$.{name}", "variant")), F.lit("null"))


def string_field(variant: Column, name: str) -> Column:
    return F.try_variant_get(variant, f"$.{name}", "string")
