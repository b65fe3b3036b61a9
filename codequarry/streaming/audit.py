"""Continuous verification of audit logs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import audit as fa

OUT = "repo {repo}, position bigint, ok boolean, first_invalid_seq bigint"
#: positions that lie in one block of waiting lines, and lines that are taken before the blocks are written
SPAN, HOLD = 1 << 14, 100_000


class ChainCheck(StatefulProcessor):
    """Lines of one log, in whatever order they come. Lines whose predecessors have not come yet wait in blocks of ``SPAN`` positions: each time
    up to ``HOLD`` lines have come, a block gets one more piece, and only the block in which the log goes on is read. So the state
    is asked a few times a block and not a few times a line. A line that came before is passed over. The value state is where the log
    stands: the position expected next, entries so far, last hash, first bad position."""

    def __init__(self, start: int):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "expected bigint, n bigint, last string, bad bigint")
        self.pieces = handle.getMapState("pieces", "block bigint", "n bigint")
        self.waiting = handle.getMapState("waiting", "block bigint, piece bigint", "lines string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, held = tuple(self.at.get()) if self.at.exists() else (self.start, 0, None, None), []
        for frame in rows:
            held += _plain(frame)
            if len(held) >= HOLD:
                at = yield from self._take(key, at, held)
                held = []
        at = yield from self._take(key, at, held)
        self.at.update(at)

    def _take(self, key, at: tuple, held: list):
        """The entries that the log goes on with after ``held``; returns where it stands then. The line at the position expected next never waits."""
        expected, n, last, bad = at
        blocks: dict[int, list] = {}
        for line in held:
            if line[0] >= expected:
                blocks.setdefault(line[0] // SPAN, []).append(line)
        here, moved = expected // SPAN, any(line[0] == expected for line in blocks.get(expected // SPAN, ()))
        while moved:
            lines: dict[int, list] = {}
            for line in chain(self._waiting(here), blocks.pop(here, ())):
                lines.setdefault(line[0], line)
            out = []
            while line := lines.pop(expected, None):
                _, expected, corrupt, seq, names, own, sound = line
                if corrupt is not None:  # else the line is no entry
                    n += 1
                    ok = bool(sound) and not corrupt and seq == n and names == last
                    last, bad = own, n if bad is None and not ok else bad
                    out.append((key[0], n, ok, bad))
            if out:
                yield pd.DataFrame({"repo": [o[0] for o in out], "position": [o[1] for o in out], "ok": [o[2] for o in out],
                                    "first_invalid_seq": pd.Series([o[3] for o in out], dtype="Int64")})
            moved = expected // SPAN != here
            if not moved and lines:
                blocks[here] = list(lines.values())
            here = expected // SPAN
        for block, lines in blocks.items():
            self._wait(block, [line for line in lines if line[0] > expected])
        return expected, n, last, bad

    def _wait(self, block: int, lines: list) -> None:
        if lines:
            n = self.pieces.getValue((block,))[0] if self.pieces.containsKey((block,)) else 0
            self.waiting.updateValue((block, n), (json.dumps(lines),))
            self.pieces.updateValue((block,), (n + 1,))

    def _waiting(self, block: int) -> Iterator[list]:
        """The waiting lines of a block, first come first; they do not wait any more."""
        if self.pieces.containsKey((block,)):
            for i in range(self.pieces.getValue((block,))[0]):
                yield from json.loads(self.waiting.getValue((block, i))[0])
                self.waiting.removeKey((block, i))
            self.pieces.removeKey((block,))

    def close(self) -> None:
        pass


def _plain(frame: pd.DataFrame) -> list[tuple]:
    """(pos, next, corrupt, seq, names, hash, sound) of each line; None for a null."""
    def column(name, kind):
        return [None if missing else kind(value) for value, missing in zip(frame[name].tolist(), frame[name].isna().tolist())]

    kinds = {"pos": int, "next": int, "corrupt": bool, "seq": int, "names": str, "hash": str, "sound": bool}
    return list(zip(*(column(name, kind) for name, kind in kinds.items())))


def verify(log: DataFrame, start: int = 1) -> DataFrame:
    """Streaming log(repo, pos, raw) -> repo, position, ok, first_invalid_seq for each entry, once all lines before it have come.

    ``pos`` is the line's number, from ``start``; with a column ``next``, the position of the line that follows, any rising positions will do
    (byte offsets from 0). Lines may come in any order and more than once over any number of triggers. The hash of every entry over
    the predecessor it names is computed in parallel; the state only checks that it names the right one, and holds ``HOLD`` rows at
    a time, so a log that is a whole trigger is never held. Needs the RocksDB state store, which ``session.configure`` sets."""
    repo = dict(log.dtypes)["repo"]
    e = fa.entries(log if "next" in log.columns else log.selectExpr("*", "pos + 1 AS next"), every_line=True).drop("raw")
    return e.groupBy("repo").transformWithStateInPandas(
        statefulProcessor=ChainCheck(start), outputStructType=OUT.format(repo=repo), outputMode="Append", timeMode="None")
