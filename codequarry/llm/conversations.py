"""Conversation repair: a generalised LR parse of the roles with weighted delete, rerole and insert actions.

The roles of a conversation must read ``(s?(ua)+)?``. An LR automaton is built from that grammar; a graph-structured stack follows all
edit scripts at once: each row may be kept (its role is shifted), reroled (user or assistant is shifted instead) or deleted, and before
any row and at the end user and assistant turns may be inserted. Stacks whose tops are equal have the same future, so they are merged by
minimum (cost, audit), where the audit is the script's initials. Two scripts of equal cost that consumed the same rows are never one the
beginning of the other (what follows could only be insertions, which cost), so the minimum stays the minimum whatever follows. For the
same reason a stretch of rows can be parsed from every stack top alone, and stretches be put together later.

That is how long conversations go: one with more than ``most`` rows or ``most_bytes`` is no single group. Its first occurrences are
aggregates, its rows are ranged by (turn, role, text) over many tasks, each task parses its run from every stack top, the runs are put
together from these summaries, and the edits are joined to the texts row by row. All others are parsed whole, one after the other.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, partitions, prepared, stored

# fixed values: the grammar, what each edit costs, and the roles that edits give
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "Pua"), ("P", "ua"))
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
ROLES = {"u": "user", "a": "assistant"}
START = 0
BLOCK = 512
SPACE = r"\x20\x09-\x0D"


class Automaton:
    """LR tables of a left-recursive grammar without nullable symbols but the start symbol, whose rules come first."""

    def __init__(self, rules=GRAMMAR):
        heads = {h for h, _ in rules}

        def closure(items):
            items = set(items)
            while True:
                more = {(r, 0) for rule, dot in items for r, (h, _) in enumerate(rules) if rules[rule][1][dot:dot + 1] == h} - items
                if not more:
                    return frozenset(items)
                items |= more

        first = closure((r, 0) for r, (h, _) in enumerate(rules) if h == rules[0][0])
        states, self.shift, self.goto, self.done = [first], {}, {}, []
        for s in states:
            self.done.append([r for r, dot in s if dot == len(rules[r][1])])
            for symbol in sorted({rules[r][1][dot] for r, dot in s if dot < len(rules[r][1])}):
                to = closure((r, dot + 1) for r, dot in s if rules[r][1][dot:dot + 1] == symbol)
                if to not in states:
                    states.append(to)
                (self.goto if symbol in heads else self.shift)[states.index(s), symbol] = states.index(to)
        self.rules, self.start = rules, rules[0][0]
        # a state that holds nothing but one finished rule is left at once
        self.eager = {i for i, s in enumerate(states) if len(s) == 1 and self.done[i] and rules[self.done[i][0]][0] != self.start}
        self.accepting = {i for i, d in enumerate(self.done) if any(rules[r][0] == self.start for r in d)}
        # a stack for each top; left recursion keeps all stacks finite
        self.stacks = {START: (START, None)}
        for node in (queue := [self.stacks[START]]):
            for symbol in sorted({c for _, c in self.shift}):
                new = self.step(node, symbol)
                if new and new not in queue:
                    self.stacks.setdefault(new[0], new)
                    queue.append(new)

    def step(self, node, symbol):
        """The stack (state, stack below) after a shift and the reductions it completes; None if the symbol cannot follow."""
        to = self.shift.get((node[0], symbol))
        if to is None:
            return None
        node = (to, node)
        while node[0] in self.eager:
            head, body = self.rules[self.done[node[0]][0]]
            for _ in body:
                node = node[1]
            node = (self.goto[node[0], head], node)
        return node


def _automaton() -> Automaton:
    held = memo("role automaton")
    return held["it"] if "it" in held else held.setdefault("it", Automaton())


def _offer(tops, cost, audit, node):
    old = tops.get(node[0])
    if old is None or (cost, audit) < old[:2]:
        tops[node[0]] = cost, audit, node
        return True
    return False


def _inserted(lr, tops):
    """All stack tops after any number of insertions."""
    tops, queue = dict(tops), list(tops)
    for state in queue:
        cost, audit, node = tops[state]
        for symbol in ROLES:
            new = lr.step(node, symbol)
            if new and _offer(tops, cost + INSERT, audit + "I", new):
                queue.append(new[0])
    return tops


def _block(kinds: str, state: int) -> dict[int, tuple[int, str]]:
    """(cost, audit) of each stack top reached over ``kinds`` from one; kinds are D (to be deleted) and initials, upper case if truncated."""
    held = memo("parsed roles")
    if (kinds, state) in held:
        return held[kinds, state]
    lr = _automaton()
    tops = {state: (0, "", lr.stacks[state])}
    for kind in kinds:
        new = {}
        extra, initial = (TRUNCATED if kind.isupper() else 0), kind.lower()
        for cost, audit, node in _inserted(lr, tops).values():
            _offer(new, cost + DELETE, audit + "D", node)
            if kind != "D":
                if kept := lr.step(node, initial):
                    _offer(new, cost + extra, audit + "K", kept)
                for symbol in ROLES:
                    if other := lr.step(node, symbol):
                        _offer(new, cost + REROLE + extra, audit + "R", other)
        tops = new
    out = {s: (cost, audit) for s, (cost, audit, _) in tops.items()}
    if len(kinds) <= 32:
        if len(held) > 50_000:
            held.clear()
        held[kinds, state] = out
    return out


def _joined(left: dict, right) -> dict:
    """Ways over one stretch and then another; ``right`` gives the second from each stack top."""
    out = {}
    for middle, (cost, audit) in left.items():
        for state, (more, rest) in right(middle).items():
            way = cost + more, audit + rest
            if state not in out or way < out[state]:
                out[state] = way
    return out


def _ways(kinds: str, state: int) -> dict[int, tuple[int, str]]:
    """As ``_block`` for any length: block by block, and what all ways agree on is set aside."""
    if len(kinds) <= BLOCK:
        return _block(kinds, state)
    ways, sure = {state: (0, "")}, []
    for i in range(0, len(kinds), BLOCK):
        part = kinds[i:i + BLOCK]
        ways = _joined(ways, lambda s: _block(part, s))  # noqa: B023
        agreed = os.path.commonprefix([a for _, a in ways.values()])
        sure.append(agreed)
        ways = {s: (c, a[len(agreed):]) for s, (c, a) in ways.items()}
    begin = "".join(sure)
    return {s: (c, begin + a) for s, (c, a) in ways.items()}


def _closed(ways: dict) -> tuple[int, str, int]:
    """The cheapest way that ends a conversation, with its closing insertions and the stack top before them."""
    lr = _automaton()
    best = None
    for state, (cost, audit) in ways.items():
        for end, (more, rest, _) in _inserted(lr, {state: (0, "", lr.stacks[state])}).items():
            if end in lr.accepting and (best is None or (cost + more, audit + rest) < best[:2]):
                best = cost + more, audit + rest, state
    return best


def cheapest(kinds: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair, of equal ones the audit that is least in ASCII."""
    return _closed(_ways(kinds, START))[:2]


def _next_role(state: int) -> str:
    """What an edit that is no system turn makes of a row when this is the stack top."""
    lr = _automaton()
    return next(r for r in "ua" if lr.step(lr.stacks[state], r))


def _walk(audit: str, kinds: str, role: str):
    """(edit, row or None, role given or None for the row's own) of each edit; ``role`` is what comes next, u or a."""
    at = 0
    for edit in audit:
        if edit == "D":
            yield edit, at, None
        elif edit == "K" and kinds[at] in "sS":
            yield edit, at, None
        else:
            yield edit, None if edit == "I" else at, None if edit == "K" else ROLES[role]
            role = "a" if role == "u" else "u"
        if edit != "I":
            at += 1


def _kind(role: str, fault: str | None) -> str:
    if fault in ("blank", "duplicate"):
        return "D"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return initial.upper() if fault else initial


EDITS = "conv_id {id}, run int, at bigint, i int, turn bigint, was string, fault string, edit string, role string, text string"
_COLUMNS = ["conv_id", "run", "at", "i", "turn", "was", "fault", "edit", "role", "text"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.string()] * 5
_ASCII_SPACE = " \t\n\x0b\x0c\r"


def _fault(text: str) -> str | None:
    last = text.rstrip(_ASCII_SPACE)[-1:]
    return "blank" if not last else None if last in ".!?" else "truncated"


class _Rows:
    """Edit rows on their way out, in record batches of bounded size."""

    def __init__(self, id_type):
        self.id_type, self.rows, self.size = id_type, [], 0

    def add(self, *row):
        self.rows.append(row)
        self.size += len(row[-1] or "")

    def full(self):
        return len(self.rows) >= 5000 or self.size > 8 << 20

    def batch(self):
        columns = list(zip(*self.rows)) or [[]] * len(_COLUMNS)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [self.id_type, *_TYPES])], _COLUMNS)


def _repair(batches):
    """Edits of whole conversations; rows come sorted by conversation, turn, role, text."""
    out, name, held = None, None, []

    def edits():
        seen, faults = set(), []
        for _, role, text in held:
            fault = _fault(text)
            if fault != "blank" and (role, text) in seen:
                fault = "duplicate"
            seen.add((role, text))
            faults.append(fault)
        kinds = "".join(_kind(role, fault) for (_, role, _), fault in zip(held, faults))
        at = 0
        for i, (edit, row, given) in enumerate(_walk(cheapest(kinds)[1], kinds, "u")):
            if row is None:
                out.add(name, 0, at, i, None, None, None, edit, given, "")
            else:
                turn, role, text = held[row]
                at = row + 1
                out.add(name, 0, row, i, turn, role, faults[row], edit, given or role, text)

    for batch in batches:
        out = out or _Rows(batch.column(0).type)
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and conv != name:
                edits()
                held = []
                if out.full():
                    yield out.batch()
            name = conv
            held.append(row)
    if held:
        edits()
    if out and out.rows:
        yield out.batch()


_RUN = "conv_id {id}, run int, at bigint, turn bigint, role string, text string, n bigint, fault string, kinds string, ways string"


def _runs(batches):
    """Rows of long conversations with their places, and for each run its kinds and the ways over it from every stack top."""
    run, name, at, kinds, ids = TaskContext.get().partitionId(), None, 0, [], None

    def summary():
        whole = "".join(kinds)
        ways = {s: _ways(whole, s) for s in sorted(_automaton().stacks)}
        return pa.RecordBatch.from_arrays(
            [pa.array([name], ids), pa.array([run], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
             pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.array([whole]), pa.array([json.dumps(ways)])], names)

    names = ["conv_id", "run", "at", "turn", "role", "text", "n", "fault", "kinds", "ways"]
    for batch in batches:
        ids, places = batch.column(0).type, []
        for conv, role, n, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "n", "fault"))):
            if kinds and conv != name:
                yield summary()
                kinds, at = [], 0
            name = conv
            places.append(at)
            kinds.append(_kind(role, fault) + "D" * (n - 1))
            at += n
        k = batch.num_rows
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([run] * k, pa.int32()), pa.array(places, pa.int64()),
                                          *(batch.column(c) for c in ("turn", "role", "text", "n", "fault")), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], names)
    if kinds:
        yield summary()


_CHOSEN = "conv_id {id}, run int, at bigint, i int, edit string, given string"
_CHUNK = 50_000


def _chosen(held):
    """(run, at, i, edit, role given) of each edit over all ``held`` runs (run, kinds, ways), in order."""
    ahead = [{START: (0, "")}]
    for _, _, ways in held:
        joined = _joined(ahead[-1], lambda s: ways[s])  # noqa: B023
        agreed = os.path.commonprefix([a for _, a in joined.values()])
        ahead.append({s: (c, a[len(agreed):]) for s, (c, a) in joined.items()})
    state = _closed(ahead[-1])[2]
    closing, parts = _closed({state: (0, "")})[1], []
    to = state
    for before, (run, kinds, ways) in zip(reversed(ahead[:-1]), reversed(held)):
        came = min((c + ways[s][to][0], a + ways[s][to][1], s) for s, (c, a) in before.items() if to in ways[s])[2]
        parts.append((run, kinds, 0, ways[came][to][1], came))
        to = came
    run, kinds, _ = held[-1]
    for run, kinds, at, audit, came in [*reversed(parts), (run, "", len(kinds), closing, state)]:
        for i, (edit, row, given) in enumerate(_walk(audit, kinds, _next_role(came))):
            at = at if row is None else row
            yield run, at, i, edit, given
            at += row is not None


def _assemble(batches):
    """Edits of long conversations from the summaries of their runs, which come sorted by conversation and run."""
    ids, name, held = None, None, []

    def edits():
        chosen = _chosen(held)
        while rows := list(itertools.islice(chosen, _CHUNK)):
            types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), ids), *(pa.array(c, t) for c, t in zip(zip(*rows), types))],
                                             ["conv_id", "run", "at", "i", "edit", "given"])

    for batch in batches:
        ids = batch.column(0).type
        for conv, run, kinds, ways in zip(*(c.to_pylist() for c in batch.columns)):
            if held and conv != name:
                yield from edits()
                held = []
            name = conv
            held.append((run, kinds, {int(s): {int(t): tuple(w) for t, w in to.items()} for s, to in json.loads(ways).items()}))
    if held:
        yield from edits()


def _matched(left: DataFrame, right: DataFrame, *columns: str, only=None) -> DataFrame:
    """``left`` with what ``right`` has for these columns, nulls matching nulls."""
    other = right.select(*(F.col(c).alias(f"_{c}") for c in columns), *(c for c in right.columns if c not in columns))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns] + ([] if only is None else [only])
    return left.join(other, functools.reduce(lambda a, b: a & b, same), "left").drop(*(f"_{c}" for c in columns))


def _long(rows: DataFrame, most: int) -> DataFrame:
    """Edits of conversations of any length, none of which is a group of its own anywhere."""
    spark, id_type = rows.sparkSession, rows.schema["conv_id"].dataType.simpleString()
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(f"[.!?][{SPACE}]*\\z")
    each = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).withColumn("digest", F.sha2("text", 256)), "turns")
    first = each.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("none"))
    first = first.select("conv_id", "role", "digest", F.expr("if(none, null, least)").alias("turn"), F.lit(True).alias("first"))
    marked = _matched(each, first, "conv_id", "role", "digest", "turn").select(
        "conv_id", "turn", "role", "text", "n",
        F.when(blank, "blank").when(F.col("first").isNull(), "duplicate").when(cut, "truncated").alias("fault"))
    order = ["conv_id", "turn", "role", "text"]
    runs = partitions(spark, each.count(), 100_000)
    placed = stored(marked.repartitionByRange(runs, *order).sortWithinPartitions(*order).mapInArrow(_runs, _RUN.format(id=id_type)), "runs")
    chosen = (placed.filter("kinds IS NOT NULL").select("conv_id", "run", "kinds", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "run")
              .mapInArrow(_assemble, _CHOSEN.format(id=id_type)))
    copies = placed.filter("kinds IS NULL").withColumn("c", F.expr("explode(sequence(0L, n - 1))")).select(
        "conv_id", "run", (F.col("at") + F.col("c")).alias("at"), "turn", F.col("role").alias("was"), "text",
        F.expr("if(c > 0 AND NOT fault <=> 'blank', 'duplicate', fault)").alias("fault"))
    found = _matched(chosen, copies, "conv_id", "run", "at", only=F.col("edit") != "I")
    return found.select("conv_id", "run", "at", "i", "turn", "was", "fault", "edit",
                        F.coalesce("given", "was").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _rows(turns: DataFrame) -> DataFrame:
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), one_space("role"), one_space("text"))


def _edited(turns: DataFrame, most: int, most_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Edits of short conversations, each in one partition and in order, and those of long ones in no order."""
    prepared(turns.sparkSession)
    rows = _rows(turns)
    sizes = stored(rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.expr("octet_length(text) + octet_length(role)")).alias("b")), "sizes")
    total = sizes.agg(F.sum("n"), F.sum("b")).first()
    # at most a million names pass either bound, so they may be broadcast
    bounds = [max(low, -(-(t or 0) // 1_000_000)) for low, t in zip((most, most_bytes), total)]
    long = sizes.filter((F.col("n") > bounds[0]) | (F.col("b") > bounds[1])).select("conv_id")
    order = ["conv_id", "turn", "role", "text"]
    repair = lambda df: df.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _repair, EDITS.format(id=rows.schema["conv_id"].dataType.simpleString()))
    if not long.limit(1).count():
        return repair(rows), None
    names = F.broadcast(long.withColumnRenamed("conv_id", "_long"))
    apart = lambda how: rows.join(names, rows["conv_id"].eqNullSafe(names["_long"]), how)
    return repair(apart("left_anti")), _long(apart("left_semi"), most)


def repair(turns: DataFrame, most: int = 10_000, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per edit: conv_id, (run, at, i) which order the edits of a conversation, turn, was (the role before), fault (blank, duplicate,
    truncated or null: a row's first), edit (Keep, Rerole, Delete or Insert by its initial), role and text.

    ``turns`` has conv_id, turn, role and text; other columns are not looked at. Rows of a conversation are taken by (turn, role, text), null
    turns first; null roles and texts are one space, so the texts are blank; null conv_ids are one conversation. Blank rows and those
    whose role and text came earlier, repeated rows among them, must go; rows without a closing [.!?] may stay at a price. An empty table
    gives no rows.
    """
    short, long = _edited(turns, most, most_bytes)
    return short if long is None else short.union(long)


_REPORT = ("conv_id {id}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
           "repaired_sha256 string")


def _report(batches):
    """Figures of each conversation from its edits in order; texts go through one by one."""
    state, done, ids = None, [], None

    def end():
        turns = state["turns"]
        return (state["name"], turns[1] - turns[0] + 1 - turns[2] if turns else 0, *(state[f] for f in ("blank", "duplicate", "truncated", "illegal", "cost")),
                "".join(state["audit"]), state["hash"].hexdigest())

    def table():
        types = [ids] + [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], [c.split()[0] for c in _REPORT.split(", ")])

    for batch in batches:
        ids = batch.column("conv_id").type
        for name, _, _, _, turn, was, fault, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or name != state["name"]:
                if state is not None:
                    done.append(end())
                state = {"name": name, "turns": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [],
                         "hash": hashlib.sha256(), "lines": 0, "was": None}
            state["audit"].append(edit)
            if edit != "I":
                if fault:
                    state[fault] += 1
                if state["was"] is not None and state["was"][:1] + was[:1] not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["was"] = was
                if turn is not None:
                    t = state["turns"]
                    state["turns"] = [turn, turn, 1] if t is None else [t[0], turn, t[2] + (turn != t[1])]
            state["cost"] += DELETE if edit == "D" else (REROLE if edit == "R" else INSERT if edit == "I" else 0) + (TRUNCATED if fault == "truncated" else 0)
            if edit != "D":
                state["hash"].update((("\n" if state["lines"] else "") + role + ":" + text).encode())
                state["lines"] += 1
        if len(done) >= 1000:
            yield table()
            done = []
    if state is not None:
        done.append(end())
    if done:
        yield table()


def report(turns: DataFrame, most: int = 10_000, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per conversation of ``turns``: gaps in the turns, counts of faults, adjacent roles out of order, and the cheapest repair's cost,
    audit and digest of the repaired ``role:text`` lines. Cases are those of ``repair``.

    Edits of short conversations are summed up where they are made, without another shuffle. Those of a long one pass a task in order, as a
    stream that is never held: SHA-256 of a whole text cannot be put together from parts.
    """
    short, long = _edited(turns, most, most_bytes)
    schema = _REPORT.format(id=turns.schema["conv_id"].dataType.simpleString())
    out = short.mapInArrow(_report, schema)
    if long is not None:
        out = out.union(long.repartition("conv_id").sortWithinPartitions("conv_id", "run", "at", "i").mapInArrow(_report, schema))
    return out


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by crc32(`conv_id:turn`) % 20, nulls as one space: 0 drops a row, 1 empties its text, 2 takes out its [.!?],
    3 repeats it, 4 makes its role user."""
    rows = _rows(turns)
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    fate = F.crc32(F.encode(name, "UTF-8")) % 20
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumn("fate", fate).filter("fate <> 0").withColumn("copy", F.explode(F.expr("if(fate = 3, array(1, 2), array(1))")))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def damage_report(turns: DataFrame, most: int = 10_000, most_bytes: int = 32 << 20) -> DataFrame:
    """``report`` of the ``damaged`` rows with every conversation of ``turns``; one that lost all rows has zeros, an empty audit and the
    digest of an empty text."""
    found = report(damaged(turns), most, most_bytes)
    every = turns.select(F.col("conv_id").alias("_every")).distinct()
    joined = every.join(found, every["_every"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select(F.col("_every").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
