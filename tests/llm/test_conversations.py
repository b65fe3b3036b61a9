import hashlib
import heapq
import random
import re
import zlib

import pytest

from codequarry.llm import conversations

LEGAL = re.compile(r"(s?(ua)+)?")
VIABLE = re.compile(r"s?(ua)*u?")
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def brute_repair(rows):
    """All scripts in order of cost, without merging: (cost, audit, lines) of the cheapest, ties by audit."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if at == len(rows) and LEGAL.fullmatch(roles) and (best is None or audit < best[1]):
            best = cost, audit, lines
        out = [(cost + 3, audit + "I", at, roles + r[0], (*lines, f"{r}:")) for r in ("user", "assistant")]
        if at < len(rows):
            role, text, fault = rows[at]
            out.append((cost + 4, audit + "D", at + 1, roles, lines))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                out.append((cost + more, audit + "K", at + 1, roles + (role[:1] or "?"), (*lines, f"{role}:{text}")))
                out += [(cost + 3 + more, audit + "R", at + 1, roles + r[0], (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
        for o in out:
            if VIABLE.fullmatch(o[3]):
                heapq.heappush(heap, o)
    return best


def faults(rows):
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
        fault = None
        if not SOLID.search(text):
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        elif SOLID.findall(text)[-1] not in ".!?":
            fault = "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute_report(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    marked = faults(rows)
    cost, audit, lines = brute_repair(marked)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    counts = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS n", "'x' AS edit", "2 AS run").repartition(3)


def by_conversation(rows):
    out = {}
    for c, *row in rows:
        out.setdefault(c, []).append(row)
    return out


def random_rows(rng, conversations=60):
    rows = []
    for c in [*range(conversations), None]:
        for _ in range(rng.randint(1, 5)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 4, 7]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", None, "", "User"]),
                         rng.choice(["Yes.", "No!", "Well, ", "a b\n", " \t", "", None, "Why? \n", "é", "End.\x0b"])))
    return rows


@pytest.mark.parametrize("most", [10_000, 2, 0])
def test_random(spark, most):
    rows = random_rows(random.Random(most))
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(table(spark, rows), most=most).collect()}
    want = {c: brute_report(r) for c, r in by_conversation(rows).items()}
    assert got == want


def test_edges(spark):
    assert conversations.report(table(spark, [])).collect() == []
    assert conversations.damage_report(table(spark, [])).collect() == []
    long = "x" * 3_000_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    for size in (32 << 20, 1000):
        got = {r.conv_id: tuple(r)[1:] for r in conversations.report(table(spark, rows), most_bytes=size).collect()}
        assert got == {c: brute_report(r) for c, r in by_conversation(rows).items()}


def test_damage(spark):
    rows = [(c, t, random.Random(f"{c}{t}").choice(["user", "assistant", None]), f"T{t}. And? {'.' * (t or 0)}") for c in (*range(40), None) for t in (None, 0, 1, 2)]
    rows += [(1000 + c, 0, "user", "One.") for c in range(60)]
    left = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        left.setdefault(c, [])
        left[c] += [(t, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: brute_report(r) if r else empty for c, r in left.items()}
    got = {r.conv_id: tuple(r)[1:] for r in conversations.damage_report(table(spark, rows)).collect()}
    assert got == want and empty in want.values()


def two_tops(kinds):
    """The cheapest (cost, audit) over long kinds by plain states: nothing yet, after s, after u, after ua."""
    ways = {0: (0, "")}
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def insert(ways):
        for _ in range(3):
            for s, (c, a) in list(ways.items()):
                for r in "ua":
                    if (s, r) in after:
                        ways[after[s, r]] = min(ways.get(after[s, r], (1 << 60, "")), (c + 3, a + "I"))
        return ways

    for k in kinds:
        new = {}
        for s, (c, a) in insert(ways).items():
            offers = [(s, (c + 4, a + "D"))]
            if k != "D":
                more = 3 * k.isupper()
                offers += [(after[s, k.lower()], (c + more, a + "K"))] if (s, k.lower()) in after else []
                offers += [(after[s, r], (c + 3 + more, a + "R")) for r in "ua" if (s, r) in after]
            for t, w in offers:
                new[t] = min(new.get(t, (1 << 60, "")), w)
        ways = new
    ways = insert(ways)
    return min(ways[s] for s in (0, 3) if s in ways)


@pytest.mark.parametrize("letters", ["uaD", "sSuUaAxXD", "x", "uax", "D", "u", "s"])
def test_long_kinds(letters):
    rng = random.Random(letters)
    for n in (0, 1, 5, 511, 512, 513, 3000):
        kinds = "".join(rng.choice(letters) for _ in range(n))
        assert conversations.cheapest(kinds) == two_tops(kinds)


def test_long_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(5, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["Yes.", f"No {t}.", "cut"])) for t in range(4000)]
    rows += [(c, t, "ua"[t % 2] and ["user", "assistant"][t % 2], f"Text {t}!") for c in range(20) for t in range(4)]
    df = table(spark, rows)
    whole = {r.conv_id: tuple(r) for r in conversations.report(df).collect()}
    apart = {r.conv_id: tuple(r) for r in conversations.report(df, most=100).collect()}
    assert whole == apart
    edits = conversations.repair(df, most=100)
    assert edits.filter("conv_id = 5").select("run").distinct().count() > 2
    kinds = "".join(conversations._kind(r, f) for r, _, f in faults([r for r in by_conversation(rows)[5]]))
    assert whole[5][-3:-1] == two_tops(kinds)
