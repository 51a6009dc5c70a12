"""Conversation repair against an exhaustive search, and against a plain walk of a long one."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.llm.conversations import damaged, repair_conversations, repaired_turns, with_all

WS = "\x20\x09\x0a\x0b\x0c\x0d"
LEGAL = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(place.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    """Sorted rows of one conversation with the first fault of each."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{r[2]}\0{r[3]}".encode()).hexdigest()))
    out, seen = [], set()
    for _, turn, role, text in rows:
        bare = text.rstrip(WS)
        out.append((turn, role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired turns) over all edits, at most two inserts between rows."""
    best = None

    def go(k, cost, audit, kept, inserted):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in kept)
        if not re.fullmatch("s?(ua)*u?", initials) or best and cost > best[0]:
            return  # nothing that follows can mend it
        if k == len(rows) and LEGAL.fullmatch(initials):
            best = min(best or (cost, audit, kept), (cost, audit, kept))
        if inserted < 2 and len(kept) < 9:
            for role in ("user", "assistant"):
                go(k, cost + 5, audit + "I", kept + [(role, "")], inserted + 1)
        if k < len(rows):
            _, role, text, fault = rows[k]
            go(k + 1, cost + 2, audit + "D", kept, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(k + 1, cost + more, audit + "K", kept + [(role, text)], 0)
                for to in ("user", "assistant"):
                    go(k + 1, cost + 1 + more, audit + "R", kept + [(to, text)], 0)

    go(0, 0, "", [], 0)
    return best


def report(conv, rows, solve):
    rows = faults(rows)
    cost, audit, kept = solve(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (conv, gaps, *(sum(r[3] == f for r in rows) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
TEXTS = ["Yes.", "No!", "Why?", "cut off", "", "  \n", None, "Yes. \t", "日本。", "ok?\x0b"]


def conversations(rng, n):
    out = []
    for conv in range(n):
        conv = None if conv == 3 else conv
        for turn in range(rng.randint(1, 4)):
            out.append((conv, rng.choice([turn, turn, turn + 1, None]), rng.choice(ROLES), rng.choice(TEXTS)))
    return out


def test_equals_an_exhaustive_search(spark):
    rng = random.Random(5)
    rows = conversations(rng, 120)
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, digest int")
    got = with_all(repair_conversations(damaged(df)), df).collect()
    harmed = damage(rows)
    want = [report(c, [r for r in harmed if r[0] == c], exhaustive) for c in {r[0] for r in rows}]
    key = lambda r: str(r[0])
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def plain(rows):
    """The same minimum, one turn after the other."""
    grammar = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names, now = {"u": "user", "a": "assistant"}, {"e": (0, "", ())}

    def inserts(states):
        for _ in range(2):
            for state, (cost, audit, kept) in list(states.items()):
                for role, to in grammar[state].items():
                    if role in names:
                        new = (cost + 5, audit + "I", (kept, (names[role], "")))
                        states[to] = min(states.get(to, new), new, key=lambda x: x[:2])
        return states

    for _, role, text, fault in rows:
        after = {}
        put = lambda to, new: after.__setitem__(to, min(after.get(to, new), new, key=lambda x: x[:2]))  # noqa: E731, B023
        for state, (cost, audit, kept) in now.items():
            put(state, (cost + 2, audit + "D", kept))
        if fault not in ("blank", "duplicate"):
            for state, (cost, audit, kept) in inserts(dict(now)).items():
                for initial, to in grammar[state].items():
                    more = 5 if fault == "truncated" else 0
                    if role[:1] == initial:
                        put(to, (cost + more, audit + "K", (kept, (role, text))))
                    elif initial in names:
                        put(to, (cost + 1 + more, audit + "R", (kept, (names[initial], text))))
        now = after
    cost, audit, kept = min((v for s, v in inserts(now).items() if s in "ea"), key=lambda x: x[:2])
    lines = []
    while kept:
        kept, line = kept
        lines.append(line)
    return cost, audit, lines[::-1]


def test_plain_walk_is_exhaustive():
    rng = random.Random(9)
    for _ in range(40):
        rows = faults([(1, k, rng.choice([r for r in ROLES if r is not None]), rng.choice([t for t in TEXTS if t is not None])) for k in range(rng.randint(0, 4))])
        a, b = plain(rows), exhaustive(rows)
        assert (a[0], a[1], a[2]) == (b[0], b[1], list(b[2]))


def test_a_long_conversation_is_walked_in_segments(spark, tmp_path):
    rng = random.Random(6)
    rows = [(1, k // 2 if k % 50 == 0 else k, rng.choice(ROLES[:6]), f"t{k % 4000}" + rng.choice([".", ".", "?", ""])) for k in range(20_000)]
    rows += [(2, k, ("user", "assistant")[k % 2], "x" * 400_000 + ".") for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r) for r in repair_conversations(df.repartition(5)).collect()}
    assert got == {c: report(c, [r for r in rows if r[0] == c], plain) for c in (1, 2)}
    turns = repaired_turns(df, str(tmp_path / "held")).where("conv = '+1'").orderBy("unit", "place").select("role", "text").collect()
    assert [tuple(r) for r in turns] == plain(faults([r for r in rows if r[0] == 1]))[2]


@pytest.mark.parametrize("rows", [[], [(7, None, None, None)]])
def test_empty_and_null(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [tuple(r) for r in with_all(repair_conversations(df), df).collect()]
    assert got == [(7, 0, 1, 0, 0, 0, 2, "D", hashlib.sha256(b"").hexdigest()) for _ in rows]


def test_nothing_left_after_damage(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, gone, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert damaged(df).isEmpty()
    got = with_all(repair_conversations(damaged(df)), df).select("*", F.lit(1)).collect()
    assert [tuple(r)[:-1] for r in got] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
