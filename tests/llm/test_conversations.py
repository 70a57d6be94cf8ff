"""Conversation repair against plain enumeration, its SQL and its awkward rows."""

import hashlib
import itertools
import random
import zlib

import duckdb
import pytest
from tests.conftest import SF, SF_SMALL

from fuelspark.llm import conversations
from fuelspark.llm.queries import ORACLE, QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost double, audit string, copy int, again string, conversation int"
CLASH = (0.5, "x", 3, "y", 9)
SPACE = " \t\n\x0b\x0c\r"


def fault_of(role, text, seen):
    if not text.strip(SPACE):
        return "blank"
    return "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else None


def accepted(roles):
    rest = roles[1:] if roles[:1] == "s" else roles
    return not roles or (len(rest) > 0 and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def enumerate_repairs(rows):
    """The least (cost, letters) and the roles of all edits with up to two inserts at a place."""
    seen, kinds = set(), []
    for role, text in rows:
        kinds.append(fault_of(role, text, seen))
        seen.add((role, text))
    best = None
    gap = ["", "u", "a", "ua", "au"]
    for inserts in itertools.product(gap, repeat=len(rows) + 1):
        for moves in itertools.product(*[["D"] if k in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for k in kinds]):
            roles, letters, cost = inserts[0], "I" * len(inserts[0]), 2 * len(inserts[0])
            for (role, _), kind, move, more in zip(rows, kinds, moves, inserts[1:], strict=True):
                roles += (role[:1] or "?") if move == "K" else move[1:] if move[0] == "R" else ""
                cost += {"K": 0, "R": 2, "D": 3}[move[0]] + (kind == "truncated" and move != "D") + 2 * len(more)
                letters += move[0] + "I" * len(more)
                roles += more
            if accepted(roles) and (best is None or (cost, letters) < best):
                best = (cost, letters)
    return best


def best_strings(rows):
    """Least cost and letters, by whole strings for each state."""
    seen, paths = set(), {"": (0, "")}
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(paths):
        out = dict(paths)
        for _ in range(3):
            for state, (cost, letters) in list(out.items()):
                to = "a" if state == "u" else "u"
                out[to] = min(out.get(to, (cost + 2, letters + "I")), (cost + 2, letters + "I"))
        return out

    for role, text in rows:
        kind, new = fault_of(role, text, seen), {}
        seen.add((role, text))
        late = kind == "truncated"
        for state, (cost, letters) in inserted(paths).items():
            moves = [(state, cost + 3, "D")]
            if kind not in ("blank", "duplicate"):
                moves.append(("a" if state == "u" else "u", cost + 2 + late, "R"))
                if role[:1] and role[:1] in follows[state]:
                    moves.append((role[:1], cost + late, "K"))
            for to, price, letter in moves:
                new[to] = min(new.get(to, (price, letters + letter)), (price, letters + letter))
        paths = new
    return min(v for k, v in inserted(paths).items() if k in ("", "a"))


def repaired(rows, letters):
    """The text after the edits, by their letters alone."""
    stays, at, k, out = len(letters.replace("D", "")), 0, 0, []
    for x in letters:
        at += x != "D"
        if x != "D":
            role = rows[k][0] if x == "K" else "user" if (at + stays) % 2 else "assistant"
            out.append(f"{role}:{'' if x == 'I' else rows[k][1]}")
        k += x != "I"
    return "\n".join(out)


def random_rows(rng, n):
    roles = rng.choice([["user", "assistant"], ["user", "assistant", "system"], ["user", "assistant", "system", "tool", ""], ["tool"]])
    return [(rng.choice(roles), rng.choice(["", " ", "yes.", "no", "why?", f"t{rng.randrange(9)}.", f"u{rng.randrange(9)}"])) for _ in range(n)]


def edits_of(rows):
    work, seen = conversations.Repair(), set()
    for k, (role, text) in enumerate(rows):
        work.add(k, role, text, (role, text) in seen)
        seen.add((role, text))
        list(work.settle())
    list(work.finish())
    return work


def test_cheapest_of_all_edits():
    rng = random.Random(3)
    for case in range(60):
        rows = random_rows(rng, case % 4)
        work = edits_of(rows)
        assert (sum(r[4] for r in work.ready), "".join(r[2][0] for r in work.ready)) == enumerate_repairs(rows) == best_strings(rows)


def test_long_conversations_and_bounded_memory():
    rng = random.Random(5)
    for _ in range(300):
        rows = random_rows(rng, rng.randrange(60))
        work = edits_of(rows)
        cost, letters = best_strings(rows)
        assert (sum(r[4] for r in work.ready), "".join(r[2][0] for r in work.ready)) == (cost, letters)
        assert "\n".join(f"{r[6]}:{r[7]}" for r in work.ready if r[2] != "Delete") == repaired(rows, letters)
    work, most = conversations.Repair(), 0
    for k in range(50_000):
        work.add(k, rng.choice(["user", "assistant"]), rng.choice(["", f"{k}.", f"{k}"]), False)
        list(work.settle())
        work.ready.clear()
        most = max(most, len(work.rows))
    assert most < 200 and len(work.parent) < 1000


def test_rows_that_never_resolve_wait_outside_memory(monkeypatch):
    monkeypatch.setattr(conversations, "PENDING_BYTES", 5_000)
    rng = random.Random(9)
    for head, tail in (([], []), ([("user", "a.")], [("assistant", "b.")]), ([("system", "s")], random_rows(rng, 20))):
        rows = [*head, *[("tool", f"{k} " + "x" * (k % 90) + ".") for k in range(2_001)], *tail]
        work, most, waiting, seen = conversations.Repair(), 0, 0, set()
        for k, (role, text) in enumerate(rows):
            work.add(k, role, text, (role, text) in seen)
            seen.add((role, text))
            most, waiting = max(most, work.rows.bytes), max(waiting, len(work.rows))
            list(work.settle())
        list(work.finish())
        cost, letters = best_strings(rows)
        assert (sum(r[4] for r in work.ready), "".join(r[2][0] for r in work.ready)) == (cost, letters)
        assert "\n".join(f"{r[6]}:{r[7]}" for r in work.ready if r[2] != "Delete") == repaired(rows, letters)
        assert most <= 5_000 and waiting > 1_000 and len(work.rows) == 0


def expected(table):
    """Digests of the contract out of rows (conv_id, turn, role, text)."""
    held = {}
    for conv, turn, role, text in table:
        out = held.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        if kind:
            out.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    result = []
    for conv, rows in held.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        plain, seen, kinds = [r[1:] for r in rows], set(), []
        for r in plain:
            kinds.append(fault_of(*r, seen))
            seen.add(r)
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(plain))
        cost, letters = best_strings(plain)
        result.append((conv, gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, letters, hashlib.sha256(repaired(plain, letters).encode()).hexdigest()))
    return sorted(result, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").collect()]
    assert rows_of(QUERIES["op11_conversation_repair"](spark, SF_SMALL)) == expected(table)


def test_query_and_sql(spark):
    got = QUERIES["op11_conversation_repair"](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(ORACLE["op11_conversation_repair"])
    assert got.columns == want.columns and rows_of(got) == sorted(want.fetchall(), key=str)


def awkward():
    rng = random.Random(8)
    long = "a word and " * 40_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 1, "assistant", long + "."), (2, None, None, None), (2, None, "user", "x."), (2, 3, "user", "x."), (3, 5, "", ""), (None, 1, "user", "hi."), (None, None, "assistant", "Ünï 日本."), (4, 9, "unknown", "who."), (4, 9, "user", "who."), (4, 9, "user", "who.")]
    for conv in range(10, 60):
        rows += [(conv, rng.choice([None, *range(12)]), *r) for r in random_rows(rng, rng.randrange(1, 30))]
    rows += [(70, k // 3, "user", f"a{k % 50}.") for k in range(900)]
    return rows


@pytest.mark.parametrize("seen_rows", [None, 20, 0])
def test_awkward_tables(spark, seen_rows):
    """Nulls, ties, repeated rows, very long texts, clashing names; repeated rows told by the task and by Spark."""
    rows = awkward()
    df = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    assert rows_of(conversations.repaired_digests(df, seen_rows)) == expected(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repaired_digests(empty, seen_rows).count() == 0 and conversations.repair(empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 9] * 3, SCHEMA)
    assert rows_of(conversations.repaired_digests(nulls, seen_rows)) == expected([(None,) * 4] * 3)


def test_edits_are_rows(spark):
    df = spark.createDataFrame([("c", 1, "assistant", "So."), ("c", 2, "tool", "cut")], "conv_id string, turn int, role string, text string")
    got = [tuple(r) for r in conversations.repair(df).orderBy("seq").collect()]
    assert got == [("c", 0, None, "Insert", None, 2, None, "user", ""), ("c", 1, 1, "Keep", None, 0, "assistant", "assistant", "So."), ("c", 2, 2, "Delete", "truncated", 3, "tool", None, None)]
