"""Conversation repair against a search over all edits."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from moundflow.llm import conversation as cv

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, `a.b` string, conv string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        role = "user" if case == 4 else role
        out += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def cheapest(rows):
    """Dijkstra over (row, roles so far): least cost, then least letters."""
    ok = re.compile(r"s?(ua)*u?\Z")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit, out
        tail = (i, roles[-1:])
        if tail in seen:
            continue
        seen.add(tail)

        def go(more, letter, j, role, add):
            if ok.match(roles + role):
                heapq.heappush(heap, (cost + more, audit + letter, j, roles + role, out + add))
        for r, name in (("u", "user"), ("a", "assistant")):
            go(5, "I", i, r, ((name, ""),))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                stays = 5 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go(stays, "K", i + 1, role[0], ((role, text),))
                for r, name in (("u", "user"), ("a", "assistant")):
                    go(1 + stays, "R", i + 1, r, ((name, text),))


def brute(rows):
    """Counts of one conversation's rows (turn, role, text), in order."""
    seen, faulty, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
        if fault:
            counts[fault] += 1
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    firsts = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:]))
    cost, audit, out = cheapest(faulty)
    return (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def expected(rows):
    by = {r[0]: [] for r in rows}
    for conv, turn, role, text in damaged(rows):
        by[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:32])
    return {c: brute(sorted(x, key=order)) for c, x in by.items()}


def got_of(df):
    return {r["conv_id"]: tuple(r[c] for c in cv.COUNTS) for r in cv.digest(df).collect()}


def conversations(n, seed=1):
    rnd, rows = random.Random(seed), []
    texts = ["Yes.", "No", "Why?", " \t", "", None, "A long answer.\n", "x" * 50 + ".", "  ok!", "é…", "one. two"]
    for c in range(n):
        for t in range(rnd.randrange(1, 9)):
            rows.append((c, t * rnd.choice([1, 1, 2]), rnd.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rnd.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)


def test_edits_are_the_least(spark):
    rows = conversations(250)
    rows += [(9000, None, "user", "Null turns."), (9000, None, "assistant", "Two."), (9000, 4, "user", "Later."),
             (None, 1, "user", "No id."), (None, 2, "assistant", "No id."), (9001, None, None, None), (2**60 + 1, 1, "user", "Big id.")]
    rows += [(9002, 5, "user", "Same.")] * 4 + [(9002, 6, "assistant", "Same.")] * 3
    assert got_of(frame(spark, rows)) == expected(rows)


def test_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert got_of(df) == expected(rows)


def test_empty_and_all_dropped(spark):
    assert got_of(frame(spark, [])) == {}
    gone = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    assert got_of(frame(spark, [(3, gone, "user", "Hi.")])) == {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_giant_conversation_spills(spark):
    """One conversation holds most rows and spans many batches; pointers go to a file."""
    rnd, rows = random.Random(2), []
    for t in range(6000):
        rows.append((1, t, "user" if t % 2 == 0 else rnd.choice(["assistant", "assistant", "tool"]), rnd.choice(["So.", "Cut", f"Turn {t}."])))
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for c in range(2, 8) for t in range(4)]
    df = frame(spark, rows)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = cv.report(cv.repair(df, held=64)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, role, text))
    assert {r["conv"]: tuple(r[c] for c in cv.COUNTS) for r in got} == {c: brute(x) for c, x in want.items()}


def test_repair_gives_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye."), (1, 4, "assistant", "Bye")]
    got = [(r.seq, r.edit, r.fault, r.new_role, r.text) for r in cv.repair(frame(spark, rows)).orderBy("seq").collect()]
    cost, audit, out = cheapest([(r, t, "truncated" if t == "Bye" else None) for _, _, r, t in rows])
    assert "".join(x[1] for x in got) == audit and [(x[3], x[4]) for x in got if x[1] != "D"] == list(out)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 200])
def test_backpointers(n):
    p = cv.Backpointers(64)
    for i in range(n):
        p.push(i)
    assert list(p.pop_all()) == list(range(n))[::-1]
