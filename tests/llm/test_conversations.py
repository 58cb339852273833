"""Conversation repair against a plain version: a shortest path over (turn,
state), computed back to front, and a plain damage and report."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from strata.llm import conversations as C
from strata.llm import queries

RNG = random.Random(11)
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NEED = "uuau"
FULL = {"u": "user", "a": "assistant"}


def plain_repair(turns, start=0, goals=(0, 3)):
    """(cost, audit) of turns (initial, must go, truncated)."""
    best = None
    for i in range(len(turns), -1, -1):
        here = {}
        for q in range(4):
            ways = []
            if i == len(turns):
                ways += [(0, "")] * (q in goals)
            else:
                x, must_go, truncated = turns[i]
                ways.append((best[q][0] + 4, "D" + best[q][1]))
                if not must_go:
                    if x in STEP[q]:
                        c, a = best[STEP[q][x]]
                        ways.append((c + 3 * truncated, "K" + a))
                    c, a = best[STEP[q][NEED[q]]]
                    ways.append((c + 3 + 3 * truncated, "R" + a))
            here[q] = min(ways, default=(10 ** 9, ""))
        for _ in range(6):
            for q in range(4):
                c, a = here[STEP[q][NEED[q]]]
                here[q] = min(here[q], (c + 3, "I" + a))
        best = here
    return best[start]


def plain(rows):
    """The contract's columns by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if k == 1:
                text = ""
            if k == 2:
                text = re.sub("[.!?]", "", text)
            if k == 4:
                role = "user"
            left += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in left:
            bare = text.rstrip(" \t\n\x0b\f\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else
                     "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append(((role or " ")[0], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit = plain_repair(turns)
        q, rest, kept = 0, list(left), []
        for e in audit:
            if e != "I":
                _, role, text = rest.pop(0)
            if e == "D":
                continue
            if e != "K":
                role = FULL[NEED[q]]
            kept.append(f"{role}:{'' if e == 'I' else text}")
            q = STEP[q][role[0]]
        numbers = {t for t, _, _ in left if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def query_rows(spark, rows, folder):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).repartition(
        3).write.parquet(f"{folder}/conversations.parquet")
    got = queries.QUERIES["op11_conversation_repair"](spark, f"file://{folder}")
    return {r[0]: tuple(r)[1:] for r in got.collect()}


def test_search_equals_the_plain_path():
    for k in range(400):
        n = RNG.randrange(14) if k % 40 else 90
        turns = [(RNG.choice("suaux t" if RNG.random() < .3 else "ua"), RNG.random() < .15, RNG.random() < .2) for _ in range(n)]
        turns = [(c, g, t and not g) for c, g, t in turns]
        t = C.Turns([(*x, 0) for x in turns])
        assert t.search(0, (0, 3)) == plain_repair(turns)
        if k % 20 == 0:
            ways = {(w["start"], w["end"]): (w["cost"], w["audit"]) for w in t.between_all_states()}
            for q in range(4):
                for r in range(4):
                    want = plain_repair(turns, q, (r,))
                    assert ways.get((q, r)) == (want if want[0] < 10 ** 9 else None)


def test_query_on_planted_conversations(spark, tmp_path):
    text = lambda: RNG.choice(["Yes.", "No!", "Why?", "cut off", " ", "a.b", "end. \t", "Long " * 9 + "."])
    rows = [(c, t, RNG.choice(["user", "assistant"]), f"{t} " * RNG.randrange(2) + text())
            for c in range(60) for t in range(RNG.randrange(1, 12))]
    # one conversation with a third of all rows, over many segments
    rows += [(77, t, RNG.choice(["user", "assistant", "system"]), RNG.choice(["same.", f"turn {t}."])) for t in range(700)]
    rows += [(80, 3, None, None), (80, None, "user", "x."), (80, 9, "", "y."), (None, 1, "user", "no conversation."), (81, None, None, None)]
    rows += [(82, 5, "user", "again.")] * 5 + [(82, 7, "user", "again."), (83, 0, "system", "only.")]
    got = query_rows(spark, rows, tmp_path)
    assert got == plain(rows)


def test_empty_and_dropped(spark, tmp_path):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert query_rows(spark, [(dropped, 0, "user", "x.")], tmp_path / "a") == {dropped: (0, 0, 0, 0, 0, 0, "", empty)}
    assert query_rows(spark, [], tmp_path / "b") == {}


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "Hi."), (1, 2, "user", "So?")], "conv_id long, turn long, role string, text string")
    report, repaired = C.repair(rows)
    assert [tuple(r) for r in report.select("cost", "audit").collect()] == [(6, "IKKI")]
    assert [tuple(t) for r in repaired.orderBy("segment").collect() for t in r.turns] == [
        ("user", ""), ("assistant", "Hi."), ("user", "So?"), ("assistant", "")]
