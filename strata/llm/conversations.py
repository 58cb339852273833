"""Cheapest repair of the turn structure of conversations.

A conversation's turns are read in order; edits keep a turn, give it another
role, delete it or insert an empty one, so that the roles become a system turn
or none and then pairs of a user and an assistant turn, or nothing at all.  The
edits are searched by iterative-deepening A*: depth first in the ASCII order of
the edits' initials (D, I, K, R) under a rising bound of the cost, with a table
of states that are known to fail; so the first path that is accepted is the
cheapest and, of these, the ASCII-least.

Spark sorts all turns by conversation over range partitions.  A task sees most
conversations whole.  Long ones, and those that a partition's border may cut,
become segments of at most ``SEGMENT`` turns: the same search finds the best
edits between every two states of the roles, and the segments of a conversation
are chained.  So no conversation's texts are ever together in one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import cut, prepare, work_path

SEGMENT = 96            # turns that one search covers
TEXT = 1 << 18          # characters of texts in a segment (or one longer turn)
DELETE, ROLE, INSERT, TRUNCATED = 4, 3, 3, 3
SPACE = " \t\n\x0b\f\r"
MARKS = (".", "!", "?")

# states of the roles so far: none, a system turn, open with a user turn, a pair done
NONE, SYSTEM, USER, PAIR = range(4)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
_NEEDED = {NONE: "user", SYSTEM: "user", USER: "assistant", PAIR: "user"}
_INSERTS = {(NONE, USER): 1, (NONE, PAIR): 2, (SYSTEM, USER): 1, (SYSTEM, PAIR): 2, (USER, PAIR): 1, (PAIR, USER): 1}
_LEGAL = {"su", "ua", "au"}
_NEVER = 1 << 60


class Turns:
    """Turns as the search sees them: ``(initial, must_go, truncated, more)``,
    ``more`` being the number of further copies, which must all go."""

    def __init__(self, turns: list[tuple[str, bool, bool, int]]):
        self.turns = turns
        self.least = self._least()

    def _least(self) -> list[int]:
        """A lower bound of the cost from each turn on: what each turn costs by
        itself, and one edit for each of the disjoint neighbours that cannot
        both be kept side by side."""
        n = len(self.turns)
        own, loss = [0] * n, [0] * n      # own cost; what not keeping the turn adds to it
        for i, (c, must_go, truncated, more) in enumerate(self.turns):
            keep = TRUNCATED if truncated else 0
            change = min(DELETE, ROLE + keep)
            own[i] = DELETE * more + (DELETE if must_go else keep if c in ("s", "u", "a") else change)
            loss[i] = change - keep if c in ("s", "u", "a") else 0
        out = [0] * (n + 1)
        after = None                       # the next turn that need not go
        between = 0                        # cost of the turns that must go before it
        for i in range(n - 1, -1, -1):
            out[i] = own[i] + out[i + 1]
            if self.turns[i][1]:
                between += own[i]
                continue
            if after is not None and self.turns[i][0] + self.turns[after][0] not in _LEGAL:
                pair = min(INSERT, loss[i], loss[after])
                out[i] = max(out[i], own[i] + between + own[after] + pair + out[after + 1])
            after, between = i, 0
        return out

    def search(self, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and edits of the cheapest way from ``start`` to one of
        ``goals``, None where there is none."""
        turns, n = self.turns, len(self.turns)
        known: dict[tuple[int, int], int] = {}      # failed with any budget below

        def bound(i: int, q: int) -> int:
            b = known.get((i, q))
            if b is None:
                b = self.least[i]
                if i == n and q not in goals:
                    b = min(INSERT * _INSERTS.get((q, g), _NEVER) for g in goals)
                known[i, q] = b
            return b

        def edits(i: int, q: int):
            # in ASCII order of the initials
            if i < n:
                c, must_go, truncated, more = turns[i]
                gone = "D" * more
                yield "D" + gone, DELETE * (1 + more), i + 1, q
            needed = _NEXT[q, _NEEDED[q][0]]
            yield "I", INSERT, i, needed
            if i < n and not must_go:
                cost = DELETE * more + (TRUNCATED if truncated else 0)
                kept = _NEXT.get((q, c))
                if kept is not None:
                    yield "K" + gone, cost, i + 1, kept
                yield "R" + gone, cost + ROLE, i + 1, needed

        def descend(i: int, q: int, budget: int) -> list[str] | None:
            if i == n and q in goals:
                return []
            least = _NEVER
            for edit, cost, j, r in edits(i, q):
                if cost + bound(j, r) <= budget:
                    rest = descend(j, r, budget - cost)
                    if rest is not None:
                        rest.append(edit)
                        return rest
                least = min(least, cost + bound(j, r))
            known[i, q] = max(known[i, q], least)
            return None

        while (budget := bound(0, start)) < _NEVER:
            found = descend(0, start, budget)
            if found is not None:
                return budget, "".join(reversed(found))
            if known[0, start] >= _worst(turns):
                return None
        return None

    def between_all_states(self) -> list[dict]:
        """The best edits from every state to every other one."""
        out = []
        for q in (NONE, SYSTEM, USER, PAIR):
            for r in range(q if q < PAIR else USER, PAIR + 1):
                found = self.search(q, (r,))
                if found:
                    out.append({"start": q, "end": r, "cost": found[0], "audit": found[1]})
        return out


def _worst(turns) -> int:
    """More than any way costs that exists: all turns go, two come."""
    return sum(DELETE * (1 + t[3]) for t in turns) + 2 * INSERT + 1


def rebuild(turns: list[dict], start: int, audit: str) -> list[dict]:
    """The turns that the edits leave."""
    out, q, at = [], start, 0
    edits = iter(audit)
    for e in edits:
        if e == "I":
            out.append({"role": _NEEDED[q], "text": ""})
        else:
            t = turns[at]
            at += 1
            for _ in range(t["n"] - 1):      # the copies' deletions
                next(edits)
            if e == "D":
                continue
            out.append({"role": t["role"] if e == "K" else _NEEDED[q], "text": t["text"]})
        q = _NEXT[q, out[-1]["role"][0]]
    return out


_TURN = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
_WAY = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_SEGMENTS = ("conv {}, segment long, first string, last string, illegal long, ways array<struct<start: int, end: int, cost: long, "
             "audit: string>>, turns array<struct<role: string, text: string, n: long>>")


def _segments(batches):
    """Sorted turns -> segments.  The partition's first and last conversation
    may go on elsewhere."""
    part, k = TaskContext.get().partitionId() << 32, 0
    rows: list[dict] = []
    out: list[tuple] = []
    conv = started = first_conv = False
    size = 0

    def flush(whole: bool):
        nonlocal k, rows, size
        turns = [((r["role"] or " ")[0], r["must_go"], r["truncated"], r["n"] - 1) for r in rows]
        t = Turns(turns)
        if whole:
            cost, audit = t.search(NONE, (NONE, PAIR))
            ways = [{"start": NONE, "end": PAIR, "cost": cost, "audit": audit}]
        else:
            ways = t.between_all_states()
        illegal = sum(x[3] for x in turns) + sum(x[0] + y[0] not in _LEGAL for x, y in zip(turns, turns[1:]))
        out.append((conv, part + k, turns[0][0], turns[-1][0], illegal, ways,
                    [{"role": r["role"], "text": r["text"], "n": r["n"]} for r in rows]))
        k, rows, size = k + 1, [], 0

    def batch():
        cols = list(zip(*out)) if out else [[]] * 7
        out.clear()
        types = (kind, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(_WAY), pa.list_(_TURN))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["conv", "segment", "first", "last", "illegal", "ways", "turns"])

    for b in batches:
        kind = b.schema.field(0).type
        for r in b.to_pylist():
            if not started or r["conv"] != conv:
                if rows:
                    flush(whole=not first_conv and not split)
                first_conv, started, split, conv = not started, True, False, r["conv"]
            elif rows and (len(rows) >= SEGMENT or size + len(r["text"]) > TEXT):
                split = True
                flush(whole=False)
            rows.append(r)
            size += len(r["text"])
        if len(out) > 2000:
            yield batch()
    if started:
        flush(whole=False)
        yield batch()


def _chain(batches):
    """Segments sorted by conversation and place -> the edits of each, and the
    border's part of the illegal neighbours.  Of equally cheap ways into a
    state the ASCII-least is the one to go on from: neither is the beginning of
    the other, since what more it had would be insertions, which cost."""
    conv, started = None, False
    some: list[dict] = []

    def chained():
        best = {NONE: (0, "", None)}
        steps = []
        for s in some:
            new: dict[int, tuple] = {}
            for w in s["ways"]:
                if w["start"] in best:
                    cost, edits, _ = best[w["start"]]
                    way = (cost + w["cost"], edits + w["audit"], w)
                    if w["end"] not in new or way[:2] < new[w["end"]][:2]:
                        new[w["end"]] = way
            steps.append({q: w for q, (_, _, w) in new.items()})
            best = new
        q = min((q for q in (NONE, PAIR) if q in best), key=lambda x: best[x][:2])
        for s, step in zip(reversed(some), reversed(steps)):
            way = step[q]
            q = way["start"]
            yield s["segment"], way
    def emit():
        way_of = dict(chained())
        last = None
        for s in some:
            w = way_of[s["segment"]]
            yield (s["conv"], s["segment"], w["start"], w["cost"], w["audit"],
                   s["illegal"] + (last is not None and last + s["first"] not in _LEGAL))
            last = s["last"]

    def batch(rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        types = (kind, pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["conv_", "segment_", "start", "cost", "audit", "illegal"])

    rows: list[tuple] = []
    for b in batches:
        kind = b.schema.field(0).type
        for s in b.to_pylist():
            if not started or s["conv"] != conv:
                rows += emit()
                some, conv, started = [], s["conv"], True
            some.append(s)
        if len(rows) > 5000:
            yield batch(rows)
            rows = []
    rows += emit()
    if started:
        yield batch(rows)


def _rebuilt(batches):
    for b in batches:
        turns = [rebuild(t, q, a) for t, q, a in zip(*(b.column(c).to_pylist() for c in ("turns", "start", "audit")))]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv"), b.column("segment"), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
            ["conv", "segment", "turns"])


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
           ) -> tuple[DataFrame, DataFrame]:
    """First result, per conversation that has rows: ``conv``, ``gaps`` (turn
    numbers missing between the least and the greatest), ``blank``,
    ``duplicate``, ``truncated`` (rows by their first fault), ``illegal``
    (neighbours whose roles' initials are not su, ua or au), ``cost`` and
    ``audit`` (initials of the cheapest edits: Keep, Rerole, Delete, Insert).
    Second result, the repaired conversations: ``(conv, segment, turns)`` with
    ``turns`` as (role, text); segments follow each other by number.

    Turns are taken by number (null first), those of one number by role and
    text.  Null roles and texts are one space; a role's initial is its first
    character, and an empty role is read as one space.  A text without any
    character but white space is blank; one whose last such character is not
    ``.``, ``!`` or ``?`` is truncated; a row whose role and text an earlier
    row has is a duplicate, repeated rows too.  Blank and duplicate rows must
    go.  Rows without a conversation are one conversation of their own.  Gaps
    ignore null turns and are 0 where all are null.  Further columns are not
    read, so none can clash.  An empty table gives empty results.
    """
    spark = rows.sparkSession
    prepare(spark)
    kind = rows.schema[conv_col].dataType.simpleString()
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    # rows that agree in all are one row with their number
    turns = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"),
                        text(role_col).alias("role"), text(text_col).alias("text")) \
        .groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("same", F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))))
    turns = cut(turns)
    order = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"))
    repeated = turns.groupBy(F.col("conv").alias("conv_"), F.col("same").alias("same_")).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    bare = F.rtrim("text", F.lit(SPACE))
    turns = turns.join(repeated, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("same") == F.col("same_")), "left") \
        .withColumn("blank", bare == "") \
        .withColumn("again", ~F.col("blank") & F.coalesce(order != F.col("first"), F.lit(False))) \
        .withColumn("cut_off", ~F.col("blank") & ~F.col("again") & ~F.right(bare, F.lit(1)).isin(*MARKS)) \
        .select("conv", "turn", "role", "text", "n", "blank", "again", "cut_off")

    faults = turns.groupBy("conv", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("again"), F.col("n")).when(~F.col("blank"), F.col("n") - 1).otherwise(0)).alias("duplicate"),
        F.sum(F.col("cut_off").cast("long")).alias("truncated")).groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])

    folder = work_path(spark, "segments")
    schema = _SEGMENTS.format(kind)
    turns.select("conv", "turn", "role", "text", "n", (F.col("blank") | F.col("again")).alias("must_go"),
                 F.col("cut_off").alias("truncated")) \
        .repartitionByRange(n_parts, "conv", "turn", "role", "text").sortWithinPartitions("conv", "turn", "role", "text") \
        .mapInArrow(_segments, schema).write.parquet(folder)
    segments = spark.read.schema(schema).parquet(folder)
    ways = cut(segments.drop("turns").repartition(n_parts, "conv").sortWithinPartitions("conv", "segment").mapInArrow(
        _chain, f"conv_ {kind}, segment_ long, start int, cost long, audit string, illegal long"))
    whole = ways.groupBy("conv_").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment_", "audit"))), lambda s: s["audit"]), "").alias("audit"))
    report = faults.join(whole, F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
    repaired = segments.select("conv", "segment", "turns").join(
        ways.select("segment_", "start", "audit"), F.col("segment") == F.col("segment_")).mapInArrow(
        _rebuilt, f"conv {kind}, segment long, turns array<struct<role: string, text: string>>")
    return report, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: the digest of ``role:text`` of all turns,
    joined by newlines.  A conversation's segments are digested one after the
    other, never together."""
    n_parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = repaired.schema["conv"].dataType.simpleString()
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    bodies = repaired.select("conv", "segment", F.size("turns").alias("n"), F.array_join(lines, "\n").alias("body"))

    def run(batches):
        conv = h = None
        done: list[tuple] = []
        for b in batches:
            of = b.schema.field(0).type
            for c, _, n, body in zip(*(x.to_pylist() for x in b.columns)):
                if h is None or c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h, empty = c, hashlib.sha256(), True
                if n:
                    h.update(("" if empty else "\n").encode() + body.encode())
                    empty = False
        if h is not None:
            done.append((conv, h.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], of), pa.array([x for _, x in done])],
                                             ["conv", "repaired_sha256"])

    return bodies.repartition(n_parts, "conv").sortWithinPartitions("conv", "segment").mapInArrow(
        run, f"conv {kind}, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """``conversations`` with faults put in: by the CRC-32 of ``conv_id:turn``
    (null: one space) modulo 20, a row is dropped (0), loses its text (1) or
    the marks ``.!?`` in it (2), comes twice (3) or gets the role user (4)."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    return rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")) \
        .filter("kind <> 0").select(
            "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(MARKS), ""))
            .otherwise(F.col("text")).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy")).drop("copy")
