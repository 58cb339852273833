"""Secret scans: fixed patterns plus sliding-window Shannon entropy.

Candidate strings (runs of base64 or hexadecimal characters) pass an
allow-list and are then read once by a window of ``WINDOW`` characters.  The
window keeps a count per character of its class; with ``f(c) = c log2 c`` its
entropy is ``log2 w - sum(f(c)) / w``, so a step only replaces the terms of
the character that enters and of the one that leaves.  ``f`` is held in
integers, which makes the running sum exact.  DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import keep_columns, prepare, text_of

WINDOW = 24
SCALE = 1 << 20
PIECE = 4096       # code points of a text that are cut at once
#: kind -> pattern, least length of the string judged, group judged
BASE = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # the runs are maximal, so the least length may stand in the pattern
    "access": (r"AKIA[A-Z0-9]{16,}", 20, 0),
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
#: character class -> (its characters, least entropy in bits of some window)
CLASSES = {
    "entropy_hex": ("0123456789abcdef", 3.0),
    "entropy_base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 4.0),
}
CANDIDATE = r"[A-Za-z0-9+/_=-]{24,}"
HEX_ONLY = r"^[0-9A-Fa-f]+$"
#: Between two separators is a piece of a candidate.
SEPARATOR = r"[=/_-]+"
#: A piece with a word of documentation is no entropy finding; what is left of its candidate is judged.
WORD = r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*(?i:example|sample|placeholder|dummy|changeme|your(?=[_-]))[A-Za-z0-9+]*"
#: Candidates that one of these fits are never entropy findings.
ALLOWED = (
    r"^[A-Za-z/_=+-]+$",                                                  # words, paths, rules: no digit at all
    r"^[0-9_=+/-]+$",                                                     # numbers, dates, phone lists
    r"(?i:example|sample|placeholder|dummy|changeme|your[_-])",           # documentation
    r"^(?i:[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})$",                # UUID
)
KINDS = (*BASE, *CLASSES)


def _f(n: int) -> int:
    return round(n * math.log2(n) * SCALE) if n > 1 else 0


def most_repetition(bits: float, window: int = WINDOW) -> int:
    """Largest sum of ``f`` of a window whose entropy is at least ``bits``."""
    return math.floor(window * (math.log2(window) - bits) * SCALE)


def _prefixes(values: Column, op, chunk: int = 64) -> Column:
    """Exclusive running results of ``op`` over an array, from 0, in two levels
    so that a text with very many matches does not copy a growing array for
    each of them."""
    def running(c, first):
        return F.slice(F.aggregate(c, F.array(first), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x)))),
                       1, F.size(c))

    last = F.floor((F.size(values) - 1) / chunk).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * chunk + 1, chunk))
    totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0).cast("long"), op))
    return F.flatten(F.zip_with(parts, running(totals, F.lit(0).cast("long")), running))


def _prefix_sums(lengths: Column) -> Column:
    return _prefixes(lengths, lambda a, x: a + x)


def _matches(df: DataFrame, text: str, name: str, pattern: str) -> DataFrame:
    """Column ``name``: array of (start, end, match) in code points, from the
    matches and the gaps between them."""
    df = df.withColumn("_llm_m", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("_llm_g", F.when(F.size("_llm_m") > 0, F.transform(
        F.slice(F.split(F.col(text), pattern, -1), 1, F.size("_llm_m")), lambda g: F.length(g).cast("long"))))
    df = df.withColumn("_llm_l", F.zip_with("_llm_g", "_llm_m", lambda g, m: g + F.length(m)))
    df = df.withColumn("_llm_o", F.when(F.size("_llm_m") > 0, _prefix_sums(F.col("_llm_l"))))
    at = F.zip_with(F.zip_with("_llm_o", "_llm_g", lambda o, g: o + g), F.col("_llm_m"), lambda s, m: F.struct(
        s.alias("start"), (s + F.length(m)).alias("end"), m.alias("match")))
    none = "array<struct<start:bigint,end:bigint,match:string>>"
    return df.withColumn(name, F.coalesce(at, F.array().cast(none))).drop("_llm_m", "_llm_g", "_llm_l", "_llm_o")


def _least_repetition(x: Column, letters: str) -> Column:
    """Smallest sum of ``f`` over the windows of a string of ``letters``."""
    table = F.array(*[F.lit(_f(n)).cast("long") for n in range(WINDOW + 2)])
    f = lambda n: F.element_at(table, n + 1)
    index = F.transform(F.split(x, ""), lambda c: F.instr(F.lit(letters), c))
    steps = F.zip_with(index, F.concat(F.array_repeat(F.lit(0), WINDOW), index),
                       lambda a, b: F.struct(a.alias("into"), b.alias("out")))
    steps = F.filter(steps, lambda s: s["into"].isNotNull())
    zero = F.array_repeat(F.lit(0), len(letters))
    start = F.struct(zero.alias("counts"), F.lit(0).cast("long").alias("sum"),
                     F.lit(0).alias("seen"), F.lit(1 << 40).cast("long").alias("least"))

    def step(acc, s):
        left = F.when(s["out"] > 0, F.element_at(acc["counts"], F.greatest(s["out"], F.lit(1)))).otherwise(F.lit(0))
        inside = F.element_at(acc["counts"], s["into"]) - F.when(s["out"] == s["into"], 1).otherwise(0)
        total = (acc["sum"] + F.when(left > 0, f(F.greatest(left - 1, F.lit(0))) - f(left)).otherwise(F.lit(0).cast("long"))
                 + f(inside + 1) - f(inside))
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k + 1 == s["into"], 1).otherwise(0)
                             - F.when(k + 1 == s["out"], 1).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("sum"), (acc["seen"] + 1).alias("seen"),
                        F.when(acc["seen"] + 1 >= WINDOW, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    return F.aggregate(steps, start, step, lambda acc: acc["least"])


def _base_spans(kind: str) -> Column:
    pattern, least, group = BASE[kind]

    def long_enough(m):
        return F.length(F.regexp_extract(m["match"], pattern, group) if group else m["match"]) >= least

    return _ranked(F.filter(f"_llm_{kind}", long_enough), kind)


def _kind(m: Column, kinds=tuple(CLASSES)) -> Column:
    """The entropy kind of a match, null when it is no finding."""
    kind = F.lit(None).cast("string")
    fine = (F.length(m["match"]) >= WINDOW) & ~m["match"].rlike("|".join(ALLOWED))
    for name in kinds:
        letters, bits = CLASSES[name]
        of_hex = name == "entropy_hex"
        x = F.lower(m["match"]) if of_hex else m["match"]
        mine = m["match"].rlike(HEX_ONLY) if of_hex else ~m["match"].rlike(HEX_ONLY)
        high = F.when(fine & mine, _least_repetition(x, letters) <= most_repetition(bits)).otherwise(F.lit(False))
        kind = F.when(high, F.lit(name)).otherwise(kind)
    return kind


def _between(m: Column, pattern: str) -> Column:
    """The parts of a match between the matches of ``pattern`` in it, with
    their places in the text; short ones are left out."""
    parts = F.split(m["match"], pattern, -1)
    lengths = F.zip_with(parts, F.regexp_extract_all(m["match"], F.lit(pattern), F.lit(0)),
                         lambda p, x: (F.length(p) + F.coalesce(F.length(x), F.lit(0))).cast("long"))
    placed = F.zip_with(parts, _prefix_sums(lengths), lambda p, o: F.struct(
        (m["start"] + o).alias("start"), (m["start"] + o + F.length(p)).alias("end"), p.alias("match")))
    return F.filter(placed, lambda p: F.length(p["match"]) >= WINDOW)


def _judged(found: Column, kinds=tuple(CLASSES)) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"], m["end"], m["match"], _kind(m, kinds).alias("kind")))


def _entropy_spans(judged: str) -> Column:
    rank = lambda m: sum((F.when(m["kind"] == k, KINDS.index(k)).otherwise(0) for k in CLASSES), F.lit(0))
    return F.transform(F.filter(judged, lambda m: m["kind"].isNotNull()), lambda m: F.struct(
        m["start"], rank(m).alias("rank"), m["end"], m["kind"].alias("kind")))


def _ranked(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"], F.lit(KINDS.index(kind)).alias("rank"), m["end"],
                                                 F.lit(kind).alias("kind")))


def scan_secrets(docs: DataFrame, text_col: str = "text", name: str = "spans") -> DataFrame:
    """Add ``spans`` (or ``name``): array of (start, end, kind), in code points with an
    exclusive end, by start, then kind in the order of ``KINDS``.

    Base kinds are found by their patterns, leftmost and non-overlapping per
    kind; entropy findings are added and may overlap them; the allow-list
    only suppresses entropy findings, its words only the piece that holds one.
    A hexadecimal piece of a candidate that is no finding is judged alone.  Null and empty texts have no spans;
    every input row stays once; an input column of that
    name is replaced.
    """
    prepare(docs.sparkSession)
    df = docs.select(*keep_columns(docs, [name]), text_of(text_col).alias("_llm_text"))
    for kind, (pattern, _, _) in BASE.items():
        df = _matches(df, "_llm_text", f"_llm_{kind}", pattern)
    df = _matches(df, "_llm_text", "_llm_candidate", CANDIDATE)
    left = F.flatten(F.transform("_llm_candidate", lambda m: F.when(m["match"].rlike(WORD), _between(m, WORD)).otherwise(F.array(m))))
    df = df.withColumn("_llm_judged", _judged(left))
    # every window of a piece is one of its candidate: only a hexadecimal
    # piece, whose class asks for less, can be a finding where the whole is none
    missed = F.filter("_llm_judged", lambda m: m["kind"].isNull() & m["match"].rlike("[0-9A-Fa-f]{24}"))
    pieces = F.flatten(F.transform(missed, lambda m: _between(m, SEPARATOR)))
    df = df.withColumn("_llm_pieces", _judged(pieces, ("entropy_hex",)))
    found = F.array_sort(F.concat(*map(_base_spans, BASE), *map(_entropy_spans, ("_llm_judged", "_llm_pieces"))))
    spans = F.transform(found, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return df.withColumn(name, spans).drop("_llm_text", "_llm_candidate", "_llm_judged", "_llm_pieces", *[f"_llm_{k}" for k in BASE])


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Rows of ``docs`` with every span of their text replaced by ``mark``
    (touching and overlapping spans by one mark).  Texts without a span are
    untouched, a null one too; the columns stay as they are."""
    found = scan_secrets(docs.withColumn("_llm_row", F.col(f"`{text_col}`")), text_col, "_llm_spans")
    # pieces of a fixed length, so that a span far into a text is not sought from its start
    found = found.withColumn("_llm_pieces", F.regexp_extract_all("_llm_row", F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))
    found = found.withColumn("_llm_before", F.when(F.size("_llm_spans") > 0, _prefixes(
        F.transform("_llm_spans", lambda s: s["end"]), lambda a, x: F.greatest(a, x))))

    def part(start, end):
        first = F.floor(start / PIECE).cast("int")
        some = F.array_join(F.slice("_llm_pieces", first + 1, F.ceil(end / PIECE).cast("int") - first), "")
        return F.when(end > start, F.substr(some, (start - first * PIECE + 1).cast("int"), (end - start).cast("int"))).otherwise("")

    # spans come in order of their starts; one that begins within or right behind an earlier one has no mark of its own
    marked = F.zip_with("_llm_spans", "_llm_before", lambda s, at: F.when(
        (s["start"] > at) | (at == 0), F.concat(part(at, s["start"]), F.lit(mark))).otherwise(""))
    end = F.array_max(F.transform("_llm_spans", lambda s: s["end"]))
    built = F.concat(F.array_join(marked, ""), part(end, F.length("_llm_row").cast("long")))
    text = F.when(F.size("_llm_spans") > 0, built).otherwise(F.col("_llm_row"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
