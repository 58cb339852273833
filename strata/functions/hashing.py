"""Deterministic per-row randomness from md5, identical in Spark and DuckDB.

A row's uniform draw is a function of (seed, key parts) only, so it does
not depend on partitioning, task retries or executor loss, and the DuckDB
oracle can reproduce it bit for bit:

    u = (int(first 8 hex digits of md5('seed:part1:part2...')) + 0.5) / 2^32
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO32 = 4294967296.0


def hash_key(seed, *parts) -> Column:
    """``'seed:part1:part2'`` as a string column."""
    cols = [F.lit(str(seed))] + [F.col(p).cast("string") if isinstance(p, str) else p.cast("string")
                                 for p in parts]
    return F.concat_ws(":", *cols)


def md5_hex(seed, *parts) -> Column:
    return F.md5(hash_key(seed, *parts))


def md5_uniform(seed, *parts) -> Column:
    """Uniform (0, 1) double from the first 32 bits of md5(seed:parts)."""
    h = F.conv(F.substring(md5_hex(seed, *parts), 1, 8), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(_TWO32)


def md5_uniform_sql(seed, *parts_sql: str) -> str:
    """The same draw as DuckDB SQL text (parts are SQL expressions)."""
    cat = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"((('0x' || substr(md5({cat}), 1, 8))::BIGINT + 0.5) / {_TWO32!r})"


# fixed values: the 32-bit integer mixer's constants (golden-ratio stride and
# the avalanche multiplier); products stay below 2^63, so the arithmetic
# never overflows a signed bigint in Spark (ANSI) or DuckDB.
_STRIDE = 0x9E3779B9
_MIX = 0x45D9F3B
_MASK32 = 0xFFFFFFFF


def md5_seed32(seed, *parts) -> Column:
    """First 32 bits of md5(seed:parts) as a bigint (one md5 per row)."""
    return F.conv(F.substring(md5_hex(seed, *parts), 1, 8), 16, 10).cast("long")


def _mix_steps(seed32: Column, stream: Column) -> list[Column]:
    """The mixer as a list of steps; step k reads only the column written
    by step k-1 (``_h``), so each is evaluated once per row."""
    m = F.lit(_MASK32)
    h = F.col("_h")
    return [
        seed32.bitwiseXOR((stream.cast("long") * F.lit(_STRIDE)).bitwiseAND(m)),
        (F.shiftright(h, 16).bitwiseXOR(h) * F.lit(_MIX)).bitwiseAND(m),
        (F.shiftright(h, 16).bitwiseXOR(h) * F.lit(_MIX)).bitwiseAND(m),
        F.shiftright(h, 16).bitwiseXOR(h),
    ]


def with_mix32_uniform(df, seed32: Column, stream: Column, out: str = "_u"):
    """Add ``out``: uniform (0, 1) draw number ``stream`` of a row whose
    32-bit seed is ``seed32`` -- xor with the stream's stride multiple, two
    multiply-xorshift rounds, a final xorshift (all mod 2^32)."""
    for step in _mix_steps(seed32, stream):
        df = df.withColumn("_h", step)
    return df.withColumn(out, (F.col("_h").cast("double") + F.lit(0.5)) / F.lit(_TWO32)).drop("_h")


def md5_seed32_sql(seed, *parts_sql: str) -> str:
    cat = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts_sql])
    return f"(('0x' || substr(md5({cat}), 1, 8))::BIGINT)"


def mix32_uniform_sql(seed32_sql: str, stream_sql: str, src: str, keep: str) -> str:
    """SELECT {keep}, u FROM src with the same mixer, one step per subquery."""
    q = f"SELECT {keep}, xor({seed32_sql}, (CAST({stream_sql} AS BIGINT) * {_STRIDE}) & {_MASK32}) AS h FROM {src}"
    q = f"SELECT {keep}, (xor(h >> 16, h) * {_MIX}) & {_MASK32} AS h FROM ({q})"
    q = f"SELECT {keep}, (xor(h >> 16, h) * {_MIX}) & {_MASK32} AS h FROM ({q})"
    q = f"SELECT {keep}, xor(h >> 16, h) AS h FROM ({q})"
    return f"SELECT {keep}, (CAST(h AS DOUBLE) + 0.5) / {_TWO32!r} AS u FROM ({q})"


def poisson1_cdf(k_max: int = 16) -> list[float]:
    """Cumulative Poisson(1) probabilities F(0..k_max), from the pmf rule."""
    out, acc, term = [], 0.0, math.exp(-1.0)
    for k in range(k_max + 1):
        if k > 0:
            term = term / k
        acc += term
        out.append(acc)
    return out


def poisson1_weight(u: Column, k_max: int = 16) -> Column:
    """Inverse-CDF Poisson(1) draw: smallest k with u <= F(k)."""
    cdf = poisson1_cdf(k_max)
    expr = F.when(u <= F.lit(cdf[0]), F.lit(0))
    for k in range(1, k_max + 1):
        expr = expr.when(u <= F.lit(cdf[k]), F.lit(k))
    return expr.otherwise(F.lit(k_max + 1))


def poisson1_weight_sql(u_sql: str, k_max: int = 16) -> str:
    cdf = poisson1_cdf(k_max)
    whens = " ".join(f"WHEN {u_sql} <= {c!r} THEN {k}" for k, c in enumerate(cdf))
    return f"(CASE {whens} ELSE {k_max + 1} END)"
