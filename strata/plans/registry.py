"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame``
per operator of the inventory, and, where SQL can state the result, the
DuckDB oracle text over the same base tables.

Double outputs are rounded to 9 significant digits on both sides so the
order-insensitive value comparison is not sensitive to summation order.
The scaling uses exact powers of ten (x / 10^e for e >= 0, x * 10^-e
otherwise), so both engines round the same double.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIGITS = 8  # decimals after scaling to [1, 10): 9 significant digits


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    dbl: Sequence[str] = field(default_factory=tuple)
    ops: str = ""
    heavy: bool = False  # model fitting: excluded from the default bench


REGISTRY: dict[str, Query] = {}


def round_sig(x, digits: int = DIGITS):
    e = F.floor(F.log10(F.abs(x)))
    scaled = F.when(e >= 0, F.round(x / F.pow(F.lit(10.0), e), digits) * F.pow(F.lit(10.0), e)) \
        .otherwise(F.round(x * F.pow(F.lit(10.0), -e), digits) / F.pow(F.lit(10.0), -e))
    return F.when(x.isNull() | F.isnan(x) | (x == 0) | (F.abs(x) == float("inf")), x).otherwise(scaled)


def round_doubles(df: DataFrame, cols: Sequence[str], digits: int = DIGITS) -> DataFrame:
    cols = set(cols)
    return df.select(*[round_sig(F.col(f"`{c}`").cast("double"), digits).alias(c) if c in cols
                       else F.col(f"`{c}`") for c in df.columns])


def _sql_sig(c: str, digits: int) -> str:
    x = f'CAST("{c}" AS DOUBLE)'
    e = f"floor(log10(abs({x})))"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 OR isinf({x}) THEN {x} "
            f"WHEN {e} >= 0 THEN round({x} / pow(10.0, {e}), {digits}) * pow(10.0, {e}) "
            f"ELSE round({x} * pow(10.0, -{e}), {digits}) / pow(10.0, -{e}) END")


def sql_round(sql: str, cols: Sequence[str], digits: int = DIGITS) -> str:
    if not cols:
        return sql
    rep = ", ".join(f'{_sql_sig(c, digits)} AS "{c}"' for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql})"


def register(name: str, sql: str | None = None, dbl: Sequence[str] = (), ops: str = "", heavy: bool = False):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from strata.session import ship_package
            ship_package(spark)
            return round_doubles(fn(spark, sf_dir), dbl)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, run, sql_round(sql, dbl) if sql else None, tuple(dbl), ops, heavy)
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: q.fn for n, q in REGISTRY.items()}


def heavy_queries() -> set[str]:
    _load()
    return {n for n, q in REGISTRY.items() if q.heavy}


def oracle_sql() -> dict[str, str]:
    _load()
    return {n: q.sql for n, q in REGISTRY.items() if q.sql}


def _load():
    # importing the modules registers their queries
    from strata.plans import q_scored  # noqa: F401
    from strata.plans import q_cohort  # noqa: F401
    from strata.plans import q_models  # noqa: F401
    from strata.plans import q_io  # noqa: F401
