"""SQL text builders for the DuckDB oracle.

These only produce SQL strings that state, independently of the Spark
code, what each registered query must return.  ``src`` is a table or CTE
name; keys are column names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def lit(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def uniform_edges(n_bins: int) -> list[float]:
    return [float(v) for v in np.linspace(0.0, 1.0, n_bins + 1)]


def digitize_right(p: str, edges: Sequence[float]) -> str:
    whens = " ".join(f"WHEN {p} <= {lit(e)} THEN {i}" for i, e in enumerate(edges))
    return f"(CASE {whens} ELSE {len(edges)} END)"


def count_edges_below(p: str, edges: Sequence[float]) -> str:
    if not edges:
        return "0"
    return "(" + " + ".join(f"(CASE WHEN {p} > {lit(e)} THEN 1 ELSE 0 END)" for e in edges) + ")"


def _k(keys: Sequence[str], trailing: bool = True) -> str:
    if not keys:
        return ""
    return ", ".join(keys) + (", " if trailing else "")


def group_by(keys: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(keys)}" if keys else ""


def threshold_metrics(src: str, y: str, p: str, t: float, n_bins: int, keys: Sequence[str] = ()) -> str:
    edges = uniform_edges(n_bins)
    bins = "".join(
        f", sum(CASE WHEN _b = {i} THEN 1 ELSE 0 END) AS _en{i}"
        f", sum(CASE WHEN _b = {i} THEN {p} ELSE 0.0 END) AS _ep{i}"
        f", sum(CASE WHEN _b = {i} THEN {y} ELSE 0 END) AS _ey{i}"
        for i in range(1, n_bins + 1)
    )
    ece = " + ".join(
        f"(CASE WHEN _en{i} > 0 THEN (_en{i} / _n) * abs(_ep{i} / _en{i} - _ey{i} / _en{i}) ELSE 0.0 END)"
        for i in range(1, n_bins + 1)
    )
    inner = (
        f"SELECT {_k(keys)}count(*) AS _n, sum(({p} - {y}) * ({p} - {y})) AS _sse, "
        f"CAST(sum(CASE WHEN {y} = 0 AND _pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS TN, "
        f"CAST(sum(CASE WHEN {y} = 0 AND _pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS FP, "
        f"CAST(sum(CASE WHEN {y} = 1 AND _pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS FN, "
        f"CAST(sum(CASE WHEN {y} = 1 AND _pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS TP"
        f"{bins} FROM (SELECT *, CASE WHEN {p} >= {lit(t)} THEN 1 ELSE 0 END AS _pred, "
        f"{digitize_right(p, edges)} AS _b FROM {src}) {group_by(keys)}"
    )
    return (
        f"SELECT {_k(keys)}(TP + TN) / _n AS Accuracy, "
        f"CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS Precision, "
        f"CASE WHEN TP + FN > 0 THEN TP / (TP + FN) ELSE 0.0 END AS Recall, "
        f"CASE WHEN 2 * TP + FP + FN > 0 THEN 2 * TP / (2 * TP + FP + FN) ELSE 0.0 END AS F1, "
        f"{ece} AS ECE, _sse / _n AS Brier, "
        f"CASE WHEN TN + FP > 0 THEN TN / (TN + FP) ELSE 0.0 END AS Specificity, "
        f"CASE WHEN TP + FP > 0 THEN TP / (TP + FP) ELSE 0.0 END AS PPV, "
        f"CASE WHEN TN + FN > 0 THEN TN / (TN + FN) ELSE 0.0 END AS NPV, "
        f"TN, FP, FN, TP FROM ({inner})"
    )


def ece(src: str, y: str, p: str, n_bins: int, keys: Sequence[str] = ()) -> str:
    full = threshold_metrics(src, y, p, 0.5, n_bins, keys)
    return f"SELECT {_k(keys)}ECE FROM ({full})"


def rank_curve(src: str, y: str, p: str, keys: Sequence[str] = (), weight: str | None = None) -> str:
    w = weight or "1"
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    return (
        f"SELECT *, sum(_tp) OVER ({part} ORDER BY {p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _ctp, "
        f"sum(_fp) OVER ({part} ORDER BY {p} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _cfp, "
        f"sum(_tp) OVER ({part}) AS _ttp, sum(_fp) OVER ({part}) AS _tfp FROM ("
        f"SELECT {_k(keys)}{p}, CAST(sum(CASE WHEN {y} = 1 THEN {w} ELSE 0 END) AS BIGINT) AS _tp, "
        f"CAST(sum(CASE WHEN {y} = 0 THEN {w} ELSE 0 END) AS BIGINT) AS _fp FROM {src} "
        f"GROUP BY {_k(keys)}{p})"
    )


def rank_metrics_from_curve(curve_sql: str, keys: Sequence[str] = ()) -> str:
    return (
        f"SELECT {_k(keys)}CASE WHEN max(_ttp) > 0 AND max(_tfp) > 0 THEN "
        f"sum(_fp * (_ctp - _tp / 2.0)) / (CAST(max(_ttp) AS DOUBLE) * max(_tfp)) END AS AUROC, "
        f"CASE WHEN max(_ttp) > 0 THEN sum(_tp * (_ctp / (_ctp + _cfp))) / max(_ttp) END AS AUPRC, "
        f"CAST(max(_ttp) AS BIGINT) AS n_pos, CAST(max(_tfp) AS BIGINT) AS n_neg "
        f"FROM ({curve_sql}) {group_by(keys)}"
    )


def rank_metrics(src: str, y: str, p: str, keys: Sequence[str] = ()) -> str:
    return rank_metrics_from_curve(rank_curve(src, y, p, keys), keys)


def evaluate(src: str, y: str, p: str, t: float, n_bins: int, keys: Sequence[str] = ()) -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys) or "TRUE"
    on2 = " AND ".join(f"a.{k} = c.{k}" for k in keys) or "TRUE"
    ks = "".join(f"a.{k}, " for k in keys)
    return (
        f"SELECT {ks}a.n_test, a.pos_rate_test, b.AUROC, b.AUPRC, c.Accuracy, c.Precision, c.Recall, c.F1, "
        f"c.Specificity, c.PPV, c.NPV, c.ECE, c.Brier, c.TN, c.FP, c.FN, c.TP FROM "
        f"(SELECT {_k(keys)}count(*) AS n_test, avg(CAST({y} AS DOUBLE)) AS pos_rate_test FROM {src} {group_by(keys)}) a "
        f"JOIN ({rank_metrics(src, y, p, keys)}) b ON {on} "
        f"JOIN ({threshold_metrics(src, y, p, t, n_bins, keys)}) c ON {on2}"
    )


def round_cols(sql: str, cols: Sequence[str], digits: int = 9, keep: Sequence[str] = ()) -> str:
    """Wrap a query so the named double columns are rounded."""
    sel = ", ".join([*keep, *[f"round({c}, {digits}) AS {c}" for c in cols]])
    return f"SELECT {sel} FROM ({sql})"
