"""Helpers for vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite components that is not
    zero; false for a null one."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(fine & F.exists(x, lambda v: v != 0), F.lit(False))


def matrix(column):
    """A pandas column of arrays as a matrix of doubles."""
    import numpy as np
    return np.array(column.tolist(), dtype=np.float64) if len(column) else np.zeros((0, 0))
