"""Which vectors take part, and Arrow lists of them as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: Column) -> Column:
    """Neither null nor empty nor all zero, and without null or non-finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(column.isNotNull() & F.forall(column, fine) & F.exists(column, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, double matrix) for each length of the vectors of a column."""
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        out.append((rows, flat[starts[rows][:, None] + np.arange(dim)]))
    return out
