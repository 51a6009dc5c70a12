"""Token counters: totals, and counts that only a total shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")


def total_tokens(extra: bool = True) -> Column:
    out = F.lit(0)
    for name in (*COUNTERS, "extra_tokens") if extra else COUNTERS:
        out = out + F.coalesce(F.col(name), F.lit(0))
    return out


def with_total_fallback(df: DataFrame, total: Column) -> DataFrame:
    """What a reported total exceeds the known counters by goes to output, if that is 0,
    else to extra_tokens."""
    missing = F.greatest(total - total_tokens(), F.lit(0))
    to_output = F.col("output_tokens") == 0
    return df.withColumns(
        {
            "output_tokens": F.col("output_tokens") + F.when(to_output, missing).otherwise(0),
            "extra_tokens": F.col("extra_tokens") + F.when(to_output, 0).otherwise(missing),
        }
    )


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))
