"""Cost of tokens under a rate card, in dollars, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of one class in one row from which the higher rate holds.
TIER = 200_000
#: An hour-long cache entry costs this many times the input rate.
HOUR_CACHE = 2.0
MODES = ("auto", "calculate", "display")


def tiered_cost(tokens: Column, base: Column, above: Column | None = None) -> Column:
    flat = tokens * base
    if above is None:
        return flat
    return F.when((tokens > TIER) & above.isNotNull(), TIER * base + (tokens - TIER) * above).otherwise(flat)


def token_cost(rate: Column, output: Column) -> Column:
    """Cost of the counters of a row under the struct ``rate``; ``output`` is what is billed as such."""
    five = F.coalesce(F.col("cache_5m_tokens"), F.col("cache_creation_tokens"))
    hour = F.when(F.col("cache_5m_tokens").isNull(), F.lit(0)).otherwise(F.coalesce(F.col("cache_1h_tokens"), F.lit(0)))
    fast = F.when(F.col("speed") == "fast", rate["fast_multiplier"]).otherwise(F.lit(1.0))
    return (
        tiered_cost(F.col("input_tokens"), rate["input"], rate["input_above"])
        + tiered_cost(output, rate["output"], rate["output_above"])
        + tiered_cost(five, rate["cache_create"], rate["cache_create_above"])
        + tiered_cost(hour, rate["input"] * HOUR_CACHE, rate["input_above"] * HOUR_CACHE)
        + tiered_cost(F.col("cache_read_tokens"), rate["cache_read"], rate["cache_read_above"])
    ) * fast


def by_mode(mode: str, recorded: Column, computed: Column) -> Column:
    """auto: the recorded cost if there is one; calculate: never; display: only that."""
    if mode not in MODES:
        raise ValueError(f"unknown cost mode {mode!r}")
    return {"auto": F.coalesce(recorded, computed), "calculate": computed, "display": F.coalesce(recorded, F.lit(0.0))}[mode]


def cumulative_log_cost(rate: Column, fast: bool) -> Column:
    """For logs whose input counts include cached ones; no tiers, reasoning is in the output."""
    times = F.when(rate["fast_multiplier"] == 1.0, 2.0).otherwise(rate["fast_multiplier"]) if fast else F.lit(1.0)
    cached_rate = F.when(rate["cache_read_explicit"], rate["cache_read"]).otherwise(rate["input"])
    fresh = F.greatest(F.col("input_tokens") - F.col("cached_tokens"), F.lit(0))
    return (fresh * rate["input"] + F.col("cached_tokens") * cached_rate + F.col("output_tokens") * rate["output"]) * times


def burn_rate(first_ms: Column, last_ms: Column, tokens: Column, plain: Column, cost: Column) -> dict[str, Column]:
    """Tokens a minute, plain (uncached) tokens a minute, cost an hour; null for no span."""
    minutes = F.nullif((last_ms - first_ms) / 60_000.0, F.lit(0.0))
    minutes = F.when(minutes > 0, minutes)
    return {"tokens_per_minute": tokens / minutes, "plain_per_minute": plain / minutes, "cost_per_hour": cost / minutes * 60}


def projection(end_ms: Column, now_ms: Column, tokens: Column, cost: Column, per_minute: Column, per_hour: Column) -> dict[str, Column]:
    """Where a block ends up at its present rate."""
    left = F.round((end_ms - now_ms) / 60_000.0)
    return {
        "remaining_minutes": left.cast("long"),
        "projected_tokens": F.round(tokens + per_minute * left).cast("long"),
        "projected_cost": F.round((cost + per_hour / 60 * left) * 100) / 100,
    }


def limit_status(projected: Column, limit: Column, warn: float = 0.8) -> Column:
    return F.when(limit.isNotNull() & projected.isNotNull(), F.when(projected > limit, "exceeds").when(projected > limit * warn, "warning").otherwise("ok"))


def burn_status(plain_per_minute: Column) -> Column:
    return F.when(plain_per_minute < 2000, "Normal").when(plain_per_minute < 5000, "Moderate").otherwise("High")
