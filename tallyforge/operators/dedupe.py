"""Removing replayed and repeated records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.tokens import total_tokens

ORDER = ["file", "line_no", "item_no"]


def _spread() -> Column:
    """A window key that is null for records with a message id and spreads the others, all of
    which stay, over tasks. Filtering both kinds apart would read and parse the logs twice."""
    return F.when(F.col("message_id").isNull(), F.xxhash64(*ORDER))


def keep_ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``; rows with a null in all keys' columns stay
    apart by their key being null-safe (nulls are equal)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def keep_first(df: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    return keep_ranked(df, keys, [F.asc(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    return keep_ranked(df, keys, [F.desc(c) for c in order])


def keep_highest(df: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """Rows for whose key there is no row of a smaller ``rank``; rows with a null in the last
    key all stay. The join asks for ``merge``: there are as many keys as rows."""
    first = df.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min(rank).alias("_first"))
    return df.join(first.hint("merge"), keys, "left").where(F.col("_first").isNull() | (F.col(rank) <= F.col("_first"))).drop("_first")


def dedupe_replayed(df: DataFrame) -> DataFrame:
    """Messages logged again by side conversations.

    Of each (message, request) the best record stays: not from a side conversation, most
    tokens, with a known speed, earliest. If a message has any record of the main
    conversation, those of side conversations go; else its single best one stays. Records
    without a message id all stay.
    """
    spread = df.withColumn("_spread", _spread())
    main = F.max(F.when(F.col("is_sidechain"), 0).otherwise(1)).over(Window.partitionBy("message_id", "_spread"))
    known = spread.withColumn("_main", main).where("message_id is null or _main = 0 or not is_sidechain")
    key = F.when(F.col("_main") == 1, F.struct(F.col("request_id").alias("r"), F.lit(1).alias("m"))).otherwise(F.struct(F.lit(None).cast("string").alias("r"), F.lit(0).alias("m")))
    best = [F.desc(total_tokens()), F.desc(F.col("speed").isNotNull()), *(F.asc(c) for c in ORDER)]
    w = Window.partitionBy("message_id", "_spread", "_key").orderBy(*best)
    known = known.withColumn("_key", key).withColumn("_place", F.row_number().over(w)).where("message_id is null or _place = 1")
    return known.select(*df.columns)


_USAGE = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens"]


def dedupe_agent(df: DataFrame, agent: str) -> DataFrame:
    """The rule of each source; the result is one row for each usage."""
    if agent == "claude":
        return dedupe_replayed(df)
    if agent == "droid":
        return keep_ranked(df, ["session_id"], [F.desc("ts_ms"), *(F.asc(c) for c in ORDER)])
    if agent == "codebuff":
        return keep_last(df, ["session_id", "message_id"])
    if agent == "opencode":
        w = Window.partitionBy("message_id", "_spread").orderBy("item_no", "file", "line_no")
        placed = df.withColumn("_spread", _spread()).withColumn("_place", F.row_number().over(w))
        return placed.where("message_id is null or _place = 1").select(*df.columns)
    if agent == "goose":
        return keep_first(df, ["file", "session_id"])
    if agent == "hermes":
        return keep_first(df, ["session_id"])
    if agent == "kilo":
        return keep_first(df, ["message_id"])
    if agent in ("pi", "openclaw"):
        return keep_first(df, ["project", "session_id", "ts_text", "model", *_USAGE, "recorded_cost"])
    if agent == "kimi":
        return keep_first(df, ["session_id", "message_id", "ts_text", "model", *_USAGE])
    if agent == "qwen":
        return keep_first(df, ["session_id", "ts_text", "model", "input_tokens", "output_tokens", "cache_read_tokens", "extra_tokens"])
    return df
