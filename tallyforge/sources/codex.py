"""Session logs with running totals: usage events as differences, and their models.

Input counts of this source include cached tokens; reasoning is part of the output.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions import timestamps as T
from tallyforge.operators.carry import carry_forward, leading_run, running_delta
from tallyforge.sources.textlogs import RANGE, file_heads, listed_files, range_lines, written

# The model that a review label stood for, by date.
REVIEW_MODEL = "codex-auto-review"
REVIEW_VERSIONS = [
    ("2026-04-23", "gpt-5.5"),
    ("2026-03-05", "gpt-5.4"),
    ("2026-02-05", "gpt-5.3-codex"),
    ("2025-12-11", "gpt-5.2-codex"),
    ("2025-11-13", "gpt-5.1-codex"),
    ("2025-09-15", "gpt-5-codex"),
    ("2025-08-07", "gpt-5"),
]
DEFAULT = "gpt-5"
SPAWNED, HEAD_BYTES = "thread_spawn", 16 * 1024

_NAMES = {
    "input": ("input_tokens", "prompt_tokens", "input"),
    "cached": ("cached_input_tokens", "cache_read_input_tokens", "cached_tokens"),
    "output": ("output_tokens", "completion_tokens", "output"),
    "reasoning": ("reasoning_output_tokens", "reasoning_tokens"),
}
#: What doesn't fit its field is null, as a missing one.
_USAGE = "struct<" + ", ".join(f"{k}: bigint" for keys in _NAMES.values() for k in keys) + ", total_tokens: bigint>"
_NAMED = "model: string, model_name: string, metadata: struct<model: string>"
_RESULT = f"struct<{_NAMED}, timestamp: string, created_at: string, createdAt: string, usage: {_USAGE}>"
_INFO = f"struct<{_NAMED}, last_token_usage: {_USAGE}, total_token_usage: {_USAGE}>"
_LINE = (
    f"type string, timestamp string, created_at string, createdAt string, model string, model_name string, metadata struct<model: string>, usage {_USAGE}, "
    f"payload struct<type: string, {_NAMED}, info: {_INFO}>, data {_RESULT}, result {_RESULT}, response {_RESULT}"
)
_PLACES = ("j", "j.data", "j.result", "j.response")


def _usage(at: str) -> Column:
    """A usage object as a struct, null if it isn't there; several names for each counter."""
    one = lambda k: F.when(F.col(f"{at}.{k}") >= 0, F.col(f"{at}.{k}"))
    n = {name: F.coalesce(*(one(k) for k in keys), F.lit(0)) for name, keys in _NAMES.items()}
    summed = n["input"] + n["output"] + n["reasoning"]
    total = F.coalesce(F.when((one("total_tokens") > 0) | (summed == 0), one("total_tokens")), summed)
    return F.when(F.col(at).isNotNull(), F.struct(*(c.alias(k) for k, c in n.items()), total.alias("total")))


def _model(*places: str) -> Column:
    """The first name at the places that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(f"{at}.{k}"), F.lit("")) for at in places for k in ("model", "model_name", "metadata.model")))


def _told(field: str) -> Column:
    """A trimmed text as it is; a number as ISO text (seconds, or ms from 10^12)."""
    text = F.nullif(F.trim(field), F.lit(""))
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    return F.when(number > 0, T.iso_ms(T.epoch_ms(number, 1_000_000_000_000))).otherwise(text)


def session_files(spark: SparkSession, homes: list[str]) -> DataFrame:
    """The log files of each home; a path that is both active and archived counts once, active
    first. session_id is the path below the folder, without its ending."""
    out = None
    for place, home in enumerate(homes):
        files = listed_files(spark, home, "*.jsonl").withColumn("home", F.lit(place))
        out = files if out is None else out.unionByName(files)
    below = F.regexp_extract("file", r"/(?:archived_)?sessions/(.+)$", 1)
    below = F.when(below == "", F.regexp_extract("file", "([^/]+)$", 1)).otherwise(below)
    out = out.withColumns({"below": below, "archived": F.col("file").contains("/archived_sessions/")})
    first = Window.partitionBy("home", "below").orderBy("archived", "file")
    out = out.withColumn("n", F.row_number().over(first)).where("n = 1")
    return out.withColumn("session_id", F.regexp_replace("below", r"\.[^./]*$", "")).drop("n", "below", "archived", "home")


def review_model(model: Column, day: Column) -> Column:
    """The review label's model on a day (ISO text): the latest one released by then."""
    versions = F.array(*(F.struct(F.lit(d).alias("since"), F.lit(m).alias("model")) for d, m in REVIEW_VERSIONS))
    hit = F.try_element_at(F.filter(versions, lambda x: x["since"] <= day), F.lit(1))["model"]
    return F.when(model == REVIEW_MODEL, F.coalesce(hit, F.lit(DEFAULT))).otherwise(model)


def read_codex(spark: SparkSession, homes: list[str] | str) -> DataFrame:
    """session_id, file, line_no, ts_text, ts_ms, model, is_fallback, input_tokens (with
    cached), cached_tokens, output_tokens, reasoning_tokens, total_tokens.

    A count event gives its own usage, or else what its running total exceeds the last total
    in the file by. In files of spawned threads whose first two count events share a second
    the leading count events of that second are replays: they move the total and no more.
    The model is the event's, else the last one named before, else a default, which marks the
    event and those that inherit it as fallback.
    """
    homes = [homes] if isinstance(homes, str) else homes
    files = session_files(spark, homes)
    spawned = file_heads(files, HEAD_BYTES).where(F.col("head").contains(SPAWNED)).select("file", F.lit(True).alias("spawned"))
    files = files.join(spawned, "file", "left").fillna(False, "spawned")
    rows = range_lines(files, [[x] for x in ("turn_context", "token_count", "usage", "input_tokens", "prompt_tokens")], also=["session_id", "spawned"])
    rows = rows.withColumn("j", F.from_json("value", _LINE)).where("j is not null")
    context = F.coalesce(F.col("j.type") == "turn_context", F.lit(False))
    counted = F.coalesce((F.col("j.type") == "event_msg") & (F.col("j.payload.type") == "token_count"), F.lit(False))
    headless = F.coalesce(~F.col("j.type").isin("event_msg", "turn_context"), F.lit(True))
    times = [f"{at}.{k}" for at in _PLACES for k in ("timestamp", "created_at", "createdAt")]
    any_usage = F.coalesce(*(F.col(f"{at}.usage") for at in _PLACES))
    rows = rows.withColumn("u", F.when(counted, F.col("j.payload.info.last_token_usage")).when(headless, any_usage))
    rows = rows.select(
        "file",
        "line_no",
        "session_id",
        "spawned",
        context.alias("context"),
        counted.alias("counted"),
        F.when(counted, _told("j.timestamp")).otherwise(F.coalesce(*map(_told, times), T.iso_ms(F.col("modified_ms")))).alias("ts_text"),
        _usage("u").alias("own"),
        F.when(counted, _usage("j.payload.info.total_token_usage")).alias("total"),
        F.when(context, _model("j.payload")).when(counted, _model("j.payload", "j.payload.info")).otherwise(_model(*_PLACES)).alias("named"),
    ).where("context or own is not null or counted")

    rows = written(rows)  # parsed once, read by each step below
    second = F.substring("ts_text", 1, 19)
    real = F.col("counted") & (F.col("own").isNotNull() | F.col("total").isNotNull()) & F.col("ts_text").isNotNull()
    #: Whether the first two count events share a second: the least place, then the least after it.
    real_rows = rows.where(real).select("file", "line_no", second.alias("second"))
    one = real_rows.groupBy("file").agg(F.min(F.struct("line_no", "second")).alias("one"))
    two = real_rows.join(one, "file").where(F.col("line_no") > F.col("one.line_no")).groupBy("file", "one").agg(F.min(F.struct("line_no", "second")).alias("two"))
    replay = two.where(F.col("one.second") == F.col("two.second")).select("file", F.col("one.second").alias("replay"))
    counts = rows.where("counted").join(replay, "file", "left")
    counts = leading_run(counts, F.coalesce(F.col("spawned") & (second == F.col("replay")), F.lit(False)), ["file"], ["line_no"], "skipped")
    span = F.floor(F.col("line_no") / RANGE)  # a long session is spread by its bytes
    parts = ("input", "cached", "output", "reasoning", "total")
    counts = counts.withColumns({f"t_{k}": F.col(f"total.{k}") for k in parts})
    counts = running_delta(counts, [f"t_{k}" for k in parts], ["file"], ["line_no"], span=span)
    minus = F.struct(*(F.col(f"t_{k}_delta").alias(k) for k in parts))
    counts = counts.withColumn("usage", F.coalesce("own", F.when(F.col("total").isNotNull(), minus))).where("not skipped")
    others = rows.where("not counted").withColumn("usage", F.col("own"))
    names = ["file", "line_no", "session_id", "ts_text", "usage", "named", "context"]
    events = counts.select(*names).unionByName(others.select(*names))
    some = sum((F.coalesce(F.col(f"usage.{k}"), F.lit(0)) for k in ("input", "cached", "output", "reasoning")), F.lit(0)) > 0
    events = events.withColumn("is_usage", ~F.col("context") & F.coalesce(some, F.lit(False)) & F.col("ts_text").isNotNull())
    #: Only contexts and events with usage can set the model.
    events = events.withColumn("carried", F.when(F.col("context") | F.col("is_usage"), F.col("named")))
    events = carry_forward(events, ["carried"], ["file"], ["line_no"], span=span).where("is_usage")
    model = F.coalesce("carried", F.lit(DEFAULT))
    day = F.when(F.col("ts_text").rlike(r"^\d{4}-\d{2}-\d{2}") & F.substring("ts_text", 1, 10).try_cast("date").isNotNull(), F.substring("ts_text", 1, 10))
    return events.select(
        "session_id",
        "file",
        "line_no",
        "ts_text",
        T.strict_ms(F.col("ts_text")).alias("ts_ms"),
        review_model(model, day).alias("model"),
        (F.col("carried").isNull() | (model == REVIEW_MODEL)).alias("is_fallback"),
        F.col("usage.input").alias("input_tokens"),
        F.least("usage.cached", "usage.input").alias("cached_tokens"),
        F.col("usage.output").alias("output_tokens"),
        F.col("usage.reasoning").alias("reasoning_tokens"),
        F.col("usage.total").alias("total_tokens"),
    )


def dedupe_events(events: DataFrame, by_session: bool = False) -> DataFrame:
    """Events equal in time, model and all counters are one (in session reports, within a
    session); of them the first by file and line stays."""
    keys = ["ts_text", "model", "input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
    w = Window.partitionBy(*keys, *["session_id"] * by_session).orderBy("file", "line_no")
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def wants_fast_tier(config_text: str) -> bool:
    """Does a TOML file set ``service_tier`` to fast or priority?"""
    for line in config_text.splitlines():
        m = re.match(r"\s*service_tier\s*=\s*[\"']*([^\"'#]*)", line.split("#")[0])
        if m and m[1].strip() in ("fast", "priority"):
            return True
    return False
