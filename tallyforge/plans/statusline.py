"""The status line of open sessions: each session's hook (a JSON text) meets the priced usage.

Hooks are a DataFrame, so one run answers for all open sessions; a single session is a hook of
one row. Costs of sessions and of the day, and the active block, come from one set of priced rows.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import formats
from tallyforge.functions import jsonpick as J
from tallyforge.functions import timestamps as T
from tallyforge.functions.costs import burn_status
from tallyforge.plans.reports import Options, activity_blocks, last_usage
from tallyforge.sources.rates import match_models
from tallyforge.sources.textlogs import json_lines, last_line, listed_files

HOOK = """session_id string, transcript_path string, model struct<id: string, display_name: string>,
    cost struct<total_cost_usd: double>, context_window struct<total_input_tokens: long, context_window_size: long>"""
#: The context of a model that no card knows, hours of a block, marks of a burn rate.
CONTEXT, BLOCK_HOURS = 200_000, 5.0
MARKS = {"Normal": "🟢", "Moderate": "⚠️", "High": "🚨"}
#: What a session's cost is taken from: its hook or else the logs, one of them, or both side by side.
COST_SOURCES = ("auto", "hook", "logs", "both")
BURN_STYLES = ("off", "emoji", "text", "emoji-text")


def read_hooks(hooks: DataFrame, column: str = "json") -> DataFrame:
    """The fields of each hook. One that is no JSON or lacks its session, transcript or the
    model's display name raises."""
    h = F.from_json(F.trim(F.col(f"`{column}`")), HOOK)
    whole = h["session_id"].isNotNull() & h["transcript_path"].isNotNull() & h["model"]["display_name"].isNotNull()
    checked = F.when(whole, h).otherwise(F.raise_error(F.lit("a hook needs session_id, transcript_path and model.display_name")))
    return hooks.select(F.explode(F.array(checked)).alias("h")).select("h.*")


def logged_costs(rows: DataFrame, hooks: DataFrame) -> DataFrame:
    """session_id and logged_cost, of the sessions of ``hooks`` that have rows: a row counts under
    its own id and its file's, once if these are equal."""
    ids = F.array_distinct(F.array_compact(F.array("session_id", "raw_session_id")))
    each = rows.select(F.explode(ids).alias("session_id"), "cost")
    return each.join(hooks.select("session_id").distinct(), "session_id", "left_semi").groupBy("session_id").agg(F.sum("cost").alias("logged_cost"))


def contexts(hooks: DataFrame, transcripts: str | list[str] | None, options: Options) -> DataFrame:
    """transcript_path, model_id, used and size of hooks that don't tell their context: the last
    assistant line with usage of the transcript below ``transcripts``, and the model's limit."""
    asked = hooks.where("context_window is null").select("transcript_path", F.col("model.id").alias("model_id")).distinct()
    limits = match_models(asked.select(F.col("model_id").alias("model")), options.cards)
    asked = asked.join(limits.select(F.col("model").alias("model_id"), F.col("rate.context_limit").alias("limit")), "model_id", "left")
    spark = hooks.sparkSession
    files = listed_files(spark, transcripts, "*")
    files = files.join(asked.select(F.col("transcript_path").alias("file")).distinct(), "file", "left_semi")
    last = json_lines(last_line(files, last_usage))
    u = ("message", "usage")
    parts = [J.u64(F.col("v"), *u, k) for k in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    used = last.select(F.col("file").alias("transcript_path"), sum(parts[1:], parts[0]).alias("used"))
    return asked.join(used, "transcript_path").select("transcript_path", "model_id", "used", F.coalesce("limit", F.lit(CONTEXT)).alias("size"))


def status(hooks: DataFrame, rows: DataFrame, options: Options = Options(), transcripts: str | list[str] | None = None, column: str = "json", aliases: dict[str, str] | None = None) -> DataFrame:
    """One row for each hook: session_id, model_label, hook_cost, logged_cost (0 without rows),
    today_cost, block_cost, minutes_left, cost_per_hour and plain_per_minute of the active block,
    context_used, context_size, context_percent and context_color.

    ``rows`` are priced and dated (``load_usage``). ``transcripts``: the folders that hold the
    transcripts; without, only contexts that hooks tell are known. ``aliases``: short labels by
    display name. Hooks of one session are told apart by nothing and all answered.
    """
    told = read_hooks(hooks, column)
    now = F.lit(options.now_ms) if options.now_ms is not None else F.unix_millis(F.current_timestamp())
    day = F.coalesce(F.sum(F.when(F.col("date") == T.local_date(now, options.timezone), F.col("cost"))), F.lit(0.0))
    blocks = activity_blocks(rows, replace(options, block_hours=BLOCK_HOURS, since=None, until=None), token_limit=0).where("is_active and not is_gap")
    block = F.struct("block_end", "cost", "cost_per_hour", "plain_per_minute")
    shared = rows.agg(day.alias("today_cost")).crossJoin(blocks.agg(F.min_by(block, "block_start").alias("block")))  # one row each
    out = told.join(logged_costs(rows, told), "session_id", "left").crossJoin(F.broadcast(shared))  # one row
    used, size = F.col("context_window.total_input_tokens"), F.col("context_window.context_window_size")
    if transcripts is not None:
        found = contexts(told, transcripts, options).withColumnRenamed("transcript_path", "path")
        out = out.join(found, F.col("context_window").isNull() & (F.col("path") == F.col("transcript_path")) & F.col("model_id").eqNullSafe(F.col("model.id")), "left")
        used, size = F.coalesce(used, "used"), F.coalesce(size, "size")
    name = F.col("model.display_name")
    if aliases:
        name = F.coalesce(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))[name], name)
    out = out.select(
        "session_id",
        name.alias("model_label"),
        F.col("cost.total_cost_usd").alias("hook_cost"),
        F.coalesce("logged_cost", F.lit(0.0)).alias("logged_cost"),
        "today_cost",
        F.col("block.cost").alias("block_cost"),
        F.floor((F.col("block.block_end") - now) / 60_000).alias("minutes_left"),
        "block.cost_per_hour",
        "block.plain_per_minute",
        used.alias("context_used"),
        size.alias("context_size"),
    )
    percent = F.when(F.col("context_used").isNotNull(), formats.context_share(F.col("context_used"), F.col("context_size")))
    return out.withColumn("context_percent", percent).withColumn("context_color", F.when(F.col("context_percent").isNotNull(), formats.context_color(F.col("context_percent"))))


def session_cost(source: str = "auto") -> Column:
    """The text of a session's cost."""
    if source not in COST_SOURCES:
        raise ValueError(f"a cost source is one of {COST_SOURCES}")
    hook, logs = F.col("hook_cost"), F.col("logged_cost")
    money = lambda x: F.coalesce(F.when(x.isNotNull(), formats.currency(x)), F.lit("N/A"))
    if source == "both":
        return F.concat(F.lit("("), money(hook), F.lit(" hook / "), money(logs), F.lit(" logs)"))
    return money({"auto": F.coalesce(hook, logs), "hook": hook, "logs": logs}[source])


def line(cost_source: str = "auto", burn: str = "off") -> Column:
    """The one-line text of a row of ``status``; ``burn``: how the burn rate is marked."""
    if burn not in BURN_STYLES:
        raise ValueError(f"a burn style is one of {BURN_STYLES}")
    level = burn_status(F.col("plain_per_minute"))
    mark = F.create_map(*(F.lit(x) for pair in MARKS.items() for x in pair))[level]
    rate = [F.concat(formats.currency(F.col("cost_per_hour")), F.lit("/hr"))]
    rate += [mark] * ("emoji" in burn) + [F.concat(F.lit("("), level, F.lit(")"))] * ("text" in burn)
    pace = F.when(F.col("cost_per_hour").isNotNull(), F.concat(F.lit(" | 🔥 "), F.concat_ws(" ", *rate))).otherwise("")
    block = F.concat(formats.currency(F.col("block_cost")), F.lit(" block ("), formats.remaining_time(F.col("minutes_left")), F.lit(")"), pace)
    block = F.when(F.col("block_cost").isNull(), "No active block").otherwise(block)
    context = F.concat(formats.whole_number(F.col("context_used")), F.lit(" ("), F.col("context_percent").cast("string"), F.lit("%)"))
    costs = [session_cost(cost_source), F.lit(" session / "), formats.currency(F.col("today_cost")), F.lit(" today / ")]
    return F.concat(F.lit("🤖 "), "model_label", F.lit(" | 💰 "), *costs, block, F.lit(" | 🧠 "), F.coalesce(context, F.lit("N/A")))
