"""Reports over priced usage rows: periods, sessions, totals, blocks, and all tools at once."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import jsonpick as J
from tallyforge.functions import timestamps as T
from tallyforge.functions.costs import burn_rate, cumulative_log_cost, limit_status, projection
from tallyforge.functions.names import project_name
from tallyforge.functions.tokens import COUNTERS, total_tokens
from tallyforge.operators.blocks import block_starts, gap_blocks, is_active
from tallyforge.operators.dedupe import dedupe_agent
from tallyforge.operators.pricing import price
from tallyforge.sources.agents import READERS
from tallyforge.sources.codex import dedupe_events, read_codex, wants_fast_tier
from tallyforge.sources.rates import Rate, built_in, match_models
from tallyforge.sources.textlogs import json_lines, last_line, listed_files, written

ORD = ["ts_ms", "file", "line_no", "item_no"]


@dataclass(frozen=True)
class Options:
    """What a report can be asked for. Dates are ``yyyyMMdd`` or ``yyyy-MM-dd``, inclusive."""

    since: str | None = None
    until: str | None = None
    timezone: str = "UTC"
    mode: str = "auto"
    order: str = "asc"
    week_starts: str = "sunday"
    project: str | None = None
    cards: list[dict[str, Rate]] = field(default_factory=lambda: [built_in()])
    now_ms: int | None = None
    block_hours: float = 5.0
    fast: bool = False


#: Option names of settings files and the fields that they set.
SETTING_NAMES = {"since": "since", "until": "until", "timezone": "timezone", "mode": "mode", "order": "order", "startOfWeek": "week_starts", "project": "project", "sessionLength": "block_hours", "speed": "fast"}


def options_of(found: dict, cards: list[dict[str, Rate]] | None = None) -> Options:
    """Options from merged settings (see ``plans.config.settings``); unknown names are left out."""
    given = {field_name: found[name] for name, field_name in SETTING_NAMES.items() if found.get(name) is not None}
    given |= {f.name: found[f.name] for f in fields(Options) if found.get(f.name) is not None and f.name not in given}
    if "fast" in given:
        given["fast"] = given["fast"] in (True, "fast", "priority")
    if "block_hours" in given:
        given["block_hours"] = float(given["block_hours"])
    return Options(**given | ({"cards": cards} if cards else {}))


def load_usage(spark: SparkSession, agent: str, path: str | list[str], options: Options = Options()) -> DataFrame:
    """Read, deduplicated and priced usage of one tool, with its local ``date``. ``path`` may be
    a list of roots. Date bounds are left to the reports: a session or block that straddles
    one is whole until it is filtered.

    The parsed rows are written once to the checkpoint folder: reports read them several
    times, and parsing logs is the dear part."""
    roots = [path] if isinstance(path, str) else [*path]
    own = {"project": options.project} if agent == "claude" and options.project else {}
    read = reduce(DataFrame.unionByName, (READERS[agent](spark, root, **own) for root in roots))
    rows = price(written(dedupe_agent(read, agent)), options.cards, options.mode)
    return dated(rows, options)


def dated(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Priced rows with their local ``date``, of the asked project."""
    rows = rows.withColumn("date", T.local_date(F.col("ts_ms"), options.timezone))
    return rows.where(F.col("project") == options.project) if options.project else rows


def between(df: DataFrame, day: Column, options: Options) -> DataFrame:
    plain = F.regexp_replace(day, "-", "")
    if options.since:
        df = df.where(plain >= options.since.replace("-", ""))
    if options.until:
        df = df.where(plain <= options.until.replace("-", ""))
    return df


def sorted_by(df: DataFrame, options: Options, *keys: str) -> DataFrame:
    return df.orderBy(*(F.desc(k) if options.order == "desc" else F.asc(k) for k in keys))


_SUMS = [*COUNTERS, "extra_tokens", "cost"]


def summarize(rows: DataFrame, keys: list[str], more: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Sums for each key, models in order of first use, and a breakdown by model, dearest first.

    Two levels: (key, model), then key; both combine before they shuffle. Rows without a
    model count in the sums alone. ``more``: further columns, as aggregates of either level.
    """
    more = more or {}
    first = F.min(F.struct(*ORD)).alias("first")
    inner = [one.alias(name) for name, (one, _) in more.items()]
    by_model = rows.groupBy(*keys, "model").agg(*(F.sum(c).alias(c) for c in _SUMS), F.sum("credits").alias("credits"), F.sum("message_count").alias("message_count"), F.max(F.col("missing_pricing").isNotNull()).alias("missing_pricing"), first, *inner)
    named = F.col("model").isNotNull()
    item = F.struct((-F.col("cost")).alias("_by"), F.col("first").alias("_then"), F.col("model").alias("model"), *(F.col(c) for c in _SUMS), F.col("missing_pricing"))
    out = by_model.groupBy(*keys).agg(
        *(F.sum(c).alias(c) for c in _SUMS),
        F.sum("credits").alias("credits"),
        F.sum("message_count").alias("message_count"),
        F.transform(F.sort_array(F.collect_list(F.when(named, F.struct("first", "model")))), lambda x: x["model"]).alias("models_used"),
        F.transform(F.sort_array(F.collect_list(F.when(named, item))), lambda x: x.dropFields("_by", "_then")).alias("model_breakdowns"),
        *(two.alias(name) for name, (_, two) in more.items()),
    )
    return out.withColumn("total_tokens", total_tokens())


def daily(rows: DataFrame, options: Options = Options(), by_project: bool = False, aliases: dict[str, str] | None = None) -> DataFrame:
    """By day (and project, with a readable ``project_label``)."""
    out = summarize(between(rows, F.col("date"), options), ["date", "project"] if by_project else ["date"])
    if by_project:
        out = out.withColumn("project_label", project_name(F.col("project"), aliases))
    return sorted_by(out, options, "date")


def monthly(rows: DataFrame, options: Options = Options()) -> DataFrame:
    rows = between(rows, F.col("date"), options).withColumn("month", F.substring("date", 1, 7))
    return sorted_by(summarize(rows, ["month"]), options, "month")


def weekly(rows: DataFrame, options: Options = Options()) -> DataFrame:
    week = T.week_start(T.iso_date(F.col("date")), options.week_starts)
    rows = between(rows, F.col("date"), options).withColumn("week", F.coalesce(F.date_format(week, "yyyy-MM-dd"), "date"))
    return sorted_by(summarize(rows, ["week"]), options, "week")


def sessions(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """By (project path, session), dearest first: activity, versions, the usual sums; sessions
    without tokens go. Bounds hold the local day of the last activity, both ends included;
    a session that straddles a bound keeps all its rows or none."""
    keys = ["project_path", "session_id"]
    about = {
        "first_ms": (F.min("ts_ms"), F.min("first_ms")),
        "last_ms": (F.max("ts_ms"), F.max("last_ms")),
        "versions": (F.collect_set("version"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("versions"))))),
    }
    out = summarize(rows, keys, about).where(total_tokens(extra=False) > 0)
    out = out.withColumns({"first_activity": T.iso_ms(F.col("first_ms")), "last_activity": T.iso_ms(F.col("last_ms"))})
    out = between(out, T.local_date(F.col("last_ms"), options.timezone), options)
    return out.orderBy(F.desc("cost"), *keys)


def agent_sessions(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """The session form of tools without project paths: by session alone, in the order of ids,
    with the last activity; sessions without tokens stay. Bounds as in ``sessions``."""
    out = summarize(rows, ["session_id"], {"last_ms": (F.max("ts_ms"), F.max("last_ms"))})
    out = between(out, T.local_date(F.col("last_ms"), options.timezone), options)
    return out.withColumn("last_activity", T.iso_ms(F.col("last_ms"))).orderBy("session_id")


def _of_session(session_id: str) -> Column:
    """Rows under the session's own id or the one of their file."""
    return (F.col("session_id") == session_id) | F.coalesce(F.col("raw_session_id") == session_id, F.lit(False))


def session_detail(rows: DataFrame, session_id: str) -> DataFrame:
    """The entries of one session in time order."""
    return rows.where(_of_session(session_id)).withColumn("total_tokens", total_tokens()).orderBy(*ORD)


def session_totals(rows: DataFrame, session_id: str) -> DataFrame:
    """entries, total_tokens and cost of one session."""
    return rows.where(_of_session(session_id)).agg(F.count("*").alias("entries"), F.coalesce(F.sum(total_tokens()), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))


def statusline_costs(rows: DataFrame, session_id: str, today: str) -> DataFrame:
    """session_cost (null without rows) and today_cost, in one pass."""
    own = F.sum(F.when(_of_session(session_id), F.col("cost"))).alias("session_cost")
    return rows.agg(own, F.coalesce(F.sum(F.when(F.col("date") == today, F.col("cost"))), F.lit(0.0)).alias("today_cost"))


def last_usage(line: bytes) -> bool:
    """Is it an assistant's line with usage?"""
    if b"input_tokens" not in line:
        return False
    try:
        row = json.loads(line)
        return row["type"] == "assistant" and row["message"]["usage"]["input_tokens"] is not None
    except (ValueError, TypeError, KeyError):
        return False


def transcript_context(spark: SparkSession, transcript: str, model: str, options: Options = Options()) -> DataFrame:
    """context_tokens of a transcript's last assistant line with usage, and the model's
    context_limit by the cards (null if none knows it). The transcript is read from its end."""
    rows, v = json_lines(last_line(listed_files(spark, transcript, "*"), last_usage)), F.col("v")
    u = ("message", "usage")
    tokens = J.u64(v, *u, "input_tokens") + J.u64(v, *u, "cache_creation_input_tokens") + J.u64(v, *u, "cache_read_input_tokens")
    last = rows.agg(F.max(tokens).alias("context_tokens"))  # of one row
    limits = match_models(spark.createDataFrame([(model,)], "model string"), options.cards)
    return last.crossJoin(F.broadcast(limits.select(F.col("rate.context_limit").alias("context_limit"))))  # one row each


def totals(summary: DataFrame) -> DataFrame:
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_SUMS, "total_tokens")]
    return summary.agg(*sums, F.sum("credits").alias("credits"))


def missing_models(rows: DataFrame) -> DataFrame:
    return rows.where("missing_pricing is not null").select(F.col("missing_pricing").alias("model")).distinct().orderBy("model")


def activity_blocks(rows: DataFrame, options: Options = Options(), group: list[str] = (), token_limit: int | None = None) -> DataFrame:
    """Blocks and the gaps between them: times, counters (without extra tokens), models, burn
    rate, and for the active block a projection and how it stands to the limit.

    ``token_limit`` None takes the largest finished block of all. Without ``group`` the whole
    history is one sequence, as the report has it. Date bounds hold the local day on which a
    block or gap starts; blocks form before they are filtered."""
    duration = int(options.block_hours * T.HOUR_MS)
    now = F.lit(options.now_ms) if options.now_ms is not None else F.unix_millis(F.current_timestamp())
    group = [*group] or ["_all"]
    rows = rows.withColumn("_all", F.lit(1))
    placed = block_starts(rows, "ts_ms", group, duration, T.HOUR_MS)
    plain = F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("plain")
    by_model = F.min(F.struct(*ORD)).alias("first_use")
    used = placed.where("model is not null").groupBy(*group, "block_start", "model").agg(by_model)
    models = used.groupBy(*group, "block_start").agg(F.transform(F.sort_array(F.collect_list(F.struct("first_use", "model"))), lambda x: x["model"]).alias("models"))
    out = placed.groupBy(*group, "block_start").agg(
        F.min("ts_ms").alias("first"),
        F.max("ts_ms").alias("last"),
        F.count("*").alias("entries"),
        *(F.sum(c).alias(c) for c in (*COUNTERS, "cost")),
        plain,
        F.min_by("reset_ms", F.when(F.col("reset_ms").isNotNull(), F.struct(*ORD))).alias("reset_ms"),
    )
    out = out.join(models, [*group, "block_start"], "left")
    gaps = gap_blocks(out, group, duration).select(*group, F.col("gap_start").alias("block_start"), F.col("gap_end").alias("block_end"), F.lit(True).alias("is_gap"), F.concat(F.lit("gap-"), T.iso_ms(F.col("gap_start"))).alias("id"))
    tokens = total_tokens(extra=False)
    out = out.withColumn("extra_tokens", F.lit(0)).withColumns(
        {
            "block_end": F.col("block_start") + duration,
            "is_gap": F.lit(False),
            "id": T.iso_ms(F.col("block_start")),
            "total_tokens": tokens,
            "is_active": is_active(F.col("last"), F.col("block_start"), now, duration),
        }
    )
    out = out.withColumns(burn_rate(F.col("first"), F.col("last"), F.col("total_tokens"), F.col("plain"), F.col("cost")))
    ahead = projection(F.col("block_end"), now, F.col("total_tokens"), F.col("cost"), F.col("tokens_per_minute"), F.col("cost_per_hour"))
    out = out.withColumns({k: F.when(F.col("is_active"), c) for k, c in ahead.items()})
    if token_limit is None:
        most = out.agg(F.max(F.when(~F.col("is_active"), F.col("total_tokens"))).alias("token_limit"))
        out = out.crossJoin(F.broadcast(most))  # one row
    else:
        out = out.withColumn("token_limit", F.lit(token_limit))
    out = out.withColumn("limit_status", limit_status(F.col("projected_tokens"), F.nullif("token_limit", F.lit(0))))
    out = out.unionByName(gaps, allowMissingColumns=True).drop("_all", "extra_tokens", "plain")
    return sorted_by(between(out, T.local_date(F.col("block_start"), options.timezone), options), options, "block_start")


def recent_blocks(blocks: DataFrame, options: Options, days: int = 3, active_only: bool = False) -> DataFrame:
    now = F.lit(options.now_ms) if options.now_ms is not None else F.unix_millis(F.current_timestamp())
    active = F.coalesce(F.col("is_active"), F.lit(False))
    return blocks.where(active if active_only else active | (F.col("block_start") >= now - days * 24 * T.HOUR_MS))


# ---- logs with running totals --------------------------------------------------------


def codex_report(spark: SparkSession, homes, kind: str, options: Options = Options(), config_text: str | None = None) -> DataFrame:
    """Periods or sessions: sums by model are priced after they are summed. ``config_text`` is
    the tool's own settings file, which can ask for the fast tier."""
    if config_text is not None and wants_fast_tier(config_text):
        options = replace(options, fast=True)
    rows = dedupe_events(written(read_codex(spark, homes)), by_session=kind == "session").where("ts_ms is not null")
    rows = rows.withColumn("date", T.local_date(F.col("ts_ms"), options.timezone))
    rows = between(rows, F.col("date"), options)
    week = F.date_format(T.week_start(T.iso_date(F.col("date")), "monday"), "yyyy-MM-dd")
    period = {"daily": F.col("date"), "monthly": F.substring("date", 1, 7), "weekly": week, "session": F.col("session_id")}[kind]
    names = ["input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens"]
    by_model = rows.withColumn("period", period).groupBy("period", "model").agg(*(F.sum(c).alias(c) for c in names), F.max("is_fallback").alias("is_fallback"), F.max("ts_text").alias("last_activity"))
    rates = match_models(by_model, options.cards)
    by_model = by_model.join(rates, "model", "left").withColumn("cost", F.coalesce(cumulative_log_cost(F.col("rate"), options.fast), F.lit(0.0)))
    item = F.struct("model", (F.col("input_tokens") - F.col("cached_tokens")).alias("input_tokens"), *(F.col(c) for c in names[1:]), "cost", "is_fallback", F.col("rate").isNull().alias("missing_pricing"))
    out = by_model.groupBy("period").agg(
        F.sum(F.col("input_tokens") - F.col("cached_tokens")).alias("input_tokens"),
        F.sum("cached_tokens").alias("cache_read_tokens"),
        *(F.sum(c).alias(c) for c in (*names[2:], "cost")),
        F.max("last_activity").alias("last_activity"),
        F.sort_array(F.collect_list(item)).alias("models"),
    )
    return sorted_by(out, options, "period")


# ---- all tools -----------------------------------------------------------------------

PERIODS = ("daily", "weekly", "monthly", "session")


def period_rows(table: DataFrame, period: str) -> DataFrame:
    """A tool's report in the columns that all tools share."""
    return table.select(F.col(period).alias("period"), "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "cost", "models_used", "model_breakdowns")


def of_agent(periods: DataFrame, agent: str) -> DataFrame:
    """Period rows of one tool, those with tokens, under its name."""
    return periods.where("total_tokens > 0").withColumn("agent", F.lit(agent))


def unified_rows(spark: SparkSession, places: dict[str, str], kind: str, options: Options = Options()) -> DataFrame:
    """One row for each (period, tool): sums, distinct models, breakdown; rows without tokens go.

    ``places`` maps tools to their folders. Weeks start on Monday."""
    parts = []
    for agent, path in places.items():
        if agent == "codex":
            rows = codex_report(spark, path, kind, options)
            flat = F.transform(
                "models",
                lambda m: F.struct(
                    m["model"].alias("model"),
                    m["input_tokens"].alias("input_tokens"),
                    m["output_tokens"].alias("output_tokens"),
                    F.lit(0).cast("long").alias("cache_creation_tokens"),
                    m["cached_tokens"].alias("cache_read_tokens"),
                    F.lit(0).cast("long").alias("extra_tokens"),
                    m["cost"].alias("cost"),
                    m["missing_pricing"].alias("missing_pricing"),
                ),
            )
            part = rows.select("period", "input_tokens", "output_tokens", F.lit(0).cast("long").alias("cache_creation_tokens"), "cache_read_tokens", "total_tokens", "cost", F.transform("models", lambda m: m["model"]).alias("models_used"), flat.alias("model_breakdowns"))
        else:
            rows = load_usage(spark, agent, path, options)
            monday = replace(options, week_starts="monday")
            table = {"daily": daily, "weekly": weekly, "monthly": monthly, "session": sessions}[kind](rows, monday)
            period = {"daily": "date", "weekly": "week", "monthly": "month", "session": "session_id"}[kind]
            part = period_rows(table, period)
        parts.append(of_agent(part, agent))
    return reduce(DataFrame.unionByName, parts)


def unified(spark: SparkSession, places: dict[str, str], kind: str = "daily", options: Options = Options()) -> DataFrame:
    """All tools by period, each period with a row for each tool inside; sessions stay rows."""
    rows = unified_rows(spark, places, kind, options)
    return sorted_by(rows, options, "period", "agent") if kind == "session" else sorted_by(roll_up(rows), options, "period")


def roll_up(rows: DataFrame) -> DataFrame:
    """Rows of (period, tool) by period, with the tools' rows inside and models merged."""
    sums = ["input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens", "cost"]
    inner = F.struct("agent", *sums, F.array_sort("models_used").alias("models_used"), "model_breakdowns")
    out = rows.groupBy("period").agg(
        *(F.sum(c).alias(c) for c in sums),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("models_used")))).alias("models_used"),
        F.array_sort(F.collect_set("agent")).alias("agents"),
        F.sort_array(F.collect_list(inner)).alias("agent_breakdowns"),
    )
    each = rows.select("period", F.inline("model_breakdowns"))
    merged = each.groupBy("period", "model").agg(*(F.sum(c).alias(c) for c in _SUMS), F.max("missing_pricing").alias("missing_pricing"))
    item = F.struct((-F.col("cost")).alias("_by"), F.col("model"), *(F.col(c) for c in _SUMS), F.col("missing_pricing"))
    merged = merged.groupBy("period").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("_by")).alias("model_breakdowns"))
    return out.join(merged, "period", "left")
