"""Usage logs of coding tools, each read into the same columns.

Every reader takes (spark, path) and gives one row for each usage record, before
deduplication and pricing. ``candidates`` are the names under which a row may be priced, in
order; ``price_rule`` says which of them counts (the first with a price, or the first with a
cost above 0) and how recorded costs are used; ``bill_extra`` whether tokens that only a total shows
are billed as output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.functions import jsonpick as J
from tallyforge.functions import names as N
from tallyforge.functions import timestamps as T
from tallyforge.functions.tokens import saturating_minus, total_tokens, with_total_fallback
from tallyforge.operators.carry import carry_forward
from tallyforge.operators.dedupe import keep_highest
from tallyforge.sources.sqlite import sqlite_rows
from tallyforge.sources.textlogs import RANGE, json_lines, listed_files, log_lines, once, range_lines, whole_files, written

COLUMNS = {
    "agent": "string",
    "file": "string",
    "line_no": "long",
    "item_no": "long",
    "ts_ms": "long",
    "ts_text": "string",
    "session_id": "string",
    "raw_session_id": "string",
    "project": "string",
    "project_path": "string",
    "message_id": "string",
    "request_id": "string",
    "version": "string",
    "model": "string",
    "speed": "string",
    "input_tokens": "long",
    "output_tokens": "long",
    "cache_creation_tokens": "long",
    "cache_read_tokens": "long",
    "cache_5m_tokens": "long",
    "cache_1h_tokens": "long",
    "extra_tokens": "long",
    "recorded_cost": "double",
    "credits": "double",
    "message_count": "long",
    "is_sidechain": "boolean",
    "reset_ms": "long",
    "candidates": "array<string>",
    "price_rule": "string",
    "bill_extra": "boolean",
}


def usage(df: DataFrame, agent: str, **given: Column) -> DataFrame:
    """``df`` in the common columns; what isn't given is 0, false or null by its kind."""
    empty = {"extra_tokens": F.lit(0), "cache_creation_tokens": F.lit(0), "cache_read_tokens": F.lit(0), "is_sidechain": F.lit(False), "bill_extra": F.lit(False)}
    empty |= {"item_no": F.lit(0), "price_rule": F.lit("mode"), "agent": F.lit(agent), "project": F.lit(agent)}
    pick = {}
    for name, kind in COLUMNS.items():
        value = given.get(name, F.col(name) if name in df.columns else empty.get(name, F.lit(None)))
        pick[name] = value.cast(kind).alias(name)
    out = df.select(*pick.values())
    #: Filters on the columns stay above this, so none of them is computed twice.
    out = once(out.select(F.struct(*COLUMNS).alias("_row")), "_row", F.col("_row")).select("_row.*")
    out = out.withColumn("ts_text", F.coalesce("ts_text", T.iso_ms(F.col("ts_ms"))))
    return out.withColumn("candidates", F.coalesce("candidates", F.when(F.col("model").isNotNull(), F.array("model"))))


def some_tokens(df: DataFrame) -> DataFrame:
    return df.where(total_tokens() > 0)


def _counters(v: Column, **where: tuple) -> dict[str, Column]:
    return {f"{name}_tokens": J.u64(v, *path) for name, path in where.items()}


# ---- JSON Lines ---------------------------------------------------------------------

NULLS = "id|cwd|model|speed|costUSD|version|sessionId|requestId|isApiErrorMessage|cache_read_input_tokens|cache_creation_input_tokens"


def _well_typed(v: Column, text: list[tuple], flags: list[tuple], numbers: list[tuple], counts: list[tuple]) -> Column:
    """Each place that is there (and not null) has its kind; counts are not negative."""
    ok = F.lit(True)
    for keys in text:
        ok &= F.coalesce(J.kind(v, *keys).isin("STRING", "VOID"), F.lit(True))
    for keys in flags:
        ok &= F.coalesce(J.kind(v, *keys).isin("BOOLEAN", "VOID"), F.lit(True))
    for keys in numbers:
        ok &= F.coalesce(J.kind(v, *keys).rlike("^(BIGINT|DECIMAL|DOUBLE|VOID)"), F.lit(True))
    for keys in counts:
        ok &= F.coalesce((J.kind(v, *keys) == "BIGINT") & (J.integer(v, *keys) >= 0), ~J.exists(v, *keys))
    return ok


def read_claude(spark: SparkSession, path: str, project: str | None = None) -> DataFrame:
    """Lines with the bytes ``"usage":{`` that are fully well-formed; also such records nested
    under ``data.message``. With ``project`` the files of other projects are not opened."""
    own = None if project is None else N.claude_session(F.col("file"))[0] == project
    rows = log_lines(spark, path, "*.jsonl", [['"usage":{']], own)
    rows = rows.where(~F.col("value").rlike(f'"({NULLS})"[^"]?:null'))
    rows = json_lines(rows)
    nested = ~J.exists(F.col("v"), "message") & J.exists(F.col("v"), "data", "message", "message")
    rows = once(rows, "v", F.when(nested, J.node(F.col("v"), "data", "message")).otherwise(F.col("v")))
    v, u = F.col("v"), ("message", "usage")
    strict = _well_typed(
        v,
        [("timestamp",), ("sessionId",), ("version",), ("requestId",), ("message", "id"), ("message", "model")],
        [("isSidechain",), ("isApiErrorMessage",)],
        [("costUSD",)],
        [(*u, x) for x in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")],
    )
    needed = J.exists(v, *u, "input_tokens") & J.exists(v, *u, "output_tokens") & J.raw_text(v, "timestamp").isNotNull()
    speed = J.raw_text(v, *u, "speed")
    filled = F.lit(True)
    for keys in (("sessionId",), ("requestId",), ("message", "id"), ("message", "model")):
        filled &= F.coalesce(J.raw_text(v, *keys) != "", F.lit(True))
    version = F.coalesce(J.raw_text(v, "version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]"), F.lit(True))
    known_speed = F.coalesce(J.kind(v, *u, "speed") == "VOID", ~J.exists(v, *u, "speed")) | speed.isin("standard", "fast")
    rows = rows.where(strict & needed & filled & version & known_speed)
    model = J.raw_text(v, "message", "model")
    project, session, where = N.claude_session(F.col("file"))
    reset = F.regexp_extract("value", r"(?s)Claude AI usage limit reached[^|]*\|(\d+)", 1).try_cast("long")
    split = J.exists(v, *u, "cache_creation")
    out = usage(
        rows,
        "claude",
        ts_ms=T.strict_ms(J.raw_text(v, "timestamp")),
        ts_text=J.raw_text(v, "timestamp"),
        session_id=session,
        raw_session_id=J.raw_text(v, "sessionId"),
        project=project,
        project_path=where,
        message_id=J.raw_text(v, "message", "id"),
        request_id=J.raw_text(v, "requestId"),
        version=J.raw_text(v, "version"),
        model=F.when(model != "<synthetic>", F.when(speed == "fast", F.concat(model, F.lit("-fast"))).otherwise(model)),
        speed=speed,
        input_tokens=J.u64(v, *u, "input_tokens"),
        output_tokens=J.u64(v, *u, "output_tokens"),
        cache_creation_tokens=F.when(split, J.u64(v, *u, "cache_creation", "ephemeral_5m_input_tokens") + J.u64(v, *u, "cache_creation", "ephemeral_1h_input_tokens")).otherwise(
            J.u64(v, *u, "cache_creation_input_tokens")
        ),
        cache_read_tokens=J.u64(v, *u, "cache_read_input_tokens"),
        cache_5m_tokens=F.when(split, J.u64(v, *u, "cache_creation", "ephemeral_5m_input_tokens")),
        cache_1h_tokens=F.when(split, J.u64(v, *u, "cache_creation", "ephemeral_1h_input_tokens")),
        recorded_cost=J.number(v, "costUSD"),
        is_sidechain=F.coalesce(J.flag(v, "isSidechain"), F.lit(False)),
        reset_ms=F.when(F.coalesce(J.flag(v, "isApiErrorMessage"), F.lit(False)) & (reset > 0), reset * 1000),
        candidates=F.when(model.isNotNull(), F.array(model)),
    )
    return out.where("ts_ms is not null")


_PI_USED = ("input", "output", "cacheWrite", "cacheRead", "totalTokens")
_PI_RECORD = f"struct<type: variant, timestamp: variant, message: struct<role: variant, model: variant, usage: struct<{J.variants(_PI_USED)}, cost: struct<total: variant>>>>"


def read_pi(spark: SparkSession, path: str) -> DataFrame:
    """Usages of assistants' messages; each value of a line is picked once, and what its file's name
    tells travels with the file's ranges."""
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    project = F.coalesce(F.nullif(F.regexp_extract("file", "/sessions/([^/]+)", 1), F.lit("")), F.lit("unknown"))
    files = listed_files(spark, path, "*.jsonl").withColumns({"session_id": F.regexp_replace(stem, "^[^_]*_", ""), "project": project})
    rows = json_lines(range_lines(files, [['"usage"', '"message"']], also=["session_id", "project"]))
    rows = once(rows, "r", J.typed(F.col("v"), _PI_RECORD)).drop("v", "value").where("r.message.usage is not null")
    kinds, u = {"type": F.col("r.type"), "timestamp": F.col("r.timestamp"), "role": F.col("r.message.role"), "model": F.col("r.message.model")}, F.col("r.message.usage")
    rows = once(rows, "t", F.struct(*(J.raw_text(x).alias(k) for k, x in kinds.items())))
    rows = rows.where("coalesce(t.type = 'message', true) and t.role = 'assistant'")
    rows = once(rows, "n", F.transform(F.array(*(u[k] for k in _PI_USED)), lambda c: J.u64(c)))
    rows = once(rows, "cost", J.number(u["cost"]["total"]))
    trimmed = lambda k: F.nullif(F.trim(f"t.{k}"), F.lit(""))
    n = {k: F.col("n")[i] for i, k in enumerate(_PI_USED)}
    out = usage(
        rows,
        "pi",
        ts_ms=T.strict_ms(trimmed("timestamp")),
        ts_text=trimmed("timestamp"),
        project=F.col("project"),
        project_path=F.col("project"),
        model=F.concat(F.lit("[pi] "), trimmed("model")),
        recorded_cost=F.col("cost"),
        input_tokens=n["input"],
        output_tokens=n["output"],
        cache_creation_tokens=n["cacheWrite"],
        cache_read_tokens=n["cacheRead"],
        message_count=n["totalTokens"],
    )
    return _settle(out)


def _settle(df: DataFrame) -> DataFrame:
    """Applies the reported total (held in message_count until here), drops rows without
    tokens or time."""
    out = with_total_fallback(df, F.coalesce("message_count", F.lit(0))).withColumn("message_count", F.lit(None).cast("long"))
    return some_tokens(out).where("ts_ms is not null")


def read_qwen(spark: SparkSession, path: str) -> DataFrame:
    rows, v = json_lines(log_lines(spark, path, "*.jsonl", [["usageMetadata"]], F.col("file").rlike(r"/projects/[^/]+/chats/[^/]+\.jsonl$"))), F.col("v")
    rows = rows.where((J.raw_text(v, "type") == "assistant") & J.exists(v, "usageMetadata"))
    u = "usageMetadata"
    project = F.regexp_extract("file", "/projects/([^/]+)/chats/", 1)
    stem = F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)
    told = T.strict_ms(J.text(v, "timestamp"))
    model = F.coalesce(J.text(v, "model"), F.lit("unknown"))
    out = usage(
        rows,
        "qwen",
        ts_ms=F.coalesce(told, "modified_ms"),
        ts_text=F.when(told.isNotNull(), J.text(v, "timestamp")),
        session_id=F.coalesce(J.text(v, "sessionId"), F.concat(project, F.lit("-"), stem)),
        project_path=project,
        model=model,
        **_counters(v, input=(u, "promptTokenCount"), output=(u, "candidatesTokenCount"), cache_read=(u, "cachedContentTokenCount"), extra=(u, "thoughtsTokenCount")),
        message_count=J.u64(v, u, "totalTokenCount"),
        candidates=F.array(model, F.concat(F.lit("qwen/"), model), F.concat(F.lit("alibaba/"), model)),
        bill_extra=F.lit(True),
    )
    return _settle(out)


KIMI_MODEL = "kimi-for-coding"
#: Fixed value: from this instant (epoch ms) the default model is the newer one.
KIMI_CUTOVER = 1_776_698_890_072


def read_kimi(spark: SparkSession, path: str) -> DataFrame:
    """Status updates; the model is in the config file four folders up (a left join by folder)."""
    rows = log_lines(spark, path, "wire.jsonl", [['"StatusUpdate"', '"token_usage"']])
    rows, v = json_lines(rows), F.col("v")
    rows = rows.where(~F.coalesce(J.raw_text(v, "type") == "metadata", F.lit(False)) & (J.raw_text(v, "message", "type") == "StatusUpdate"))
    root = lambda up: F.regexp_replace("file", f"(/[^/]*){{{up}}}$", "")
    config = whole_files(spark, path, "config.json").select(root(1).alias("root"), J.text(F.try_parse_json("value"), "model").alias("config_model"))
    rows = rows.withColumn("root", root(4)).join(config.groupBy("root").agg(F.first("config_model").alias("config_model")), "root", "left")
    u = ("message", "payload", "token_usage")
    rows = rows.where(J.exists(v, *u))
    seconds = J.number(v, "timestamp")
    ts = F.coalesce((seconds * 1000).try_cast("long"), "modified_ms")
    model = F.coalesce("config_model", F.lit(KIMI_MODEL))
    current = F.when(ts < KIMI_CUTOVER, "moonshot/kimi-k2.5").otherwise("moonshot/kimi-k2.6")
    named = F.array(F.concat(F.lit("moonshot/"), model), F.concat(F.lit("kimi/"), model), model)
    out = usage(
        rows,
        "kimi",
        ts_ms=ts,
        session_id=F.regexp_extract("file", "([^/]+)/[^/]+$", 1),
        project_path=F.lit("Kimi"),
        message_id=J.text(v, "message", "payload", "message_id"),
        model=model,
        **_counters(v, input=(*u, "input_other"), output=(*u, "output"), cache_creation=(*u, "input_cache_creation"), cache_read=(*u, "input_cache_read")),
        message_count=J.u64(v, *u, "total"),
        candidates=F.array_distinct(F.when(model == KIMI_MODEL, F.concat(F.array(current), named)).otherwise(named)),
        price_rule=F.lit("never_recorded"),
    )
    return _settle(out)


def read_openclaw(spark: SparkSession, path: str) -> DataFrame:
    """Messages take model and provider from the last change before them in their file."""
    marks = [['"model_change"'], ['"model-snapshot"'], ['"usage"']]
    rows = log_lines(spark, path, "*.jsonl*", marks, F.col("file").rlike(r"\.jsonl$|\.jsonl\.(deleted|reset)\."))
    rows, v = json_lines(rows), F.col("v")
    change = (J.raw_text(v, "type") == "model_change") | ((J.raw_text(v, "type") == "custom") & (J.raw_text(v, "customType") == "model-snapshot"))
    change = F.coalesce(change, F.lit(False))
    data = F.when(J.kind(v, "data").startswith("OBJECT"), J.node(v, "data")).otherwise(v)
    rows = rows.withColumns(
        {
            "changed_model": F.when(change, F.coalesce(J.text(data, "modelId"), J.text(data, "model"))),
            "changed_provider": F.when(change, J.text(data, "provider")),
        }
    )
    rows = carry_forward(rows, ["changed_model", "changed_provider"], ["file"], ["line_no"], span=F.floor(F.col("line_no") / RANGE))
    rows = rows.where(~change & (J.raw_text(v, "type") == "message") & (J.raw_text(v, "message", "role") == "assistant") & J.exists(v, "message", "usage"))
    m, u = "message", ("message", "usage")
    name = F.regexp_extract("file", "([^/]+)$", 1)
    own = lambda *k: F.coalesce(J.integer(v, *k), T.strict_ms(J.raw_text(v, *k)))
    ts = F.when(J.exists(v, m, "timestamp"), own(m, "timestamp")).otherwise(own("timestamp"))
    model = F.coalesce(J.text(v, m, "modelId"), J.text(v, m, "model"), "changed_model", F.lit("unknown"))
    out = usage(
        rows,
        "openclaw",
        ts_ms=F.coalesce(ts, "modified_ms"),
        session_id=F.coalesce(F.nullif(F.regexp_replace(name, r"\.jsonl.*$", ""), F.lit("")), name),
        project_path=F.lit("OpenClaw"),
        version=F.coalesce(J.text(v, m, "provider"), "changed_provider"),
        model=F.concat(F.lit("[openclaw] "), model),
        recorded_cost=J.number(v, *u, "cost", "total"),
        **_counters(v, input=(*u, "input"), output=(*u, "output"), cache_creation=(*u, "cacheWrite"), cache_read=(*u, "cacheRead")),
        message_count=J.u64(v, *u, "totalTokens"),
    )
    return _settle(out)


# ---- Copilot (telemetry records) -----------------------------------------------------

_MODEL_ATTRS = ("gen_ai.response.model", "gen_ai.request.model")
#: Attribute and priority; of equal priority the later counts.
_SESSION_ATTRS = (("gen_ai.conversation.id", 3), ("copilot_chat.session_id", 3), ("copilot_chat.chat_session_id", 3), ("session.id", 3), ("github.copilot.interaction_id", 2), ("gen_ai.response.id", 1))


_PAIRS, _MOMENTS = ("endTime", "startTime", "hrTime", "_hrTime", "time"), ("timestamp", "observedTimestamp", "timeUnixNano")
_USED = {
    "input": ("input_tokens",), "output": ("output_tokens",), "cached": ("cache_read.input_tokens",), "written": ("cache_write.input_tokens", "cache_creation.input_tokens"),
    "reasoning": ("reasoning.output_tokens", "reasoning_tokens"), "total": ("total_tokens", "total.token_count"),
}


def _loose(v: Column, *keys) -> Column:
    """A non-negative integer, also one written as text."""
    return F.when(J.integer(v, *keys) >= 0, J.integer(v, *keys)).otherwise(F.when(J.text(v, *keys).rlike(r"^\+?\d+$"), J.text(v, *keys).try_cast("long")))


def read_copilot(spark: SparkSession, path: str) -> DataFrame:
    """Four kinds of records tell of the same calls; a lower kind counts only where no higher
    one has its trace or response (anti joins within the file)."""
    rows, v = json_lines(log_lines(spark, path, "*.jsonl", [['"attributes"']])), F.col("v")
    a = lambda key: ("attributes", key)
    #: Values are picked once each, then read: nested in each other the picks outgrow a compiled method.
    texts = {k: (k,) for k in ("name", "spanId", "traceId", "body", "_body")} | {"trace_of": ("spanContext", "traceId"), "kind": a("gen_ai.operation.name"), "event": a("event.name")}
    texts |= {f"model_{i}": a(k) for i, k in enumerate(_MODEL_ATTRS)} | {f"session_{i}": a(k) for i, (k, _) in enumerate(_SESSION_ATTRS)}
    rows = once(rows, "t", F.array(*(J.text(v, *keys) for keys in texts.values())))
    t = {k: F.col("t")[i] for i, k in enumerate(texts)}
    typed = J.raw_text(v, "type")
    spanlike = t["name"].isNotNull() & (t["spanId"].isNotNull() | t["traceId"].isNotNull() | J.exists(v, "startTime") | J.exists(v, "endTime") | J.exists(v, "duration") | J.exists(v, "kind"))
    span = F.when(typed.isNotNull(), typed == "span").otherwise(spanlike)
    body = F.coalesce(t["body"], t["_body"])
    either = lambda attr, value, start, other: F.coalesce(t[attr] == value, F.lit(False)) | F.coalesce(other.startswith(start), F.lit(False))
    rank = (
        F.when(span & either("kind", "chat", "chat ", t["name"]), 1)
        .when(~span & either("event", "gen_ai.client.inference.operation.details", "GenAI inference:", body), 2)
        .when(~span & either("event", "copilot_chat.agent.turn", "copilot_chat.agent.turn", body), 3)
        .when(span & either("kind", "invoke_agent", "invoke_agent ", t["name"]), 4)
    )
    told = sorted(((p, i) for i, (_, p) in enumerate(_SESSION_ATTRS)), reverse=True)
    session = F.coalesce(*(t[f"session_{i}"] for _, i in told))
    priority = F.coalesce(*(F.when(t[f"session_{i}"].isNotNull(), p) for p, i in told), F.lit(0))
    rows = once(rows, "rank", rank)
    at = {f"{k}_{i}": (k, i) for k in _PAIRS for i in (0, 1)} | {k: (k,) for k in _MOMENTS} | {f"{k}_{i}": a(f"gen_ai.usage.{x}") for k, xs in _USED.items() for i, x in enumerate(xs)}
    rows = once(rows, "raw", F.array(*(J.node(v, *keys) for keys in at.values())))
    rows = once(rows, "x", F.transform("raw", lambda x: _loose(x)))
    x = {k: F.col("x")[i] for i, k in enumerate(at)}
    parts = (F.when(x[f"{k}_0"].isNotNull() & x[f"{k}_1"].isNotNull(), x[f"{k}_0"] * 1000 + F.floor(x[f"{k}_1"] / 1_000_000)) for k in _PAIRS)
    ts = F.coalesce(*parts, *(T.otel_ms(x[k]) for k in _MOMENTS[:2]), F.when(x["timeUnixNano"] > 0, F.floor(x["timeUnixNano"] / 1_000_000)), "modified_ms")
    rows = rows.select(
        "file",
        "line_no",
        "rank",
        F.coalesce(t["traceId"], t["trace_of"]).alias("trace"),
        t["session_5"].alias("response"),  # its id, which also is the last resort for a session
        F.coalesce(*(t[f"model_{i}"] for i in range(len(_MODEL_ATTRS)))).alias("own_model"),
        session.alias("own_session"),
        priority.alias("priority"),
        ts.alias("ts"),
        *(_positive(*(x[f"{k}_{i}"] for i in range(len(names)))).alias(f"n_{k}") for k, names in _USED.items()),
    )
    rows = written(rows.where("rank is not null or trace is not null"))  # parsed once, read by both sides of the join
    context = rows.where("trace is not null").groupBy("file", "trace").agg(
        F.min_by("own_model", F.when(F.col("own_model").isNotNull(), F.col("line_no"))).alias("trace_model"),
        F.max_by("own_session", F.when(F.col("own_session").isNotNull(), F.struct("priority", -F.col("line_no")))).alias("trace_session"),
    )
    #: About as many traces as rows, though Spark takes them for few: no broadcast.
    rows = rows.where("rank is not null").join(context.hint("merge"), ["file", "trace"], "left")
    cached = F.col("n_cached")
    model = F.coalesce("own_model", "trace_model", F.lit("unknown"))
    out = usage(
        rows,
        "copilot",
        ts_ms=F.col("ts"),
        session_id=F.coalesce("own_session", "trace_session", "trace", F.lit("unknown-session")),
        project_path=F.lit("Copilot"),
        message_id=F.col("response"),
        request_id=F.col("trace"),
        version=F.col("rank").cast("string"),
        model=model,
        input_tokens=saturating_minus(F.col("n_input"), cached),
        output_tokens=F.col("n_output"),
        cache_read_tokens=cached,
        cache_creation_tokens=F.col("n_written"),
        extra_tokens=F.col("n_reasoning"),
        message_count=F.col("n_total"),
        bill_extra=F.lit(True),
    )
    out = written(_settle(out))
    for key in ("request_id", "message_id"):
        out = keep_highest(out, ["file", key], "version")
    return out.select(*COLUMNS).withColumn("version", F.lit(None).cast("string"))


# ---- JSON documents ------------------------------------------------------------------


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    return json_lines(whole_files(spark, path, glob).withColumn("line_no", F.lit(0)))


def _items(df: DataFrame, value: Column, name: str) -> DataFrame:
    """A row for each element of a JSON array (none for another kind), in order."""
    array = F.when(J.kind(value).startswith("ARRAY"), F.from_json(F.to_json(value), "array<variant>"))
    return df.select("*", F.posexplode(array).alias("item_no", name))


_AMP_USED = ("inputTokens", "outputTokens", "cacheCreationInputTokens", "cacheReadInputTokens", "totalTokens", "input", "output", "total")
_AMP_ITEM = f"struct<{J.variants(('role', 'id', 'messageId', 'toMessageId', 'timestamp', 'model', 'credits', 'usage', 'tokens'))}>"
_AMP_THREAD = f"struct<id: variant, messages: array<{_AMP_ITEM}>, usageLedger: struct<events: array<{_AMP_ITEM}>>>"
_AMP_USE = f"struct<{J.variants(('timestamp', 'model', 'credits', *_AMP_USED))}>"


def read_amp(spark: SparkSession, path: str) -> DataFrame:
    """Ledger events, with cache tokens of the message they led to (by id); threads without a ledger
    by their messages. A thread is read and parsed once: messages and events meet in a window, in
    plain columns, each value picked once."""
    docs = json_lines(whole_files(spark, path, "*.json"))
    docs = once(docs, "r", J.typed(F.col("v"), _AMP_THREAD)).drop("v", "value")
    docs = once(docs, "thread", J.text(F.col("r.id"))).where("thread is not null")
    items = lambda kind, of: F.transform(F.coalesce(of, F.array().cast(f"array<{_AMP_ITEM}>")), lambda x, k: F.struct(F.lit(kind).alias("ledger"), k.cast("long").alias("item_no"), x.alias("x")))
    events = F.col("r.usageLedger.events")
    docs = docs.select("file", "thread", events.isNotNull().alias("has_ledger"), F.explode(F.array(F.concat(items(False, F.col("r.messages")), items(True, events)))).alias("items"))
    rows = docs.select("file", "thread", "has_ledger", F.explode("items").alias("i")).select("file", "thread", "has_ledger", "i.*")
    x, u, t, n, ledger = F.col("x"), F.col("u"), F.col("t"), F.col("n"), F.col("ledger")
    rows = once(rows, "of", F.when(ledger, x["tokens"]).otherwise(x["usage"]))
    rows = once(rows, "u", J.typed(F.col("of"), _AMP_USE))
    rows = once(rows, "t", F.struct(*(J.raw_text(x[k]).alias(k) for k in ("role", "id", "messageId", "timestamp", "model")), *(J.raw_text(u[k]).alias(f"use_{k}") for k in ("timestamp", "model"))))
    rows = once(rows, "ids", F.struct(J.integer(x["messageId"]).alias("own"), J.integer(x["toMessageId"]).alias("to")))
    rows = once(rows, "credits", F.when(ledger, J.number(x["credits"])).otherwise(J.number(u["credits"])))
    rows = once(rows, "n", F.transform(F.array(*(u[k] for k in _AMP_USED)), lambda c: J.u64(c))).where("ledger or t.role = 'assistant'")
    n = {k: F.coalesce(n[i], F.lit(0)) for i, k in enumerate(_AMP_USED)}
    trimmed = lambda k: F.nullif(F.trim(t[k]), F.lit(""))
    own = {"input": n["inputTokens"], "output": n["outputTokens"], "c": n["cacheCreationInputTokens"], "r": n["cacheReadInputTokens"], "total": n["totalTokens"]}
    rows = rows.select(
        "file",
        F.lit(0).alias("line_no"),
        "item_no",
        "thread",
        "has_ledger",
        "ledger",
        F.when(ledger, F.col("ids.to")).otherwise(F.col("ids.own")).alias("to_id"),
        F.when(ledger, trimmed("id")).otherwise(F.coalesce(F.col("ids.own").cast("string"), t["messageId"])).alias("message_id"),
        F.when(ledger, trimmed("timestamp")).otherwise(F.coalesce(trimmed("use_timestamp"), trimmed("timestamp"))).alias("told"),
        F.when(ledger, trimmed("model")).otherwise(F.coalesce(trimmed("use_model"), trimmed("model"))).alias("model"),
        "credits",
        F.col("of").isNotNull().alias("used"),
        *(F.when(ledger, n[k] if k in _AMP_USED else F.lit(0).cast("long")).otherwise(v).alias(f"n_{k}") for k, v in own.items()),
    )
    #: The last message of an id tells the cache tokens; rows without an id are spread.
    same = Window.partitionBy("file", "to_id", F.when(F.col("to_id").isNull(), F.xxhash64("file", "ledger", "item_no")))
    said = F.max(F.when(~ledger & F.col("to_id").isNotNull(), F.struct("item_no", "n_c", "n_r"))).over(same)
    rows = rows.withColumn("said", said).where("used and ledger = has_ledger")
    cached = lambda k: F.when(ledger, F.coalesce(F.col("said")[k], F.lit(0))).otherwise(F.col(k))
    out = usage(
        rows,
        "amp",
        ts_ms=T.strict_ms(F.col("told")),
        ts_text=F.col("told"),
        session_id=F.col("thread"),
        project_path=F.lit("Amp"),
        input_tokens=F.col("n_input"),
        output_tokens=F.col("n_output"),
        cache_creation_tokens=cached("n_c"),
        cache_read_tokens=cached("n_r"),
        message_count=F.col("n_total"),
        bill_extra=F.lit(True),
    )
    return _settle(out).where("model is not null")


def read_droid(spark: SparkSession, path: str) -> DataFrame:
    """A row for each settings file; a model that it lacks is looked up in the session's log."""
    docs, v = _documents(spark, path, "*.settings.json").where("v is not null"), F.col("v")
    stem = F.regexp_replace("file", r"\.settings\.json$", "")
    said = F.regexp_extract("value", r'(?s)Model:([^"\\\[]*)', 1)
    beside = log_lines(spark, path, "*.jsonl", [["Model:"]], numbered=True).where("line_no < 500").select(F.regexp_replace("file", r"\.jsonl$", "").alias("stem"), "line_no", N.plain_model_name(said).alias("said"))
    beside = beside.where("said <> ''").groupBy("stem").agg(F.min_by("said", "line_no").alias("said"))
    docs = docs.where(J.kind(v, "tokenUsage").startswith("OBJECT")).withColumn("stem", stem).join(beside, "stem", "left")
    docs = docs.withColumn("given", N.plain_provider(J.text(v, "providerLock")))
    model = F.when(J.text(v, "model").isNotNull(), N.plain_model_name(J.text(v, "model"))).otherwise(F.col("said"))
    docs = docs.withColumn("model", F.coalesce(F.nullif(model, F.lit("")), N.default_model(F.col("given"))))
    docs = docs.withColumn("provider", F.when(F.col("given") == "unknown", N.provider_of_model(F.col("model"))).otherwise(F.col("given")))
    u = "tokenUsage"
    out = usage(
        docs,
        "droid",
        ts_ms=F.coalesce(T.strict_ms(J.text(v, "providerLockTimestamp")), "modified_ms"),
        session_id=F.regexp_extract("stem", "([^/]*)$", 1),
        project_path=F.lit("Droid"),
        version=F.col("provider"),
        model=F.col("model"),
        **_counters(v, input=(u, "inputTokens"), output=(u, "outputTokens"), cache_creation=(u, "cacheCreationTokens"), cache_read=(u, "cacheReadTokens"), extra=(u, "thinkingTokens")),
        message_count=J.u64(v, u, "totalTokens"),
        candidates=N.prefixed(F.col("provider"), F.col("model")),
        price_rule=F.lit("positive"),
        bill_extra=F.lit(True),
    )
    return _settle(out)


_CB = {
    "input": ("inputTokens", "input_tokens", "promptTokens", "prompt_tokens"),
    "output": ("outputTokens", "output_tokens", "completionTokens", "completion_tokens"),
    "cache_creation": ("cacheCreationInputTokens", "cache_creation_input_tokens", "cacheCreationTokens", "cache_creation_tokens", "cachedTokensCreated", "cached_tokens_created"),
    "cache_read": ("cacheReadInputTokens", "cache_read_input_tokens"),
    "total": ("totalTokens", "total_tokens", "total"),
}


_CB_USAGE = (
    "struct<" + ", ".join(f"{k}: bigint" for keys in _CB.values() for k in keys)
    + ", promptTokensDetails: struct<cachedTokens: bigint>, prompt_tokens_details: struct<cached_tokens: bigint>, credits: double, model: string>"
)
_CB_HISTORY = f"array<struct<role: string, providerOptions: struct<usage: {_CB_USAGE}, codebuff: struct<model: string, usage: {_CB_USAGE}>>>>"
_CB_STATE = f"struct<sessionState: struct<mainAgentState: struct<messageHistory: {_CB_HISTORY}>>>"
_CB_METADATA = f"struct<model: string, timestamp: string, usage: {_CB_USAGE}, codebuff: struct<usage: {_CB_USAGE}>, runState: {_CB_STATE}>"
_CB_MESSAGES = f"array<struct<variant: string, role: string, id: string, credits: double, timestamp: string, createdAt: string, metadata: {_CB_METADATA}>>"
_CB_COUNTERS = ("input", "output", "cache_creation", "cache_read", "extra", "credits")


def _positive(*columns: Column) -> Column:
    """The first that is above 0, else 0."""
    return F.coalesce(*(F.when(c > 0, c) for c in columns), F.lit(0))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _picked(u: Column) -> Column:
    """A usage object's counters under one name each (null for none)."""
    pick = {k: _positive(*(u[x] for x in keys)) for k, keys in _CB.items()}
    cached = F.greatest(pick.pop("cache_read"), F.coalesce(u["promptTokensDetails"]["cachedTokens"], F.lit(0)), F.coalesce(u["prompt_tokens_details"]["cached_tokens"], F.lit(0)))
    return F.when(u.isNotNull(), F.struct(*(c.alias(k) for k, c in pick.items()), cached.alias("cache_read"), u["credits"].alias("credits"), _filled(u["model"]).alias("model")))


def _settled(u: Column) -> Column:
    """Counters with what only the total shows, in output or extra."""
    missing = F.greatest(u["total"] - (u["input"] + u["output"] + u["cache_creation"] + u["cache_read"]), F.lit(0))
    return F.struct(
        u["input"].alias("input"),
        F.when(u["output"] == 0, missing).otherwise(u["output"]).alias("output"),
        u["cache_creation"].alias("cache_creation"),
        u["cache_read"].alias("cache_read"),
        F.when(u["output"] == 0, F.lit(0)).otherwise(missing).alias("extra"),
        u["credits"].alias("credits"),
        u["model"].alias("model"),
    )


def read_codebuff(spark: SparkSession, path: str) -> DataFrame:
    """Assistant messages; each counter from the first of several usage objects that has it:
    the metadata's, its tool's own, then the run state's history, latest first."""
    files = whole_files(spark, path, "chat-messages.json").withColumn("line_no", F.lit(0))
    rows = files.select("file", "modified_ms", "line_no", F.posexplode(F.from_json("value", _CB_MESSAGES)).alias("item_no", "m"))
    rows = rows.where(F.coalesce(_filled(F.col("m.variant")), _filled(F.col("m.role"))).isin("ai", "agent", "assistant"))
    history = F.coalesce(F.col("m.metadata.runState.sessionState.mainAgentState.messageHistory"), F.array().cast(_CB_HISTORY))
    said = F.reverse(F.filter(history, lambda h: F.coalesce(F.trim(h["role"]) == "assistant", F.lit(False))))
    two = lambda h: F.array(_picked(h["providerOptions"]["usage"]), _picked(h["providerOptions"]["codebuff"]["usage"]))
    rows = rows.withColumns(
        {
            "own": F.array(_picked(F.col("m.metadata.usage")), _picked(F.col("m.metadata.codebuff.usage"))),
            "past": F.transform(said, lambda h: F.struct(_filled(h["providerOptions"]["codebuff"]["model"]).alias("told"), two(h).alias("both"))),
        }
    )
    settle = lambda xs: F.transform(F.array_compact(xs), _settled)
    rows = rows.withColumns({"own": settle("own"), "past": F.transform("past", lambda p: F.struct(p["told"].alias("told"), settle(p["both"]).alias("both")))})
    #: All usage objects in the order in which they are asked, and the models they name.
    rows = rows.withColumns(
        {
            "uses": F.concat("own", F.flatten(F.transform("past", lambda p: p["both"]))),
            "models": F.array_compact(
                F.concat(F.array(_filled(F.col("m.metadata.model"))), F.transform("own", lambda u: u["model"]), F.flatten(F.transform("past", lambda p: F.concat(F.array(p["told"]), F.transform(p["both"], lambda u: u["model"])))))
            ),
        }
    )
    first = lambda k: F.coalesce(F.try_element_at(F.filter(F.transform("uses", lambda u: u[k]), lambda x: x > 0), F.lit(1)), F.lit(0))
    part = lambda up: _filled(F.regexp_extract("file", "([^/]+)" + "/[^/]*" * up + "$", 1))
    moment = lambda c: F.when(c.rlike(r"^\d+$"), F.when(c.try_cast("long") > 0, T.epoch_ms(c.try_cast("long"), 10_000_000_000))).otherwise(T.strict_ms(c))
    rows = rows.select(
        "file",
        "line_no",
        "item_no",
        "modified_ms",
        *(first(k).alias(k) for k in _CB_COUNTERS),
        F.coalesce(F.try_element_at("models", F.lit(1)), F.lit("codebuff-unknown")).alias("model"),
        F.greatest(F.coalesce("m.credits", F.lit(0.0)), F.lit(0.0)).alias("message_credits"),
        F.coalesce(moment(F.col("m.timestamp")), moment(F.col("m.createdAt")), moment(F.col("m.metadata.timestamp"))).alias("told"),
        _filled(F.col("m.id")).alias("id"),
        F.coalesce(part(1), F.lit("unknown")).alias("chat"),
        F.coalesce(part(3), F.lit("unknown")).alias("folder"),
        F.coalesce(part(5), F.lit("manicode")).alias("channel"),
    )
    model = F.col("model")
    provider = F.when(model.rlike("^claude-|^anthropic/"), "anthropic").when(model.rlike("^gpt-|^openai/|^o[0-9]"), "openai").when(model.rlike("^gemini|^google/"), "google").otherwise("codebuff")
    from_chat = T.strict_ms(F.regexp_replace("chat", r"^([^T]*T[^-]*)-([^-]*)-", "$1:$2:"))
    credits = F.when(F.col("credits") > 0, F.col("credits")).otherwise(F.col("message_credits"))
    out = usage(
        rows.withColumn("provider", provider),
        "codebuff",
        ts_ms=F.coalesce("told", from_chat, "modified_ms"),
        session_id=F.concat_ws("/", "channel", "folder", "chat"),
        project_path=F.lit("Codebuff"),
        message_id=F.coalesce("id", F.col("item_no").cast("string")),
        version=F.col("provider"),
        **{f"{k}_tokens": F.col(k) for k in ("input", "output", "cache_creation", "cache_read", "extra")},
        credits=F.when(credits > 0, credits),
        candidates=F.array_distinct(F.array(model, F.concat("provider", F.lit("/"), model))),
        price_rule=F.lit("positive"),
        bill_extra=F.lit(True),
    )
    return out.where((total_tokens() > 0) | (F.coalesce("credits", F.lit(0.0)) > 0))


_GM = {
    "input": ("input", "prompt", "input_tokens", "prompt_tokens"),
    "output": ("output", "candidates", "output_tokens", "candidates_tokens"),
    "cached": ("cached", "cached_tokens"),
    "thoughts": ("thoughts", "reasoning", "thoughts_tokens", "reasoning_tokens"),
    "tool": ("tool", "tool_tokens"),
}


_GM_COUNTS = (*(k for keys in _GM.values() for k in keys), "total", "total_tokens")
_GM_SHAPE = f"struct<{J.variants(_GM_COUNTS)}>"
_GM_TEXTS = ("type", "id", "model", "timestamp", "created_at")
_GM_ITEM = J.variants(_GM_TEXTS) + f", tokens: {_GM_SHAPE}"
_GM_TOP = ("sessionId", "session_id", "startTime", "lastUpdated")
_GM_RECORD = f"struct<{_GM_ITEM}, {J.variants((*_GM_TOP, 'stats'))}, messages: array<struct<{_GM_ITEM}>>, result: struct<stats: variant>>"


def _texts(of: str, names) -> Column:
    return F.struct(*(J.raw_text(F.col(f"{of}.{k}")).alias(k) for k in names))


def _gemini_found(rows: DataFrame, lines: bool) -> DataFrame:
    """Records (a document or a line each) to the usages in them, in plain columns: ``form`` (1
    a message, 2 the record itself, 3 a model's statistics, 4 statistics alone), names, times and
    counters. Each value is picked once, so no step outgrows a compiled method. Of lines, records
    without a usage stay, with a null form, since session and model carry forward from them."""
    r, t = F.col("r"), F.col("t")
    rows = once(json_lines(rows), "r", J.typed(F.col("v"), _GM_RECORD)).drop("v", "value").where("r is not null")
    rows = once(rows, "t", _texts("r", (*_GM_TEXTS, *_GM_TOP)))
    rows = once(rows, "stats", F.coalesce(r["stats"], r["result"]["stats"]))
    rows = once(rows, "models", J.typed(F.col("stats"), f"map<string, struct<tokens: {_GM_SHAPE}>>", "models"))
    none, shape = F.lit(None), _GM_SHAPE
    event = lambda form, tokens, n=F.lit(0), name=none, x=None: F.struct(
        F.lit(form).alias("form"), n.cast("long").alias("item_no"), name.cast("string").alias("name"), *((none.cast("variant") if x is None else x[k]).alias(k) for k in _GM_TEXTS), tokens.alias("tokens")
    )
    priced = F.filter(F.map_entries("models"), lambda e: e["value"]["tokens"].isNotNull())
    by_model = F.when(F.size(priced) > 0, F.transform(priced, lambda e: event(3, e["value"]["tokens"], name=e["key"])))
    by_stats = F.when(F.col("stats").isNotNull(), F.coalesce(by_model, F.array(event(4, J.typed(F.col("stats"), shape)))))
    found = F.when(t["type"] == "gemini", F.array(event(2, r["tokens"], x=r))).otherwise(by_stats)
    if not lines:
        found = F.when(r["messages"].isNotNull(), F.transform(r["messages"], lambda x, n: event(1, x["tokens"], n, x=x))).otherwise(found)
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = rows.select(
        "file",
        "line_no",
        "modified_ms",
        F.coalesce(trimmed(t["sessionId"]), trimmed(t["session_id"])).alias("session"),
        trimmed(t["model"]).alias("hint"),
        *(T.strict_ms(t[k]).alias(f"at_{k}") for k in ("startTime", "lastUpdated", "timestamp")),
        F.explode(F.array(found)).alias("found"),  # once: Spark filters by its size
    )
    rows = rows.select("*", (F.explode_outer if lines else F.explode)("found").alias("e")).drop("found")
    rows = once(rows, "x", _texts("e", _GM_TEXTS))
    whole = lambda c: F.floor(F.greatest(c, F.lit(0.0)))
    rows = once(rows, "n", F.transform(F.transform(F.array(*(F.col(f"e.tokens.{k}") for k in _GM_COUNTS)), lambda c: J.number(c)), lambda c: F.when(c.isNotNull(), whole(c))))
    n, x, form = {k: F.col("n")[i] for i, k in enumerate(_GM_COUNTS)}, F.col("x"), F.col("e.form")
    own = F.coalesce(T.strict_ms(x["timestamp"]), T.strict_ms(x["created_at"]))
    at = F.when(form == 1, F.coalesce(own, "at_startTime", "at_lastUpdated")).when(form == 2, own).otherwise(F.col("at_timestamp"))
    rows = rows.where("e is null or e.form <> 1 or x.type = 'gemini'")
    return rows.select(
        "file",
        "line_no",
        F.col("e.item_no"),
        form.alias("form"),
        "session",
        "hint",
        F.when(form == 1, trimmed(x["model"])).when(form == 3, F.col("e.name")).alias("named"),
        F.when(form <= 2, trimmed(x["id"])).alias("mid"),
        F.coalesce(at, "modified_ms").alias("at"),
        F.col("e.tokens").isNotNull().alias("counted"),
        *(F.coalesce(*(n[k] for k in keys), F.lit(0)).alias(f"n_{name}") for name, keys in _GM.items()),
        F.when(F.col("e.tokens.total").isNotNull(), n["total"]).otherwise(n["total_tokens"]).alias("n_total"),
    )


def read_gemini(spark: SparkSession, path: str) -> DataFrame:
    """Session documents (messages, one record, or statistics by model) and session lines; in
    lines session and model carry forward, and a repeated message id replaces the earlier."""
    docs = _gemini_found(whole_files(spark, path, "*.json").withColumn("line_no", F.lit(0).cast("long")), False)
    rows = written(_gemini_found(log_lines(spark, path, "*.jsonl"), True))  # parsed once, read twice to carry
    rows = carry_forward(rows, ["session", "hint"], ["file"], ["line_no"], span=F.floor(F.col("line_no") / RANGE)).where("form is not null")
    #: Only records with an id replace each other; the others are spread.
    replaces = (F.col("form") == 2) & F.col("mid").isNotNull()
    latest = Window.partitionBy("file", "mid", "_spread").orderBy(F.desc("line_no"))
    rows = rows.withColumn("_spread", F.when(~replaces, F.xxhash64("file", "line_no", "item_no", "named"))).withColumn("_place", F.row_number().over(latest))
    rows = rows.where((F.col("_place") == 1) | F.col("_spread").isNotNull())
    stem = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    rows = docs.unionByName(rows.select(docs.columns)).where("counted").withColumn("session", F.coalesce("session", stem))
    n = {name: F.col(f"n_{name}") for name in (*_GM, "total")}
    summed = n["input"] + n["output"] + n["thoughts"] + n["tool"]
    overlap = (F.col("form") >= 3) | F.coalesce((n["cached"] > 0) & (n["total"] == summed), F.lit(False))
    model = F.when(F.col("form") == 2, F.col("hint")).when(F.col("form") == 4, F.coalesce("hint", F.lit("unknown"))).otherwise(F.col("named"))
    out = usage(
        rows.withColumn("model", model),
        "gemini",
        ts_ms=F.col("at"),
        session_id=F.col("session"),
        project_path=F.lit("Gemini"),
        message_id=F.col("mid"),
        model=F.nullif(F.trim("model"), F.lit("")),
        input_tokens=F.when(overlap, saturating_minus(n["input"], n["cached"])).otherwise(n["input"]) + n["tool"],
        output_tokens=n["output"],
        cache_read_tokens=n["cached"],
        extra_tokens=n["thoughts"],
        message_count=F.coalesce(n["total"], F.lit(0)),
        candidates=F.array("model", *(F.concat(F.lit(f"{x}/"), "model") for x in ("gemini", "google", "vertex_ai"))),
        price_rule=F.lit("never_recorded"),
        bill_extra=F.lit(True),
    )
    return _settle(out).where("model is not null")


# ---- SQLite --------------------------------------------------------------------------


MESSAGE = {"id": "string", "session": "string", "value": "string"}
MESSAGE_PLACES = {"session": "session_id", "value": "data"}


def _opencode(df: DataFrame, session: Column, message: Column) -> DataFrame:
    v, t = F.col("v"), "tokens"
    model, provider = J.text(v, "modelID"), J.text(v, "providerID")
    known = F.when(model == "gemini-3-pro-high", "gemini-3-pro-preview").when(model == "k2p6", "kimi-k2.6").otherwise(model)
    base = F.array_distinct(F.array(known, N.versioned_family(known)))
    under = F.transform(base, lambda x: F.concat(F.translate(provider, "-", "_"), F.lit("/"), x))
    out = usage(
        df.where(J.exists(v, t)),
        "opencode",
        ts_ms=F.coalesce(J.integer(v, "time", "created"), F.lit(0)),
        session_id=F.coalesce(session, J.text(v, "sessionID"), F.lit("unknown")),
        project_path=F.lit("OpenCode"),
        message_id=F.coalesce(message, J.text(v, "id")),
        version=provider,
        model=model,
        recorded_cost=J.number(v, "cost"),
        **_counters(v, input=(t, "input"), output=(t, "output"), cache_creation=(t, "cache", "write"), cache_read=(t, "cache", "read")),
        message_count=J.u64(v, t, "total"),
        candidates=F.when(provider != "unknown", F.concat(base, under)).otherwise(base),
        price_rule=F.lit("recorded_positive"),
        bill_extra=F.lit(True),
    )
    return _settle(out).where("model is not null and version is not null")


def read_opencode(spark: SparkSession, path: str) -> DataFrame:
    """Messages of the databases, then of message files; a message id counts once, from the
    database first (see dedupe)."""
    db = sqlite_rows(spark, path, "message", MESSAGE, "opencode*.db", MESSAGE_PLACES)
    db = json_lines(db)
    files = _documents(spark, path, "*.json").where(F.col("file").contains("/storage/message/"))
    none = F.lit(None).cast("string")
    return _opencode(db, F.col("session"), F.col("id")).withColumn("item_no", F.lit(0).cast("long")).unionByName(
        _opencode(files, none, none).withColumn("item_no", F.lit(1).cast("long"))
    )


def read_kilo(spark: SparkSession, path: str) -> DataFrame:
    #: Only texts that name the role are parsed.
    db = sqlite_rows(spark, path, "message", MESSAGE, "kilo.db", MESSAGE_PLACES, [("instr(data, ?) > 0", ["assistant"])])
    db, v, t = json_lines(db), F.col("v"), "tokens"
    db = db.where((J.raw_text(v, "role") == "assistant") & J.exists(v, t))
    model, provider = J.text(v, "modelID"), F.translate(J.text(v, "providerID"), "-", "_")
    created = J.integer(v, "time", "created")
    out = usage(
        db,
        "kilo",
        ts_ms=F.when(created > 0, T.epoch_ms(created, 1_000_000_000_000)),
        session_id=F.coalesce(J.text(v, "session_id"), "session"),
        project_path=F.lit("Kilo"),
        message_id=F.coalesce(J.text(v, "id"), F.concat_ws(":", "file", "id")),
        model=model,
        recorded_cost=J.number(v, "cost"),
        **_counters(v, input=(t, "input"), output=(t, "output"), cache_creation=(t, "cache", "write"), cache_read=(t, "cache", "read"), extra=(t, "reasoning")),
        message_count=J.u64(v, t, "total"),
        candidates=F.array_distinct(F.array_compact(F.array(F.when(~provider.isin("unknown", "kilo"), F.concat(provider, F.lit("/"), model)), model))),
        bill_extra=F.lit(True),
    )
    return _settle(out).where("model is not null")


def read_hermes(spark: SparkSession, path: str) -> DataFrame:
    places = {
        "provider": "billing_provider",
        "started": "started_at",
        "messages": "message_count",
        "i": "input_tokens",
        "o": "output_tokens",
        "r": "cache_read_tokens",
        "w": "cache_write_tokens",
        "t": "reasoning_tokens",
        "estimated": "estimated_cost_usd",
        "actual": "actual_cost_usd",
    }
    columns = {c: "string" for c in ("id", "model", "provider")} | {"started": "double"} | {c: "long" for c in ("messages", *"iorwt")} | {"estimated": "double", "actual": "double"}
    db = sqlite_rows(spark, path, "sessions", columns, "state.db", places)
    low = F.lower("model")
    inferred = F.when(low.rlike("^claude[-/]"), "anthropic").when(low.rlike("^(gpt|chatgpt|o[0-9])"), "openai").when(low.rlike("^gemini[-/]"), "google").otherwise("hermes")
    said = F.translate(F.lower(F.trim("provider")), "-", "_")
    folded = F.when(said.isin("claude"), "anthropic").when(said == "openai_codex", "openai").when(said.isin("google_ai", "gemini", "vertex", "vertex_ai"), "google").otherwise(said)
    provider = F.when(F.coalesce(said, F.lit("")) == "", inferred).otherwise(folded)
    positive = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    cost = F.greatest(F.coalesce("actual", "estimated"), F.when(F.coalesce("actual", "estimated").isNotNull(), 0.0))
    model = F.trim("model")
    out = usage(
        db.where("id <> '' and trim(model) <> '' and started > 0"),
        "hermes",
        ts_ms=F.when(F.col("started") > 1e12, F.col("started")).otherwise(F.col("started") * 1000),
        session_id=F.col("id"),
        project_path=F.lit("Hermes"),
        message_id=F.concat(F.lit("hermes:"), "id"),
        version=provider,
        model=model,
        input_tokens=positive("i"),
        output_tokens=positive("o"),
        cache_creation_tokens=positive("w"),
        cache_read_tokens=positive("r"),
        extra_tokens=positive("t"),
        recorded_cost=cost,
        message_count=positive("messages"),
        candidates=F.array_distinct(F.array_compact(F.array(F.when(provider != "hermes", F.concat(provider, F.lit("/"), model)), model))),
        price_rule=F.lit("recorded_positive"),
        bill_extra=F.lit(True),
    )
    return out.where((total_tokens() > 0) | (F.coalesce("recorded_cost", F.lit(0.0)) > 0))


def read_goose(spark: SparkSession, path: str) -> DataFrame:
    places = {"config": "model_config_json", "provider": "provider_name", "created": "CAST(created_at AS TEXT)"}
    places |= {"t": "total_tokens", "i": "input_tokens", "o": "output_tokens"} | {f"a{c}": f"accumulated_{name}_tokens" for c, name in zip("tio", ("total", "input", "output"))}
    columns = {c: "string" for c in ("id", "config", "provider", "created")} | {c: "long" for c in ("t", "i", "o", "at", "ai", "ao")}
    db = sqlite_rows(spark, path, "sessions", columns, "sessions.db", places)
    when = F.trim("created")
    count = when.try_cast("long")
    day = F.when(when.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(when, F.lit("T00:00:00Z"))).when(
        when.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$"), F.concat(F.substring(when, 1, 10), F.lit("T"), F.substring(when, 12, 8), F.lit("Z"))
    )
    ts = F.when(when.rlike(r"^[+-]?\d+$"), F.when(count > 0, F.when(count > 1_000_000_000_000, count).otherwise(count * 1000))).otherwise(F.coalesce(T.strict_ms(when), T.strict_ms(day)))
    pick = lambda a, b: F.coalesce(F.when(F.col(a) > 0, F.col(a)), F.when(F.col(b) > 0, F.col(b)))
    i, o = F.coalesce(pick("ai", "i"), F.lit(0)), F.coalesce(pick("ao", "o"), F.lit(0))
    model = J.text(F.try_parse_json("config"), "model_name")
    said = F.nullif(F.trim("provider"), F.lit(""))
    inferred = F.when(model.startswith("claude-"), "anthropic").when(model.rlike("^(gpt-|chatgpt-|o)"), "openai").when(model.startswith("gemini-"), "google").when(F.lower(model).startswith("qwen"), "openrouter").otherwise("goose")
    provider = F.coalesce(F.translate(said, "-", "_"), inferred)
    out = usage(
        db,
        "goose",
        ts_ms=ts,
        session_id=F.col("id"),
        project_path=F.lit("Goose"),
        message_id=F.col("id"),
        version=provider,
        model=model,
        input_tokens=i,
        output_tokens=o,
        extra_tokens=saturating_minus(F.coalesce(pick("at", "t"), i + o), i + o),
        candidates=F.array_distinct(F.array(model, F.concat(provider, F.lit("/"), model))),
        price_rule=F.lit("positive"),
        bill_extra=F.lit(True),
    )
    return some_tokens(out).where("ts_ms is not null and model is not null")


READERS = {
    "claude": read_claude,
    "opencode": read_opencode,
    "amp": read_amp,
    "droid": read_droid,
    "codebuff": read_codebuff,
    "hermes": read_hermes,
    "pi": read_pi,
    "goose": read_goose,
    "openclaw": read_openclaw,
    "kilo": read_kilo,
    "copilot": read_copilot,
    "gemini": read_gemini,
    "kimi": read_kimi,
    "qwen": read_qwen,
}
