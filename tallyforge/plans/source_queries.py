"""Queries over the tools' own logs: ``events`` is written in each tool's format, read back by its
reader, deduplicated and priced; the SQL says what must come out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.plans.reports import Options, codex_report, load_usage
from tallyforge.sources.logfiles import write_databases, write_logs
from tallyforge.sources.rates import built_in
from tallyforge.sources.textlogs import remove, shared_folder

#: The model that an event type stands for; the last has no price.
MODELS = {"view": "gpt-5", "click": "claude-sonnet-4", "purchase": "claude-opus-4-5", "signup": "claude-haiku-4-5", "error": "mystery-1"}
Q, SQL = {}, {}
_MODEL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in MODELS.items()) + " end"
_RATES = ", ".join(f"('{m}', {r.input}::double, {r.output}::double, {r.cache_create}::double, {r.cache_read}::double)" for m, r in built_in().items() if m in MODELS.values())
_BASE = f"""
    with card(name, ri, ro, rw, rr) as (values {_RATES}),
    e as (
        select event_id, user_id, epoch_us(ts) // 1000 as ms, 's' || (user_id % 20) as s, {_MODEL} as m, floor(value)::bigint + 1 as i,
            event_id % 97 + 1 as o, event_id % 13 as w, event_id % 29 as r from events
    )
"""


def expected(session="s", ms="ms", model="m", w="w", r="r", extra="0", billed="o", cost=None, more="") -> str:
    price = cost or f"coalesce(i * ri + ({billed}) * ro + ({w}) * rw + ({r}) * rr, 0)"
    return _BASE + f""" select {session} as session_id, ({ms})::bigint as ts_ms, {model} as model, i as input_tokens, o as output_tokens, ({w})::bigint as cache_creation_tokens,
        ({r})::bigint as cache_read_tokens, ({extra})::bigint as extra_tokens, round({price}, 12) as cost from e left join card on m = name {more}"""


def _events(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    model = F.create_map(*(F.lit(x) for pair in MODELS.items() for x in pair))
    ts, n = F.col("ts").cast("timestamp"), F.col("event_id")
    return e.select(
        n.alias("n"), "user_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("iso"), F.concat(F.lit("s"), F.col("user_id") % 20).alias("s"),
        model[F.col("event_type")].alias("m"), (F.floor("value").cast("long") + 1).alias("i"), (n % 97 + 1).alias("o"), (n % 13).alias("w"), (n % 29).alias("r"),
    )


def j(**fields):
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def source(agent: str, sql: str, form: str = ""):
    """Registers ``source_<agent>`` (and the form of its log); the function writes events to a folder in the tool's format."""

    def keep(write):
        def run(spark, sf_dir):
            folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
            write(_events(spark, sf_dir), folder)
            rows = load_usage(spark, agent, folder, Options())
            remove(spark, folder)  # the parsed rows are written by now
            return rows.select(
                "session_id", "ts_ms", "model", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens", F.round("cost", 12).alias("cost")
            )

        name = f"source_{agent}{form}"
        run.__name__ = name
        Q[name], SQL[name] = run, sql
        return write

    return keep


c, text = F.col, F.lit


def share():
    """A log's share of a session, so that the number of files grows with the events."""
    return F.floor(F.col("n") / 5000)


def _lines(e: DataFrame, folder: str, file, record) -> None:
    write_logs(e.select(file.alias("file"), "n", F.to_json(record).alias("line")), folder)


@source("claude", expected())
def claude(e, folder):
    usage = j(input_tokens=c("i"), output_tokens=c("o"), cache_creation_input_tokens=c("w"), cache_read_input_tokens=c("r"))
    record = j(timestamp=c("iso"), sessionId=c("s"), requestId=F.concat(text("q"), "n"), version=text("1.2.3"), message=j(id=F.concat(text("g"), "n"), model=c("m"), usage=usage))
    again = j(timestamp=c("iso"), sessionId=c("s"), requestId=F.concat(text("z"), "n"), isSidechain=text(True), message=j(id=F.concat(text("g"), "n"), model=c("m"), usage=usage))
    file = F.concat(text("projects/p"), "s", text("/"), "s", text("/chat"), share(), text(".jsonl"))
    both = F.explode(F.array(F.to_json(record), F.when(c("n") % 5 == 0, F.to_json(again)))).alias("line")
    write_logs(e.select(file.alias("file"), "n", both).where("line is not null"), folder)


@source("pi", expected(model="'[pi] ' || m"))
def pi(e, folder):
    usage = j(input=c("i"), output=c("o"), cacheWrite=c("w"), cacheRead=c("r"), cost=F.when(c("m") == "mystery-1", j(total=text(0.0))))
    _lines(e, folder, F.concat(text("sessions/p/x"), share(), text("_"), "s", text(".jsonl")), j(type=text("message"), timestamp=c("iso"), message=j(role=text("assistant"), model=c("m"), usage=usage)))


@source("qwen", expected(w="0", extra="event_id % 3", billed="o + event_id % 3"))
def qwen(e, folder):
    usage = j(promptTokenCount=c("i"), candidatesTokenCount=c("o"), cachedContentTokenCount=c("r"), thoughtsTokenCount=c("n") % 3)
    _lines(e, folder, F.concat(text("projects/p/chats/"), "s", text("-"), share(), text(".jsonl")), j(type=text("assistant"), timestamp=c("iso"), sessionId=c("s"), model=c("m"), usageMetadata=usage))


@source("kimi", expected(ms="ms // 1000 * 1000", model="'kimi-for-coding'", cost="i * 0.6e-6 + o * 3e-6 + w * 0.75e-6 + r * 0.1e-6"))
def kimi(e, folder):
    usage = j(input_other=c("i"), output=c("o"), input_cache_creation=c("w"), input_cache_read=c("r"))
    record = j(timestamp=F.floor(c("ms") / 1000), message=j(type=text("StatusUpdate"), payload=j(message_id=F.concat(text("g"), "n"), token_usage=usage)))
    _lines(e, folder, F.concat(text("sessions/g"), share(), text("/"), "s", text("/wire.jsonl")), record)


@source("openclaw", expected(model="'[openclaw] ' || m"))
def openclaw(e, folder):
    change = j(type=text("model_change"), modelId=c("m"), provider=text("p"))
    used = j(type=text("message"), message=j(role=text("assistant"), timestamp=c("ms"), usage=j(input=c("i"), output=c("o"), cacheWrite=c("w"), cacheRead=c("r"))))
    both = F.posexplode(F.array(F.to_json(change), F.to_json(used))).alias("k", "line")
    rows = e.select(F.concat(text("a"), share(), text("/"), "s", text(".jsonl")).alias("file"), "n", both)
    write_logs(rows.select("file", (c("n") * 2 + c("k")).alias("n"), "line"), folder)


@source("copilot", expected(session="s", w="w", extra="0", more="where event_id % 4 <> 3"))
def copilot(e, folder):
    """Every fourth event repeats the trace of the one before as a record of a lower kind."""
    low, trace = c("n") % 4 == 3, F.concat(text("t"), F.when(c("n") % 4 == 3, c("n") - 1).otherwise(c("n")))
    attributes = {
        "gen_ai.usage.input_tokens": c("i") + c("r"), "gen_ai.usage.output_tokens": c("o"), "gen_ai.usage.cache_read.input_tokens": c("r"), "gen_ai.usage.cache_write.input_tokens": c("w"),
        "gen_ai.request.model": c("m"), "session.id": c("s"),
    }
    record = j(type=text("span"), name=F.when(low, "invoke_agent x").otherwise("chat x"), traceId=trace, endTime=F.array(F.floor(c("ms") / 1000), c("ms") % 1000 * 1_000_000), attributes=j(**attributes))
    _lines(e, folder, F.concat(text("otel"), share(), text(".jsonl")), record)


@source("gemini", expected(w="0", extra="event_id % 5", billed="o + event_id % 5", model="m"))
def gemini(e, folder):
    tokens = j(input=c("i"), output=c("o"), cached=c("r"), thoughts=c("n") % 5, total=c("i") + c("o") + c("r") + c("n") % 5 + 0)
    record = j(type=text("gemini"), id=F.concat(text("g"), "n"), sessionId=c("s"), model=c("m"), timestamp=c("iso"), tokens=tokens)
    _lines(e, folder, F.concat("s", text("/log"), share(), text(".jsonl")), record)


def _documents(e: DataFrame, folder: str, file, item, build) -> None:
    """One JSON document for each session and share, its items in the order of events."""
    rows = e.withColumns({"item": item, "share": share()}).groupBy("s", "share").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]).alias("items"))
    write_logs(rows.select(file.alias("file"), text(0).alias("n"), F.to_json(build).alias("line")), folder)


@source("amp", expected(w="case when event_id % 2 = 0 then w else 0 end", r="case when event_id % 2 = 0 then r else 0 end"))
def amp(e, folder):
    event = j(id=F.concat(text("g"), "n"), timestamp=c("iso"), model=c("m"), toMessageId=F.when(c("n") % 2 == 0, c("n")), tokens=j(input=c("i"), output=c("o")))
    message = j(role=text("assistant"), messageId=c("n"), usage=j(cacheCreationInputTokens=c("w"), cacheReadInputTokens=c("r")))
    thread = j(id=c("s"), messages=F.transform("items", lambda x: x["message"]), usageLedger=j(events=F.transform("items", lambda x: x["event"])))
    _documents(e, folder, F.concat(text("threads/"), "s", text("-"), "share", text(".json")), j(event=event, message=message), thread)


@source("codebuff", expected(session="'manicode/p/' || s"))
def codebuff(e, folder):
    usage = j(inputTokens=c("i"), outputTokens=c("o"), cacheCreationInputTokens=c("w"), cacheReadInputTokens=c("r"))
    item = j(variant=text("ai"), id=c("n").cast("string"), timestamp=c("iso"), metadata=j(model=c("m"), usage=usage))
    _documents(e, folder, F.concat(text("r"), "share", text("/manicode/projects/p/chats/"), "s", text("/chat-messages.json")), item, c("items"))


@source("gemini", expected(w="0", extra="event_id % 5", billed="o + event_id % 5"), "_documents")
def gemini_documents(e, folder):
    """Session documents; cached tokens are within the input there, as the total shows."""
    tokens = j(input=c("i") + c("r"), output=c("o"), cached=c("r"), thoughts=c("n") % 5, total=c("i") + c("r") + c("o") + c("n") % 5)
    message = j(type=text("gemini"), id=F.concat(text("g"), "n"), model=c("m"), timestamp=c("iso"), tokens=tokens)
    _documents(e, folder, F.concat(text("chats/"), "s", text("-"), "share", text(".json")), message, j(sessionId=c("s"), messages=c("items")))


_DROID = _BASE + """, d as (select s, max(ms) as ms, sum(i)::bigint as i, sum(o)::bigint as o, sum(w)::bigint as w, sum(r)::bigint as r from e group by s)
    select s as session_id, ms as ts_ms, 'gpt-5' as model, i as input_tokens, o as output_tokens, w as cache_creation_tokens, r as cache_read_tokens, 0::bigint as extra_tokens,
        round(i * ri + o * ro + w * rw + r * rr, 12) as cost from d, card where name = 'gpt-5'"""


@source("droid", _DROID)
def droid(e, folder):
    sums = e.groupBy("s").agg(F.max("iso").alias("iso"), *(F.sum(k).alias(k) for k in "iowr"))
    usage = j(inputTokens=c("i"), outputTokens=c("o"), cacheCreationTokens=c("w"), cacheReadTokens=c("r"))
    record = j(tokenUsage=usage, model=text("custom:GPT-5 [x]"), providerLockTimestamp=c("iso"))
    write_logs(sums.select(F.concat("s", text(".settings.json")).alias("file"), text(0).alias("n"), F.to_json(record).alias("line")), folder)


def _database(e: DataFrame, folder: str, name: str, table: str, columns: str, *cells) -> None:
    file = F.concat(text("d"), c("user_id") % 5, text("-"), share(), text("/"), text(name))
    write_databases(e.select(file.alias("file"), "n", F.array(*(x.cast("string") for x in cells)).alias("cells")), folder, table, columns)


def _tokens(**more):
    return j(input=c("i"), output=c("o"), cache=j(read=c("r"), write=c("w")), **more)


@source("opencode", expected())
def opencode(e, folder):
    data = j(modelID=c("m"), providerID=text("unknown"), time=j(created=c("ms")), tokens=_tokens())
    _database(e, folder, "opencode.db", "message", "id text, session_id text, data text", c("n"), c("s"), F.to_json(data))


@source("kilo", expected(extra="event_id % 7", billed="o + event_id % 7"))
def kilo(e, folder):
    data = j(role=text("assistant"), modelID=c("m"), providerID=text("kilo"), time=j(created=c("ms")), tokens=_tokens(reasoning=c("n") % 7))
    _database(e, folder, "kilo.db", "message", "id text, session_id text, data text", c("n"), c("s"), F.to_json(data))


@source("hermes", expected(session="'h' || event_id", extra="event_id % 7", billed="o + event_id % 7"))
def hermes(e, folder):
    columns = "id text, model text, billing_provider text, started_at real, message_count int, input_tokens int, output_tokens int, cache_read_tokens int, cache_write_tokens int, reasoning_tokens int, estimated_cost_usd real, actual_cost_usd real"
    none = F.lit(None)
    _database(e, folder, "state.db", "sessions", columns, F.concat(text("h"), "n"), c("m"), none, c("ms"), text(1), c("i"), c("o"), c("r"), c("w"), c("n") % 7, none, none)


@source("goose", expected(session="'g' || event_id", w="0", r="0", extra="event_id % 7", billed="o + event_id % 7"))
def goose(e, folder):
    columns = "id text, model_config_json text, provider_name text, created_at text, total_tokens int, input_tokens int, output_tokens int, accumulated_total_tokens int, accumulated_input_tokens int, accumulated_output_tokens int"
    none = F.lit(None)
    _database(e, folder, "sessions.db", "sessions", columns, F.concat(text("g"), "n"), F.to_json(j(model_name=c("m"))), text("goose"), c("iso"), none, none, none, c("i") + c("o") + c("n") % 7, c("i"), c("o"))


_CODEX = _BASE + """, u as (select strftime(make_timestamp(ms * 1000), '%Y-%m-%d') as period, case when m = 'mystery-1' then 'gpt-5.4' when m = 'gpt-5' then 'gpt-5' else 'gpt-5.2-codex' end as model, i, o, least(r, i) as r, w from e)
    select period, sum(i - r)::bigint as input_tokens, sum(r)::bigint as cache_read_tokens, sum(o)::bigint as output_tokens, sum(w)::bigint as reasoning_tokens,
        round(sum((i - r) * ri + r * rr + o * ro), 9) as cost, string_agg(distinct model, ',' order by model) as models
    from u join (values """ + ", ".join(f"('{m}', {r.input}::double, {r.output}::double, {r.cache_read}::double)" for m, r in built_in().items() if m in ("gpt-5", "gpt-5.4", "gpt-5.2-codex")) + """) as k(name, ri, ro, rr) on model = name group by period"""


def source_codex(spark, sf_dir):
    """Running totals: what each event adds to its session's total is what it used."""
    folder = f"{shared_folder(spark)}/logs-{uuid.uuid4().hex}"
    e = _events(spark, sf_dir).withColumn("model", F.when(c("m") == "mystery-1", "gpt-5.4").when(c("m") == "gpt-5", "gpt-5").otherwise("gpt-5.2-codex"))
    far = Window.partitionBy("s").orderBy("ms", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = {"input_tokens": c("i"), "cached_input_tokens": F.least("r", "i"), "output_tokens": c("o"), "reasoning_output_tokens": c("w"), "total_tokens": c("i") + c("o")}
    e = e.select("*", F.row_number().over(Window.partitionBy("s").orderBy("ms", "n")).alias("k"), *(F.sum(v).over(far).alias(k) for k, v in own.items()))
    info = j(model=c("model"), total_token_usage=F.struct(*own))
    record = j(timestamp=c("iso"), type=text("event_msg"), payload=j(type=text("token_count"), info=info))
    write_logs(e.select(F.concat(text("sessions/"), "s", text(".jsonl")).alias("file"), c("k").alias("n"), F.to_json(record).alias("line")), folder)
    out = codex_report(spark, folder, "daily")
    names = F.array_join(F.transform("models", lambda x: x["model"]), ",")
    return out.select("period", "input_tokens", "cache_read_tokens", "output_tokens", "reasoning_tokens", F.round("cost", 9).alias("cost"), names.alias("models"))


Q["source_codex"], SQL["source_codex"] = source_codex, _CODEX
