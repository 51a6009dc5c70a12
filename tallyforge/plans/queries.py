"""The engine's operators over the supplied star-schema and event tables, and their SQL.

``events`` stands for the usage fact: user = session, event type = model, value = tokens or
cost, props = the raw usage object. Each query goes through the operators of this package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import costs, formats, jsonpick, names
from tallyforge.functions import timestamps as T
from tallyforge.functions.tokens import saturating_minus
from tallyforge.operators.blocks import block_starts, gap_blocks, is_active
from tallyforge.operators.carry import as_of, as_of_merge, carry_forward, leading_run, running_delta, with_lookup
from tallyforge.operators.dedupe import keep_first, keep_highest, keep_last, keep_ranked
from tallyforge.operators.pricing import price
from tallyforge.plans import reports as R
from tallyforge.plans.statusline import session_cost, status
from tallyforge.sources.agents import usage
from tallyforge.sources.rates import Rate, built_in, match_models

HOUR_US = 3_600_000_000
DURATION_US = 5 * HOUR_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, sf_dir) -> DataFrame:
    """events with ts as an instant (the session is in UTC) and its microseconds."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def _money(c):
    return F.round(c, 6)


Q, SQL = {}, {}


def query(sql: str):
    def keep(f):
        Q[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


_BLOCKS = """
    with recursive e as (select user_id, epoch_us(ts) as us, value, row_number() over (partition by user_id order by ts, event_id) as n from events),
    b as (
        select user_id, n, us, value, us - us % 3600000000 as start from e where n = 1
        union all
        select e.user_id, e.n, e.us, e.value,
            case when e.us - b.start > 18000000000 or e.us - b.us > 18000000000 then e.us - e.us % 3600000000 else b.start end
        from b join e on e.user_id = b.user_id and e.n = b.n + 1
    ),
    blocks as (select user_id, start, min(us) as first, max(us) as last, count(*) as entries, sum(value) as total from b group by user_id, start)
"""


def _blocks(spark, sf_dir) -> DataFrame:
    placed = block_starts(_events(spark, sf_dir), "us", ["user_id"], DURATION_US, HOUR_US)
    return placed.groupBy("user_id", "block_start").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("entries"), F.sum("value").alias("total"))


@query(_BLOCKS + "select user_id, start as block_start, first, last, entries, round(total, 6) as total from blocks")
def session_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).withColumn("total", _money(F.col("total")))


@query(
    _BLOCKS
    + """, o as (select *, lag(last) over (partition by user_id order by start, first) as previous from blocks)
    select user_id, previous + 18000000000 as gap_start, first as gap_end from o where first - previous > 18000000000"""
)
def block_gaps(spark, sf_dir):
    return gap_blocks(_blocks(spark, sf_dir), ["user_id"], DURATION_US)


@query(
    _BLOCKS
    + """select user_id, start as block_start, round(total / ((last - first) / 6e7), 6) as tokens_per_minute,
        round(total / ((last - first) / 6e7) * 60, 6) as cost_per_hour from blocks where last > first"""
)
def burn_rate(spark, sf_dir):
    rates = costs.burn_rate(F.lit(0.0), (F.col("last") - F.col("first")) / 1000, F.col("total"), F.col("total"), F.col("total"))
    out = _blocks(spark, sf_dir).withColumns(rates).where("tokens_per_minute is not null")
    return out.select("user_id", "block_start", _money(F.col("tokens_per_minute")).alias("tokens_per_minute"), _money(F.col("cost_per_hour")).alias("cost_per_hour"))


@query(
    _BLOCKS
    + """, n as (select max(us) + 60000000 as now from e), p as (
        select user_id, start, total, (start + 18000000000 - now) / 6e7 as ahead, total / ((last - first) / 6e7) as rate
        from blocks, n where last > first and now - last < 18000000000 and now < start + 18000000000
    ), r as (select *, round(ahead) as remaining, round(total + rate * round(ahead))::bigint as projected from p)
    select user_id, start as block_start, remaining::bigint as remaining_minutes, projected as projected_tokens,
        round((total + rate * remaining) * 100) / 100 as projected_cost,
        case when projected > 500 then 'exceeds' when projected > 400 then 'warning' else 'ok' end as limit_status from r"""
)
def block_projection(spark, sf_dir):
    now = _events(spark, sf_dir).agg((F.max("us") + 60_000_000).alias("now"))
    b = _blocks(spark, sf_dir).crossJoin(F.broadcast(now))  # one row
    b = b.where(is_active(F.col("last"), F.col("block_start"), F.col("now"), DURATION_US))
    b = b.withColumns(costs.burn_rate(F.lit(0.0), (F.col("last") - F.col("first")) / 1000, F.col("total"), F.col("total"), F.col("total"))).where("tokens_per_minute is not null")
    end = (F.col("block_start") + DURATION_US) / 1000
    b = b.withColumns(costs.projection(end, F.col("now") / 1000, F.col("total"), F.col("total"), F.col("tokens_per_minute"), F.col("cost_per_hour")))
    status = costs.limit_status(F.col("projected_tokens"), F.lit(500))
    return b.select("user_id", "block_start", "remaining_minutes", "projected_tokens", "projected_cost", status.alias("limit_status"))


@query("select event_id, case when event_type = 'error' then null when value > 50 then event_type || '-fast' else event_type end as model, value from events where strftime(ts, '%Y%m%d') between '20240105' and '20240112'")
def scan_filter_project(spark, sf_dir):
    model = F.when(F.col("event_type") != "error", F.when(F.col("value") > 50, F.concat("event_type", F.lit("-fast"))).otherwise(F.col("event_type")))
    rows = table(spark, sf_dir, "events").where(T.in_days(F.col("ts"), "20240105", "2024-01-12"))
    return rows.select("event_id", model.alias("model"), "value")


def _as_usage(rows: DataFrame, agent: str, ts, key, model, tokens, cost, **more) -> DataFrame:
    """A table as priced usage rows: what the reports of this package take."""
    rows = usage(rows, agent, ts_ms=F.unix_millis(ts.cast("timestamp")), file=F.lit("f"), line_no=key, model=model, input_tokens=F.floor(tokens).cast("long"), output_tokens=(key % 10).cast("long"), recorded_cost=cost, **more)
    return R.dated(rows.withColumns({"cost": F.col("recorded_cost"), "missing_pricing": F.lit(None).cast("string")}))


def _usage(spark, sf_dir) -> DataFrame:
    """events as usage: user = session, type = model (none for errors) and version, value = tokens and cost."""
    project = F.concat(F.lit("p"), F.col("user_id") % 7)
    return _as_usage(
        table(spark, sf_dir, "events"), "events", F.col("ts"), F.col("event_id"), F.when(F.col("event_type") != "error", F.col("event_type")), F.col("value"), F.col("value"),
        session_id=F.col("user_id"), project=project, project_path=project, version=F.col("event_type"),
    )


_U = "u as (select *, case when event_type <> 'error' then event_type end as model, floor(value)::bigint as i, event_id % 10 as o, epoch_us(ts) // 1000 as ms from events)"


def _report_sql(**keys: str) -> str:
    names = ", ".join(keys)
    return f"""with {_U}, m as (
            select {", ".join(f"{v} as {k}" for k, v in keys.items())}, model, sum(i) as i, sum(o) as o, sum(value) as c, min((ms, event_id)) as first from u group by all)
        select {names}, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, (sum(i) + sum(o))::bigint as total_tokens, round(sum(c), 6) as cost,
            coalesce(string_agg(model, ',' order by first) filter (model is not null), '') as models, arg_max(model, c) filter (model is not null) as dearest from m group by {names}"""


def _report(table_: DataFrame, *keys) -> DataFrame:
    dearest = F.get("model_breakdowns", F.lit(0))["model"]
    return table_.select(*keys, "input_tokens", "output_tokens", "total_tokens", _money(F.col("cost")).alias("cost"), F.array_join("models_used", ",").alias("models"), dearest.alias("dearest"))


@query(_report_sql(date="strftime(ts, '%Y-%m-%d')"))
def daily_summary(spark, sf_dir):
    return _report(R.daily(_usage(spark, sf_dir)), "date")


@query(_report_sql(month="strftime(ts, '%Y-%m')"))
def monthly_summary(spark, sf_dir):
    return _report(R.monthly(_usage(spark, sf_dir)), "month")


_WEEK = "strftime(ts::date - ((dayofweek(ts::date) - {0} + 7) % 7)::int, '%Y-%m-%d')"


@query(_report_sql(week=_WEEK.format(0)))
def weekly_summary_sunday(spark, sf_dir):
    return _report(R.weekly(_usage(spark, sf_dir)), "week")


@query(_report_sql(week=_WEEK.format(1)))
def weekly_summary_monday(spark, sf_dir):
    return _report(R.weekly(_usage(spark, sf_dir), R.Options(week_starts="monday")), "week")


@query(_report_sql(date="strftime(ts, '%Y-%m-%d')", project="'p' || (user_id % 7)"))
def daily_by_project(spark, sf_dir):
    return _report(R.daily(_usage(spark, sf_dir), by_project=True), "date", "project")


@query(_report_sql(date="strftime(ts, '%Y-%m-%d')") + " having date between '2024-01-10' and '2024-01-12'")
def daily_in_bounds(spark, sf_dir):
    return _report(R.daily(_usage(spark, sf_dir), R.Options(since="20240110", until="2024-01-12")), "date")


_SESSIONS = f"""with {_U}, s as (select user_id::varchar as session_id, 'p' || (user_id % 7) as project_path, sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, round(sum(value), 6) as cost,
        min(ms) as first_ms, max(ms) as last_ms, string_agg(distinct event_type, ',' order by event_type) as versions from u group by all)
    select * from s where input_tokens + output_tokens > 0"""


def _sessions(spark, sf_dir, options) -> DataFrame:
    out = R.sessions(_usage(spark, sf_dir), options)
    return out.select("session_id", "project_path", "input_tokens", "output_tokens", _money(F.col("cost")).alias("cost"), "first_ms", "last_ms", F.array_join("versions", ",").alias("versions"))


@query(_SESSIONS)
def session_summary(spark, sf_dir):
    return _sessions(spark, sf_dir, R.Options())


@query(_SESSIONS + " and strftime(make_timestamp(last_ms * 1000), '%Y-%m-%d') between '2024-01-20' and '2024-01-29'")
def session_date_filter(spark, sf_dir):
    """Sessions whose last activity is in the bounds, with all their rows."""
    return _sessions(spark, sf_dir, R.Options(since="20240120", until="20240129"))


@query(
    f"""with {_U}, m as (select user_id::varchar as session_id, model, sum(i)::bigint as input_tokens, sum(value) as c, min((ms, event_id)) as first from u where model is not null group by all)
    select session_id, model, input_tokens, round(c, 6) as cost, row_number() over (partition by session_id order by c desc, first)::int as dearest,
        row_number() over (partition by session_id order by first)::int as first_use from m"""
)
def model_breakdown(spark, sf_dir):
    s = R.sessions(_usage(spark, sf_dir)).withColumn("used", F.col("models_used"))
    each = s.select("session_id", "used", F.posexplode("model_breakdowns").alias("place", "m"))
    return each.select("session_id", "m.model", "m.input_tokens", _money(F.col("m.cost")).alias("cost"), (F.col("place") + 1).alias("dearest"), F.array_position("used", F.col("m.model")).cast("int").alias("first_use"))


@query(f"with {_U} select sum(i)::bigint as input_tokens, sum(o)::bigint as output_tokens, (sum(i) + sum(o))::bigint as total_tokens, round(sum(value), 6) as cost from u")
def totals(spark, sf_dir):
    return R.totals(R.daily(_usage(spark, sf_dir))).select("input_tokens", "output_tokens", "total_tokens", _money(F.col("cost")).alias("cost"))


@query(f"with {_U} select count(*) as entries, (sum(i) + sum(o))::bigint as total_tokens, round(sum(value), 6) as cost from u where user_id = 7")
def session_detail_totals(spark, sf_dir):
    return R.session_totals(_usage(spark, sf_dir), "7").select("entries", "total_tokens", _money(F.col("cost")).alias("cost"))


@query(f"with {_U} select round(sum(value) filter (user_id = 7), 6) as session_cost, round(coalesce(sum(value) filter (strftime(ts, '%Y-%m-%d') = '2024-01-15'), 0), 6) as today_cost from u")
def statusline_costs(spark, sf_dir):
    out = R.statusline_costs(_usage(spark, sf_dir), "7", "2024-01-15")
    return out.select(*(_money(F.col(c)).alias(c) for c in ("session_cost", "today_cost")))


@query(
    f"""with {_U}, s as (select user_id::varchar as session_id, sum(value) as logged, count(*) as n, max(event_id) as last from u group by all)
    select session_id, round(logged, 6) as logged_cost, case when last % 3 <> 0 then last / 4.0 end as hook_cost, case when n % 2 = 0 then 'short' else 'Model ' || n end as model_label,
        floor(n * 70000.0 / 4300 + 0.5)::bigint as context_percent,
        printf('$%.2f', case when last % 3 <> 0 then last / 4.0 else logged end) as session_cost from s"""
)
def status_of_sessions(spark, sf_dir):
    """A hook for each session that the log has; two thirds of them tell a cost."""
    rows = _usage(spark, sf_dir)
    s = _events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    text = F.struct(F.when(F.col("n") % 2 == 0, "Model X").otherwise(F.concat(F.lit("Model "), "n")).alias("display_name"))
    cost = F.when(F.col("last") % 3 != 0, F.struct((F.col("last") / 4).alias("total_cost_usd")))
    window = F.struct((F.col("n") * 700).alias("total_input_tokens"), F.lit(4300).alias("context_window_size"))
    hook = F.struct(F.col("user_id").cast("string").alias("session_id"), F.lit("/t").alias("transcript_path"), text.alias("model"), cost.alias("cost"), window.alias("context_window"))
    out = status(s.select(F.to_json(hook).alias("json")), rows, R.Options(now_ms=1_800_000_000_000), aliases={"Model X": "short"})
    return out.select("session_id", *(_money(F.col(c)).alias(c) for c in ("logged_cost", "hook_cost")), "model_label", "context_percent", session_cost().alias("session_cost"))


@query(
    _BLOCKS.replace("epoch_us(ts) as us", "epoch_us(ts) // 1000 as us").replace("3600000000", "3600000").replace("18000000000", "18000000").replace("value, row_number", "floor(value)::bigint + event_id % 10 as tokens, value, row_number").replace("select user_id, n, us, value", "select user_id, n, us, tokens, value").replace("e.us, e.value", "e.us, e.tokens, e.value").replace("sum(value) as total", "sum(tokens)::bigint as total_tokens, sum(value) as total")
    + """select user_id::varchar as session_id, start as block_start, entries, total_tokens, round(total, 6) as cost, first, last from blocks
        where strftime(make_timestamp(start * 1000), '%Y-%m-%d') between '2024-01-10' and '2024-01-20'"""
)
def blocks_in_bounds(spark, sf_dir):
    """Blocks that start in the bounds; they form over all rows."""
    options = R.Options(since="20240110", until="20240120", now_ms=1_800_000_000_000)
    out = R.activity_blocks(_usage(spark, sf_dir), options, ["session_id"]).where("not is_gap")
    return out.select("session_id", "block_start", "entries", "total_tokens", _money(F.col("cost")).alias("cost"), "first", "last")


@query(
    """select o_orderkey, round(case when t > 200000 then 200000 * 3e-6 + (t - 200000) * 6e-6 else t * 3e-6 end, 6) as tiered,
        round(t * 3e-6, 6) as flat from (select o_orderkey, floor(o_totalprice)::bigint * 2 as t from orders)"""
)
def tiered_cost(spark, sf_dir):
    t = (F.floor("o_totalprice").cast("long") * 2).alias("t")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", t)
    return rows.select("o_orderkey", _money(costs.tiered_cost(F.col("t"), F.lit(3e-6), F.lit(6e-6))).alias("tiered"), _money(costs.tiered_cost(F.col("t"), F.lit(3e-6), F.lit(None).cast("double"))).alias("flat"))


_TOKEN_RATES = "floor(l_quantity)::bigint * 9000 as i, floor(l_extendedprice)::bigint as o, l_linenumber * 1000 as c5, l_linenumber * 500 as c1, floor(l_discount * 1000000)::bigint as r"


@query(
    f"""with t as (select l_orderkey, l_linenumber, l_returnflag, {_TOKEN_RATES} from lineitem)
    select l_orderkey, l_linenumber, round((
        case when i > 200000 then 200000 * 3e-6 + (i - 200000) * 6e-6 else i * 3e-6 end
        + case when o > 200000 then 200000 * 15e-6 + (o - 200000) * 22.5e-6 else o * 15e-6 end
        + c5 * 3.75e-6 + c1 * 6e-6 + case when r > 200000 then 200000 * 0.3e-6 + (r - 200000) * 0.6e-6 else r * 0.3e-6 end
    ), 6) as cost from t"""
)
def token_cost(spark, sf_dir):
    whole = lambda c: F.floor(c).cast("long")
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (whole("l_quantity") * 9000).alias("input_tokens"),
        whole("l_extendedprice").alias("output_tokens"),
        (F.col("l_linenumber") * 1500).cast("long").alias("cache_creation_tokens"),
        (F.col("l_linenumber") * 1000).cast("long").alias("cache_5m_tokens"),
        (F.col("l_linenumber") * 500).cast("long").alias("cache_1h_tokens"),
        whole(F.col("l_discount") * 1_000_000).alias("cache_read_tokens"),
        F.when(F.col("l_returnflag") == "R", "fast").otherwise("standard").alias("speed"),
    )
    r = built_in()["claude-sonnet-4"]
    rate = F.struct(*(F.lit(v).alias(k) for k, v in r.__dict__.items() if k not in ("model", "context_limit")))
    return rows.select("l_orderkey", "l_linenumber", _money(costs.token_cost(rate, F.col("output_tokens"))).alias("cost"))


@query(
    """with r as (select event_id, case when event_id % 3 = 0 then null else value end as recorded, event_id * 1e-3 as computed from events)
    select event_id, round(coalesce(recorded, computed), 6) as auto, round(computed, 6) as calculate, round(coalesce(recorded, 0), 6) as display from r"""
)
def cost_modes(spark, sf_dir):
    recorded, computed = F.when(F.col("event_id") % 3 != 0, F.col("value")), F.col("event_id") * 0.001
    return _events(spark, sf_dir).select("event_id", *(_money(costs.by_mode(m, recorded, computed)).alias(m) for m in costs.MODES))


#: Dollars a token of a card for three event types.
_TYPES = {"view": 1.5, "click": 2.0, "purchase": 9.25}


def _priced(spark, sf_dir) -> DataFrame:
    return price(_usage(spark, sf_dir).drop("cost", "missing_pricing"), [{k: Rate(k, input=v) for k, v in _TYPES.items()}], "calculate")


@query(
    f"""with {_U}, card(name, rate) as (values {", ".join(f"('{k}', {v}::double)" for k, v in _TYPES.items())})
    select event_id, round(i * coalesce(rate, 0), 6) as cost, rate is null and model is not null and i + o > 0 as missing from u left join card on model = name"""
)
def pricing_exact_join(spark, sf_dir):
    return _priced(spark, sf_dir).select(F.col("line_no").alias("event_id"), _money(F.col("cost")).alias("cost"), F.col("missing_pricing").isNotNull().alias("missing"))


_CARD = {"promo": 1.0, "promo brushed": 2.0, "economy": 3.0, "standard": 4.0, "steel": 5.0, "tin": 6.0, "brushed steel": 7.0}


@query(
    "with card(key, rate) as (values " + ", ".join(f"('{k}', {v})" for k, v in _CARD.items()) + """),
    m as (select distinct lower(p_type) as model from part),
    hit as (select model, key, rate from m join card on regexp_matches(model, '(^|[^a-z0-9])' || key || '($|[^a-z0-9])')
        or regexp_matches(key, '(^|[^a-z0-9])' || model || '($|[^a-z0-9])')
        qualify row_number() over (partition by model order by model = key desc, length(key) desc, key) = 1)
    select p_partkey, key as matched, rate from part left join hit on lower(p_type) = model"""
)
def pricing_fuzzy_join(spark, sf_dir):
    card = {k: Rate(k, input=v) for k, v in _CARD.items()}
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_type").alias("model"))
    rows = parts.join(match_models(parts, [card]), "model", "left")
    return rows.select("p_partkey", F.col("rate.model").alias("matched"), F.col("rate.input").alias("rate"))


_VERSIONS = [("2024-01-03", "v1"), ("2024-01-10", "v2"), ("2024-01-22", "v3")]


@query(
    "with v(since, version) as (values " + ", ".join(f"('{d}', '{m}')" for d, m in _VERSIONS) + """)
    select event_id, coalesce((select max_by(version, since) from v where since <= strftime(ts, '%Y-%m-%d')), 'v0') as version from events"""
)
def asof_model_fallback(spark, sf_dir):
    versions = spark.createDataFrame(_VERSIONS, "since string, version string")
    rows = _events(spark, sf_dir).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return as_of(rows, versions, "day", "since", "version", "v0").select("event_id", "version")


@query("select event_id % 700 as key, event_id, value from events qualify row_number() over (partition by event_id % 700 order by event_type = 'error', value desc, event_id) = 1")
def dedupe_best(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("key", F.col("event_id") % 700)
    return keep_ranked(rows, ["key"], [F.asc(F.col("event_type") == "error"), F.desc("value"), F.asc("event_id")]).select("key", "event_id", "value")


@query("select user_id, event_type, event_id from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def dedupe_last(spark, sf_dir):
    return keep_last(_events(spark, sf_dir), ["user_id", "event_type"], ["us", "event_id"]).select("user_id", "event_type", "event_id")


@query("select min(event_id) as event_id, user_id, event_type, date from (select *, strftime(ts, '%Y-%m-%d') as date from events) group by user_id, event_type, date")
def dedupe_composite(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return keep_first(rows, ["user_id", "event_type", "date"], ["event_id"]).select("event_id", "user_id", "event_type", "date")


@query(
    """with k as (select *, event_id % 900 as message_id, event_id % 4 as request_id, event_id % 5 = 0 as side from events),
    m as (select *, bool_or(not side) over (partition by message_id) as has_main from k)
    select event_id from m where not has_main or not side
    qualify row_number() over (partition by message_id, case when has_main then request_id end order by floor(value)::bigint desc, event_type = 'view' desc, event_id) = 1"""
)
def dedupe_replayed(spark, sf_dir):
    from tallyforge.operators.dedupe import dedupe_replayed as dedupe

    e = F.col("event_id")
    rows = _events(spark, sf_dir).select(
        "event_id",
        (e % 900).cast("string").alias("message_id"),
        (e % 4).cast("string").alias("request_id"),
        (e % 5 == 0).alias("is_sidechain"),
        F.floor("value").cast("long").alias("input_tokens"),
        *(F.lit(0).cast("long").alias(c) for c in ("output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")),
        F.when(F.col("event_type") == "view", "fast").alias("speed"),
        F.lit("f").alias("file"),
        e.alias("line_no"),
        F.lit(0).cast("long").alias("item_no"),
    )
    return dedupe(rows).select("event_id")


@query("select event_id from events e where not exists (select 1 from events p where p.user_id = e.user_id and p.event_type < e.event_type)")
def anti_suppress(spark, sf_dir):
    return keep_highest(_events(spark, sf_dir), ["user_id"], "event_type").select("event_id")


@query("select c_custkey, coalesce(n, 0) as n_orders, round(coalesce(total, 0), 2) as total from customer left join (select o_custkey, count(*) as n, sum(o_totalprice) as total from orders group by 1) on o_custkey = c_custkey")
def left_lookup_default(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.sum("o_totalprice").alias("total"))
    rows = with_lookup(table(spark, sf_dir, "customer"), orders, ["c_custkey"], {"n_orders": F.lit(0).cast("long"), "total": F.lit(0.0)})
    return rows.select("c_custkey", "n_orders", F.round("total", 2).alias("total"))


@query(
    """select event_id, case when event_id % 4 = 0 then null else greatest(floor(value)::bigint - coalesce(last_value(case when event_id % 4 <> 0 then floor(value)::bigint end ignore nulls)
        over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0), 0) end as total_delta from events"""
)
def cumulative_delta(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("total", F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("long")))
    return running_delta(rows, ["total"], ["user_id"], ["us", "event_id"]).select("event_id", "total_delta")


@query("select event_id, last_value(case when event_type in ('view', 'signup') then event_type end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as model from events")
def carry_forward_model(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("model", F.when(F.col("event_type").isin("view", "signup"), F.col("event_type")))
    return carry_forward(rows, ["model"], ["user_id"], ["us", "event_id"]).select("event_id", "model")


@query("select event_id from events qualify bool_and(event_type <> 'purchase') over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)")
def leading_replay_run(spark, sf_dir):
    return leading_run(_events(spark, sf_dir), F.col("event_type") != "purchase", ["user_id"], ["us", "event_id"], "inside").where("inside").select("event_id")


def _tools(spark, sf_dir) -> DataFrame:
    """Three tables as three tools, by month."""
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = {
        "order": _as_usage(o, "order", F.col("o_orderdate"), F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_totalprice")),
        "line": _as_usage(x, "line", F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice")),
        "event": _usage(spark, sf_dir),
    }
    return reduce(DataFrame.unionByName, (R.of_agent(R.period_rows(R.monthly(r), "month"), a) for a, r in rows.items()))


_TOOLS = """with t as (
        select 'order' as agent, strftime(o_orderdate, '%Y-%m') as period, o_orderpriority as model, floor(o_totalprice)::bigint as i, o_orderkey % 10 as o, o_totalprice as c from orders
        union all select 'line', strftime(l_shipdate, '%Y-%m'), l_returnflag, floor(l_quantity)::bigint, l_orderkey % 10, l_extendedprice from lineitem
        union all select 'event', strftime(ts, '%Y-%m'), case when event_type <> 'error' then event_type end, floor(value)::bigint, event_id % 10, value from events)
"""


@query(_TOOLS + "select agent, period, (sum(i) + sum(o))::bigint as total_tokens, round(sum(c), 6) as cost, count(distinct model) as models from t group by agent, period")
def union_sources(spark, sf_dir):
    return _tools(spark, sf_dir).select("agent", "period", "total_tokens", _money(F.col("cost")).alias("cost"), F.size("models_used").cast("long").alias("models"))


@query(_TOOLS + "select period, string_agg(distinct agent, ',' order by agent) as agents, (sum(i) + sum(o))::bigint as total_tokens, round(sum(c), 6) as cost, string_agg(distinct model, ',' order by model) as models from t group by period")
def unified_rollup(spark, sf_dir):
    out = R.roll_up(_tools(spark, sf_dir))
    return out.select("period", F.array_join("agents", ",").alias("agents"), "total_tokens", _money(F.col("cost")).alias("cost"), F.array_join("models_used", ",").alias("models"))


@query(
    """with t as (select event_id, floor(value)::bigint as i, case when event_id % 3 = 0 then 0 else event_id % 10 end as o, floor(value)::bigint + event_id % 20 as total from events)
    select event_id, o + case when o = 0 then greatest(total - i - o, 0) else 0 end as output_tokens, case when o = 0 then 0 else greatest(total - i - o, 0) end as extra_tokens from t"""
)
def token_fallback(spark, sf_dir):
    from tallyforge.functions.tokens import with_total_fallback

    e, whole = F.col("event_id"), F.floor("value").cast("long")
    zero = [F.lit(0).cast("long").alias(c) for c in ("cache_creation_tokens", "cache_read_tokens", "extra_tokens")]
    rows = _events(spark, sf_dir).select("event_id", whole.alias("input_tokens"), F.when(e % 3 == 0, 0).otherwise(e % 10).alias("output_tokens"), *zero, (whole + e % 20).alias("t"))
    return with_total_fallback(rows, F.col("t")).select("event_id", "output_tokens", "extra_tokens")


@query("select event_id, greatest(floor(value)::bigint - least(event_id % 60, floor(value)::bigint), 0) as fresh, greatest(floor(value)::bigint - event_id % 60, 0) as saturated from events")
def cached_input(spark, sf_dir):
    whole, cached = F.floor("value").cast("long"), F.col("event_id") % 60
    return _events(spark, sf_dir).select("event_id", saturating_minus(whole, F.least(cached, whole)).alias("fresh"), saturating_minus(whole, cached).alias("saturated"))


@query("select event_id, greatest(coalesce(try_cast(json_extract(props, '$.k') as bigint), 0), 0) as k, coalesce(try_cast(json_extract(props, '$.none') as bigint), 0) as none from events")
def json_lossy_extract(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", jsonpick.u64(F.col("v"), "k").alias("k"), jsonpick.u64(F.col("v"), "none").alias("none"))


@query(
    r"""with s as (select event_id, case event_id % 4 when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%SZ') when 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S.123+09:00')
        when 2 then strftime(ts, '%Y-%m-%d %H:%M:%S') else strftime(ts, '%Y-%m-%dT%H:%M:61Z') end as text from events)
    select event_id, case when regexp_matches(text, '^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{3})?(Z|[+-]\d{2}:\d{2})$') then epoch_ms(try_cast(text as timestamptz)) end as ms from s"""
)
def ts_strict_parse(spark, sf_dir):
    e, f = F.col("event_id") % 4, lambda x: F.date_format("ts", x)
    text = F.when(e == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(e == 1, f("yyyy-MM-dd'T'HH:mm:ss'.123+09:00'")).when(e == 2, f("yyyy-MM-dd HH:mm:ss")).otherwise(f("yyyy-MM-dd'T'HH:mm:'61Z'"))
    return _events(spark, sf_dir).select("event_id", text.alias("text")).select("event_id", T.strict_ms(F.col("text")).alias("ms"))


@query("select event_id, strftime(ts + interval 9 hour, '%Y-%m-%d') as tokyo, epoch_us(ts) - epoch_us(ts) % 3600000000 as hour from events")
def local_dates(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", T.local_date(F.unix_millis("ts"), "Asia/Tokyo").alias("tokyo"), (T.floor_hour(F.unix_millis("ts")) * 1000).alias("hour"))


@query(
    """with m as (select p_partkey, case p_partkey % 4 when 0 then 'anthropic/claude-' when 1 then 'claude-' else '' end || lower(replace(p_type, ' ', '-')) || case when p_partkey % 3 = 0 then '-20250514' else '' end as model from part),
    b as (select *, regexp_replace(model, '^(anthropic/)?claude-', '') as bare from m)
    select p_partkey, case when len(string_split(bare, '-')) >= 3 and length(string_split(bare, '-')[-1]) = 8 then array_to_string(string_split(bare, '-')[:-2], '-') else bare end as short,
        replace(replace(model, '.', '-'), '@', '-') as pricing_key from b"""
)
def short_model_name(spark, sf_dir):
    k = F.col("p_partkey")
    prefix = F.when(k % 4 == 0, "anthropic/claude-").when(k % 4 == 1, "claude-").otherwise("")
    model = F.concat(prefix, F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))), F.when(k % 3 == 0, "-20250514").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", model.alias("model"))
    return rows.select("p_partkey", names.short_model_name(F.col("model")).alias("short"), names.pricing_key(F.col("model")).alias("pricing_key"))


@query("select distinct event_type as model from events where event_type not in ('view', 'click', 'purchase', 'error') and floor(value)::bigint + event_id % 10 > 0")
def missing_pricing(spark, sf_dir):
    return R.missing_models(_priced(spark, sf_dir))


@query("select epoch, case when epoch < 1000000000000 then epoch * 1000 else epoch end as ms, case when o >= 100000000000000000 then o // 1000000 when o >= 100000000000000 then o // 1000 when o >= 100000000000 then o else o * 1000 end as otel_ms from (select event_id, case when event_id % 2 = 0 then epoch_us(ts) // 1000 else epoch_us(ts) // 1000000 end as epoch, epoch_us(ts) // 1000000 * case event_id % 4 when 0 then 1 when 1 then 1000 when 2 then 1000000 else 1000000000 end as o from events)")
def flexible_timestamps(spark, sf_dir):
    e, us = F.col("event_id"), F.col("us")
    whole = lambda n: F.floor(us / n).cast("long")
    epoch = F.when(e % 2 == 0, whole(1000)).otherwise(whole(1_000_000))
    scale = F.when(e % 4 == 0, 1).when(e % 4 == 1, 1000).when(e % 4 == 2, 1_000_000).otherwise(F.lit(1_000_000_000))
    rows = _events(spark, sf_dir).select(epoch.alias("epoch"), (whole(1_000_000) * scale).alias("o"))
    return rows.select("epoch", T.epoch_ms(F.col("epoch"), 1_000_000_000_000).alias("ms"), T.otel_ms(F.col("o")).alias("otel_ms"))


@query("select o_orderkey, format('{:,}', floor(o_totalprice)::bigint) as n, printf('$%.2f', round(o_totalprice, 2)) as money, case when m >= 60 then (m // 60) || 'h ' || (m % 60) || 'm left' else m || 'm left' end as left_text from (select *, o_orderkey % 400 as m from orders)")
def formats_of_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.select(
        "o_orderkey",
        formats.whole_number(F.floor("o_totalprice")).alias("n"),
        formats.currency(F.round("o_totalprice", 2)).alias("money"),
        formats.remaining_time(F.col("o_orderkey") % 400).alias("left_text"),
    )


@query(
    """with s as (select user_id, sum(floor(value)::bigint)::bigint as tokens, sum(value) as cost, count(*) as n from events group by user_id)
    select user_id, round(tokens / 2e3 * 100)::bigint as percent, case when round(tokens / 2e3 * 100) < 50 then 'green' when round(tokens / 2e3 * 100) < 80 then 'yellow' else 'red' end as color,
        case when n * 40.0 < 2000 then 'Normal' when n * 40.0 < 5000 then 'Moderate' else 'High' end as burn, round(cost, 6) as cost from s"""
)
def statusline_values(spark, sf_dir):
    s = _events(spark, sf_dir).groupBy("user_id").agg(F.sum(F.floor("value").cast("long")).alias("tokens"), F.sum("value").alias("cost"), F.count("*").alias("n"))
    percent = formats.context_share(F.col("tokens"), F.lit(2000))
    return s.select("user_id", percent.alias("percent"), formats.context_color(percent).alias("color"), costs.burn_status(F.col("n") * 40.0).alias("burn"), _money(F.col("cost")).alias("cost"))


@query("select l_suppkey as model, round((sum(i) - sum(c)) * 1.75e-6 * 2 + sum(c) * 0.175e-6 * 2 + sum(o) * 14e-6 * 2, 6) as cost from (select l_suppkey, floor(l_quantity)::bigint * 100 as i, l_linenumber * 10 as c, floor(l_extendedprice)::bigint as o from lineitem) group by l_suppkey")
def price_after_aggregate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("model")).agg(
        F.sum(F.floor("l_quantity").cast("long") * 100).alias("input_tokens"), F.sum(F.col("l_linenumber") * 10).alias("cached_tokens"), F.sum(F.floor("l_extendedprice").cast("long")).alias("output_tokens")
    )
    r = built_in()["gpt-5.3-codex"]
    rate = F.struct(*(F.lit(v).alias(k) for k, v in r.__dict__.items() if k not in ("model", "context_limit") and v is not None))
    return rows.select("model", _money(costs.cumulative_log_cost(rate, fast=True)).alias("cost"))


@query(
    """with recursive e as (select epoch_us(ts) as us, value from events), b(first) as (
        select min(us) from e
        union all
        select min(e.us) from b join e on e.us > b.first - b.first % 3600000000 + 9000000000 group by b.first
    ), f as (select first, coalesce(lead(first) over (order by first), 1::bigint << 62) as until from b)
    select first - first % 3600000000 as block_start, min(us) as first, max(us) as last, count(*) as entries, round(sum(value), 6) as total
    from f join e on us >= f.first and us < until group by f.first"""
)
def blocks_of_all_events(spark, sf_dir):
    """Blocks of two and a half hours over all events as one history."""
    placed = block_starts(_events(spark, sf_dir).withColumn("all", F.lit(1)), "us", ["all"], HOUR_US * 5 // 2, HOUR_US)
    sums = placed.groupBy("block_start").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("entries"), F.sum("value").alias("total"))
    return sums.withColumn("total", _money(F.col("total")))


@query(
    """select event_id, case when event_id % 4 = 0 then null else greatest(floor(value)::bigint - coalesce(last_value(case when event_id % 4 <> 0 then floor(value)::bigint end ignore nulls)
        over (order by ts, event_id rows between unbounded preceding and 1 preceding), 0), 0) end as total_delta,
        last_value(case when event_type in ('view', 'signup') then event_type end ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row) as model from events"""
)
def carries_of_one_session(spark, sf_dir):
    """Running differences and carried models over all events as one session, a day at a time."""
    day = F.floor(F.col("us") / (24 * HOUR_US))
    total, model = F.when(F.col("event_id") % 4 != 0, F.floor("value").cast("long")), F.when(F.col("event_type").isin("view", "signup"), F.col("event_type"))
    rows = _events(spark, sf_dir).withColumns({"session": F.lit(1), "total": total, "model": model})
    rows = running_delta(rows, ["total"], ["session"], ["us", "event_id"], span=day)
    return carry_forward(rows, ["model"], ["session"], ["us", "event_id"], span=day).select("event_id", "total_delta", "model")


@query(
    """with v as (select l_suppkey as k, l_shipdate as since, max(l_returnflag) as flag from lineitem where l_linenumber = 1 group by all)
    select l_orderkey, l_linenumber, coalesce(flag, 'none') as flag from lineitem asof left join v on l_suppkey = k and l_shipdate >= since"""
)
def asof_long_versions(spark, sf_dir):
    """The flag of the supplier's latest first line by the day a line ships: a version for each order."""
    lines = table(spark, sf_dir, "lineitem")
    versions = lines.where("l_linenumber = 1").select("l_suppkey", F.col("l_shipdate").alias("since"), F.col("l_returnflag").alias("flag"))
    facts = lines.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    year = F.year("_at")
    return as_of_merge(facts, versions, ["l_suppkey"], "l_shipdate", "since", "flag", "none", span=year).select("l_orderkey", "l_linenumber", "flag")
