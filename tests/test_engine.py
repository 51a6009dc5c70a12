"""Driver queries against their SQL, streaming, names, formats and rate cards."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import formats, names
from tallyforge.functions import timestamps as T
from tallyforge.plans import queries, source_queries
from tallyforge.sources import rates
from tallyforge.streaming.usage_stream import daily_totals, open_blocks, usage_stream, without_replays

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return db


def same(a, b):
    return a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("name", [*queries.Q, *source_queries.Q])
def test_query_is_its_sql(spark, duck, name):
    held, sql = queries.Q | source_queries.Q, queries.SQL | source_queries.SQL
    df = held[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(([r[c] for c in cols] for r in df.collect()), key=str)
    found = duck.execute(sql[name])
    heads = [d[0] for d in found.description]
    assert sorted(heads) == cols
    want = sorted(([r[heads.index(c)] for c in cols] for r in found.fetchall()), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.Q) <= set(entry.queries()) and set(queries.SQL) <= set(entry.oracle_sql())


def test_rate_matching():
    keys = sorted(rates.built_in())
    want = {
        "claude-opus-4-5": "claude-opus-4-5",
        "claude-opus-4-5-20251101": "claude-opus-4-5",
        "claude-opus-4.5": "claude-opus-4-5",
        "claude-opus-4-20250514": "claude-opus-4",
        "anthropic/claude-sonnet-4@20250514": "claude-sonnet-4",
        "claude-opus-4-9": None,
        "gpt-5": "gpt-5",
        "gpt-5-codex": "gpt-5",
        "openai/gpt-5.1-codex": "gpt-5.1-codex",
        "gpt-5.7": None,
        "kimi-k2.6": "moonshot/kimi-k2.6",
        "xgpt-5": None,
        "gpt-5.3-spark": "gpt-5.3-codex",
        "": None,
    }
    for model, key in want.items():
        assert rates.card_key(model, keys) == key, model
    assert rates.card_key("gpt-5.3-spark", ["gpt-5.3-codex-spark"]) == "gpt-5.3-codex-spark"


def test_scan_pushes_the_days(spark):
    plan = queries.scan_filter_project(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_rate_cards():
    card = rates.load_per_token(json.dumps({"m": {"input_cost_per_token": 2e-6, "output_cost_per_token": 4e-6}, "bad": {"input_cost_per_token": 1}, "n": 5}))
    assert list(card) == ["m"] and card["m"].cache_create == pytest.approx(2.5e-6) and not card["m"].cache_read_explicit
    doubled = rates.override(card, "m", input=4e-6)["m"]
    assert doubled.cache_create == pytest.approx(5e-6) and doubled.output == 4e-6
    assert rates.override(card, "new", input=1e-6)["new"].output == 0
    per = rates.load_per_million(json.dumps({"p": {"models": {"x": {"cost": {"input": 3, "output": 15, "cache_read": 0.3}, "limit": {"context": 9}}, "y": {}}}}))
    assert per["x"].input == pytest.approx(3e-6) and per["x"].cache_read_explicit and per["x"].context_limit == 9
    assert rates.load_per_million('{"p": 1}') == {} and rates.load_per_token("nope") == {}
    assert rates.fast_multiplier("claude-opus-4-6") == 6 and rates.fast_multiplier("anthropic/claude-opus-4.8-x") == 2 and rates.fast_multiplier("gpt-5") == 1


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).head()


def test_names(spark):
    cases = {
        "-Users-me-Development-my-app": "my-app",
        "/Users/me/Development/thing": "thing",
        "C:\\Users\\me\\Dev\\thing": "thing",
        "unknown": "Unknown Project",
        "": "Unknown Project",
        "a2cd99ed-a586-4fe4-8f59-b0026409ec09.jsonl": "8f59-b0026409ec09.jsonl",
        "/project--branch/": "project",
        "feature-very-long-application-service": "application-service",
        "---": "---",
    }
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.n for r in df.select("p", names.project_name(F.col("p"), {}).alias("n")).collect()}
    assert {k: got[k] for k in cases if k != "a2cd99ed-a586-4fe4-8f59-b0026409ec09.jsonl"} == {k: v for k, v in cases.items() if k != "a2cd99ed-a586-4fe4-8f59-b0026409ec09.jsonl"}
    named = names.project_name(F.lit("/project--branch/"), names.parse_aliases("project=Mine, x = ,=y"))
    model = names.plain_model_name(F.lit("custom:Claude  Opus 4.5 [Anthropic]-"))
    r = one(spark, a=named, b=model, c=names.versioned_family(F.lit("claude-opus-45-x")), d=names.versioned_family(F.lit("claude-haiku-4.5")), e=names.short_model_name(F.lit("claude-opus-4-20250514")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("Mine", "claude-opus-4-5", "claude-opus-4-5-x", "claude-haiku-4-5", "opus-4")
    paths = ["/r/projects/p/s.jsonl", "/r/projects/p/q/s/chat.jsonl", "/r/projects/p/sess/subagents/a.jsonl", "/x/y.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "f string")
    got = [tuple(r) for r in df.select(*(c.alias(str(k)) for k, c in enumerate(names.claude_session(F.col("f"))))).collect()]
    assert got == [("p", "s", "p"), ("p", "s", "p/q"), ("p", "sess", "p"), ("unknown", "y", "x")]


def test_formats_and_times(spark):
    r = one(
        spark,
        a=formats.whole_number(F.lit(1234567)),
        b=formats.currency(F.lit(1.005)),
        c=formats.remaining_time(F.lit(125)),
        d=formats.model_list(F.array(F.lit("b"), F.lit("a"), F.lit("b"))),
        e=formats.context_color(formats.context_share(F.lit(85), F.lit(100))),
        f=T.iso_ms(T.strict_ms(F.lit("2026-01-02T03:04:05.678+02:00"))),
        g=T.strict_ms(F.lit("2026-02-30T00:00:00Z")),
        h=T.strict_ms(F.lit("2026-1-2T00:00:00Z")),
        i=T.week_start(T.iso_date(F.lit("2026-01-09")), "monday").cast("string"),
        j=T.clock_12(F.lit(1_770_000_000_000)),
    )
    assert (r.a, r.c, r.d, r.e, r.f, r.g, r.h, r.i) == ("1,234,567", "2h 5m left", "- a\n- b", "red", "2026-01-02T01:04:05.678Z", None, None, "2026-01-05")
    assert r.b in ("$1.00", "$1.01") and r.j == "2 AM"


def test_stream_ends_as_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    events.orderBy("ts").repartition(1).sortWithinPartitions("ts").write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "in"))
    events.where("event_id % 10 = 0").write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string, us long"
    stream = without_replays(usage_stream(spark, str(tmp_path / "in"), schema), ["event_id"], "ts", "40 days")
    q = daily_totals(stream, "ts", "value").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = {r.date: (r.entries, round(r.total, 6)) for r in spark.table("days").collect()}
    want = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("entries"), F.round(F.sum("value"), 6).alias("total")).collect()
    assert got == {r.date: (r.entries, r.total) for r in want}


def test_open_blocks(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = usage_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string, us long")
    q = open_blocks(stream, "user_id", "us", "value").writeStream.format("memory").queryName("blocks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.block_start, r.entries) for r in spark.table("blocks").collect())
    assert got == sorted((r.user_id, r.block_start, r.entries) for r in queries.session_blocks(spark, SMALL).collect())


@pytest.mark.parametrize("hours", [5.0, 1.0, 2.5])
def test_blocks_are_the_sequential_ones(spark, hours):
    import random

    from tallyforge.operators.blocks import block_starts

    rng, hour = random.Random(int(hours * 2)), 3_600_000
    duration = int(hours * hour)
    rows, t = [], 0
    for _ in range(400):
        t += rng.choice([0, hour, duration, duration + 1, 60_000, rng.randrange(hour), rng.randrange(2 * duration)])
        t -= rng.choice([0, 0, t % hour])
        rows.append((1, max(t, rows[-1][1] if rows else 0)))
    want, start, last = [], None, None
    for _, x in rows:
        if start is None or x - start > duration or x - last > duration:
            start = x - x % hour
        last = x
        want.append((x, start))
    got = block_starts(spark.createDataFrame(rows, "g int, t long").repartition(5), "t", ["g"], duration, hour)
    assert sorted((r.t, r.block_start) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("hours", [5, 2.5, 1, 0.1])
def test_blocks_of_one_group_by_doubling(spark, sf, monkeypatch, hours):
    """All events as one group: hours in spans, jumps doubled; equal to the sequential fold."""
    from tallyforge.operators import blocks

    monkeypatch.setattr(blocks, "FOLD", 0)
    monkeypatch.setattr(blocks, "SPAN", 8)
    hour = 3_600_000_000
    duration = int(hours * hour)
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.lit(None).cast("int").alias("g"))
    start, want = None, []
    for x in sorted(r.t for r in events.collect()):
        if start is None or x - start > duration:
            start = x - x % hour
        want.append((x, start))
    got = blocks.block_starts(events, "t", ["g"], duration, hour)
    assert sorted((r.t, r.block_start) for r in got.collect()) == want


@pytest.mark.parametrize("span", [1, 10, 1000])
def test_carries_in_two_levels(spark, span):
    import random

    from tallyforge.operators.carry import carry_forward, leading_run, running_delta

    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", None]), k, rng.choice([None, None, k % 7, k]), rng.choice([None, None, None, f"m{k % 5}"])) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, total long, model string").repartition(5)
    far = F.floor(F.col("k") / span)
    one, two = (sorted(map(repr, f(df).collect())) for f in (lambda d: carry_forward(d, ["model", "total"], ["g"], ["k"]), lambda d: carry_forward(d, ["model", "total"], ["g"], ["k"], span=far)))
    assert one == two and len(one) == 300
    one, two = (sorted(map(repr, running_delta(df, ["total"], ["g"], ["k"], span=s).collect())) for s in (None, far))
    assert one == two and len(one) == 300
    runs = {r.k for r in leading_run(df, F.col("k") < 100, ["g"], ["k"], "inside").where("inside").collect()}
    assert runs == set(range(100))


def test_name_index_finds_what_a_full_search_finds():
    import random

    from tallyforge.sources import rates

    def full(model, keys):
        flat = lambda x: x.replace(".", "-").replace("@", "-")
        hold = lambda a, b: rates._within(a, b) or rates._within(b, a)
        fits = [k for k in keys if hold(model, k) or hold(flat(model), flat(k))]
        return model if model in keys else min(fits, key=lambda k: (-len(k.encode()), k), default=None)

    rng, parts = random.Random(1), ["gpt", "5", "mini", "claude", "4", "20250101", "é", "a1", "-", ".", "@", "/", "--"]
    name = lambda: "".join(rng.choice(parts) + rng.choice(["-", ".", "/", "@", "", "_"]) for _ in range(rng.randint(1, 5)))
    keys = sorted({name() for _ in range(150)})
    index = rates.NameIndex(keys)
    names = [name() for _ in range(600)]
    assert [rates.card_key(m, index) for m in names] == [full(m, keys) for m in names]
    many = rates.NameIndex([f"vendor{k % 40}/model-{k}-{k % 7}" for k in range(3000)])
    assert sum(len(many.near(f"model-{k}-x")) for k in range(10_000)) < 10_000 * 100


@pytest.mark.parametrize("span", [None, 3])
def test_as_of_merge_is_as_of(spark, span):
    import random

    from tallyforge.operators.carry import as_of, as_of_merge

    rng = random.Random(4)
    day = lambda: rng.choice([None, *(f"2024-01-{k:02d}" for k in range(1, 28))])
    facts = spark.createDataFrame([(k, "x", day()) for k in range(200)], "id int, key string, day string")
    versions = spark.createDataFrame([(d, f"v{k % 9}") for k in range(30) if (d := day())], "since string, version string")
    want = {r.id: r.version for r in as_of(facts, versions, "day", "since", "version", "none").collect()}
    coarse = None if span is None else F.floor(F.substring("_at", 9, 2).cast("int") / span)
    got = as_of_merge(facts, versions.withColumn("key", F.lit("x")), ["key"], "day", "since", "version", "none", coarse)
    assert {r.id: r.version for r in got.collect()} == want and set(got.columns) == {"id", "key", "day", "version"}
