"""Scans of line logs by byte ranges and of SQLite tables by row ids."""

import json
import random
import re
import sqlite3

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import pricing
from tallyforge.operators.dedupe import dedupe_agent
from tallyforge.plans.reports import transcript_context
from tallyforge.sources import agents, codex, logfiles, textlogs
from tallyforge.sources import sqlite as S
from tallyforge.sources.rates import Rate
from tallyforge.sources.textlogs import file_heads, last_line, listed_files, log_lines, range_lines, ranges_of


@pytest.fixture(scope="module")
def logs(tmp_path_factory):
    """Files with long and empty lines, both line breaks, characters of several bytes."""
    root, rng, texts = tmp_path_factory.mktemp("logs"), random.Random(3), {}
    for k in range(4):
        lines = [rng.choice(["", "é" * rng.randint(1, 40), "x" * rng.randint(1, 9), "日本🙂", '{"usage":{}}', "y" * 700]) for _ in range(120)]
        texts[f"p{k % 2}/f {k}+é.jsonl"] = "".join(x + rng.choice(["\n", "\r\n"]) for x in lines) + rng.choice(["", "no break at the end"])
    texts["p0/empty.jsonl"], texts["p1/breaks.jsonl"], texts["p1/other.txt"] = "", "\n\n\r\n", "not asked for\n"
    for name, text in texts.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_bytes(text.encode())
    return root, {str(root / n): t for n, t in texts.items() if n.endswith(".jsonl")}


def direct(texts, numbered):
    out = []
    for file, text in texts.items():
        at = 0
        for number, line in enumerate(text.encode().split(b"\n")):
            shown = line.removesuffix(b"\r").decode()
            out += [(file, number if numbered else at, shown)] if shown else []
            at += len(line) + 1
    return sorted(out)


@pytest.mark.parametrize("size", [1, 7, 333, 64 << 20])
@pytest.mark.parametrize("numbered", [False, True])
def test_ranges_give_the_same_lines(spark, logs, size, numbered):
    root, texts = logs
    if size == 1:  # a range for each byte, of one file
        name = min(texts, key=lambda n: len(texts[n]) or 1e9)
        texts, root = {name: texts[name]}, name
    got = log_lines(spark, str(root), "*.jsonl", numbered=numbered, size=size)
    assert sorted((r.file, r.line_no, r.value) for r in got.collect()) == direct(texts, numbered)


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "big.jsonl").write_bytes(b"".join(b'{"n":%d}\n' % k for k in range(200_000)))
    files = listed_files(spark, str(tmp_path), "*.jsonl")
    rows = range_lines(files, size=100_000).withColumn("task", F.spark_partition_id())
    got = rows.agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.sum(F.get_json_object("value", "$.n").cast("long")).alias("sum")).head()
    assert (got.n, got.sum) == (200_000, 199_999 * 100_000) and got.tasks > 1


def test_needles_and_the_condition_on_files(spark, logs):
    root, texts = logs
    want = [x for x in direct(texts, False) if '"usage"' in x[2] or ("é" in x[2] and len(x[2]) > 30)]
    got = log_lines(spark, str(root), "*.jsonl", [['"usage"', "{"], ["é" * 31]]).collect()
    assert sorted((r.file, r.line_no, r.value) for r in got) == want
    some = listed_files(spark, str(root), "*.jsonl").where(F.col("file").contains("/p1/"))
    assert {r.file for r in ranges_of(some).collect()} == {f for f, t in texts.items() if "/p1/" in f and t}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        log_lines(spark, str(root / "nowhere"), "*.jsonl")


def test_bytes_that_are_not_text(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b"ok\n\xff\xfe!\nend")
    assert [r.value for r in log_lines(spark, str(tmp_path), "*", size=4).orderBy("line_no").collect()] == ["ok", "��!", "end"]
    assert file_heads(listed_files(spark, str(tmp_path), "*"), 2).head().head == "ok"


def test_other_projects_are_not_opened(spark, tmp_path):
    from tallyforge.functions.names import claude_session
    from tallyforge.sources.agents import read_claude

    line = '{"timestamp":"2025-06-16T22:10:00.000Z","message":{"model":"m","usage":{"input_tokens":1,"output_tokens":2}}}'
    for name in ("near", "far", "nearer"):
        path = tmp_path / "projects" / name / "s" / "log.jsonl"
        path.parent.mkdir(parents=True)
        path.write_text(line)
    own = listed_files(spark, str(tmp_path), "*.jsonl").where(claude_session(F.col("file"))[0] == "near")
    assert [r.file for r in ranges_of(own).collect()] == [str(tmp_path / "projects" / "near" / "s" / "log.jsonl")]
    assert [r.project for r in read_claude(spark, str(tmp_path), project="near").collect()] == ["near"]


def test_transcripts_are_read_from_their_end(spark, tmp_path):
    usage = {"input_tokens": 5, "cache_creation_input_tokens": 6, "cache_read_input_tokens": 7}
    early = [{"type": "assistant", "message": {"usage": usage | {"input_tokens": 900}}}] * 20_000
    late = [{"type": "assistant", "message": {"usage": usage}}, {"type": "user", "text": "input_tokens"}, {"type": "assistant", "message": None}]
    path = tmp_path / "chat.jsonl"
    path.write_text("\n".join(map(json.dumps, early + late)) + "\nnot json input_tokens")
    assert transcript_context(spark, str(path), "claude-sonnet-4").head().context_tokens == 18
    files = listed_files(spark, str(path), "*")
    got = last_line(files, lambda x: b'"input_tokens": 5' in x, block=100).head()
    assert json.loads(got.value) == late[0] and got.bytes_read < 500 < path.stat().st_size // 1000
    assert last_line(files, lambda x: x.startswith(b'{"type": "assistant", "message": {"usage": {"input_tokens": 900'), block=64).head().bytes_read < 1500
    assert last_line(files, lambda x: b"absent" in x).collect() == []


@pytest.fixture(scope="module")
def databases(tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("dbs"), random.Random(8)
    rows = []
    for k in range(3):
        (root / f"d{k}").mkdir()
        with sqlite3.connect(root / f"d{k}" / "a.db") as db:
            db.execute("CREATE TABLE t (id, role text, n, x)")
            for r in range(300 if k else 0):
                row = (rng.choice(["a", "b", 5, 5.0, None, b"z"]), rng.choice(["user", "assistant"]), rng.choice([1, 2, 3.7, "4", "x", None, 2**70 * 1.0]), rng.random())
                db.execute("INSERT INTO t VALUES (?,?,?,?)", row)
            db.execute("DELETE FROM t WHERE rowid % 7 = 3")
            rows += [(str(root / f"d{k}" / "a.db"), *r) for r in db.execute("SELECT rowid, id, role, n, x FROM t")]
        db.close()
    (root / "d0" / "empty.db").write_bytes(b"")
    with sqlite3.connect(root / "d0" / "other.db") as db:
        db.execute("CREATE TABLE u (id)")
    db.close()
    return root, [(f, r, *(S._fit(v, k) for v, k in zip(x, ("string", "string", "long", "double")))) for f, r, *x in rows]


COLUMNS = {"name": "string", "role": "string", "n": "long", "x": "double"}


@pytest.mark.parametrize("rows", [10, 100_000])
def test_row_ranges_give_the_same_rows(spark, databases, rows):
    root, want = databases
    got = S.sqlite_rows(spark, str(root), "t", COLUMNS, places={"name": "id"}, rows=rows)
    assert got.rdd.getNumPartitions() == (60 if rows == 10 else 2)
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert S.sqlite_rows(spark, str(root), "t", {"n": "long"}, where=[("role = ? AND x < ?", ["user", 0.5])]).count() == sum(r[3] == "user" and r[5] < 0.5 for r in want)


def test_filters_of_spark_reach_sqlite(spark, databases):
    root, want = databases
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = S.sqlite_rows(spark, str(root), "t", COLUMNS, places={"name": "id"})
        for test, of in [
            ("name = '5'", lambda r: r[2] == "5"),
            ("name in ('a', '5.0')", lambda r: r[2] in ("a", "5.0")),
            ("n >= 3 and x < 0.25", lambda r: r[4] is not None and r[4] >= 3 and r[5] < 0.25),
            ("n is not null and role = 'user'", lambda r: r[4] is not None and r[3] == "user"),
            ("n is null", lambda r: r[4] is None),
        ]:
            assert sorted(r.line_no for r in rows.where(test).collect()) == sorted(r[1] for r in want if of(r)), test
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_pushed_filter_is_sql(databases):
    from pyspark.sql.datasource import EqualTo, In
    from pyspark.sql.types import StructType

    schema = StructType().add("file", "string").add("line_no", "long").add("name", "string").add("n", "long")
    reader = S.FilteringReader(schema, {"path": f"file:{databases[0]}", "table": "t", "columns": '{"name": "id"}', "rows": "50"})
    given = [EqualTo(("n",), 2), In(("name",), ("a",)), EqualTo(("unknown",), 1)]
    assert list(reader.pushFilters(given)) == given
    text, values = reader.sql(reader.partitions()[0])
    assert "rowid BETWEEN ? AND ?" in text and 'CAST("n" AS INTEGER) = ?' in text and "id IN (?)" in text and "role" not in text
    assert values == [1, 50, 2, "a"]


def test_missing_and_damaged_databases_raise(spark, tmp_path):
    with pytest.raises(Exception, match="no file or folder"):
        S.sqlite_rows(spark, str(tmp_path / "nowhere"), "t", COLUMNS).collect()
    (tmp_path / "bad.db").write_bytes(b"damaged header" * 100)
    with pytest.raises(Exception, match="not a database"):
        S.sqlite_rows(spark, str(tmp_path), "t", {"n": "long"}).collect()


def test_what_is_known_of_a_file_travels_with_its_lines(spark, logs):
    root, texts = logs
    files = listed_files(spark, str(root), "*.jsonl").withColumns({"tag": F.length("file"), "odd": F.col("file").contains("p1")})
    got = range_lines(files, also=["tag", "odd"]).select("file", "line_no", "value", "tag", "odd").collect()
    assert sorted((r.file, r.line_no, r.value) for r in got) == direct(texts, False)
    assert all(r.tag == len(r.file) and r.odd == ("/p1/" in r.file) for r in got)


def plans_of(monkeypatch, module, read):
    """The plans of what a reader writes, and of its result."""
    plans, keep = [], module.written
    monkeypatch.setattr(module, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    plans.append(read()._jdf.queryExecution().optimizedPlan().toString())
    return plans


def test_lines_of_codex_are_not_joined(spark, tmp_path, monkeypatch):
    (tmp_path / "sessions").mkdir()
    (tmp_path / "sessions" / "s.jsonl").write_text('{"type":"turn_context","payload":{"model":"m"}}\n')
    first = plans_of(monkeypatch, codex, lambda: codex.read_codex(spark, str(tmp_path)))[0]
    reading = first.index("MapInArrow")  # the tree's upper part comes first
    assert "value#" in first[reading : first.index("\n", reading)] and "Join" not in first[:reading]


def test_joins_of_copilot_are_no_broadcasts(spark, tmp_path, monkeypatch):
    (tmp_path / "a.jsonl").write_text('{"type":"span","name":"chat x","traceId":"t","attributes":{"gen_ai.usage.input_tokens":3,"gen_ai.response.id":"r"}}\n')
    plans = plans_of(monkeypatch, agents, lambda: agents.read_copilot(spark, str(tmp_path)))
    joins = [line for plan in plans for line in plan.splitlines() if "Join LeftOuter" in line]
    assert len(joins) >= 3 and all("strategy=merge" in line for line in joins)
    assert max(len(plan) for plan in plans) < 60_000  # picks aren't nested in picks


def test_files_are_written_in_order_by_streams(spark, tmp_path):
    rows = spark.range(30_000).select(F.concat(F.lit("d/f"), F.col("id") % 3).alias("file"), (-F.col("id")).alias("n"), F.col("id").cast("string").alias("line"))
    logfiles.write_logs(rows, str(tmp_path / "logs"))
    for k in range(3):
        assert (tmp_path / "logs" / "d" / f"f{k}").read_text().split() == [str(x) for x in reversed(range(k, 30_000, 3))]
    batches = [pa.RecordBatch.from_pydict({"file": ["a"] * 5 + ["b"] * 5, "line": ["x"] * 10})] * 2
    assert list(logfiles._runs(batches, "line")) == [("a", ["x"] * 5), ("b", ["x"] * 5)] * 2


def test_many_small_databases_are_packed_unopened(spark, tmp_path, monkeypatch):
    rows = spark.range(6000).select(F.concat(F.lit("d"), F.col("id") % 60, F.lit("/a.db")).alias("file"), F.col("id").alias("n"), F.array(F.col("id").cast("string")).alias("cells"))
    logfiles.write_databases(rows, str(tmp_path / "dbs"), "t", "n int")
    got = S.sqlite_rows(spark, str(tmp_path / "dbs"), "t", {"n": "long"})
    assert got.rdd.getNumPartitions() <= 8  # by bytes; there are 60 files and 4 cores
    found = got.collect()
    assert sorted(r.n for r in found) == list(range(6000)) and all(r.file.endswith(f"/d{r.n % 60}/a.db") and r.line_no == r.n // 60 + 1 for r in found)
    reader = S.SqliteReader(got.schema, {"path": f"file:{tmp_path}/dbs", "table": "t", "tasks": "4"})
    monkeypatch.setattr(reader, "_bounds", None)  # planning opens none
    assert sum(len(p.parts) for p in reader.partitions()) == 60


def test_deduplication_reads_its_input_once(spark):
    rows = spark.range(9).select(
        F.when(F.col("id") < 4, "m").when(F.col("id") < 6, "k").alias("message_id"), F.lit(None).cast("string").alias("request_id"), (F.col("id") % 2 == 1).alias("is_sidechain"), F.lit(None).cast("string").alias("speed"),
        F.lit("f").alias("file"), F.lit(0).alias("line_no"), F.lit(0).alias("item_no"), *(F.col("id").alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "extra_tokens")),
    )
    for agent, kept in (("claude", [2, 4, 6, 7, 8]), ("opencode", None)):
        out = dedupe_agent(rows, agent)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
        ids = sorted(r.input_tokens for r in out.collect())
        assert ids == kept if kept else len(ids) == 5 and ids[2:] == [6, 7, 8]


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    for k in range(80):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / "a.json").write_text(str(k))
    before = spark.conf.get(textlogs.LISTING)
    spark.sparkContext.setJobGroup("listing of folders", "")
    try:
        found = textlogs.whole_files(spark, str(tmp_path), "*.json")
        status = spark.sparkContext.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing of folders") for s in status.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and max(s.numTasks for s in stages) <= 16 and spark.conf.get(textlogs.LISTING) == before
    assert sorted(int(r.value) for r in found.select("value").collect()) == list(range(80))


def method_sizes(spark, df):
    """Bytes of the largest compiled method of each stage. The JIT leaves methods beyond 8,000 uncompiled."""
    text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


@pytest.mark.parametrize("agent", ["gemini", "pi", "amp"])
def test_readers_keep_to_methods_that_are_compiled(spark, tmp_path, monkeypatch, agent):
    (tmp_path / "a.json").write_text('{"id":"t","messages":[]}')
    (tmp_path / "a.jsonl").write_text('{"type":"gemini","message":{"usage":{}}}\n')
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else stages are compiled one by one
    try:
        monkeypatch.setattr(agents, "written", lambda df: df)
        sizes = method_sizes(spark, agents.READERS[agent](spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("agent", ["gemini", "amp"])
def test_documents_are_read_once(spark, tmp_path, agent):
    (tmp_path / "a.json").write_text('{"id":"t","messages":[]}')
    plan = agents.READERS[agent](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_an_amp_event_takes_the_last_message_of_its_id(spark, tmp_path):
    used = lambda n: {"cacheCreationInputTokens": n, "cacheReadInputTokens": n + 1}
    said = [{"role": "assistant", "messageId": 5, "usage": used(7)}, {"role": "user", "messageId": 6, "usage": used(90)}, {"role": "assistant", "messageId": 5, "usage": used(3)}, {"role": "assistant", "messageId": "x", "usage": used(1)}]
    event = lambda to, **more: {"timestamp": "2026-01-01T00:00:00Z", "model": "m", "toMessageId": to, "tokens": {"input": 10, "output": 20}} | more
    (tmp_path / "a.json").write_text(json.dumps({"id": "t", "messages": said, "usageLedger": {"events": [event(5), event(5, tokens=1), event(6), event(None), None, 4]}}))
    got = sorted(agents.read_amp(spark, str(tmp_path)).collect(), key=lambda r: r.item_no)
    assert [(r.item_no, r.input_tokens, r.cache_creation_tokens, r.cache_read_tokens) for r in got] == [(0, 10, 3, 4), (1, 0, 3, 4), (2, 10, 0, 0), (3, 10, 0, 0)]


def test_facts_are_not_dealt_by_their_candidates(spark, monkeypatch):
    rows = agents.usage(spark.range(40).select(F.concat(F.lit("m"), F.col("id") % 3).alias("model"), F.lit(1).alias("input_tokens"), F.lit(0).alias("output_tokens")), "x")
    facts = textlogs.written(rows)
    cards = [{"m1": Rate("m1", input=2.0)}]
    found = lambda: sorted((r.model, r.cost, r.missing_pricing) for r in pricing.price(facts, cards).collect())
    few = found()
    assert {m: c for m, c, _ in few} == {"m0": 0.0, "m1": 2.0, "m2": 0.0} and len(few) == 40 and {m for _, _, m in few} == {None, "m0", "m2"}
    joins = [line for line in pricing.price(facts, cards)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert "strategy=broadcast" in joins[0]
    monkeypatch.setattr(pricing, "LISTS", 2)  # too many to broadcast: dealt, with the same results
    assert found() == few
