"""Readers, deduplication, pricing and reports over small hand-made logs."""

import json
import sqlite3
from pathlib import Path

import pytest

from tallyforge.plans import render, statusline
from tallyforge.plans.config import settings
from tallyforge.plans.reports import (
    Options,
    activity_blocks,
    agent_sessions,
    codex_report,
    daily,
    load_usage,
    missing_models,
    monthly,
    options_of,
    recent_blocks,
    session_detail,
    session_totals,
    sessions,
    statusline_costs,
    totals,
    transcript_context,
    unified,
    weekly,
)
from tallyforge.sources.agents import READERS
from tallyforge.sources.codex import wants_fast_tier


def put(root: Path, name: str, rows) -> Path:
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    text = rows if isinstance(rows, str) else "\n".join(r if isinstance(r, str) else json.dumps(r, separators=(",", ":")) for r in rows)
    path.write_text(text)
    return path


def claude(ts, model, i, o, cw=0, cr=0, cost=None, mid=None, rid=None, session="s", **more):
    row = {"timestamp": ts, "sessionId": session, "message": {"model": model, "usage": {"input_tokens": i, "output_tokens": o, "cache_creation_input_tokens": cw, "cache_read_input_tokens": cr}}}
    row |= {} if cost is None else {"costUSD": cost}
    if mid:
        row["message"]["id"] = mid
    if rid:
        row["requestId"] = rid
    if "speed" in more:
        row["message"]["usage"]["speed"] = more.pop("speed")
    return row | more


FAST, SLOW, TINY = "claude-opus-4-6", "claude-sonnet-4", "claude-3-haiku"


@pytest.fixture(scope="module")
def claude_logs(tmp_path_factory):
    """Three sessions of June 2025; one runs over midnight before the 17th (a Tuesday)."""
    root = tmp_path_factory.mktemp("claude")
    put(
        root,
        "projects/harbor/night/turns.jsonl",
        [
            claude("2025-06-16T22:10:00.000Z", SLOW, 7, 3, 2, 1, 0.5, "a", "q1", version="2.0.1"),
            claude("2025-06-16T22:10:09.000Z", SLOW, 6, 3, 2, 1, 8.0, "a", "q7", isSidechain=True),
            claude("2025-06-17T00:30:00.000Z", FAST, 11, 5, 0, 4, 0.25, "b", "q2", speed="fast", version="2.0.3"),
            claude("2025-06-17T00:30:00.000Z", FAST, 11, 5, 0, 4, 0.25, "b", "q2", speed="fast", version="2.0.3"),
        ],
    )
    put(root, "projects/harbor/noon/turns.jsonl", [claude("2025-06-17T12:45:00.000Z", SLOW, 13, 6, 1, 0, 0.125, "c", "q3", session="raw-noon")])
    ts = "2025-06-20T05:00:00.000Z"
    bad = [
        '{"timestamp":"2025-06-20T05:00:00.000Z","message": {"usage": {"input_tokens":1,"output_tokens":1}}}',
        '{"timestamp":"2025-06-20T05:00:00.000Z","requestId":null,"message":{"usage":{"input_tokens":1,"output_tokens":1}}}',
        "not json \"usage\":{",
        *(claude(*x, **y) for x, y in [((ts, "", 1, 1), {}), ((ts, "m", -3, 1), {}), ((ts, "m", "7", 1), {}), (("2025-06-20 05:00", "m", 1, 1), {}), ((ts, "m", 1, 1), {"version": "abc"}), ((ts, "m", 1, 1), {"speed": "slow"})]),
    ]
    put(root, "projects/quay/dawn/turns.jsonl", [claude("2025-06-20T05:20:00.000Z", TINY, 17, 8, 0, 0, 1.0), claude("2025-06-20T08:20:00.000Z", TINY, 19, 9, 0, 10, 2.0), *bad])
    return str(root)


#: 20 June 2025, 09:00 UTC.
DISPLAY = Options(mode="display", now_ms=1_750_410_000_000)


def test_claude_daily(spark, claude_logs):
    rows = load_usage(spark, "claude", claude_logs, DISPLAY)
    got = [(r.date, r.input_tokens, r.output_tokens, r.cache_creation_tokens, r.cache_read_tokens, r.total_tokens, r.cost, r.models_used) for r in daily(rows).collect()]
    assert got == [
        ("2025-06-16", 7, 3, 2, 1, 13, 0.5, [SLOW]),
        ("2025-06-17", 24, 11, 1, 4, 40, 0.375, [FAST + "-fast", SLOW]),
        ("2025-06-20", 36, 17, 0, 10, 63, 3.0, [TINY]),
    ]
    assert [(r.week, r.cost) for r in weekly(rows).collect()] == [("2025-06-15", 3.875)]
    assert [r.week for r in weekly(rows, Options(week_starts="tuesday")).collect()] == ["2025-06-10", "2025-06-17"]
    assert [(r.month, r.cost) for r in monthly(rows, Options(order="desc")).collect()] == [("2025-06", 3.875)]
    assert [(r.date, r.project, r.project_label) for r in daily(rows, by_project=True, aliases={"quay": "Quay side"}).collect()][-1] == ("2025-06-20", "quay", "Quay side")
    assert totals(daily(rows)).head().cost == 3.875
    assert [r.date for r in daily(rows, Options(since="2025-06-17", until="20250617")).collect()] == ["2025-06-17"]
    assert load_usage(spark, "claude", claude_logs, Options(project="quay")).count() == 2


def test_claude_sessions(spark, claude_logs):
    rows = load_usage(spark, "claude", claude_logs, DISPLAY)
    got = sessions(rows).collect()
    assert [(r.session_id, r.project_path, r.versions) for r in got] == [("dawn", "quay", []), ("night", "harbor", ["2.0.1", "2.0.3"]), ("noon", "harbor", [])]
    assert got[1].first_activity == "2025-06-16T22:10:00.000Z" and got[1].last_activity == "2025-06-17T00:30:00.000Z"
    assert session_detail(rows, "dawn").count() == 2
    assert [tuple(session_totals(rows, x).head()) for x in ("raw-noon", "noon", "none")] == [(1, 20, 0.125), (1, 20, 0.125), (0, 0, 0.0)]
    assert tuple(statusline_costs(rows, "night", "2025-06-20").head()) == (0.75, 3.0)


def test_bounds_keep_what_straddles_them_whole(spark, claude_logs):
    since = Options(mode="display", now_ms=DISPLAY.now_ms, since="20250617", until="20250617")
    rows = load_usage(spark, "claude", claude_logs, since)
    assert {r.session_id: r.input_tokens for r in sessions(rows, since).collect()} == {"night": 18, "noon": 13}
    assert {r.period: r.input_tokens for r in unified(spark, {"claude": claude_logs}, "session", since).collect()} == {"night": 18, "noon": 13}
    assert [(b.id, b.entries) for b in activity_blocks(rows, since).where("not is_gap").collect()] == [("2025-06-17T12:00:00.000Z", 1)]
    early = Options(mode="display", now_ms=DISPLAY.now_ms, until="20250616")
    assert [(b.id, b.entries, b.input_tokens) for b in activity_blocks(rows, early).where("not is_gap").collect()] == [("2025-06-16T22:00:00.000Z", 2, 18)]


def test_claude_costs(spark, claude_logs):
    computed = {(r.date, r.model): r.cost for r in load_usage(spark, "claude", claude_logs, Options(mode="calculate")).collect()}
    assert computed["2025-06-16", SLOW] == pytest.approx(7 * 3e-6 + 3 * 15e-6 + 2 * 3.75e-6 + 1 * 0.3e-6)
    assert computed["2025-06-17", FAST + "-fast"] == pytest.approx(6 * (11 * 5e-6 + 5 * 25e-6 + 4 * 0.5e-6))
    assert missing_models(load_usage(spark, "claude", claude_logs, Options(mode="calculate"))).count() == 0


def test_claude_blocks(spark, claude_logs):
    blocks = activity_blocks(load_usage(spark, "claude", claude_logs, DISPLAY), DISPLAY).collect()
    assert [(b.id, b.is_gap, b.entries) for b in blocks] == [
        ("2025-06-16T22:00:00.000Z", False, 2),
        ("gap-2025-06-17T05:30:00.000Z", True, None),
        ("2025-06-17T12:00:00.000Z", False, 1),
        ("gap-2025-06-17T17:45:00.000Z", True, None),
        ("2025-06-20T05:00:00.000Z", False, 2),
    ]
    last = blocks[-1]
    assert last.is_active and last.remaining_minutes == 60 and last.tokens_per_minute == pytest.approx(63 / 180)
    assert last.projected_tokens == 84 and last.token_limit == 33 and last.limit_status == "exceeds"
    assert blocks[2].tokens_per_minute is None
    rows = activity_blocks(load_usage(spark, "claude", claude_logs, DISPLAY), DISPLAY)
    assert recent_blocks(rows, DISPLAY).count() == 3 and recent_blocks(rows, DISPLAY, active_only=True).count() == 1
    line = render.statusline("Haiku", 1.5, 0.07, last, DISPLAY.now_ms, (50_000, 200_000))
    assert line == "Haiku | $1.50 session / $0.07 today / $3.00 block (1h 0m left) | $1.00/hr (Normal) | 50,000 (25%)"


def test_transcript_context(spark, tmp_path):
    said = lambda kind, **u: {"type": kind, "message": {"usage": u}}
    path = put(tmp_path, "t.jsonl", [said("assistant", input_tokens=5), said("assistant", input_tokens=40, cache_creation_input_tokens=2, cache_read_input_tokens=3), said("user", input_tokens=9), {"type": "assistant"}])
    assert tuple(transcript_context(spark, str(path), "claude-opus-4-6-20260101").head()) == (45, 1_000_000)
    assert tuple(transcript_context(spark, str(path), "nobody").head()) == (45, None)


def test_status_of_hooks(spark, claude_logs, tmp_path):
    said = lambda n: {"type": "assistant", "message": {"usage": {"input_tokens": n, "cache_read_input_tokens": 10_000}}}
    for name, tokens in (("a", 50_000), ("b", 890_000), ("unasked", 1)):
        put(tmp_path, f"{name}.jsonl", [said(3), said(tokens), {"type": "user"}])
    at = lambda name, kind, **more: {"transcript_path": str(tmp_path / f"{name}.jsonl"), "model": {"id": kind, "display_name": f"Model {name}"}, **more}
    hooks = [
        {"session_id": "dawn", **at("a", "nobody")},
        {"session_id": "raw-noon", **at("b", "claude-opus-4-6-20260101"), "cost": {"total_cost_usd": 1.5}},
        {"session_id": "night", **at("unasked", None), "context_window": {"total_input_tokens": 1234, "context_window_size": 0}, "more": 1},
        {"session_id": "none", **at("absent", None)},
        {"session_id": "none", **at("absent", None)},
    ]
    frame = lambda xs: spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in xs], "json string")
    rows = load_usage(spark, "claude", claude_logs, DISPLAY)
    got = statusline.status(frame(hooks), rows, DISPLAY, str(tmp_path), aliases={"Model b": "B"})
    lines = {r.session_id: r for r in got.select("*", statusline.line(burn="emoji-text").alias("line"), statusline.session_cost("both").alias("both")).collect()}
    assert got.count() == 5
    block = "$3.00 today / $3.00 block (1h 0m left) | 🔥 $1.00/hr 🟢 (Normal) | 🧠 "
    assert lines["dawn"].line == f"🤖 Model a | 💰 $3.00 session / {block}60,000 (30%)"
    assert lines["raw-noon"].line == f"🤖 B | 💰 $1.50 session / {block}900,000 (90%)" and lines["raw-noon"].context_color == "red"
    assert lines["raw-noon"].both == "($1.50 hook / $0.13 logs)" and lines["dawn"].both == "(N/A hook / $3.00 logs)"
    assert lines["night"].line.endswith("🧠 1,234 (0%)") and lines["none"].line == f"🤖 Model absent | 💰 $0.00 session / {block}N/A"
    later = Options(mode="display", now_ms=DISPLAY.now_ms + 90 * 86_400_000)
    idle = statusline.status(frame(hooks[:1]), rows, later).select(statusline.line()).head()[0]
    assert idle == "🤖 Model a | 💰 $3.00 session / $0.00 today / No active block | 🧠 N/A"
    assert statusline.status(frame([]), rows, DISPLAY, str(tmp_path)).count() == 0
    for bad in ("", "no json", '{"session_id": "x"}'):
        with pytest.raises(Exception, match="a hook needs"):
            statusline.status(frame([bad]), rows, DISPLAY).collect()
    with pytest.raises(ValueError, match="cost source"):
        statusline.line("other")


def test_render(spark, claude_logs):
    report = daily(load_usage(spark, "claude", claude_logs, DISPLAY))
    out = json.loads(render.report_json(report, totals(report), "daily"))
    assert out["daily"][1]["modelsUsed"] == [FAST + "-fast", SLOW]
    assert out["daily"][1]["modelBreakdowns"][0]["modelName"] == FAST + "-fast" and out["totals"]["totalTokens"] == 116
    assert "totalCost" not in render.report_json(report, totals(report), "daily", costs=False)
    text = render.table(report, {"date": "Date", "models_used": "Models", "input_tokens": "Input", "cache_read_tokens": "Cache", "cost": "Cost"})
    assert "$3.88" in text and f"- {FAST}-fast" in text
    assert "Cache" not in render.table(report, {"date": "Date", "cache_read_tokens": "Cache"}, width=80)


def codex_event(ts, last=None, total=None, model=None):
    use = lambda x: dict(zip(("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"), x))
    info = ({"last_token_usage": use(last)} if last else {}) | ({"total_token_usage": use(total)} if total else {}) | ({"model": model} if model else {})
    return {"timestamp": ts, "type": "event_msg", "payload": {"type": "token_count", "info": info}}


def test_codex(spark, tmp_path):
    put(
        tmp_path,
        "sessions/p/s1.jsonl",
        [
            {"timestamp": "2026-05-13T08:00:00Z", "type": "turn_context", "payload": {"model": "gpt-5.2-codex"}},
            codex_event("2026-05-13T08:00:01.000Z", last=(1000, 250, 125, 75, 1200), total=(1000, 250, 125, 75, 1200)),
            codex_event("2026-05-14T08:00:01.000Z", total=(3500, 750, 425, 275, 4200), model="gpt-5.3-codex"),
        ],
    )
    put(tmp_path, "archived_sessions/p/s1.jsonl", [codex_event("2026-05-13T08:00:01.000Z", last=(9, 9, 9, 9, 9))])
    got = codex_report(spark, str(tmp_path), "daily").collect()
    assert [(r.period, r.input_tokens, r.cache_read_tokens, r.output_tokens, r.reasoning_tokens, r.total_tokens) for r in got] == [
        ("2026-05-13", 750, 250, 125, 75, 1200),
        ("2026-05-14", 2000, 500, 300, 200, 3000),
    ]
    assert [r.cost for r in got] == [pytest.approx(0.00310625), pytest.approx(0.0077875)]
    assert [r.models[0].model for r in got] == ["gpt-5.2-codex", "gpt-5.3-codex"]


def test_codex_replays_and_fallbacks(spark, tmp_path):
    put(
        tmp_path,
        "sessions/child.jsonl",
        [
            '{"type":"session_meta","payload":{"source":{"thread_spawn":{}}}}',
            codex_event("2026-01-01T00:00:00.100Z", total=(100, 0, 10, 0, 110)),
            codex_event("2026-01-01T00:00:00.200Z", total=(200, 0, 20, 0, 220)),
            codex_event("2026-01-01T00:00:07.000Z", total=(260, 0, 25, 0, 285)),
        ],
    )
    put(tmp_path, "sessions/exec.jsonl", [{"timestamp": "2026-02-10T00:00:00Z", "model": "codex-auto-review", "usage": {"prompt_tokens": 5, "completion_tokens": 2}}, {"created_at": 1_770_700_000, "data": {"usage": {"input": 3, "output": 1}}}])
    got = {r.period: r for r in codex_report(spark, str(tmp_path), "session").collect()}
    assert (got["child"].input_tokens, got["child"].output_tokens, got["child"].models[0].model, got["child"].models[0].is_fallback) == (60, 5, "gpt-5", True)
    assert got["exec"].models[0].model == "gpt-5.3-codex" and got["exec"].total_tokens == 11 and got["exec"].models[0].is_fallback
    assert wants_fast_tier('a=1\nservice_tier = "priority" # x') and not wants_fast_tier('# service_tier = "fast"')


def rows_of(spark, agent, root, **options):
    return load_usage(spark, agent, str(root), Options(**options)).orderBy("ts_ms", "line_no", "item_no").collect()


def sums(r):
    return (r.input_tokens, r.output_tokens, r.cache_creation_tokens, r.cache_read_tokens, r.extra_tokens)


def test_json_line_agents(spark, tmp_path):
    pi = {"type": "message", "timestamp": "2026-01-02T03:04:05Z", "message": {"role": "assistant", "model": "gpt-5", "usage": {"input": 10, "output": 0, "cacheRead": 1, "cacheWrite": 2, "totalTokens": 20, "cost": {"total": 0.5}}}}
    put(tmp_path / "pi", "sessions/proj/2026_abc.jsonl", [pi, pi, {"type": "other", "message": {"usage": {}}}])
    got = rows_of(spark, "pi", tmp_path / "pi")
    assert len(got) == 1 and sums(got[0]) == (10, 7, 2, 1, 0) and got[0].session_id == "abc" and got[0].project == "proj" and got[0].model == "[pi] gpt-5" and got[0].cost == 0.5
    qwen = {"type": "assistant", "timestamp": "2026-01-02T03:04:05Z", "sessionId": "q", "model": "qwen3", "usageMetadata": {"promptTokenCount": 4, "candidatesTokenCount": 3, "thoughtsTokenCount": 2, "totalTokenCount": 9}}
    put(tmp_path / "qwen", "projects/p1/chats/c.jsonl", [qwen, qwen, "broken", {"type": "user"}])
    got = rows_of(spark, "qwen", tmp_path / "qwen")
    assert [sums(r) for r in got] == [(4, 3, 0, 0, 2)] and got[0].project_path == "p1" and got[0].missing_pricing == "qwen3"
    status = {"timestamp": 1_776_698_890.0, "message": {"type": "StatusUpdate", "payload": {"message_id": "m", "token_usage": {"input_other": 100, "output": 10, "input_cache_read": 5}}}}
    later = json.loads(json.dumps(status))
    later["timestamp"], later["message"]["payload"]["message_id"] = 1_776_698_891.0, "n"
    put(tmp_path / "kimi", "sessions/g/s/wire.jsonl", [status, status, later])
    got = rows_of(spark, "kimi", tmp_path / "kimi")
    assert [r.cost for r in got] == [pytest.approx(100 * 0.6e-6 + 10 * 3e-6 + 5 * 0.1e-6), pytest.approx(100 * 0.95e-6 + 10 * 4e-6 + 5 * 0.16e-6)]
    put(tmp_path / "kimi", "config.json", json.dumps({"model": "other"}))
    assert {r.model for r in rows_of(spark, "kimi", tmp_path / "kimi")} == {"other"}
    message = lambda **m: {"type": "message", "timestamp": 1_770_000_000_000, "message": {"role": "assistant", "usage": {"input": 1, "output": 1, "totalTokens": 5}} | m}
    put(tmp_path / "claw", "a/s1.jsonl.reset.1", [message(), {"type": "model_change", "modelId": "m1", "provider": "p"}, message(timestamp=1_770_000_000_001), {"type": "custom", "customType": "model-snapshot", "data": {"model": "m2"}}, message(timestamp=1_770_000_000_002), message(timestamp=1_770_000_000_003, model="own")])
    got = rows_of(spark, "openclaw", tmp_path / "claw")
    assert [(r.model, r.version, r.session_id) for r in got] == [("[openclaw] unknown", None, "s1"), ("[openclaw] m1", "p", "s1"), ("[openclaw] m2", "p", "s1"), ("[openclaw] own", "p", "s1")]
    assert sums(got[0]) == (1, 1, 0, 0, 3)


def test_copilot(spark, tmp_path):
    def record(trace, kind, n, response=None, **more):
        attrs = {"gen_ai.usage.input_tokens": n, "gen_ai.usage.output_tokens": 1, "gen_ai.usage.cache_read.input_tokens": "3"}
        attrs |= {"gen_ai.response.id": response} if response else {}
        base = {"chat": {"type": "span", "name": "chat x"}, "inference": {"body": "GenAI inference: y"}, "turn": {"body": "copilot_chat.agent.turn 1"}, "agent": {"type": "span", "name": "invoke_agent z"}}[kind]
        return base | {"traceId": trace, "endTime": [1_770_000_000 + n, 5_000_000], "attributes": attrs | more.get("attrs", {})}

    put(
        tmp_path,
        "otel.jsonl",
        [
            record("t1", "agent", 50, attrs={"session.id": "sess", "gen_ai.request.model": "gpt-5"}),
            record("t1", "chat", 10),
            record("t2", "inference", 11, response="r2"),
            record("t3", "turn", 12, response="r2"),
            record("t4", "agent", 13),
            {"attributes": {"x": 1}},
        ],
    )
    got = rows_of(spark, "copilot", tmp_path)
    assert [(r.input_tokens, r.cache_read_tokens, r.session_id, r.model) for r in got] == [(7, 3, "sess", "gpt-5"), (8, 3, "r2", "unknown"), (10, 3, "t4", "unknown")]
    assert got[0].ts_ms == 1_770_000_010_005


def test_json_document_agents(spark, tmp_path):
    usage = {"cacheCreationInputTokens": 7, "cacheReadInputTokens": 8}
    thread = {"id": "th", "messages": [{"role": "assistant", "messageId": 5, "usage": usage}], "usageLedger": {"events": [{"id": "e", "timestamp": "2026-01-01T00:00:00Z", "model": "claude-opus-4-5", "credits": 2.5, "toMessageId": 5, "tokens": {"input": 10, "output": 20}}, {"timestamp": "bad", "model": "x", "tokens": {}}]}}
    put(tmp_path / "amp", "threads/a.json", json.dumps(thread))
    put(tmp_path / "amp", "threads/b.json", json.dumps({"id": "tb", "messages": [{"role": "assistant", "messageId": "x", "timestamp": "2026-01-02T00:00:00Z", "model": "gpt-5", "usage": {"inputTokens": 1, "outputTokens": 2, "totalTokens": 9}}]}))
    got = rows_of(spark, "amp", tmp_path / "amp")
    assert [sums(r) for r in got] == [(10, 20, 7, 8, 0), (1, 2, 0, 0, 6)] and got[0].credits == 2.5
    assert got[0].cost == pytest.approx(10 * 5e-6 + 20 * 25e-6 + 7 * 6.25e-6 + 8 * 0.5e-6) and got[1].cost == pytest.approx(1 * 1.25e-6 + 8 * 10e-6)
    put(tmp_path / "droid", "x/s1.settings.json", json.dumps({"tokenUsage": {"inputTokens": 5, "outputTokens": 5, "thinkingTokens": 2}, "providerLock": "Claude", "providerLockTimestamp": "2026-01-01T00:00:00Z"}))
    put(tmp_path / "droid", "x/s1.jsonl", 'a\n{"text":"Model: Claude Opus 4.5 [Anthropic]"}')
    put(tmp_path / "droid", "x/s2.settings.json", json.dumps({"tokenUsage": {"totalTokens": 5}, "model": "custom:GPT-5 [x]", "providerLockTimestamp": "2026-01-02T00:00:00Z"}))
    got = rows_of(spark, "droid", tmp_path / "droid")
    assert [(r.model, r.version, r.session_id, sums(r)) for r in got] == [("claude-opus-4-5", "anthropic", "s1", (5, 5, 0, 0, 2)), ("gpt-5", "openai", "s2", (0, 5, 0, 0, 0))]
    assert got[0].cost == pytest.approx(5 * 5e-6 + 7 * 25e-6)
    chat = [
        {"variant": "ai", "id": "1", "credits": 3, "timestamp": 1_770_000_000, "metadata": {"model": "gpt-5", "usage": {"prompt_tokens": 10, "promptTokensDetails": {"cachedTokens": 4}}, "codebuff": {"usage": {"outputTokens": 6, "inputTokens": 99}}}},
        {"variant": "ai", "id": "1", "timestamp": 1_770_000_001, "metadata": {"runState": {"sessionState": {"mainAgentState": {"messageHistory": [{"role": "assistant", "providerOptions": {"usage": {"inputTokens": 1, "outputTokens": 1}}}, {"role": "assistant", "providerOptions": {"codebuff": {"model": "claude-opus-4-5", "usage": {"inputTokens": 2}}}}, {"role": "user"}]}}}}},
        {"variant": "user", "credits": 5},
    ]
    put(tmp_path / "cb", "manicode-dev/projects/pp/chats/2026-01-02T10-11-12.000Z/chat-messages.json", json.dumps(chat))
    put(tmp_path / "cb", "manicode/projects/pp/chats/2026-01-02T10-11-12.000Z/chat-messages.json", json.dumps([{"role": "agent", "metadata": {"usage": {"total": 7}}}]))
    raw = READERS["codebuff"](spark, str(tmp_path / "cb")).orderBy("ts_ms").collect()
    assert [sums(r) for r in raw] == [(0, 7, 0, 0, 0), (10, 6, 0, 4, 0), (2, 1, 0, 0, 0)] and raw[1].credits == 3 and raw[2].model == "claude-opus-4-5"
    assert raw[0].session_id == "manicode/pp/2026-01-02T10-11-12.000Z" and raw[0].ts_ms == 1_767_348_672_000 and raw[0].model == "codebuff-unknown"
    assert len(rows_of(spark, "codebuff", tmp_path / "cb")) == 2
    put(tmp_path / "gem", "a/s.json", json.dumps({"sessionId": "g1", "startTime": "2026-01-01T00:00:00Z", "messages": [{"type": "gemini", "id": "m", "model": "gemini-x", "tokens": {"input": 10, "output": 5, "cached": 4, "thoughts": 1, "tool": 2, "total": 18}}, {"type": "user"}]}))
    put(tmp_path / "gem", "a/stats.json", json.dumps({"timestamp": "2026-01-02T00:00:00Z", "stats": {"models": {"gpt-5": {"tokens": {"prompt": 10.7, "candidates": 5, "cached": 4}}}}}))
    direct = lambda n, ts: {"type": "gemini", "id": "same", "timestamp": ts, "tokens": {"input": n, "output": 1}}
    put(tmp_path / "gem", "b/l.jsonl", [{"sessionId": "g3", "model": "gemini-y"}, direct(1, "2026-01-03T00:00:00Z"), direct(7, "2026-01-03T00:00:01Z")])
    got = rows_of(spark, "gemini", tmp_path / "gem")
    assert [(r.session_id, r.model, sums(r)) for r in got] == [("g1", "gemini-x", (8, 5, 0, 4, 1)), ("stats", "gpt-5", (6, 5, 0, 4, 0)), ("g3", "gemini-y", (7, 1, 0, 0, 0))]


def database(path: Path, table: str, columns: str, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE {table} ({columns})")
        db.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * len(rows[0]))})", rows)
    db.close()


def test_sqlite_agents(spark, tmp_path):
    data = {"modelID": "claude-opus-4.5", "providerID": "anthropic", "time": {"created": 1_770_000_000_000}, "tokens": {"input": 10, "output": 2, "cache": {"read": 1, "write": 3}}}
    database(tmp_path / "oc/opencode.db", "message", "id text, session_id text, data text", [("a", "s", json.dumps(data)), ("b", "s", "nope"), ("c", "s", json.dumps(data | {"cost": 0.7}))])
    put(tmp_path / "oc", "storage/message/s/a.json", json.dumps(data | {"id": "a", "sessionID": "s"}))
    put(tmp_path / "oc", "storage/message/s/d.json", json.dumps(data | {"id": "d", "sessionID": "s2"}))
    got = {r.message_id: r for r in rows_of(spark, "opencode", tmp_path / "oc")}
    assert set(got) == {"a", "c", "d"} and got["c"].cost == 0.7 and got["d"].session_id == "s2"
    assert got["a"].cost == pytest.approx(10 * 5e-6 + 2 * 25e-6 + 3 * 6.25e-6 + 1 * 0.5e-6)
    kilo = {"role": "assistant", "modelID": "gpt-5", "providerID": "open-ai", "time": {"created": 1_770_000_000}, "tokens": {"input": 4, "output": 2, "reasoning": 3, "total": 12}, "cost": 0.0}
    database(tmp_path / "k/kilo.db", "message", "id text, session_id text, data text", [("1", "s", json.dumps(kilo)), ("2", "s", json.dumps(kilo | {"role": "user"}))])
    got = rows_of(spark, "kilo", tmp_path / "k")
    assert [(sums(r), r.ts_ms, r.cost) for r in got] == [((4, 2, 0, 0, 6), 1_770_000_000_000, 0.0)]
    ddl = "id text, model text, billing_provider text, started_at, message_count, input_tokens, output_tokens, cache_read_tokens, cache_write_tokens, reasoning_tokens, estimated_cost_usd, actual_cost_usd"
    database(tmp_path / "h/state.db", "sessions", ddl, [("h1", "gpt-5", None, 1_770_000_000.5, 3, 10, 5, 0, 0, 2, 0.4, None), ("h2", " ", None, 1, 1, 1, 1, 1, 1, 1, 1, 1), ("h3", "gpt-5", "openai", 1_770_000_001, -1, 10, 5, 0, 0, 2, None, None)])
    got = rows_of(spark, "hermes", tmp_path / "h")
    assert [(r.session_id, r.message_count, r.ts_ms) for r in got] == [("h1", 3, 1_770_000_000_500), ("h3", 0, 1_770_000_001_000)] and got[0].cost == 0.4
    assert got[1].cost == pytest.approx(10 * 1.25e-6 + 7 * 10e-6)
    ddl = "id text, model_config_json text, provider_name text, created_at, total_tokens, input_tokens, output_tokens, accumulated_total_tokens, accumulated_input_tokens, accumulated_output_tokens"
    database(tmp_path / "g/sessions.db", "sessions", ddl, [("g1", '{"model_name":"gpt-5"}', None, "2026-01-01 00:00:00", 10, 3, 4, 0, 5, None), ("g2", "{}", None, "2026-01-01", 1, 1, 1, 1, 1, 1)])
    got = rows_of(spark, "goose", tmp_path / "g")
    assert [(sums(r), r.ts_text) for r in got] == [((5, 4, 0, 0, 1), "2026-01-01T00:00:00.000Z")]
    put(tmp_path, "none/kilo.db", "no database")
    assert rows_of(spark, "kilo", tmp_path / "none") == []


def test_unified(spark, claude_logs, tmp_path):
    put(tmp_path, "sessions/s.jsonl", [codex_event("2025-06-17T08:00:01.000Z", last=(400, 100, 30, 20, 430), model="gpt-5")])
    rows = unified(spark, {"claude": claude_logs, "codex": str(tmp_path)}, "daily", DISPLAY).collect()
    assert [(r.period, r.agents, r.total_tokens) for r in rows] == [("2025-06-16", ["claude"], 13), ("2025-06-17", ["claude", "codex"], 470), ("2025-06-20", ["claude"], 63)]
    assert [b.agent for b in rows[1].agent_breakdowns] == ["claude", "codex"] and len(rows[1].model_breakdowns) == 3
    assert [r.period for r in unified(spark, {"claude": claude_logs}, "weekly", DISPLAY).collect()] == ["2025-06-16"]
    assert unified(spark, {"claude": claude_logs, "codex": str(tmp_path)}, "session", DISPLAY).count() == 4
    assert unified(spark, {"claude": claude_logs}, "monthly", DISPLAY).count() == 1


def test_several_roots(spark, claude_logs, tmp_path):
    put(tmp_path, "projects/x/y/z.jsonl", [claude("2025-07-01T00:00:00.000Z", SLOW, 1, 1)])
    assert load_usage(spark, "claude", [claude_logs, str(tmp_path)], DISPLAY).count() == 6


def test_options_of_settings():
    got = options_of({"since": "20250101", "startOfWeek": "monday", "sessionLength": 3, "speed": "fast", "other": 1, "mode": None})
    assert (got.since, got.week_starts, got.block_hours, got.fast, got.mode) == ("20250101", "monday", 3.0, True, "auto")


def test_settings():
    config = {"defaults": {"mode": "auto", "order": "asc"}, "commands": {"daily": {"order": "desc"}, "claude:daily": {"mode": "display"}}, "claude": {"defaults": {"timezone": "UTC"}, "commands": {"daily": {"timezone": "Asia/Tokyo"}}}}
    assert settings(config, "daily") == {"mode": "auto", "order": "desc"}
    assert settings(config, "daily", "claude", order="asc", mode=None) == {"mode": "display", "order": "asc", "timezone": "Asia/Tokyo"}


def test_reports_in_parts_join_to_the_same_json(spark, claude_logs, tmp_path):
    rows = load_usage(spark, "claude", claude_logs, DISPLAY)
    for k, (report, by_project, costs) in enumerate([(daily(rows), False, True), (daily(rows, by_project=True), True, False), (sessions(rows).repartition(1), False, True), (daily(rows).where("false"), False, True)]):
        render.write_report(report, totals(report), str(tmp_path / f"r{k}"), "list", costs, by_project)
        render.join_report(spark, str(tmp_path / f"r{k}"), str(tmp_path / f"r{k}.json"))
        assert (tmp_path / f"r{k}.json").read_text() == render.report_json(report, totals(report), "list", costs, by_project)
    got = agent_sessions(rows).collect()
    assert [(r.session_id, r.cost, r.last_activity) for r in got] == [("dawn", 3.0, "2025-06-20T08:20:00.000Z"), ("night", 0.75, "2025-06-17T00:30:00.000Z"), ("noon", 0.125, "2025-06-17T12:45:00.000Z")]
    assert [r.session_id for r in agent_sessions(rows, Options(until="20250617")).collect()] == ["night", "noon"]
