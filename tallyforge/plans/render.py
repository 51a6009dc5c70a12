"""Finished reports as JSON or text: whole (a row a period), or written in parts by Spark (sessions)."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.sources.textlogs import listed_files, opened, whole_path

NAMES = {
    "input_tokens": "inputTokens",
    "output_tokens": "outputTokens",
    "cache_creation_tokens": "cacheCreationTokens",
    "cache_read_tokens": "cacheReadTokens",
    "reasoning_tokens": "reasoningOutputTokens",
    "total_tokens": "totalTokens",
    "cost": "totalCost",
    "models_used": "modelsUsed",
    "model_breakdowns": "modelBreakdowns",
    "session_id": "sessionId",
    "project_path": "projectPath",
    "first_activity": "firstActivity",
    "last_activity": "lastActivity",
    "agent_breakdowns": "agentBreakdowns",
}
HIDDEN = {"extra_tokens", "missing_pricing", "first_ms", "last_ms", "message_count", "versions"}
OPTIONAL = {"credits", "project", "agents"}
COSTS = {"totalCost", "costUSD", "cost"}


def plain(value, nested: bool = False):
    """Rows to dicts under report names; whole floats print as integers."""
    if isinstance(value, (Row, dict)):
        out = {}
        for name, x in (value.asDict() if isinstance(value, Row) else value).items():
            if name in HIDDEN or name in OPTIONAL and x is None:
                continue
            key = "modelName" if nested and name == "model" else "cost" if nested and name == "cost" else NAMES.get(name, name)
            out[key] = plain(x, True)
        return out
    if isinstance(value, list):
        return [plain(x, nested) for x in value]
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def without_costs(value):
    if isinstance(value, dict):
        return {k: without_costs(x) for k, x in value.items() if k not in COSTS}
    return [without_costs(x) for x in value] if isinstance(value, list) else value


def report_json(rows: DataFrame, totals: DataFrame | None, key: str, costs: bool = True, by_project: bool = False) -> str:
    """``{key: [...], "totals": {...}}``, or rows grouped below ``projects``."""
    data = [plain(r) for r in rows.collect()]
    if by_project:
        groups: dict[str, list] = {}
        for row in data:
            groups.setdefault(row.get("project") or "unknown", []).append(row)
        out = {"projects": dict(sorted(groups.items()))}
    else:
        out = {key: data}
    if totals is not None:
        out["totals"] = _sums(totals)
    return json.dumps(out if costs else without_costs(out), indent=2, ensure_ascii=False)


def _sums(totals: DataFrame) -> dict:
    sums = plain(totals.head())
    if not sums.get("credits"):
        sums.pop("credits", None)
    return sums


def write_report(rows: DataFrame, totals: DataFrame | None, folder: str, key: str, costs: bool = True, by_project: bool = False) -> None:
    """A report of any size as text below ``folder``: ``rows`` in parts, each a sorted range with
    a JSON object a line, and ``last``, the name of the list and the totals. Nothing but the
    totals comes to the driver; ``join_report`` makes the one document of it."""
    if by_project:  # in the order of projects, and in each in the report's
        rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_group", F.coalesce(F.nullif("project", F.lit("")), F.lit("unknown")))
        rows = rows.orderBy("_group", "_at")

    def lines(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                group = row.pop("_group", None)
                row.pop("_at", None)
                shown = plain(row)
                out.append(json.dumps([group, shown if costs else without_costs(shown)], ensure_ascii=False))
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.string())})

    rows.mapInArrow(lines, "value string").write.text(f"{folder}/rows")
    last = [key, by_project, None if totals is None else _sums(totals) if costs else without_costs(_sums(totals))]
    rows.sparkSession.createDataFrame([(json.dumps(last, ensure_ascii=False),)], "value string").coalesce(1).write.text(f"{folder}/last")


def join_report(spark: SparkSession, folder: str, out_path: str) -> None:
    """The parts of ``write_report`` as one JSON document, the same text that ``report_json`` gives.
    Parts are copied through one after the other, a line at a time."""

    def parts(of):
        for row in listed_files(spark, f"{folder}/{of}", "part-*").select("uri").orderBy("uri").toLocalIterator():
            fs, path = opened(row["uri"])
            with fs.open_input_stream(path, compression=None) as file, pa.PythonFile(file, mode="r") as lines:
                rest = b""
                while block := lines.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    yield from (json.loads(x) for x in whole if x)
                if rest:
                    yield json.loads(rest)

    key, by_project, sums = next(parts("last"))
    fs, path = opened(whole_path(spark, out_path))
    deep = "      " if by_project else "    "
    shown = lambda x, pad: json.dumps(x, indent=2, ensure_ascii=False).replace("\n", "\n" + pad)
    opens, closes = ("{", "}") if by_project else ("[", "]")
    with fs.open_output_stream(path, compression=None) as out:
        put = lambda text: out.write(text.encode())
        put(f'{{\n  {json.dumps("projects" if by_project else key)}: {opens}')
        count, now = 0, None
        for group, row in parts("rows"):
            if by_project and (count == 0 or group != now):
                put(("\n    ]," if count else "") + f"\n    {json.dumps(group, ensure_ascii=False)}: [\n")
            else:
                put(",\n" if count else "\n")
            put(deep + shown(row, deep))
            count, now = count + 1, group
        put(("\n    ]" if by_project and count else "") + ("\n  " if count else "") + closes)
        put("" if sums is None else ',\n  "totals": ' + shown(sums, "  "))
        put("\n}")


def table(rows: DataFrame, columns: dict[str, str], width: int | None = None, total: bool = True) -> str:
    """A text table: ``columns`` maps column names to headings; numbers right-aligned, lists a
    line each; narrow tables drop the cache columns."""
    if width is not None and width < 100:
        columns = {k: v for k, v in columns.items() if not k.startswith("cache_")}
    data = rows.select(*columns).collect()

    def text(name, value):
        if value is None:
            return ""
        if isinstance(value, list):
            return "\n".join(f"- {x}" for x in sorted(set(value)))
        if name == "cost":
            return f"${value:.2f}"
        return f"{value:,}" if isinstance(value, int) else str(value)

    body = [[text(n, r[n]) for n in columns] for r in data]
    if total and data:
        sums = [sum(r[n] or 0 for r in data) if isinstance(data[0][n], (int, float)) else None for n in columns]
        body.append(["Total" if k == 0 else text(n, s) for k, (n, s) in enumerate(zip(columns, sums))])
    heads = [*columns.values()]
    size = [max(len(line) for row in [heads, *body] for line in row[k].split("\n")) for k in range(len(heads))]
    right = [not data or isinstance(data[0][n], (int, float)) for n in columns]

    def show(row):
        cells = [c.split("\n") for c in row]
        for k in range(max(map(len, cells))):
            yield " | ".join((c[k] if k < len(c) else "").rjust(w) if r else (c[k] if k < len(c) else "").ljust(w) for c, w, r in zip(cells, size, right)).rstrip()

    rule = "-+-".join("-" * w for w in size)
    return "\n".join([*show(heads), rule, *(line for row in body for line in show(row))])


def compact_date(day: str) -> str:
    """``2026-01-09`` on two lines, as narrow tables show it."""
    return re.sub(r"^(\d{4})-(\d{2}-\d{2})$", r"\1\n\2", day)


def statusline(model: str, session_cost: float | None, today_cost: float, block: Row | None, now_ms: int, context: tuple[int, int] | None) -> str:
    """One line: model, costs, the active block with time left and burn rate, context used."""
    money = lambda x: "N/A" if x is None else f"${x:.2f}"
    if block is None:
        state = "No active block"
    else:
        minutes = (block["block_end"] - now_ms) // 60_000
        left = f"{minutes // 60}h {minutes % 60}m left" if minutes >= 60 else f"{minutes}m left"
        state = f"{money(block['cost'])} block ({left})"
        if block["cost_per_hour"] is not None:
            rate = block["plain_per_minute"]
            state += f" | {money(block['cost_per_hour'])}/hr ({'Normal' if rate < 2000 else 'Moderate' if rate < 5000 else 'High'})"
    used = "N/A" if context is None else f"{context[0]:,} ({round(context[0] / context[1] * 100) if context[1] else 0}%)"
    return f"{model} | {money(session_cost)} session / {money(today_cost)} today / {state} | {used}"
