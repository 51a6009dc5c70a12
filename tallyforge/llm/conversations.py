"""Conversation structure repair: the cheapest edits that give roles ``(s?(ua)+)?``.

A conversation is a run of turns, and a repair walks them through a small grammar: nothing yet,
after a system turn, after a user turn, after an assistant turn. A recursive DuckDB query does
the walk for a batch of many conversations at once; each recursion takes one turn of all of
them and keeps, for each grammar state, the least cost and the audit that is ASCII-least among
the cheapest. Spark deals the batches by hash.

A conversation of any length is cut into segments of bounded size. A segment is walked from
every state that it may begin in; what comes out (state to state, cost, audit) composes like a
single turn, so runs of segments are walked by the same recursion, level by level, until one
is left. Two different audits of equal cost over the same turns are never a prefix of each other
(what follows would be paid inserts), so the least whole comes from the least parts.
"""

from __future__ import annotations

import hashlib
import uuid

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import blocks_for, bounded_batches, cut, remove, shared_folder

SPACES = " \t\n\v\f\r"
#: Turns and bytes of a segment, segments of a run, rows of a batch.
TURNS, BYTES, RUN, BATCH = 256, 1 << 20, 64, 100_000
DELETE, REROLE, INSERT, CUT_OFF = 2, 1, 5, 5
INITIALS, FAULTS = "sua", "otd"
#: state -> role initial -> state; e: nothing yet.
GRAMMAR = {"e": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAMES = {"u": "user", "a": "assistant"}
#: Edits after the last turn that end in an accepted state.
ENDINGS = {"e": "", "a": "", "u": "I", "s": "II"}


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the hash of a row's place tells; nulls of
    role and text (and, in the hash, of the place) are one space."""
    one = F.lit(" ")
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), one) for c in ("conv_id", "turn")))
    fate, text = F.crc32(place.cast("binary")) % 20, F.coalesce(F.col("text").cast("string"), one)
    out = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), one)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).when(fate != 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))).alias("copy"),
    )
    return out.drop("copy")


def _moves() -> pa.Table:
    """(code, state, to_state, cost, audit): the best way over one turn; inserts come before it."""
    best: dict = {}
    for i, initial in enumerate(INITIALS + "x"):
        for j, fault in enumerate(FAULTS):
            code = chr(65 + 3 * i + j)
            for state in GRAMMAR:
                ways = [(DELETE, "D", state)]
                now, inserted = state, 0
                while fault != "d" and inserted <= 2:
                    for role, after in GRAMMAR[now].items():
                        fee = INSERT * inserted + (CUT_OFF if fault == "t" else 0)
                        if role == initial:
                            ways.append((fee, "I" * inserted + "K", after))
                        elif role in NAMES:
                            ways.append((fee + REROLE, "I" * inserted + "R", after))
                    now, inserted = GRAMMAR[now].get("u" if now != "u" else "a"), inserted + 1
                for cost, audit, after in ways:
                    key = (code, state, after)
                    best[key] = min(best.get(key, (cost, audit)), (cost, audit))
    return pa.table(
        {
            "code": [k[0] for k in best],
            "state": [k[1] for k in best],
            "to_state": [k[2] for k in best],
            "cost": pa.array([v[0] for v in best.values()], pa.int64()),
            "audit": [v[1] for v in best.values()],
        }
    )


#: The newest row of each key stays, so a batch holds one row for each unit, start and state.
WALK = """
    with recursive walk(unit, start, state, pos, cost, audit) using key (unit, start, state) as (
        select unit, state, state, 0, 0::bigint, '' from starts
        union
        select unit, start, to_state, pos + 1, best.cost, best.audit from (
            select w.unit, w.start, s.to_state, w.pos, min({'cost': w.cost + s.cost, 'audit': w.audit || s.audit}) as best
            from walk as w join steps as s on s.unit = w.unit and s.pos = w.pos and s.state = w.state
            group by w.unit, w.start, s.to_state, w.pos
        )
    )
    select w.unit, start, state, cost, audit from walk as w join ends as e on e.unit = w.unit and w.pos = e.turns order by 1, 2, 3
"""


def _walk(**tables: pa.Table | str) -> pa.Table:
    """The recursion over the tables starts, steps and ends (or SQL over the ones before)."""
    with duckdb.connect(config={"threads": 1, "memory_limit": "700MB"}) as db:
        for name, held in tables.items():
            if isinstance(held, str):
                db.execute(f"create temp view {name} as {held}")
            else:
                db.register(name, held)
        return db.sql(WALK).to_arrow_table()


_MATRIX = "conv string, unit long, segments long, state string, to_state string, cost long, audit string"


def _matrix(units: pa.Table, walked: pa.Table, mark: bool) -> pa.Table:
    at, audit = walked.column("unit"), walked.column("audit").cast(pa.string())
    state = walked.column("state").cast(pa.string())
    if mark:  # where a segment ends, its audit tells the state
        audit = pa.array([a + s for a, s in zip(audit.to_pylist(), state.to_pylist())], pa.string())
    held = {c: units.column(c).take(at) for c in ("conv", "unit", "segments")}
    return pa.table(held | {"state": walked.column("start").cast(pa.string()), "to_state": state, "cost": walked.column("cost"), "audit": audit})


def _over_turns(table: pa.Table) -> pa.Table:
    """A batch of segments (conv, unit, segments, codes): state to state over each."""
    codes = table.column("codes").to_pylist()
    n = np.array([len(c) for c in codes], dtype=np.int64)
    unit = np.repeat(np.arange(len(n)), n)
    pos = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    turns = pa.table({"unit": unit, "pos": pos, "code": list("".join(codes))})
    ends = pa.table({"unit": np.arange(len(n)), "turns": n, "first": table.column("unit").to_numpy() == 0})
    steps = "select unit, pos, state, to_state, cost, audit from turns join moves using (code)"
    starts = "select unit, state from ends, (values ('e'), ('s'), ('u'), ('a')) as v(state) where state = 'e' or not first"
    return _matrix(table, _walk(moves=_moves(), turns=turns, ends=ends, steps=steps, starts=starts), mark=True)


def _over_segments(table: pa.Table) -> pa.Table:
    """A batch of runs of segments (conv, unit, segments, pos, state, to_state, cost, audit)."""
    keys = list(zip(table.column("conv").to_pylist(), table.column("unit").to_pylist()))
    number = {key: k for k, key in enumerate(dict.fromkeys(keys))}
    unit = np.array([number[k] for k in keys], dtype=np.int64)
    where = np.unique(unit, return_index=True)[1]
    steps = table.select(["pos", "state", "to_state", "cost", "audit"]).append_column("unit", pa.array(unit))
    walked = _walk(steps=steps, starts="select distinct unit, state from steps where pos = 0", ends="select unit, max(pos) + 1 as turns from steps group by unit")
    return _matrix(table.select(["conv", "unit", "segments"]).take(pa.array(where)), walked, mark=False)


_SEGMENT = (
    "conv string, part int, seq long, codes string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, "
    "first string, last string, turn_lo long, turn_hi long, turns long"
)
_LEGAL = {"su", "ua", "au"}


def _segments(batches):
    """Sorted rows to segments. Rows that repeat the row before (same turn) are duplicates too."""
    held: dict | None = None
    before = None

    def done():
        return pa.RecordBatch.from_pylist([held], schema=schema)

    names = [f.split(" ") for f in _SEGMENT.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in names])
    size = seq = 0
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["conv"], row["turn"], row["digest"])
            if held is None or held["conv"] != row["conv"] or len(held["texts"]) >= TURNS or size >= BYTES:
                if held is not None:
                    yield done()
                if before is None or before[0] != row["conv"]:
                    seq = 0
                held = {"conv": row["conv"], "part": row["part"], "seq": seq, "codes": "", "roles": [], "texts": [], "first": row["role"][:1]}
                held |= {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0, "turn_lo": row["turn"], "turn_hi": None}
                seq, size = seq + 1, 0
            elif held["last"] + row["role"][:1] not in _LEGAL:
                held["illegal"] += 1
            fault = "blank" if row["blank"] else "duplicate" if row["late"] or key == before else "truncated" if row["open"] else ""
            if fault:
                held[fault] += 1
            initial = INITIALS.find(row["role"][:1]) if row["role"] else 3
            held["codes"] += chr(65 + 3 * (3 if initial < 0 else initial) + (0 if not fault else 1 if fault == "truncated" else 2))
            held["roles"].append(row["role"])
            held["texts"].append(row["text"])
            held["last"] = row["role"][:1]
            if row["turn"] is not None and row["turn"] != held["turn_hi"]:
                held["turn_lo"] = row["turn"] if held["turn_hi"] is None else held["turn_lo"]
                held["turn_hi"] = row["turn"]
                held["turns"] += 1
            size += len(row["role"]) + len(row["text"])
            before = key
    if held is not None:
        yield done()


def repaired_lines(roles: list, texts: list, audit: str, state: str):
    """(role, text) of the turns that the edits leave, from a grammar state on."""
    k = 0
    for edit in audit:
        if edit == "D":
            k += 1
            continue
        role = roles[k] if edit == "K" else ""
        initial = role[:1] if edit == "K" else "a" if state == "u" else "u"
        yield (role, texts[k]) if edit == "K" else (NAMES[initial], texts[k] if edit == "R" else "")
        k += edit != "I"
        state = GRAMMAR[state][initial]


def _written(batches):
    """Each segment's repaired text; of a conversation's only segment the digest is enough."""
    for batch in batches:
        for row in batch.to_pylist():
            lines = [f"{r}:{t}" for r, t in repaired_lines(row["roles"], row["texts"], row["edits"], row["begins"])]
            text, only = "\n".join(lines) if lines else None, row["segments"] == 1
            sha = hashlib.sha256((text or "").encode()).hexdigest() if only else None
            yield pa.RecordBatch.from_pylist([{"conv": row["conv"], "unit": row["unit"], "text": None if only else text, "sha": sha}], schema=_PIECE)


_PIECE = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("text", pa.string()), ("sha", pa.string())])


def _digests(batches):
    """Digests of conversations whose segments come in order, a segment at a time."""
    conv, hashed, empty = None, None, True
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if hashed is not None and row["conv"] != conv:
                out.append((conv, hashed.hexdigest()))
                hashed = None
            if row["sha"] is not None:
                out.append((row["conv"], row["sha"]))
                continue
            if hashed is None:
                conv, hashed, empty = row["conv"], hashlib.sha256(), True
            if row["text"] is not None:
                hashed.update(("" if empty else "\n").encode() + row["text"].encode())
                empty = False
        yield pa.RecordBatch.from_pydict({"conv": [x[0] for x in out], "repaired_sha256": [x[1] for x in out]}, schema=_DIGEST)
    if hashed is not None:
        yield pa.RecordBatch.from_pydict({"conv": [conv], "repaired_sha256": [hashed.hexdigest()]}, schema=_DIGEST)


_DIGEST = pa.schema([("conv", pa.string()), ("repaired_sha256", pa.string())])


def _key():
    """Conversations by text, so that a null id is a conversation too."""
    return F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))


def _cut_into_segments(rows: DataFrame) -> DataFrame:
    """Rows by (conversation, turn) in ranges, so that one conversation spreads over tasks; rows
    of one turn are ordered by a digest of role and text, equal ones are neighbours."""
    bare = F.rtrim("text", F.lit(SPACES))
    told = rows.select(_key().alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text")
    told = told.withColumns(
        {
            "digest": F.md5(F.concat_ws("\0", "role", "text").cast("binary")),
            "blank": bare == "",
            "open": ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        }
    )
    #: Few role-text pairs come at two turns of a conversation; only those need to meet.
    same = told.where(~F.col("blank")).groupBy("conv", "digest").agg(F.min(F.struct("turn")).alias("lo"), F.max(F.struct("turn")).alias("hi"))
    same = same.where(~F.col("lo.turn").eqNullSafe(F.col("hi.turn"))).select("conv", "digest", F.col("lo.turn").alias("lo"), F.lit(True).alias("again"))
    late = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("lo"))
    told = told.join(same, ["conv", "digest"], "left").withColumn("late", late).drop("lo", "again")
    order = ["conv", "turn", "digest"]
    told = told.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    return told.mapInArrow(_segments, _SEGMENT)


def _best_edits(segments: DataFrame) -> DataFrame:
    """conv, cost, marked: each conversation's cheapest audit, with states where segments end."""
    deal = lambda df, unit, rows: df.withColumn("batch", F.pmod(F.xxhash64("conv", unit), F.lit(blocks_for(rows, BATCH))))
    turns, most = segments.agg(F.sum(F.length("codes")), F.max("segments")).head()
    table = deal(segments.select("conv", "unit", "segments", "codes"), "unit", turns or 0)
    walked = cut(table.groupBy("batch").applyInArrow(_over_turns, _MATRIX))
    while most and most > 1:
        long = walked.where("segments > 1").withColumns({"pos": F.col("unit") % RUN, "unit": F.floor(F.col("unit") / RUN), "segments": F.ceil(F.col("segments") / RUN)})
        long = deal(long, "unit", long.count()).groupBy("batch").applyInArrow(_over_segments, _MATRIX)
        walked, most = cut(walked.where("segments = 1").union(long)), -(-most // RUN)
    tail = F.create_map(*(F.lit(x) for pair in ENDINGS.items() for x in pair))[F.col("to_state")]
    ended = F.struct((F.col("cost") + INSERT * F.length(tail)).alias("cost"), F.concat("audit", tail).alias("marked"))
    return walked.where("state = 'e'").groupBy("conv").agg(F.min(ended).alias("best")).select("conv", "best.*")


def _settled(rows: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The segments, written to ``folder``, with what each keeps (edits, begins); their sums without
    texts; the best edits."""
    spark = rows.sparkSession
    bounded_batches(spark)
    _cut_into_segments(rows).write.parquet(folder)
    whole = spark.read.parquet(folder)
    by_conv = Window.partitionBy("conv")
    order = by_conv.orderBy("part", "seq")
    light = whole.drop("roles", "texts").withColumns(
        {
            "unit": F.row_number().over(order).cast("long") - 1,
            "segments": F.count("*").over(by_conv),
            "last_before": F.lag("last").over(order),
            "turn_before": F.lag("turn_hi").over(order),
        }
    )
    light = cut(light)
    best = cut(_best_edits(light))
    slices = best.select("conv", F.posexplode(F.split("marked", "(?<=[a-z])")).alias("unit", "edits"), F.split("marked", "(?<=[a-z])").alias("all"))
    edits = F.regexp_replace("edits", "[a-z]", "")
    tail = F.when(F.col("unit") == F.size("all") - 2, F.element_at("all", -1)).otherwise("")
    begins = F.when(F.col("unit") == 0, "e").otherwise(F.right(F.get("all", F.col("unit") - 1), F.lit(1)))
    slices = slices.where(F.col("unit") < F.size("all") - 1).select("conv", F.col("unit").cast("long").alias("unit"), F.concat(edits, tail).alias("edits"), begins.alias("begins"))
    placed = light.select("conv", "part", "seq", "unit", "segments").join(slices, ["conv", "unit"])
    return whole.select("conv", "part", "seq", "roles", "texts").join(placed, ["conv", "part", "seq"]), light, best


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 over rows
    (conv_id, turn, role, text), one a conversation; rows are taken as they are.

    Nulls of role and text are one space; null turns come first and count in no gap; rows of a
    null conv_id are one conversation. Rows of equal turn are ordered by the MD5 of role and
    text, so equal rows are neighbours and all but one are duplicates. An empty role has no
    initial: it is illegal and can only be reroled or deleted. Other columns are not read. The
    digest of a conversation is read by one task, a segment at a time, since SHA-256 is
    sequential; all else of a long conversation is spread. No rows give no rows.
    """
    one = F.lit(" ")
    told = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), one).alias(c) for c in ("role", "text")))
    folder = f"{shared_folder(rows.sparkSession)}/conversations-{uuid.uuid4().hex}"
    pieces, light, best = _settled(told, folder)
    pieces = pieces.select("conv", "unit", "segments", "roles", "texts", "edits", "begins").mapInArrow(_written, "conv string, unit long, text string, sha string")
    digests = pieces.repartition("conv").sortWithinPartitions("conv", "unit").mapInArrow(_digests, "conv string, repaired_sha256 string")
    across = F.when(F.concat("last_before", "first").isin(*_LEGAL), 0).when(F.col("last_before").isNotNull(), 1).otherwise(0)
    met = F.when(F.col("turn_before") == F.col("turn_lo"), 1).otherwise(0)
    span = F.max("turn_hi") - F.min("turn_lo") + 1 - F.sum(F.col("turns") - met)
    counts = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    sums = light.groupBy("conv").agg(F.coalesce(span, F.lit(0)).alias("gaps"), *counts, F.sum(F.col("illegal") + across).alias("illegal"))
    audit = F.regexp_replace("marked", "[a-z]", "").alias("audit")
    ids = rows.select("conv_id", _key().alias("conv")).distinct()
    out = sums.join(best, "conv").join(digests, "conv").join(ids, "conv")
    out = cut(out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", audit, "repaired_sha256"))
    remove(rows.sparkSession, folder)
    return out


def with_all(report: DataFrame, originals: DataFrame) -> DataFrame:
    """``report`` with a row for every id of ``originals``: zeros, no edits and the digest of
    the empty string where nothing is left of a conversation."""
    ids = originals.select("conv_id").distinct().alias("i")
    found = ids.join(report.alias("r"), F.col("i.conv_id").eqNullSafe(F.col("r.conv_id")), "left").select("i.conv_id", *(f"r.{c}" for c in report.columns[1:]))
    return found.fillna(0, report.columns[1:]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})


def repaired_turns(rows: DataFrame, folder: str) -> DataFrame:
    """conv (``+`` and the id, ``-`` for null), unit, place, role, text: the turns of the repaired
    conversations, in the order of unit and place. Segments are kept in ``folder``."""

    def turns(batches):
        for batch in batches:
            for row in batch.to_pylist():
                lines = repaired_lines(row["roles"], row["texts"], row["edits"], row["begins"])
                held = [(row["conv"], row["unit"], k, r, t) for k, (r, t) in enumerate(lines)]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x)) for x in held], schema=schema)

    schema = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    one = F.lit(" ")
    told = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), one).alias(c) for c in ("role", "text")))
    pieces = _settled(told, folder)[0].select("conv", "unit", "roles", "texts", "edits", "begins")
    return pieces.mapInArrow(turns, "conv string, unit long, place long, role string, text string")
