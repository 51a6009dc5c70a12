"""Ordered operators inside a group: carry forward, running differences, as-of lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_last(df: DataFrame, columns: list[str], group: list[str], order: list[str], span: Column | None, until: int) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` and, for each column, its last non-null value up to ``until`` rows from each row.

    With ``span`` (a coarse value that never falls along ``order``: a range of bytes, of time)
    no task gets a whole group: windows look within (group, span), spans are reduced to their
    last values (combined before the shuffle), and these few are carried between spans. The
    window and the join deal rows by the same keys, so they move once.
    """
    frame = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
    if span is None:
        w = frame(Window.partitionBy(*group))
        return df, {c: F.last(c, ignorenulls=True).over(w) for c in columns}
    rows = df.withColumn("_span", span)
    keys, w = [*group, "_span"], frame(Window.partitionBy(*group, "_span"))
    place = F.struct(*order)
    ends = rows.groupBy(*keys).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in columns))
    before = Window.partitionBy(*group).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_before_{c}") for c in columns))
    same = F.lit(True)
    for k in keys:  # a null is a group, too
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    rows = rows.withColumns({f"_here_{c}": F.last(c, ignorenulls=True).over(w) for c in columns}).join(ends, same)
    return rows, {c: F.coalesce(f"_here_{c}", f"_before_{c}") for c in columns}


def carry_forward(df: DataFrame, columns: list[str], group: list[str], order: list[str], suffix: str = "", span: Column | None = None) -> DataFrame:
    """Nulls of ``columns`` become the last value before them in their group (into
    ``column + suffix``; the columns themselves by default). ``span``: see above; groups of any
    size are then spread."""
    rows, last = with_last(df, columns, group, order, span, Window.currentRow)
    given = [c for c in df.columns if suffix or c not in columns]
    return rows.select(*given, *(last[c].alias(c + suffix) for c in columns)).select(*df.columns, *((c + suffix for c in columns) if suffix else ()))


def running_delta(df: DataFrame, columns: list[str], group: list[str], order: list[str], suffix: str = "_delta", span: Column | None = None) -> DataFrame:
    """By how much each column exceeds its last non-null value before, 0 at least; the first
    value counts whole, null stays null. ``span``: groups of any size are spread."""
    rows, last = with_last(df, columns, group, order, span, -1)
    more = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(c) - F.coalesce(last[c], F.lit(0)), F.lit(0))) for c in columns}
    return rows.select(*df.columns, *(v.alias(c + suffix) for c, v in more.items()))


def as_of(df: DataFrame, versions: DataFrame, day: str, since: str, value: str, default: str) -> DataFrame:
    """Adds ``value``: that of the latest version with ``since`` not after ``day``; else the default.

    The versions are a short, static list: it is folded into one sorted array that every
    row searches, so the facts are not shuffled."""
    held = versions.agg(F.sort_array(F.collect_list(F.struct(F.col(since).alias("since"), F.col(value).alias("value"))), asc=False).alias("held"))
    rows = df.crossJoin(F.broadcast(held))  # one row
    hit = F.try_element_at(F.filter("held", lambda x: x["since"] <= F.col(day)), F.lit(1))
    return rows.withColumn(value, F.coalesce(hit["value"], F.lit(default))).drop("held")


def as_of_merge(df: DataFrame, versions: DataFrame, keys: list[str], at: str, since: str, value: str, default: str, span: Column | None = None) -> DataFrame:
    """Like ``as_of`` for version lists of any length, one for each of ``keys``: both sides are
    dealt by key, sorted by time together, and each row takes the last version before it.

    Nothing is broadcast. A version holds from its ``since`` on; of versions of one moment the
    greatest value counts; a null time has the default; versions without a time count for
    nothing. ``span``: a coarse value of the column ``_at`` (the time) that spreads large keys."""
    told = versions.where(F.col(since).isNotNull()).select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_value"))
    rows = df.drop(value).withColumns({"_at": F.col(at), "_side": F.lit(1)})
    both = rows.unionByName(told, allowMissingColumns=True).withColumn("_by", F.col("_value"))
    out = carry_forward(both, ["_value"], keys, ["_at", "_side", "_by"], span=span).where("_side = 1")
    return out.withColumn(value, F.coalesce("_value", F.lit(default))).drop("_at", "_side", "_value", "_by")


def leading_run(df: DataFrame, inside: Column, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: is the row in the run of ``inside`` rows that its group begins with? The run
    ends at the first row outside, a minimum a group; no group is sorted. Rows of equal
    ``order`` are all before or all after that row."""
    place = F.struct(*order)
    ends = df.groupBy(*(F.col(k).alias(f"_of_{k}") for k in group)).agg(F.min(F.when(~F.coalesce(inside, F.lit(False)), place)).alias("_end"))
    same = F.lit(True)
    for k in group:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    run = F.col("_end").isNull() | (place < F.col("_end"))
    return df.join(ends, same).select(*df.columns, run.alias(name))


def with_lookup(df: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, Column]) -> DataFrame:
    """``df`` with columns of ``table`` (a row a key); where it has none, the defaults."""
    out = df.join(table.select(*keys, *defaults), keys, "left")
    return out.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})
