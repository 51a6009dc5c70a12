"""Activity blocks: windows of at most a duration that start at the hour of their first row.

Which row ends a block depends on the hour it starts in and on no more: the first row after
that hour plus the duration. So blocks are a chain over the active hours of a group, which are
few however many rows there are, and rows are only met again to find their block by their hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.carry import carry_forward, with_last
from tallyforge.sources.textlogs import written

#: Hours of a span; a group with at most so many hours is chained in one fold.
SPAN = FOLD = 1024


def block_starts(df: DataFrame, ts: str, group: list[str], duration: int, hour: int) -> DataFrame:
    """Adds ``block_start``: the start of the row's block.

    A block starts at the full hour of its first row and ends before the first row that is
    more than ``duration`` after its start (which a gap longer than that also brings). Any
    duration works; below an hour every active hour starts a block of its own. One group may
    hold all rows: they are reduced to active hours (combined before the shuffle), hours are
    dealt by spans of time, and the chain through them is found by pointer doubling.
    """
    at = F.col(ts) - F.pmod(ts, F.lit(hour))
    if duration < hour:
        return df.withColumn("block_start", at)
    rest = duration % hour
    hours = df.groupBy(*group, at.alias("_hour")).agg(F.min(ts).alias("lo"), F.min(F.when(F.col(ts) - at > rest, F.col(ts))).alias("past"))
    hours = written(hours)
    firsts = _firsts(hours, group, duration, hour)
    starts = firsts.select(*group, (F.col("first") - F.pmod("first", F.lit(hour))).alias("_hour"), "first")
    placed = _joined(hours, starts, [*group, "_hour"], ["first"]).withColumn("start", F.when(F.col("first").isNotNull(), F.col("_hour")))
    #: An hour has one first row at most; before it the block of an earlier hour goes on.
    rows, before = with_last(placed, ["start"], group, ["_hour"], _span("_hour", hour), -1)
    placed = rows.select(*group, "_hour", "first", "start", before["start"].alias("before"))
    found = _joined(df.withColumn("_hour", at), placed, [*group, "_hour"], ["first", "start", "before"], "_b_")
    return found.select(*df.columns, F.when(F.col(ts) >= F.col("_b_first"), F.col("_b_start")).otherwise(F.col("_b_before")).alias("block_start"))


def _span(at: str, hour: int) -> Column:
    return F.floor(F.col(at) / (hour * SPAN))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """``left`` with columns of ``right``; a null key is a key, too."""
    right = right.select(*(F.col(k).alias(f"_of_{k}") for k in keys), *(F.col(c).alias(prefix + c) for c in columns))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return left.join(right, same, "left").drop(*(f"_of_{k}" for k in keys))


def _next_firsts(hours: DataFrame, group: list[str], duration: int, hour: int) -> DataFrame:
    """(group, _hour, value): the row that ends a block which starts in that hour, null if none does.

    For an hour it is the first row after the hour plus the duration: of the hour in which that
    moment falls its first row past the moment, or else the next active hour's first. Read from
    the latest hour down, that is the value last seen."""
    whole = duration - duration % hour
    event = lambda key, step, value, of: F.struct(key.alias("key"), F.lit(step).alias("step"), value.alias("value"), of.alias("of"))
    none = F.lit(None).cast("long")
    seen = [event(F.col("_hour"), 0, F.col("past"), none), event(F.col("_hour") + whole, 1, none, F.col("_hour")), event(F.col("_hour"), 2, F.col("lo"), none)]
    events = hours.select(*group, F.explode(F.array(*seen)).alias("e")).select(*group, "e.*").withColumn("down", -F.col("key"))
    events = carry_forward(events, ["value"], group, ["down", "step"], span=_span("down", hour))
    return events.where("step = 1").select(*group, F.col("of").alias("_hour"), "value")


def _firsts(hours: DataFrame, group: list[str], duration: int, hour: int) -> DataFrame:
    """(group, first): the first row of every block."""
    links = written(_next_firsts(hours, group, duration, hour))
    roots = hours.groupBy(*group).agg(F.min("lo").alias("first"))
    most = links.groupBy(*group).count().agg(F.max("count")).head()[0] or 0
    floor = lambda x: x - F.pmod(x, F.lit(hour))
    if most <= FOLD:
        chains = links.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("_hour", "value"))).alias("links"))
        chains = _joined(chains, roots, group, ["first"])
        begin = F.struct(F.col("first").alias("now"), F.array().cast("array<bigint>").alias("all"))
        step = lambda s, x: F.when(x["_hour"] == floor(s["now"]), F.struct(x["value"].alias("now"), F.concat(s["all"], F.array(s["now"])).alias("all"))).otherwise(s)
        return chains.select(*group, F.explode(F.aggregate("links", begin, step)["all"]).alias("first"))
    #: Pointer doubling: jumps of 1, 2, 4 ... blocks; what is reached doubles with each.
    reached = roots
    jumps = links.where("value is not null").select(*group, "_hour", "value")
    while True:
        grown = _joined(reached.withColumn("_hour", floor(F.col("first"))), jumps, [*group, "_hour"], ["value"]).where("value is not null")
        reached = written(reached.unionByName(grown.select(*group, F.col("value").alias("first"))))
        over = jumps.select(*group, F.col("_hour").alias("_from"), floor(F.col("value")).alias("_hour"))
        jumps = written(_joined(over, jumps, [*group, "_hour"], ["value"]).where("value is not null").select(*group, F.col("_from").alias("_hour"), "value"))
        if jumps.isEmpty():
            return reached


def gap_blocks(blocks: DataFrame, group: list[str], duration: int) -> DataFrame:
    """For (group, block_start, last): gap_start and gap_end between blocks further apart
    than the duration."""
    order = Window.partitionBy(*group).orderBy("block_start", "first")
    before = blocks.withColumn("previous_last", F.lag("last").over(order))
    return before.where(F.col("first") - F.col("previous_last") > duration).select(
        *group, (F.col("previous_last") + duration).alias("gap_start"), F.col("first").alias("gap_end")
    )


def is_active(last: Column, start: Column, now: Column, duration: int) -> Column:
    return (now - last < duration) & (now < start + duration)
