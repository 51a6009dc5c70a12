"""Usage logs as a stream: new files are picked up, replays dropped, days kept up to date.

An addition of this engine: the batch reports stay the reference point, and a stream over
the same rows ends with the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US = 3_600_000_000


def usage_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet usage rows that arrive below a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def without_replays(stream: DataFrame, keys: list[str], ts: str, late: str = "1 day") -> DataFrame:
    """Rows of which another with the same keys came within the lateness go."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def daily_totals(stream: DataFrame, ts: str, value: str, late: str | None = None) -> DataFrame:
    """Sums for each day; late rows count while their day is within the lateness (None: the
    stream has a watermark already)."""
    day = F.window(ts, "1 day")
    marked = stream if late is None else stream.withWatermark(ts, late)
    out = marked.groupBy(day).agg(F.count("*").alias("entries"), F.sum(value).alias("total"))
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("date"), "entries", "total")


def open_blocks(stream: DataFrame, group: str, us: str, value: str, duration: int = 5 * HOUR_US) -> DataFrame:
    """The activity block that each group is in, after every batch: state is one open block a
    group. Rows of a batch are put in order; a row older than the open block's last one
    counts into that block if it isn't before its start, else it is reported as late."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, entries, total, late = state.get if state.exists else (0, 0, 0, 0.0, 0)
        rows = pd.concat(frames).sort_values(us)
        closed = []
        for t, v in zip(rows[us], rows[value]):
            if entries and t < start:
                late += 1
                continue
            if entries and (t - start > duration or t - last > duration):
                closed.append((start, last, entries, total, late, True))
                entries, total = 0, 0.0
            if not entries:
                start = last = t
                start = t - t % HOUR_US
            last, entries, total = max(last, t), entries + 1, total + v
        state.update((int(start), int(last), int(entries), float(total), int(late)))
        out = [*closed, (start, last, entries, total, late, False)]
        yield pd.DataFrame([(key[0], *r) for r in out], columns=[group, "block_start", "last", "entries", "total", "late", "closed"])

    kind = dict(stream.dtypes)[group]
    return stream.groupBy(group).applyInPandasWithState(
        update,
        outputStructType=f"{group} {kind}, block_start long, last long, entries long, total double, late long, closed boolean",
        stateStructType="start long, last long, entries long, total double, late long",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )
