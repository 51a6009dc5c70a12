"""Text of numbers, money, time left and models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_number(n: Column) -> Column:
    return F.format_number(n, 0)


def currency(x: Column) -> Column:
    return F.format_string("$%.2f", x.cast("double"))


def remaining_time(minutes: Column) -> Column:
    hours, rest = F.floor(minutes / 60), minutes % 60
    return F.when(hours > 0, F.concat_ws("", hours.cast("string"), F.lit("h "), rest.cast("string"), F.lit("m left"))).otherwise(
        F.concat(rest.cast("string"), F.lit("m left"))
    )


def model_list(models: Column) -> Column:
    """A bullet for each distinct model."""
    return F.array_join(F.transform(F.array_sort(F.array_distinct(models)), lambda m: F.concat(F.lit("- "), m)), "\n")


def context_share(tokens: Column, limit: Column) -> Column:
    return F.when(F.coalesce(limit, F.lit(0)) == 0, 0).otherwise(F.round(tokens / limit * 100)).cast("long")


def context_color(percent: Column, low: int = 50, medium: int = 80) -> Column:
    return F.when(percent < low, "green").when(percent < medium, "yellow").otherwise("red")
