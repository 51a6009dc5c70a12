"""Pricing usage rows: candidates to card rows, card rows to costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.costs import by_mode, token_cost
from tallyforge.functions.tokens import total_tokens
from tallyforge.sources.rates import Rate, match_models
from tallyforge.sources.textlogs import once, written

#: So many candidate lists with their rates are broadcast at most.
LISTS = 10_000


def price(usage: DataFrame, cards: list[dict[str, Rate]], mode: str = "auto") -> DataFrame:
    """``usage`` with cost and missing_pricing (the model, if no card has it and it matters).

    Distinct candidate lists are few: they are written once, matched with the cards, and up to
    ``LISTS`` of them are broadcast, so the facts stay where they are. Dealt by their lists, all facts
    of a model would go to one task.
    """
    lists = written(usage.where("candidates is not null").select("candidates").distinct())
    each = lists.select("candidates", F.posexplode("candidates").alias("place", "model"))
    rates = each.join(match_models(each, cards), "model").groupBy("candidates").agg(
        F.filter(F.sort_array(F.collect_list(F.struct("place", "rate"))), lambda x: x["rate"].isNotNull()).alias("_found")
    )
    few = lists.limit(LISTS + 1).count() <= LISTS
    rows = usage.join(F.broadcast(rates) if few else rates, "candidates", "left")
    billed = F.col("output_tokens") + F.when(F.col("bill_extra"), F.col("extra_tokens")).otherwise(0)
    rows = once(rows, "_costs", F.transform("_found", lambda x: token_cost(x["rate"], billed)))
    costs = F.coalesce("_costs", F.array().cast("array<double>"))
    first = F.coalesce(F.try_element_at(costs, F.lit(1)), F.lit(0.0))
    positive = F.coalesce(F.try_element_at(F.filter(costs, lambda c: c > 0), F.lit(1)), F.lit(0.0))
    rule = F.col("price_rule")
    computed = F.when(rule.isin("positive", "recorded_positive"), positive).otherwise(first)
    recorded = F.col("recorded_cost")
    cost = (
        F.when(rule == "recorded_positive", F.coalesce(F.when(recorded > 0, recorded), computed))
        .when(rule == "positive", computed)
        .when(rule == "never_recorded", F.lit(0.0) if mode == "display" else computed)
        .otherwise(by_mode(mode, recorded, computed))
    )
    unpriced = (F.size(costs) == 0) & (total_tokens() > 0) & F.col("model").isNotNull()
    covered = (recorded > 0) if mode == "auto" else F.lit(mode == "display")
    covered = F.when(rule == "recorded_positive", (recorded > 0) | F.lit(mode == "display")).otherwise(covered)
    missing = F.when(unpriced & ~F.coalesce(covered, F.lit(False)), F.col("model"))
    return rows.withColumns({"cost": cost, "missing_pricing": missing}).drop("_found", "_costs")
