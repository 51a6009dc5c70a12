"""Rate cards: built-in, from JSON, overrides; and which card row a model name means."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Dollars a million tokens (input, output, cache creation, cache read), and
# whether the cache rate is published or derived. The card is a few dozen rows.
BUILT_IN = [
    ("claude-opus-4-5", 5, 25, 6.25, 0.5, True),
    ("claude-opus-4-6", 5, 25, 6.25, 0.5, True),
    ("claude-opus-4-7", 5, 25, 6.25, 0.5, True),
    ("claude-opus-4-8", 5, 25, 6.25, 0.5, True),
    ("claude-haiku-4-5", 1, 5, 1.25, 0.1, True),
    ("claude-opus-4", 15, 75, 18.75, 1.5, True),
    ("claude-sonnet-4-6", 3, 15, 3.75, 0.3, True),
    ("claude-sonnet-4", 3, 15, 3.75, 0.3, True),
    ("claude-3-5-haiku", 0.8, 4, 1, 0.08, True),
    ("claude-3-5-haiku-20241022", 0.8, 4, 1, 0.08, True),
    ("claude-3-opus", 15, 75, 18.75, 1.5, True),
    ("claude-3-sonnet", 3, 15, 3.75, 0.3, True),
    ("claude-3-haiku", 0.25, 1.25, 0.3, 0.03, True),
    ("gpt-5", 1.25, 10, 1.25, 0.125, True),
    ("gpt-5.5", 5, 30, 5, 0.5, True),
    ("grok-4.3", 1.25, 2.5, 1.25, 0.125, False),
    ("moonshot/kimi-k2.5", 0.6, 3, 0.75, 0.1, True),
    ("moonshot/kimi-k2.6", 0.95, 4, 1.1875, 0.16, True),
    ("gpt-5.1", 1.25, 10, 1.25, 0.125, True),
    ("gpt-5.1-codex", 1.25, 10, 1.25, 0.125, True),
    ("gpt-5.2-codex", 1.75, 14, 1.75, 0.175, True),
    ("gpt-5.3-codex", 1.75, 14, 1.75, 0.175, True),
    ("gpt-5.2", 1.75, 14, 1.75, 0.175, True),
    ("gpt-5.4", 2.5, 15, 2.5, 0.25, True),
    ("gpt-5.4-mini", 0.75, 4.5, 0.75, 0.075, True),
    ("gpt-5.4-nano", 0.2, 1.25, 0.2, 0.02, True),
    ("glm-4.5", 0.6, 2.2, 0, 0.11, True),
    ("zai/glm-4.5", 0.6, 2.2, 0, 0.11, True),
    ("zai/glm-4.5-x", 2.2, 8.9, 0, 0.45, True),
    ("zai/glm-4.5-air", 0.2, 1.1, 0, 0.03, True),
    ("zai/glm-4.5-airx", 1.1, 4.5, 0, 0.22, True),
    ("zai/glm-4.5v", 0.6, 1.8, 0, 0.11, True),
    ("zai/glm-4-32b-0414-128k", 0.1, 0.1, 0, 0, True),
    ("zai/glm-4.5-flash", 0, 0, 0, 0, True),
    ("glm-4.6", 0.6, 2.2, 0, 0.11, True),
    ("glm-4.7", 0.6, 2.2, 0, 0.11, True),
    ("glm-5", 1, 3.2, 0, 0.2, True),
    ("glm-5-turbo", 1.2, 4, 0, 0.24, True),
    ("glm-5.1", 1.4, 4.4, 0, 0.26, True),
]
# Rates above 200,000 tokens, multipliers of fast service, context sizes, aliases.
ABOVE_TIER = {"claude-sonnet-4": (6, 22.5, 7.5, 0.6)}
FAST_EXACT = {"gpt-5.5": 2.5, "gpt-5.4": 2.0, "gpt-5.3-codex": 2.0}
FAST_FAMILY = {"claude-opus-4-6": 6.0, "claude-opus-4-7": 6.0, "claude-opus-4-8": 2.0}
CONTEXT_LIMITS = {
    1_050_000: ["gpt-5.5", "gpt-5.4"],
    1_000_000: ["grok-4.3", "claude-opus-4-8", "claude-opus-4-7", "claude-opus-4-6", "claude-sonnet-4-6"],
    262_144: ["moonshot/kimi-k2.5", "moonshot/kimi-k2.6"],
    200_000: ["claude-opus-4-5", "claude-haiku-4-5", "claude-opus-4", "claude-sonnet-4", "claude-3-5-haiku", "claude-3-5-haiku-20241022", "claude-3-opus", "claude-3-sonnet", "claude-3-haiku"],
}
ALIASES = {"gpt-5.3-spark": "gpt-5.3-codex-spark"}


@dataclass(frozen=True)
class Rate:
    model: str
    input: float = 0.0
    output: float = 0.0
    cache_create: float = 0.0
    cache_read: float = 0.0
    cache_read_explicit: bool = False
    input_above: float | None = None
    output_above: float | None = None
    cache_create_above: float | None = None
    cache_read_above: float | None = None
    fast_multiplier: float = 1.0
    context_limit: int | None = None


RATE_DDL = (
    "model string, input double, output double, cache_create double, cache_read double, cache_read_explicit boolean, input_above double, "
    "output_above double, cache_create_above double, cache_read_above double, fast_multiplier double, context_limit long"
)


def fast_multiplier(model: str) -> float:
    """Exact names first; then families, also with a suffix after a dash or below a provider."""
    if model in FAST_EXACT:
        return FAST_EXACT[model]
    for part in model.replace(".", "-").replace("@", "-").replace(":", "/").split("/"):
        for base, times in FAST_FAMILY.items():
            _, found, rest = part.rpartition(base)
            if found and (not rest or rest.startswith("-")):
                return times
    return 1.0


def built_in() -> dict[str, Rate]:
    limits = {m: n for n, models in CONTEXT_LIMITS.items() for m in models}
    million = lambda x: x / 1e6
    out = {}
    for model, *rates, explicit in BUILT_IN:
        above = [million(x) for x in ABOVE_TIER[model]] if model in ABOVE_TIER else [None] * 4
        out[model] = Rate(model, *map(million, rates), explicit, *above, fast_multiplier(model), limits.get(model))
    return out


_FULL = {
    "input": ("input_cost_per_token", "i"),
    "output": ("output_cost_per_token", "o"),
    "cache_create": ("cache_creation_input_token_cost", "cc"),
    "cache_read": ("cache_read_input_token_cost", "cr"),
    "input_above": ("input_cost_per_token_above_200k_tokens", "ia"),
    "output_above": ("output_cost_per_token_above_200k_tokens", "oa"),
    "cache_create_above": ("cache_creation_input_token_cost_above_200k_tokens", "cca"),
    "cache_read_above": ("cache_read_input_token_cost_above_200k_tokens", "cra"),
}


def _number(value):
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def load_per_token(text: str, card: dict[str, Rate] | None = None) -> dict[str, Rate]:
    """A JSON object of models with rates a token; entries without input and output rates
    are skipped. Missing cache rates follow from the input rate (1.25 and 0.1 times)."""
    out = dict(card or {})
    try:
        models = json.loads(text)
    except ValueError:
        return out
    for model, raw in models.items() if isinstance(models, dict) else ():
        if not isinstance(raw, dict):
            continue
        got = {name: next((_number(raw[k]) for k in keys if k in raw), None) for name, keys in _FULL.items()}
        if got["input"] is None or got["output"] is None:
            continue
        explicit = got["cache_read"] is not None
        got["cache_create"] = got["input"] * 1.25 if got["cache_create"] is None else got["cache_create"]
        got["cache_read"] = got["input"] * 0.1 if not explicit else got["cache_read"]
        provider = raw.get("provider_specific_entry")
        fast = _number(provider.get("fast")) if isinstance(provider, dict) else None
        limit = raw.get("max_input_tokens")
        out[model] = Rate(model, **got, cache_read_explicit=explicit, fast_multiplier=fast or fast_multiplier(model), context_limit=limit if isinstance(limit, int) else None)
    return out


def load_per_million(text: str) -> dict[str, Rate]:
    """Providers with models with rates a million tokens; all or nothing if the shape is off."""
    try:
        providers = json.loads(text)
    except ValueError:
        return {}
    out: dict[str, Rate] = {}
    if not isinstance(providers, dict) or not all(isinstance(p, dict) and isinstance(p.get("models"), dict) for p in providers.values()):
        return {}
    for provider in providers.values():
        for model, raw in provider["models"].items():
            cost = raw.get("cost") if isinstance(raw, dict) else None
            if not isinstance(cost, dict) or _number(cost.get("input")) is None or _number(cost.get("output")) is None:
                continue
            per = {k: _number(cost.get(k)) for k in ("input", "output", "cache_write", "cache_read")}
            limit = (raw.get("limit") or {}).get("context") if isinstance(raw.get("limit"), dict) else None
            out.setdefault(
                model,
                Rate(
                    model,
                    per["input"] / 1e6,
                    per["output"] / 1e6,
                    per["input"] * 1.25 / 1e6 if per["cache_write"] is None else per["cache_write"] / 1e6,
                    per["input"] * 0.1 / 1e6 if per["cache_read"] is None else per["cache_read"] / 1e6,
                    per["cache_read"] is not None,
                    fast_multiplier=fast_multiplier(model),
                    context_limit=limit if isinstance(limit, int) else None,
                ),
            )
    return out


def override(card: dict[str, Rate], model: str, **given) -> dict[str, Rate]:
    """``card`` with the given fields of one exact model replaced; an unknown model starts
    from zero. Derived cache rates follow a new input rate in proportion."""
    base = card.get(model, Rate(model))
    new = {k: v for k, v in given.items() if v is not None}
    if "input" in new and base.input > 0 and not base.cache_read_explicit:
        times = new["input"] / base.input
        for name in ("cache_create", "cache_read", "cache_create_above", "cache_read_above"):
            held = getattr(base, name)
            if name not in new and held:
                new[name] = held * times
    explicit = base.cache_read_explicit or "cache_read" in given and given["cache_read"] is not None
    return card | {model: replace(base, **new, cache_read_explicit=explicit)}


def frame(spark: SparkSession, card: dict[str, Rate]) -> DataFrame:
    return spark.createDataFrame([tuple(r.__dict__.values()) for r in card.values()], RATE_DDL)


def _within(value: str, key: str) -> bool:
    """Does ``key`` stand in ``value`` as a whole name? Its neighbours are no ASCII letters or
    digits; behind a key that ends in a digit no further number follows, except a date."""
    if not key:
        return False
    behind = r"(?![0-9A-Za-z])"
    if key[-1] in "0123456789":
        behind += r"(?![-.](?![0-9]{8}(?![0-9A-Za-z]))[0-9])"
    return re.search(rf"(?<![0-9A-Za-z]){re.escape(key)}{behind}", value) is not None


def _parts(name: str) -> set[str]:
    """Runs of ASCII letters and digits. A name that stands whole in another has all its parts there."""
    return set(re.findall("[0-9A-Za-z]+", name))


class NameIndex:
    """A card's keys by their parts, so that a name is held against few of them."""

    def __init__(self, keys):
        self.keys = set(keys)
        self.holding: dict[str, list[str]] = {}
        for key in sorted(self.keys):
            for part in _parts(key) or {""}:
                self.holding.setdefault(part, []).append(key)
        self.rarest: dict[str, list[str]] = {}
        for key in sorted(self.keys):
            self.rarest.setdefault(min(_parts(key) or {""}, key=lambda p: (len(self.holding[p]), p)), []).append(key)

    def near(self, name: str) -> set[str]:
        """Keys that may stand in the name, or it in them."""
        parts = _parts(name)
        out = {key for part in parts | {""} for key in self.rarest.get(part, ())}
        fewest = min((self.holding.get(part, []) for part in parts), key=len, default=self.keys)
        return out | set(fewest)


def card_key(model: str, keys: list[str] | NameIndex) -> str | None:
    """The card row a model means: its own, else the longest (then first) that holds it or
    that it holds, as written or with dots and at-signs read as dashes; else by alias."""
    index = keys if isinstance(keys, NameIndex) else NameIndex(keys)

    def find(name):
        if name in index.keys:
            return name
        flat = name.replace(".", "-").replace("@", "-")
        fits = []
        for key in index.near(name):
            other = key.replace(".", "-").replace("@", "-")
            if _within(name, key) or _within(key, name) or _within(flat, other) or _within(other, flat):
                fits.append(key)
        return min(fits, key=lambda k: (-len(k.encode()), k), default=None)

    return find(model) or (find(ALIASES[model]) if model in ALIASES else None)


def match_models(models: DataFrame, cards: list[dict[str, Rate]]) -> DataFrame:
    """Distinct ``model`` names with ``rate`` (struct of the card row, null if unpriced).

    Later cards are asked only for what the earlier ones miss. Each distinct name meets the
    keys that share a part with it (an index of the card's size), and facts join the result.
    """
    spark = models.sparkSession
    held = [(NameIndex(card), card) for card in cards]

    @F.pandas_udf("string")
    def key(names: pd.Series) -> pd.Series:
        out = []
        for name in names:
            hit = next(((n, k) for n, (keys, _) in enumerate(held) if name and (k := card_key(name, keys))), None)
            out.append(f"{hit[0]}:{hit[1]}" if hit else None)
        return pd.Series(out, dtype=object)

    rows = [(f"{n}:{m}", *r.__dict__.values()) for n, (_, card) in enumerate(held) for m, r in card.items()]
    rates = spark.createDataFrame(rows, "card_key string, " + RATE_DDL)
    rates = rates.select("card_key", F.struct(*[c for c in rates.columns if c != "card_key"]).alias("rate"))
    return models.select("model").distinct().withColumn("card_key", key("model")).join(rates, "card_key", "left").select("model", "rate")
