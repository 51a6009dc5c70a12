"""Names of models, providers, projects and sessions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_model_name(model: Column) -> Column:
    """Without vendor prefix and without a trailing part of eight characters (a date)."""
    bare = F.regexp_replace(model, "^(?:anthropic/)?claude-", "")
    return F.when(bare.rlike("^[^-]*-.*-[^-]{8}$"), F.regexp_replace(bare, "-[^-]{8}$", "")).otherwise(bare)


def pricing_key(model: Column) -> Column:
    return F.translate(model, ".@", "--")


def plain_model_name(model: Column) -> Column:
    """Lower case, without ``custom:``, bracketed remarks and doubled or outer dashes."""
    bare = F.regexp_replace(F.regexp_replace(model, "^custom:", ""), r"\[[^\]]*\]", "")
    bare = F.regexp_replace(F.lower(F.trim(bare)), r"[.\s-]+", "-")
    return F.regexp_replace(bare, "^-+|-+$", "")


def plain_provider(provider: Column) -> Column:
    name = F.translate(F.lower(F.trim(provider)), "-", "_")
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "unknown")
        .when(name.isin("claude", "anthropic"), "anthropic")
        .when(name.isin("google", "google_ai", "gemini", "vertex", "vertex_ai"), "google")
        .when(name.isin("xai", "x_ai", "grok"), "xai")
        .otherwise(name)
    )


def provider_of_model(model: Column) -> Column:
    return (
        F.when(model.rlike("claude|opus|sonnet|haiku"), "anthropic")
        .when(model.rlike("^gpt-|-gpt-|chatgpt|^o[0-9]"), "openai")
        .when(model.contains("gemini"), "google")
        .when(model.contains("grok"), "xai")
        .otherwise("unknown")
    )


def default_model(provider: Column) -> Column:
    names = {"anthropic": "claude-unknown", "openai": "gpt-unknown", "google": "gemini-unknown", "xai": "grok-unknown"}
    out = F.lit("unknown")
    for key, value in names.items():
        out = F.when(provider == key, value).otherwise(out)
    return out


def prefixed(provider: Column, model: Column) -> Column:
    """The model alone, then under the prefixes that rate cards use for a provider."""
    under = {
        "anthropic": ("anthropic/", "openrouter/anthropic/"),
        "openai": ("openai/", "openrouter/openai/"),
        "google": ("google/", "vertex_ai/", "openrouter/google/"),
        "xai": ("xai/", "openrouter/x-ai/"),
    }
    out = F.array(F.concat(provider, F.lit("/"), model), F.concat(F.lit("openrouter/"), provider, F.lit("/"), model))
    out = F.when(provider == "unknown", F.array().cast("array<string>")).otherwise(out)
    for key, parts in under.items():
        out = F.when(provider == key, F.array(*(F.concat(F.lit(p), model) for p in parts))).otherwise(out)
    return F.array_distinct(F.concat(F.array(model), out))


def versioned_family(model: Column) -> Column:
    """``claude-opus-4.5`` and ``claude-opus-45`` become ``claude-opus-4-5``."""
    family = r"^(claude-(?:haiku|opus|sonnet)-)"
    dotted = F.regexp_replace(model, family + r"(\d*)\.(\d)", "$1$2-$3")
    return F.when(dotted != model, dotted).otherwise(F.regexp_replace(model, family + r"(\d)(\d)", "$1$2-$3"))


_SMALL = "^(?:dev|development|feat|feature|fix|bug|test|staging|prod|production|main|master|branch)$"


def project_name(project: Column, aliases: dict[str, str] | None = None) -> Column:
    """A readable name of a project folder; an alias of the folder or the name wins."""
    parts = lambda x, by: F.split(x, by)
    user = F.when(project.rlike(r"^.:\\Users\\|^\\Users\\"), F.lit("\\")).when(project.startswith("-Users-"), F.lit("-")).when(project.startswith("/Users/"), F.lit("/"))
    pieces = F.filter(F.when(user == "\\", parts(project, r"\\")).when(user == "-", parts(project, "-")).otherwise(parts(project, "/")), lambda x: x != "")
    at = F.array_position(pieces, F.lit("Users"))
    after = lambda n: F.array_join(F.slice(pieces, (at + n).cast("int"), F.greatest(F.size(pieces), F.lit(1))), "-")
    own = F.when(at + 2 < F.size(pieces), after(3)).when(at + 1 < F.size(pieces), after(2)).otherwise(project)
    outer = r"^[/\\-]+|[/\\-]+$"
    name = F.when(user.isNotNull(), own).otherwise(F.regexp_replace(project, outer, ""))
    hexed = name.rlike(r"^[0-9A-Fa-f.]*(?:-[0-9A-Fa-f.]*){4,}$")
    name = F.when(hexed, F.array_join(F.slice(F.split(name, "-"), -2, 2), "-")).otherwise(name)
    name = F.regexp_replace(name, "(?s)--.*$", "")
    telling = F.filter(F.split(name, "-"), lambda x: (F.length(x) > 2) & ~F.lower(x).rlike(_SMALL))
    last = lambda n: F.array_join(F.slice(telling, -n, n), "-")
    shorter = F.when(F.length(last(2)) >= 6, last(2)).when(F.size(telling) >= 3, last(3)).otherwise(name)
    name = F.when(name.contains("-") & (F.octet_length(name) > 20) & (F.size(telling) >= 2), shorter).otherwise(name)
    name = F.regexp_replace(name, outer, "")
    name = F.when((project == "") | (project == "unknown"), "Unknown Project").when(name == "", project).otherwise(name)
    if not aliases:
        return name
    held = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    return F.coalesce(F.try_element_at(held, project), F.try_element_at(held, name), name)


def parse_aliases(text: str | None) -> dict[str, str]:
    """``a=b,c=d`` to a dict; parts without a name or a value are skipped."""
    pairs = (part.partition("=") for part in (text or "").split(","))
    return {a.strip(): b.strip() for a, eq, b in pairs if eq and a.strip() and b.strip()}


def claude_session(file: Column) -> tuple[Column, Column, Column]:
    """(project, session, project path) of a log file below a ``projects`` folder."""
    pieces = F.filter(F.split(file, "/"), lambda x: x != "")
    at = F.array_position(pieces, F.lit("projects")).cast("int")
    below = F.when(at > 0, F.slice(pieces, at + 1, F.size(pieces))).otherwise(pieces)
    n = F.size(below)
    stem = F.regexp_extract(F.element_at(below, -1), r"^(.+)\.jsonl$", 1)
    flat = (n == 2) & (stem != "")
    nested = (n >= 4) & (F.try_element_at(below, F.lit(-2)) == "subagents")
    joined = lambda k: F.nullif(F.array_join(F.slice(below, 1, F.greatest(n - k, F.lit(0))), "/"), F.lit(""))
    project = F.when(at > 0, F.coalesce(F.nullif(F.trim(F.try_element_at(below, F.lit(1))), F.lit("")), F.lit("unknown"))).otherwise("unknown")
    session = F.when(flat, stem).when(nested, F.try_element_at(below, F.lit(-3))).otherwise(F.coalesce(F.try_element_at(below, F.lit(-2)), F.lit("unknown")))
    where = F.when(flat, F.element_at(below, 1)).when(nested, F.coalesce(joined(3), F.lit("Unknown Project"))).otherwise(F.coalesce(joined(2), F.lit("Unknown Project")))
    return project, session, where


def model_label(label: Column, aliases: dict[str, str]) -> Column:
    """A model's display name, or what an alias says for exactly that name."""
    if not aliases:
        return label
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), label), label)
