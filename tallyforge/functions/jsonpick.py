"""Typed picks from a VARIANT column: strict about kinds, never failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = "BIGINT"


def path(*keys: str | int) -> str:
    return "$" + "".join(f"[{k}]" if isinstance(k, int) else f'["{k}"]' for k in keys)


def node(v: Column, *keys) -> Column:
    return F.try_variant_get(v, path(*keys), "variant") if keys else v


def typed(v: Column, ddl: str, *keys) -> Column:
    """The node in a given shape, read in one pass; null, here or further in, where its kind is another.
    Fields left as ``variant`` keep their kinds, and JSON nulls there aren't null. Far cheaper than
    a walk from the top for each field, or than ``kind`` of a whole object, which visits all of it."""
    return F.try_variant_get(v, path(*keys), ddl)


def variants(names) -> str:
    """The shape of an object whose fields are asked one by one."""
    return ", ".join(f"`{k}`: variant" for k in names)


def kind(v: Column, *keys) -> Column:
    return F.schema_of_variant(node(v, *keys))


def exists(v: Column, *keys) -> Column:
    return F.coalesce(node(v, *keys).isNotNull(), F.lit(False))


def integer(v: Column, *keys) -> Column:
    """An integer number, else null."""
    return F.when(kind(v, *keys) == _INTEGER, F.try_variant_get(v, path(*keys), "long"))


def u64(v: Column, *keys) -> Column:
    """A non-negative integer number, else 0."""
    return F.coalesce(F.greatest(integer(v, *keys), F.lit(0)), F.lit(0))


def first_u64(v: Column, *paths: tuple) -> Column:
    """The first of several places that holds more than 0, else 0."""
    return F.coalesce(*(F.when(u64(v, *p) > 0, u64(v, *p)) for p in paths), F.lit(0))


def number(v: Column, *keys) -> Column:
    """Any JSON number as a double, else null."""
    return F.when(kind(v, *keys).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path(*keys), "double"))


def raw_text(v: Column, *keys) -> Column:
    """A JSON string as it is, else null."""
    return F.when(kind(v, *keys) == "STRING", F.try_variant_get(v, path(*keys), "string"))


def text(v: Column, *keys) -> Column:
    """A JSON string, trimmed, that isn't blank, else null."""
    return F.nullif(F.trim(raw_text(v, *keys)), F.lit(""))


def flag(v: Column, *keys) -> Column:
    return F.when(kind(v, *keys) == "BOOLEAN", F.try_variant_get(v, path(*keys), "boolean"))
