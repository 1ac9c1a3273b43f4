"""Schemaless JSON documents as columns: scalars, lists and dictionaries of an object."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entity(content: Column) -> dict[str, Column]:
    """attrs (name -> text), lists (name -> texts) and dicts (name -> name -> text); members nested in a list or dictionary are dropped."""
    raw = F.from_json(content, "map<string,string>")
    kind = lambda v: F.substring(F.ltrim(v), 1, 1)
    plain = lambda v: v.isNotNull() & ~kind(v).isin("{", "[")
    attrs = F.map_filter(raw, lambda _, v: plain(v))
    lists = F.transform_values(F.map_filter(raw, lambda _, v: kind(v) == "["), lambda _, v: F.filter(F.from_json(v, "array<string>"), plain))
    dicts = F.transform_values(F.map_filter(raw, lambda _, v: kind(v) == "{"), lambda _, v: F.map_filter(F.from_json(v, "map<string,string>"), lambda _, x: plain(x)))
    return {"attrs": attrs, "lists": lists, "dicts": dicts}


def attribute(attrs: Column, name: str, kind: str = "string", default=None) -> Column:
    """A typed attribute with a default for missing or unreadable ones."""
    return F.coalesce(F.try_element_at(attrs, F.lit(name)).try_cast(kind), F.lit(default).cast(kind))


def list_holds(lists: Column, name: str, item: str) -> Column:
    return F.coalesce(F.array_contains(F.try_element_at(lists, F.lit(name)), item), F.lit(False))


def dict_item(dicts: Column, name: str, item: str) -> Column:
    return F.try_element_at(F.try_element_at(dicts, F.lit(name)), F.lit(item))


def as_json(attrs: Column, lists: Column, dicts: Column) -> Column:
    """The object again, as JSON text: attributes, then lists, then dictionaries."""
    parts = F.array(attrs_json(attrs), F.to_json(lists), F.to_json(dicts))
    inner = F.filter(F.transform(parts, lambda x: F.substring(x, F.lit(2), F.length(x) - 2)), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(inner, ","), F.lit("}"))


def attrs_json(attrs: Column) -> Column:
    return F.to_json(attrs)
