"""Dotted paths: segments joined by '.', with '.' and '\\' inside a segment escaped by '\\'; '*' stands for any member."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shalebed.functions import truth


def escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("\\"), F.lit("\\\\")), F.lit("."), F.lit("\\."))


def join_path(segments: Column) -> Column:
    return F.array_join(F.transform(segments, escape), ".")


def split_path(path: Column) -> Column:
    """Inverse of join_path. Each piece is found as a run of escaped pairs and plain characters."""
    pieces = F.regexp_extract_all(F.concat(path, F.lit(".")), F.lit(r"((?:\\.|[^.\\])*)\."), 1)
    return F.when(path == "", F.array().cast("array<string>")).otherwise(F.transform(pieces, lambda s: F.regexp_replace(s, r"\\(.)", "$1")))


def append_segment(path: Column, segment: Column) -> Column:
    return F.when(path == "", escape(segment)).otherwise(F.concat_ws(".", path, escape(segment)))


def scope_path(prefix: Column, path: Column) -> Column:
    return F.when(prefix == "", path).when(path == "", prefix).otherwise(F.concat_ws(".", prefix, path))


def is_descendant(path: Column, ancestor: Column) -> Column:
    """Strictly below, by whole segments; every path but the root is below the root."""
    return F.when(ancestor == "", path != "").otherwise(path.startswith(F.concat(ancestor, F.lit("."))))


def item_path(path: Column) -> Column:
    return F.concat(path, F.lit("[*]"))


def dynamic_key_path(path: Column) -> Column:
    return F.concat_ws(".", path, F.lit("{*}"))


def pointer_escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def split_segments(path: str) -> list[str]:
    """split_path of a plain string."""
    return [re.sub(r"\\(.)", r"\1", m) for m in re.findall(r"((?:\\.|[^.\\])*)(?:\.|$)", path)[:-1]] if path else []


def join_segments(segments: list[str]) -> str:
    return ".".join(s.replace("\\", "\\\\").replace(".", "\\.") for s in segments)


def lookup(document: Column, path: str, kind: str = "string") -> Column:
    """Value at a literal dotted path of a VARIANT, or NULL; escaped dots belong to their segment."""
    return truth.get(document, *split_segments(path), kind=kind)


def lookup_all(document: Column, path: str) -> Column:
    """array<variant>: all values at a path whose `*` segments stand for any member of an object or array, in order; empty if there are none."""
    out = F.array(document)
    for s in split_segments(path):
        if s == "*":
            out = F.flatten(F.transform(out, lambda v: F.coalesce(truth.items(v), F.transform(F.array_sort(F.map_entries(truth.members(v)), lambda x, y: F.when(x["key"] < y["key"], -1).otherwise(1)), lambda e: e["value"]), F.array().cast("array<variant>"))))
        else:
            out = F.filter(_members_named(out, s), lambda v: v.isNotNull())
    return out


def _members_named(values: Column, name: str) -> Column:
    return F.transform(values, lambda v: truth.get(v, name))


def strip_prefix(path: Column, prefix: Column) -> Column:
    """The path below the prefix; NULL if it is not below. Every path is below the root."""
    return F.when(prefix == "", path).when(path.startswith(F.concat(prefix, F.lit("."))), F.substring(path, F.length(prefix) + 2, F.lit(2**31 - 1)))
