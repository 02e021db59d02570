"""Requirements: what an aborting branch asks of a value, as Columns over VARIANT and as JSON Schema, with the targets they bind.

A requirement holds or fails; NULL nowhere. A missing value has no kind: only requirements that ask for presence, or
for a kind that null has not, fail on it.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shalebed.functions import truth
from shalebed.functions.guards import FALSY, TRUTHY
from shalebed.operators.lattice import allows_type

# Which content a quoted or plain YAML scalar can hold as it is.
DOUBLE_QUOTED = r'^([^"\\]|\\["\\/0abtnvfre N_LP]|\\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*$'
SINGLE_QUOTED = r"^([^']|'')*$"
PLAIN_BREAKS = r":(\s|$)|\s#|[\n\r]"
PLAIN_FIRST = r"^([,\[\]{}#&*!|>'\"%@`]|[-?:](\s|$))"
ACTION = "{{"


@dataclass(frozen=True)
class Requirement:
    """kind and its argument:

    schema_type, schema_type_even_null, truthy_implies_type, comparable_kind, not_schema_type: a kind. truthy, falsy: none.
    field_falsy, field_present, field_truthy: a field's segments. field_equals, field_not_equals: (segments, literal).
    any_of: lists of requirements. not_equals: a literal. has_member, has_member_even_defaulted: a key.
    matches, not_matches: (pattern, templated). length: (least, most), either may be None. member_host: kinds allowed
    beside objects. iterable: whether whole numbers are counts. indexable: a place. split_segments: (separator, n,
    whether other kinds pass). quoted_safe: (double or single, templated). printf_string: none. plain_safe: (first in
    its slot, templated).
    """

    kind: str
    arg: object = None

    def holds(self, v: Column) -> Column:
        """Of a VARIANT column, NULL being a missing value."""
        return F.coalesce(_TESTS[self.kind](v, self.arg), F.lit(False))

    def schema(self) -> dict:
        return _SCHEMAS[self.kind](self.arg)


def is_kind(v: Column, kind: str) -> Column:
    k = truth.kind_of(v)
    return F.coalesce(k.isin("integer", "number") if kind == "number" else k == kind, F.lit(False))


def _field(v: Column, path) -> Column:
    return truth.get(v, *path)


def _text(v: Column) -> Column:
    return F.when(truth.kind_of(v) == "string", truth.get(v, kind="string"))


def _strings_below(v: Column, depth: int = 3) -> Column:
    """Strings and keys of a value, at any of `depth` levels; containers below that have the text of their JSON."""
    own = F.when(truth.kind_of(v) == "string", F.array(truth.get(v, kind="string"))).otherwise(F.array().cast("array<string>"))
    if not depth:
        return F.when(truth.kind_of(v).isin("array", "object"), F.array(F.to_json(v))).otherwise(own)
    inner = F.coalesce(truth.items(v), F.map_values(truth.members(v)), F.array().cast("array<variant>"))
    keys = F.coalesce(F.map_keys(truth.members(v)), F.array().cast("array<string>"))
    return F.concat(own, keys, F.flatten(F.transform(inner, lambda x: _strings_below(x, depth - 1))))


def _matches(v: Column, arg, wanted: bool) -> Column:
    pattern, templated = arg if isinstance(arg, tuple) else (arg, False)
    found = _text(v).rlike(pattern)
    found = found if wanted else ~found
    return found | _text(v).contains(ACTION) if templated else found


def _split(v: Column, arg) -> Column:
    separator, n, other = arg
    long_enough = F.size(F.split(_text(v), re.escape(separator) if separator else "")) >= n
    return F.when(truth.kind_of(v) == "string", long_enough).otherwise(F.lit(bool(other)))


def _quoted(v: Column, arg) -> Column:
    style, templated = arg
    pattern = {"double": DOUBLE_QUOTED, "single": SINGLE_QUOTED}[style]
    safe = lambda s: s.rlike(pattern) | s.contains(ACTION) if templated else s.rlike(pattern)
    return F.forall(_strings_below(v), safe)


def _plain(v: Column, arg) -> Column:
    first, templated = arg
    s = _text(v)
    bad = s.rlike(PLAIN_BREAKS) | (s.rlike(PLAIN_FIRST) if first else F.lit(False))
    safe = ~bad | s.contains(ACTION) if templated else ~bad
    return F.when(truth.kind_of(v) == "string", safe).otherwise(True)


_TESTS = {
    "schema_type": lambda v, a: truth.absent(v) | is_kind(v, a),
    "schema_type_even_null": lambda v, a: v.isNull() | is_kind(v, a),
    "truthy_implies_type": lambda v, a: ~truth.truthy_variant(v) | is_kind(v, a),
    "truthy": lambda v, a: truth.truthy_variant(v),
    "falsy": lambda v, a: ~truth.truthy_variant(v),
    "field_falsy": lambda v, a: ~truth.truthy_variant(_field(v, a)),
    "field_equals": lambda v, a: truth.equals(_field(v, a[0]), a[1]),
    "field_present": lambda v, a: ~truth.absent(_field(v, a)),
    "field_truthy": lambda v, a: truth.truthy_variant(_field(v, a)),
    "any_of": lambda v, a: functools.reduce(operator.or_, [functools.reduce(operator.and_, [r.holds(v) for r in rs], F.lit(True)) for rs in a], F.lit(False)),
    "not_equals": lambda v, a: ~truth.equals(v, a),
    "field_not_equals": lambda v, a: ~truth.equals(_field(v, a[0]), a[1]),
    "comparable_kind": lambda v, a: truth.absent(v) | is_kind(v, a),
    "not_schema_type": lambda v, a: ~is_kind(v, a),
    "has_member": lambda v, a: truth.has_member(v, a),
    "has_member_even_defaulted": lambda v, a: truth.has_member(v, a),
    "matches": lambda v, a: _matches(v, a, True),
    "not_matches": lambda v, a: _matches(v, a, False),
    "length": lambda v, a: F.char_length(_text(v)).between(a[0] if a[0] is not None else 0, a[1] if a[1] is not None else 2**31 - 1),
    "member_host": lambda v, a: functools.reduce(operator.or_, [is_kind(v, k) for k in ("object", *a)]),
    "iterable": lambda v, a: truth.absent(v) | truth.kind_of(v).isin("array", "object", *(["integer"] if a else [])),
    "indexable": lambda v, a: F.when(truth.kind_of(v) == "array", F.size(truth.items(v)) > a).otherwise(truth.kind_of(v) == "string"),
    "split_segments": _split,
    "quoted_safe": _quoted,
    "printf_string": lambda v, a: truth.kind_of(v).isin("string", "object"),
    "plain_safe": _plain,
}


def _as_variant(text: Column) -> Column:
    return truth.get(F.to_variant_object(F.array(text)), 0)


def _at(path, leaf: dict, needed: bool) -> dict:
    for part in reversed(path):
        leaf = {"properties": {part: leaf}} | ({"required": [part], "type": "object"} if needed else {})
    return leaf


def _nullable(kind: str) -> dict:
    return {"type": kind} if kind == "null" else {"type": [kind, "null"]}


def _quoted_schema(a) -> dict:
    pattern = {"double": DOUBLE_QUOTED, "single": SINGLE_QUOTED}[a[0]]
    text = {"type": "string", "pattern": pattern}
    return {"anyOf": [text, {"type": "string", "pattern": r"\{\{"}]} if a[1] else {"not": {"type": "string", "not": text}}


def _split_schema(a) -> dict:
    sep = re.escape(a[0])
    text = {"type": "string", "pattern": "^" + f"[\\s\\S]*{sep}" * (a[1] - 1)} if a[1] > 1 else {"type": "string"}
    return {"anyOf": [text, {"not": {"type": "string"}}]} if a[2] else text


def _pattern_schema(a, wanted: bool) -> dict:
    pattern, templated = a if isinstance(a, tuple) else (a, False)
    if ecma_pattern(pattern) is None:
        return {"type": "string"}
    leaf = {"type": "string", "pattern": pattern} if wanted else {"type": "string", "not": {"pattern": pattern}}
    return {"anyOf": [leaf, {"type": "string", "pattern": r"\{\{"}]} if templated else leaf


_SCHEMAS = {
    "schema_type": _nullable,
    "schema_type_even_null": lambda a: {"type": a},
    "truthy_implies_type": lambda a: {"anyOf": [FALSY, {"type": a}]},
    "truthy": lambda a: TRUTHY,
    "falsy": lambda a: FALSY,
    "field_falsy": lambda a: _at(a, FALSY, False),
    "field_equals": lambda a: _at(a[0], {"const": a[1]}, True),
    "field_present": lambda a: _at(a, {"not": {"type": "null"}}, True),
    "field_truthy": lambda a: _at(a, TRUTHY, True),
    "any_of": lambda a: {"anyOf": [lower(rs) for rs in a]},
    "not_equals": lambda a: {"not": {"const": a}},
    "field_not_equals": lambda a: _at(a[0], {"not": {"const": a[1]}}, False),
    "comparable_kind": _nullable,
    "not_schema_type": lambda a: {"not": {"type": a}},
    "has_member": lambda a: {"type": "object", "required": [a]},
    "has_member_even_defaulted": lambda a: {"type": "object", "required": [a]},
    "matches": lambda a: _pattern_schema(a, True),
    "not_matches": lambda a: _pattern_schema(a, False),
    "length": lambda a: {"type": "string"} | ({"minLength": a[0]} if a[0] is not None else {}) | ({"maxLength": a[1]} if a[1] is not None else {}),
    "member_host": lambda a: {"type": sorted({"object", *a})} if a else {"type": "object"},
    "iterable": lambda a: {"type": ["array", *(["integer"] if a else []), "null", "object"]},
    "indexable": lambda a: {"anyOf": [{"type": "array", "minItems": a + 1}, {"type": "string"}]},
    "split_segments": _split_schema,
    "quoted_safe": _quoted_schema,
    "printf_string": lambda a: {"type": ["object", "string"]},
    "plain_safe": lambda a: {"not": {"type": "string", "pattern": PLAIN_BREAKS + ("|" + PLAIN_FIRST if a[0] else "")} | ({"not": {"pattern": r"\{\{"}} if a[1] else {})},
}


def ecma_pattern(pattern: str) -> str | None:
    """The pattern if a schema's validators read it as Go and Java do; None for flags, possessive or named groups, \\A, \\z, \\Q and POSIX or Unicode classes."""
    return None if re.search(r"\(\?[imsUx-]+[:)]|\(\?P?<[A-Za-z]|\\[AzZQE]|\[\[:|\\[pP]|[*+?}]\+", pattern) else pattern


def lower(requirements) -> dict:
    """All of them as one schema."""
    out = [r.schema() for r in requirements]
    return out[0] if len(out) == 1 else {"allOf": out} if out else {}


@dataclass(frozen=True)
class Target:
    """What the requirements bind. kind and its argument:

    value: none. members: none. members_except: keys. members_prefix: a prefix. members_where: (selector segments,
    literal, target segments). members_at: target segments. members_at_truthy: (selector segments, target segments).
    keys: none. allow_integer: whether a whole number, which has no members, passes as a count.
    """

    kind: str = "value"
    arg: object = None
    allow_integer: bool = False

    def holds(self, v: Column, requirements: list[Requirement]) -> Column:
        every = lambda x: functools.reduce(operator.and_, [r.holds(x) for r in requirements], F.lit(True))
        if self.kind == "value":
            return every(v)
        elements, fields = truth.items(v), truth.members(v)
        values, entries = F.coalesce(elements, F.map_values(fields)), F.map_entries(fields)
        a = self.arg
        if self.kind == "keys":
            places = (F.size(elements) == 0) | every(F.parse_json(F.lit("0")))  # an array's keys are its places
            test = F.coalesce(F.forall(F.map_keys(fields), lambda k: every(_as_variant(k))), places)
        elif self.kind == "members":
            test = F.forall(values, every)
        elif self.kind == "members_except":
            test = F.coalesce(F.forall(elements, every), F.forall(entries, lambda e: e["key"].isin(*a) | every(e["value"])))
        elif self.kind == "members_prefix":
            test = F.forall(entries, lambda e: ~e["key"].startswith(a) | every(e["value"]))
        elif self.kind == "members_where":
            test = F.forall(values, lambda x: ~truth.equals(truth.get(x, *a[0]), a[1]) | every(truth.get(x, *a[2])))
        elif self.kind == "members_at":
            test = F.forall(values, lambda x: truth.get(x, *a).isNotNull() & every(truth.get(x, *a)))
        elif self.kind == "members_at_truthy":
            test = F.forall(values, lambda x: ~truth.truthy_variant(truth.get(x, *a[0])) | every(truth.get(x, *a[1]) if a[1] else x))
        else:
            raise ValueError(self.kind)
        nothing = truth.absent(v)
        if self.kind == "members_prefix":
            nothing = nothing | F.coalesce(F.size(elements) == 0, F.lit(False))
        if self.allow_integer:
            nothing = nothing | (truth.kind_of(v) == "integer")
        return F.coalesce(nothing, F.lit(False)) | F.coalesce(test, F.lit(False))

    def schema(self, requirements: list[Requirement]) -> dict:
        leaf, a = lower(requirements), self.arg
        if self.kind == "value":
            return leaf
        kinds = ["array", *(["integer"] if self.allow_integer else []), "null", "object"]
        if self.kind == "keys":
            return {"type": kinds, "propertyNames": leaf} | ({} if allows_type(leaf, "integer") else {"maxItems": 0})
        if self.kind == "members_except":
            return {"type": kinds, "items": leaf, "properties": {k: {} for k in sorted(a)}, "additionalProperties": leaf}
        if self.kind == "members_prefix":
            return {"type": kinds, "maxItems": 0, "patternProperties": {"^" + re.escape(a): leaf}}
        if self.kind == "members_where":
            leaf = {"if": _at(a[0], {"const": a[1]}, True), "then": _at(a[2], leaf, True)}
        elif self.kind == "members_at":
            leaf = _at(a, leaf, True)
        elif self.kind == "members_at_truthy":
            leaf = {"if": _at(a[0], TRUTHY, True), "then": _at(a[1], leaf, False)}
        return {"type": kinds, "items": leaf, "additionalProperties": leaf}
