"""Guards: atomic tests of a document, compiled to Columns over VARIANT or typed data, to JSON-Schema conditions, and evaluated on values.

A guard on a missing value is false, except where it asks for absence, falsity or difference.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shalebed.functions import truth
from shalebed.functions.paths import split_segments
from shalebed.operators.lattice import canonical

FALSY = {"anyOf": [{"type": "null"}, {"const": False}, {"type": "number", "const": 0}, {"type": "string", "maxLength": 0}, {"type": "array", "maxItems": 0}, {"type": "object", "maxProperties": 0}]}
TRUTHY = {"not": FALSY}


@dataclass(frozen=True)
class Guard:
    """kind and its argument:

    truthy, not, with, range, default: none. eq, ne, contains: a literal. absent: none. matches, not_matches: a pattern.
    type_is, not_type_is: a kind. int_gt, int_lt, min_members: a bound. at_most_one: none. has_key, not_has_key: a key.
    range_key_prefix, range_key_equals, range_key_matches: a prefix, key or pattern that some key of the ranged object has.
    contains_member: (member, literal). contains_truthy: a member. or: more paths. any_of: lists of guards; not_guard, all_of: guards.
    """

    kind: str
    path: str = ""
    arg: object = None

    def column(self, types: dict[str, str]) -> Column:
        """Over typed columns named as the paths. A column of type variant takes every kind."""
        if self.kind in ("or", "any_of", "not_guard", "all_of"):
            return self._combined(lambda g: g.column(types))
        c, t, k = F.col(self.path), types[self.path], self.kind
        if t == "variant":
            return on_variant(k, self.arg, c)
        same = {
            "truthy": lambda: truth.truthy(c, t),
            "with": lambda: truth.truthy(c, t),
            "range": lambda: truth.truthy(c, t),
            "default": lambda: F.lit(True),
            "not": lambda: ~truth.truthy(c, t),
            "eq": lambda: c == F.lit(self.arg),
            "ne": lambda: ~c.eqNullSafe(F.lit(self.arg)),
            "absent": lambda: c.isNull(),
            "matches": lambda: c.rlike(self.arg),
            "not_matches": lambda: ~c.rlike(self.arg),
            "type_is": lambda: c.isNotNull() & F.lit(_json_kind(t) == self.arg),
            "not_type_is": lambda: c.isNull() | F.lit(_json_kind(t) != self.arg),
            "int_gt": lambda: c > self.arg,
            "int_lt": lambda: c < self.arg,
            "min_members": lambda: F.size(c) >= self.arg,
            "at_most_one": lambda: F.size(c) <= 1,
            "has_key": lambda: truth.has_key(c, self.arg),
            "not_has_key": lambda: ~truth.has_key(c, self.arg),
            "contains": lambda: F.array_contains(c, self.arg),
            "contains_member": lambda: F.exists(c, lambda x: x[self.arg[0]] == F.lit(self.arg[1])),
        }
        return F.coalesce(same[k](), F.lit(False))

    def on(self, document: Column) -> Column:
        """Over a VARIANT document, by the guard's path."""
        if self.kind in ("or", "any_of", "not_guard", "all_of"):
            return self._combined(lambda g: g.on(document))
        return on_variant(self.kind, self.arg, truth.get(document, *split_segments(self.path)))

    def _combined(self, one) -> Column:
        if self.kind == "or":
            parts = [one(Guard("truthy", p)) for p in (self.path, *self.arg)]
        elif self.kind == "any_of":
            parts = [functools.reduce(operator.and_, [one(g) for g in gs], F.lit(True)) for gs in self.arg]
        elif self.kind == "all_of":
            return functools.reduce(operator.and_, [one(g) for g in self.arg], F.lit(True))
        else:
            return ~one(self.arg)
        return functools.reduce(operator.or_, parts, F.lit(False))

    def paths(self) -> set[str]:
        if self.kind == "or":
            return {self.path, *self.arg}
        if self.kind == "any_of":
            return {p for gs in self.arg for g in gs for p in g.paths()}
        if self.kind == "all_of":
            return {p for g in self.arg for p in g.paths()}
        return self.arg.paths() if self.kind == "not_guard" else {self.path}

    def schema(self) -> dict:
        """The condition as an `if` for the document's root."""
        if self.kind == "or":
            return {"anyOf": [Guard("truthy", p).schema() for p in (self.path, *self.arg)]}
        if self.kind == "any_of":
            return {"anyOf": [all_schema(gs) for gs in self.arg]}
        if self.kind == "all_of":
            return all_schema(self.arg)
        if self.kind == "not_guard":
            return {"not": self.arg.schema()}
        a = self.arg
        leaf = {
            "truthy": lambda: TRUTHY,
            "with": lambda: TRUTHY,
            "range": lambda: TRUTHY,
            "default": lambda: {},
            "not": lambda: FALSY,
            "eq": lambda: {"const": a},
            "ne": lambda: {"not": {"const": a}},
            "absent": lambda: {"type": "null"},
            "matches": lambda: {"type": "string", "pattern": a},
            "not_matches": lambda: {"type": "string", "not": {"pattern": a}},
            "type_is": lambda: {"type": a},
            "not_type_is": lambda: {"not": {"type": a}},
            "int_gt": lambda: {"type": "integer", "exclusiveMinimum": a},
            "int_lt": lambda: {"type": "integer", "exclusiveMaximum": a},
            "min_members": lambda: {"type": "object", "minProperties": a},
            "at_most_one": lambda: {"maxItems": 1, "maxProperties": 1},
            "has_key": lambda: {"type": "object", "required": [a]},
            "not_has_key": lambda: {"not": {"type": "object", "required": [a]}},
            "range_key_equals": lambda: {"type": "object", "required": [a]},
            "range_key_prefix": lambda: some_key("^" + re.escape(a)),
            "range_key_matches": lambda: some_key(a),
            "contains": lambda: {"type": "array", "contains": {"const": a}},
            "contains_member": lambda: {"type": "array", "contains": {"type": "object", "properties": {a[0]: {"const": a[1]}}, "required": [a[0]]}},
            "contains_truthy": lambda: {"type": "array", "contains": {"type": "object", "properties": {a: TRUTHY}, "required": [a]}},
        }[self.kind]()
        needed = self.kind not in ("not", "absent", "ne", "default", "not_type_is", "not_has_key")
        for part in reversed(split_segments(self.path)):
            leaf = {"properties": {part: leaf}} | ({"required": [part], "type": "object"} if needed else {})
        return leaf


def some_key(pattern: str) -> dict:
    return {"type": "object", "not": {"propertyNames": {"not": {"pattern": pattern}}}}


def all_schema(guards) -> dict:
    guards = list(guards)
    return guards[0].schema() if len(guards) == 1 else {"allOf": [g.schema() for g in guards]} if guards else {}


def on_variant(kind: str, arg: object, v: Column) -> Column:
    """One test of the VARIANT value at a guard's path; NULL nowhere."""
    k = truth.kind_of(v)
    text = truth.get(v, kind="string")
    keys = F.map_keys(truth.members(v))
    whole = truth.get(v, kind="bigint")
    elements = truth.items(v)
    tests = {
        "truthy": lambda: truth.truthy_variant(v),
        "with": lambda: truth.truthy_variant(v),
        "range": lambda: F.when(k.isin("array", "object"), truth.truthy_variant(v)).when(k == "integer", whole > 0),
        "default": lambda: F.lit(True),  # a fallback stands in for whatever is falsy
        "not": lambda: ~truth.truthy_variant(v),
        "eq": lambda: truth.equals(v, arg),
        "ne": lambda: ~truth.equals(v, arg),
        "absent": lambda: truth.absent(v),
        "matches": lambda: (k == "string") & text.rlike(arg),
        "not_matches": lambda: (k == "string") & ~text.rlike(arg),
        "type_is": lambda: k.isin("integer", "number") if arg == "number" else k == arg,
        "not_type_is": lambda: ~F.coalesce(k.isin("integer", "number") if arg == "number" else k == arg, F.lit(False)),
        "int_gt": lambda: (k == "integer") & (whole > arg),
        "int_lt": lambda: (k == "integer") & (whole < arg),
        "min_members": lambda: F.size(keys) >= arg,
        "at_most_one": lambda: truth.size(v) <= 1,
        "has_key": lambda: truth.has_member(v, arg),
        "not_has_key": lambda: ~truth.has_member(v, arg),
        "range_key_prefix": lambda: F.exists(keys, lambda x: x.startswith(arg)),
        "range_key_equals": lambda: truth.has_member(v, arg),
        "range_key_matches": lambda: F.exists(keys, lambda x: x.rlike(arg)),
        "contains": lambda: F.exists(elements, lambda x: truth.equals(x, arg)),
        "contains_member": lambda: F.exists(_ranged(v), lambda x: truth.equals(truth.get(x, arg[0]), arg[1])),
        "contains_truthy": lambda: F.exists(_ranged(v), lambda x: truth.truthy_variant(truth.get(x, arg))),
    }
    return F.coalesce(tests[kind](), F.lit(False))


def _ranged(v: Column) -> Column:
    return F.coalesce(truth.items(v), F.map_values(truth.members(v)))


def evaluate(guards: list[Guard], document) -> bool | None:
    """Whether all guards hold on a plain document: False if one is refuted, None if one can't be decided (patterns that no engine here reads)."""
    found = [_evaluate(g, document) for g in guards]
    return False if False in found else None if None in found else True


def value_at(document, segments: list[str]):
    """(found, value) at literal segments."""
    for s in segments:
        if not isinstance(document, dict) or s not in document:
            return False, None
        document = document[s]
    return True, document


def is_truthy(value) -> bool:
    return bool(value) if not isinstance(value, float) else value != 0


def kind_of_value(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", list: "array"}.get(type(value), "object")


def matches_type(value, kind: str) -> bool:
    own = kind_of_value(value)
    return own == kind or kind == "number" and own == "integer"


def _same(a, b) -> bool:
    return type(a) is type(b) and a == b or (kind_of_value(a) in ("integer", "number") and kind_of_value(b) in ("integer", "number") and a == b)


def _evaluate(g: Guard, document) -> bool | None:
    k, a = g.kind, g.arg
    if k == "or":
        return any(_evaluate(Guard("truthy", p), document) for p in (g.path, *a))
    if k == "any_of":
        found = [evaluate(list(gs), document) for gs in a]
        return True if True in found else None if None in found else False
    if k == "all_of":
        return evaluate(list(a), document)
    if k == "not_guard":
        inner = _evaluate(a, document)
        return None if inner is None else not inner
    there, v = value_at(document, split_segments(g.path))
    ranged = v if isinstance(v, list) else list(v.values()) if isinstance(v, dict) else []
    try:
        return {
            "truthy": lambda: is_truthy(v),
            "with": lambda: is_truthy(v),
            "range": lambda: bool(ranged) or type(v) is int and v > 0,
            "default": lambda: True,
            "not": lambda: not is_truthy(v),
            "eq": lambda: there and _same(v, a),
            "ne": lambda: not (there and _same(v, a)),
            "absent": lambda: v is None,
            "matches": lambda: isinstance(v, str) and bool(re.search(a, v)),
            "not_matches": lambda: isinstance(v, str) and not re.search(a, v),
            "type_is": lambda: there and matches_type(v, a),
            "not_type_is": lambda: not (there and matches_type(v, a)),
            "int_gt": lambda: type(v) is int and v > a,
            "int_lt": lambda: type(v) is int and v < a,
            "min_members": lambda: isinstance(v, dict) and len(v) >= a,
            "at_most_one": lambda: isinstance(v, (list, dict)) and len(v) <= 1,
            "has_key": lambda: isinstance(v, dict) and a in v,
            "not_has_key": lambda: not (isinstance(v, dict) and a in v),
            "range_key_prefix": lambda: isinstance(v, dict) and any(x.startswith(a) for x in v),
            "range_key_equals": lambda: isinstance(v, dict) and a in v,
            "range_key_matches": lambda: isinstance(v, dict) and any(re.search(a, x) for x in v),
            "contains": lambda: isinstance(v, list) and any(_same(x, a) for x in v),
            "contains_member": lambda: any(isinstance(x, dict) and a[0] in x and _same(x[a[0]], a[1]) for x in ranged),
            "contains_truthy": lambda: any(isinstance(x, dict) and is_truthy(x.get(a)) for x in ranged),
        }[k]()
    except re.error:
        return None


def _json_kind(data_type: str) -> str:
    if data_type.startswith("array"):
        return "array"
    if data_type.startswith(("map", "struct")):
        return "object"
    return {"string": "string", "boolean": "boolean", "double": "number", "float": "number"}.get(data_type, "number" if data_type.startswith("decimal") else "integer")


def violates(guards: list[Guard], requirement: Guard, types: dict[str, str]) -> Column:
    """Rows for which every guard holds and the requirement does not."""
    out = F.lit(True)
    for g in guards:
        out = out & g.column(types)
    return out & ~requirement.column(types)


def overlay(guards: list[Guard], requirement: dict) -> dict:
    return {"if": all_schema(guards), "then": requirement}


def negated_members(guard: Guard) -> dict | None:
    """Every member violates the guard on a member; for the kinds that ask for some member."""
    a = guard.arg
    if guard.kind == "contains":
        return {"items": {"not": {"const": a}}}
    if guard.kind == "contains_member":
        bad = {"type": "object", "properties": {a[0]: {"const": a[1]}}, "required": [a[0]]}
    elif guard.kind == "contains_truthy":
        bad = {"type": "object", "properties": {a: TRUTHY}, "required": [a]}
    else:
        return None
    return {"items": {"not": bad}, "additionalProperties": {"not": bad}}


def absent_condition(path: str) -> dict | None:
    """The raw input lacks the path or holds null there; the root is never absent."""
    parts = split_segments(path)
    if not parts:
        return None
    inner: dict = {"type": "null"}
    for part in reversed(parts):
        inner = {"anyOf": [{"not": {"required": [part]}}, {"properties": {part: inner}}]}
    return inner


def int_preimage(greater: bool, bound: int) -> str | None:
    """A pattern of plain decimal strings whose whole number is surely past the bound; None where lengths don't decide it.

    Strings of more digits than the bound has are past it; this claims less than the cast does, on purpose.
    """
    digits = len(str(abs(bound)))
    if digits >= 18:
        return None
    if greater:
        return f"^[1-9][0-9]{{{digits},17}}$" if bound >= 0 else "^(0|[1-9][0-9]{0,17})$"
    return f"^-[1-9][0-9]{{{digits},17}}$" if bound <= 0 else "^(0|-[1-9][0-9]{0,17})$"


LOWERABLE = frozenset({"truthy", "with", "eq", "ne", "absent", "type_is", "matches", "int_gt", "int_lt", "has_key", "contains_member", "contains_truthy", "contains", "at_most_one", "min_members", "not_guard", "all_of", "any_of", "not", "or"})


def lowerable(guard: Guard) -> Guard | None:
    """The guard as a condition that values alone decide, or None; a path's own fallback says nothing about it."""
    if guard.kind in ("any_of", "all_of", "not_guard"):
        inner = [g for gs in guard.arg for g in gs] if guard.kind == "any_of" else list(guard.arg) if guard.kind == "all_of" else [guard.arg]
        return guard if all(lowerable(g) for g in inner) else None
    if guard.kind == "range":
        return Guard("truthy", guard.path)
    if guard.kind in ("not_type_is", "not_has_key"):
        return Guard("not_guard", arg=Guard({"not_type_is": "type_is", "not_has_key": "has_key"}[guard.kind], guard.path, guard.arg))
    if guard.kind == "range_key_equals":
        return Guard("has_key", guard.path, guard.arg)
    return guard if guard.kind in LOWERABLE else None


def lower_set(guards: list[Guard], target: str | None = None) -> list[Guard] | None:
    """All guards lowered, without defaults and without the target's own truthiness; None if one can't be, as a partial condition would claim too much."""
    out = []
    for g in guards:
        if g.kind == "default" or (g.kind in ("truthy", "with", "range") and g.path == target):
            continue
        low = lowerable(g)
        if low is None:
            return None
        if low not in out:
            out.append(low)
    return sorted(out, key=lambda g: (g.path, g.kind, canonical(repr(g.arg))))


def terminal_clause(guards: list[Guard]) -> Guard | None:
    """The condition of an abort as one guard, if every part of it can be lowered."""
    low = lower_set(guards)
    return None if low is None else low[0] if len(low) == 1 else Guard("all_of", arg=tuple(low))
