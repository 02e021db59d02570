"""Version constraints in the usual comparator language, compiled to Columns and to patterns.

Comparators are joined by commas or spaces (all must hold) and groups by || (one must). A comparator is =, !=, >, <, >=
or =>, <= or =<, ~ or ~>, ^, or none, before a version whose minor and patch number may be missing or x, X or *; `a - b`
is a range. A pre-release is only met by a comparator that names a pre-release itself.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_ID = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
VERSION = rf"^v?([0-9]+)(?:\.([0-9]+))?(?:\.([0-9]+))?(?:-({_ID}(?:\.{_ID})*))?(?:\+([0-9A-Za-z-]+(?:\.[0-9A-Za-z-]+)*))?$"
_COMPARATOR = re.compile(r"\s*(=>|>=|=<|<=|!=|~>|~|\^|=|>|<)?\s*v?(\d+|[xX*])(?:\.(\d+|[xX*]))?(?:\.(\d+|[xX*]))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?\s*")
_SAME = {"=>": ">=", "=<": "<=", "~>": "~", None: "=", "": "="}


@dataclass(frozen=True)
class Comparator:
    op: str
    major: int
    minor: int
    patch: int
    tag: str
    any_minor: bool
    any_patch: bool
    any_major: bool = False


def parse(constraint: str) -> list[list[Comparator]] | None:
    """Groups of comparators, or None where the text is no constraint."""
    groups = []
    for part in constraint.split("||"):
        part = re.sub(r"(\S+)\s+-\s+(\S+)", r">=\1 <=\2", part.strip())
        found, at = [], 0
        while at < len(part):
            m = _COMPARATOR.match(part, at)
            if not m or m.end() == at:
                return None
            op, numbers = _SAME.get(m[1], m[1]), [m[2], m[3], m[4]]
            wild = [x is None or x in "xX*" for x in numbers]
            n = [0 if w else int(x) for x, w in zip(numbers, wild, strict=True)]
            found.append(Comparator(op, n[0], 0 if wild[0] else n[1], 0 if wild[0] or wild[1] else n[2], m[5] or "", wild[0] or wild[1], any(wild), wild[0]))
            at = m.end()
            if at < len(part) and part[at] == ",":
                at += 1
        if not found:
            return None
        groups.append(found)
    return groups


def key(version: Column) -> Column:
    """Comparable struct: major, minor, patch, releases after pre-releases, and the tag's identifiers, numbers before names; NULL if it is no version."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(version, VERSION, i), F.lit("")).try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    tag = F.regexp_extract(version, VERSION, 4)
    ids = F.when(tag != "", F.transform(F.split(tag, r"\."), lambda x: F.struct((~x.rlike("^[0-9]+$")).alias("name"), x.try_cast("decimal(38,0)").alias("number"), x.alias("text")))).otherwise(F.array().cast("array<struct<name:boolean,number:decimal(38,0),text:string>>"))
    return F.when(version.rlike(VERSION), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"), (tag == "").alias("release"), ids.alias("ids")))


def is_version(version: Column) -> Column:
    return version.rlike(VERSION)


def compare(constraint: str, version: Column) -> Column:
    """Whether the version meets the constraint; NULL if it is no version. A constraint that can't be read is an error."""
    groups = parse(constraint)
    if groups is None:
        raise ValueError(f"no version constraint: {constraint!r}")
    k = key(version)
    out = F.lit(False)
    for group in groups:
        every = F.lit(True)
        for c in group:
            every = every & _holds(c, k)
        out = out | every
    return F.when(k.isNotNull(), out)


def _holds(c: Comparator, k: Column) -> Column:
    if c.any_major:
        test = F.lit(c.op in ("=", ">=", "<=", "~", "^"))
        return test if c.tag else test & k["release"]
    bound = key(F.lit(f"{c.major}.{c.minor}.{c.patch}" + (f"-{c.tag}" if c.tag else "")))
    major, minor, patch = (k[n] == bound[n] for n in ("major", "minor", "patch"))
    if c.op == "=" and not c.any_patch:
        test = k == bound
    elif c.op in "=~":
        near = major if c.any_minor else major & minor
        test = (k >= bound) & near
        if c.op == "~" and not c.any_patch and (c.major, c.minor, c.patch) == (0, 0, 0):
            test = F.lit(True)
    elif c.op == "^":
        if c.major or c.any_minor:
            near = major
        elif c.minor or c.any_patch:
            near = major & minor
        else:
            near = major & minor & patch
        test = (k >= bound) & near
    elif c.op == "!=":
        test = ~major if c.any_minor else ~(major & minor) if c.any_patch else k != bound
    elif c.op == ">":
        test = k["major"] > bound["major"] if c.any_minor else F.struct(k["major"], k["minor"]) > F.struct(bound["major"].alias("major"), bound["minor"].alias("minor")) if c.any_patch else k > bound
    elif c.op == "<=":
        test = k["major"] <= bound["major"] if c.any_minor else F.struct(k["major"], k["minor"]) <= F.struct(bound["major"].alias("major"), bound["minor"].alias("minor")) if c.any_patch else k <= bound
    else:
        test = k >= bound if c.op == ">=" else k < bound
    return test if c.tag else test & k["release"]


def pattern(constraint: str) -> str | None:
    """A pattern of exactly the versions that meet one plain <, <=, > or >= comparator without a tag; None for other constraints.

    A version may leave out minor and patch numbers, which count as 0, and have leading zeros.
    """
    groups = parse(constraint)
    if not groups or len(groups) != 1 or len(groups[0]) != 1:
        return None
    c = groups[0][0]
    if c.op not in ("<", "<=", ">", ">=") or c.tag or c.any_major:
        return None
    bound, cores = (c.major, c.minor, c.patch), []
    for written in (1, 2, 3):
        for decides in (0, 1, 2, 3):  # the first number that differs; 3: none does
            if decides == 3 and c.op in ("<", ">"):
                continue
            if any(bound[i] for i in range(written, min(decides, 3))):
                continue  # an omitted number is 0, so it can't equal this one
            if written <= decides < 3 and not (c.op.startswith("<") and bound[decides] > 0):
                continue
            parts = []
            for i in range(written):
                parts.append(_digits_equal(bound[i]) if i < decides else "[0-9]+" if i > decides else _digits_less(bound[i]) if c.op.startswith("<") else _digits_more(bound[i]))
            if None not in parts:
                cores.append(r"\.".join(parts))
    return r"^v?(?:" + "|".join(cores) + r")(?:\+[0-9A-Za-z.-]+)?$" if cores else None


def _digits_equal(n: int) -> str:
    return f"0*{n}" if n else "0+"


def _digits_less(n: int) -> str | None:
    s = str(n)
    out = [s[:i] + f"[0-{int(d) - 1}]" + "[0-9]" * (len(s) - i - 1) for i, d in enumerate(s) if d > "0"]
    out += ["[0-9]" * m for m in range(1, len(s))]
    return "0*(?:" + "|".join(dict.fromkeys(out)) + ")" if out else None


def _digits_more(n: int) -> str:
    s = str(n)
    out = [s[:i] + f"[{int(d) + 1}-9]" + "[0-9]" * (len(s) - i - 1) for i, d in enumerate(s) if d < "9"]
    return "0*(?:" + "|".join([*out, f"[1-9][0-9]{{{len(s)},}}"]) + ")"
