"""String functions of the template language as Columns."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shalebed.functions import semver, truth

_UNIT = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)(ns|us|\u00b5s|\u03bcs|ms|s|m|h)"
DURATION = rf"^[-+]?(0|({_UNIT})+)$"
URL = r"^([A-Za-z][A-Za-z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
NANOSECONDS = {"ns": 1, "us": 10**3, "\u00b5s": 10**3, "\u03bcs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def text_of(value: Column, data_type: str) -> Column:
    """toString: total. Null is <nil>, whole doubles have no fraction, strings stay; containers are JSON."""
    if data_type == "variant":
        k = truth.kind_of(value)
        text = F.when(k == "string", truth.get(value, kind="string")).when(k == "number", _number(truth.get(value, kind="double"))).when(k == "null", "<nil>").otherwise(F.to_json(value))
    elif data_type in ("double", "float"):
        text = _number(value)
    elif data_type.startswith(("array", "map", "struct")):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("<nil>"))


def _number(x: Column) -> Column:
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def quote(s: Column) -> Column:
    """In double quotes, with quotes, backslashes and control characters escaped; null renders nothing."""
    out = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for c, e in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\x07", "\\a"), ("\x08", "\\b"), ("\x0c", "\\f"), ("\x0b", "\\v")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit(""))


def squote(s: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), s, F.lit("'")), F.lit(""))


def b64enc(s: Column) -> Column:
    return F.replace(F.base64(s.cast("binary")), F.lit("\r\n"), F.lit(""))  # Spark breaks lines after 76 characters


def b64dec(s: Column) -> Column:
    return F.unbase64(s).cast("string")


def trim_prefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), F.substring(s, len(prefix) + 1, 2**31 - 1)).otherwise(s)


def trim_suffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), F.left(s, F.length(s) - len(suffix))).otherwise(s)


def trim_all(s: Column, cutset: str) -> Column:
    return F.btrim(s, F.lit(cutset))


def trunc(s: Column, n: int) -> Column:
    """First n characters, or the last -n."""
    return F.left(s, F.lit(n)) if n >= 0 else F.right(s, F.lit(-n))


def substr(s: Column, start: int, end: int) -> Column:
    """[start, end) counted from 0; a negative start is the beginning, a negative end the end."""
    start = max(0, start)
    return F.substring(s, start + 1, max(0, end - start)) if end >= 0 else F.substring(s, start + 1, 2**31 - 1)


def repeat(s: Column, n: int) -> Column:
    return F.repeat(s, max(0, n))


def indent(s: Column, n: int) -> Column:
    return F.concat(F.lit(" " * n), F.replace(s, F.lit("\n"), F.lit("\n" + " " * n)))


def nindent(s: Column, n: int) -> Column:
    return F.concat(F.lit("\n"), indent(s, n))


def sha1sum(s: Column) -> Column:
    return F.sha1(s.cast("binary"))


def sha256sum(s: Column) -> Column:
    return F.sha2(s, 256)


def sha512sum(s: Column) -> Column:
    return F.sha2(s, 512)


@F.pandas_udf(LongType())
def _adler32(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else zlib.adler32(v.encode("utf-8", "surrogatepass"))).astype("Int64")


def adler32sum(s: Column) -> Column:
    """By Arrow batches: a built-in would fold byte by byte in an interpreted lambda."""
    return _adler32(s)


def _numbered(parts: Column) -> Column:
    return F.map_from_arrays(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.concat(F.lit("_"), i.cast("string"))), parts)


def split_map(s: Column, separator: str) -> Column:
    """{_0: .., _1: ..}"""
    return _numbered(split_list(s, separator))


def split_list(s: Column, separator: str, limit: int = -1) -> Column:
    return F.split(s, "\\Q" + separator + "\\E", limit)


def urlquery(s: Column) -> Column:
    return F.url_encode(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def trim(s: Column) -> Column:
    """Without white space at its ends (all of Unicode's, not blanks alone)."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def replace(s: Column, old: str, new: str) -> Column:
    return F.replace(s, F.lit(old), F.lit(new))


def regex_match(pattern: str, s: Column) -> Column:
    return s.rlike(pattern)


def regex_replace_all(s: Column, pattern: str, new: str) -> Column:
    """`new` names groups as ${1} or $1."""
    return F.regexp_replace(s, pattern, re.sub(r"\$\{(\d+)\}", r"$\1", new))


def regex_replace_all_literal(s: Column, pattern: str, new: str) -> Column:
    """`new` is taken as it is."""
    return F.regexp_replace(s, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))


def regex_split(s: Column, pattern: str, n: int = -1) -> Column:
    """At most n pieces, the last with the rest; all of them for n < 0, none for 0."""
    return F.array().cast("array<string>") if n == 0 else F.split(s, pattern, n)


def contains(needle: str, s: Column) -> Column:
    return s.contains(needle)


def has_prefix(prefix: str, s: Column) -> Column:
    return s.startswith(prefix)


def has_suffix(suffix: str, s: Column) -> Column:
    return s.endswith(suffix)


def split_n(s: Column, separator: str, n: int) -> Column:
    """{_0: .., _1: ..} of at most n pieces."""
    return _numbered(split_list(s, separator, n))


def join(values: Column, separator: str) -> Column:
    """Null items are left out."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), separator)


def cat(*values: Column) -> Column:
    """With blanks between; nulls are left out."""
    return F.concat_ws(" ", *[v.cast("string") for v in values])


def print_(*values: tuple[Column, str]) -> Column:
    """Operands (column, type) one after another, with a blank between two that are both no strings; null is <nil>."""
    parts = []
    for i, (v, t) in enumerate(values):
        if i and t != "string" and values[i - 1][1] != "string":
            parts.append(F.lit(" "))
        parts.append(text_of(v, t))
    return F.concat(*parts)


def htpasswd_contract(user: Column) -> Column:
    """Whether a user name can be written to a password file; the salted digest itself differs in every run."""
    return ~user.contains(":")


def semver_key(version: Column) -> Column:
    return semver.key(version)


def semver_part(version: Column, part: str) -> Column:
    """major, minor or patch as a number; NULL if it is no version."""
    return semver.key(version)[part].cast("bigint")


def semver_compare(constraint: str, version: Column) -> Column:
    return semver.compare(constraint, version)


_VERBS = re.compile(r"%([-+# 0]*)(\d*)((?:\.\d+)?)([a-zA-Z%])")


def printf(fmt: str, *args: Column, types: tuple[str, ...] = ()) -> Column:
    """Verbs %s %v %d %f %g %e %x %X %o %q %t %c %T %%, with flags and width. `types` are the operands' types, where a verb depends on them."""
    out, at, n = [], 0, 0
    for m in _VERBS.finditer(fmt):
        out.append(F.lit(fmt[at : m.start()]))
        at = m.end()
        flags, width, precision, verb = m.groups()
        if verb == "%":
            out.append(F.lit("%"))
            continue
        if n >= len(args):
            out.append(F.lit(f"%!{verb}(MISSING)"))
            continue
        v, t = args[n], types[n] if n < len(types) else "string"
        n += 1
        if verb == "T":
            out.append(F.lit(GO_TYPES.get(t, "string")))
        elif verb == "q":
            out.append(_padded(quote(v.cast("string")), flags, width))
        elif verb == "t":
            out.append(_padded(v.cast("boolean").cast("string"), flags, width))
        elif verb in "sv":
            s = text_of(v, t) if n <= len(types) else v.cast("string")
            out.append(_padded(F.left(s, F.lit(int(precision[1:]))) if precision and verb == "s" else s, flags, width))
        elif verb in "dxXoc":
            if verb in "xX" and t == "string":
                s = F.hex(v.cast("binary"))
                out.append(_padded(s if verb == "X" else F.lower(s), flags, width))
            else:
                out.append(F.format_string(f"%{flags}{width}{verb}", v.cast("int" if verb == "c" else "bigint")))
        elif verb == "g":
            out.append(_padded(_number(v.cast("double")), flags, width))
        else:
            out.append(F.format_string(f"%{flags}{width}{precision}{verb}", v.cast("double")))
    out.append(F.lit(fmt[at:]))
    return F.concat(*out)


GO_TYPES = {"string": "string", "boolean": "bool", "int": "int", "bigint": "int64", "double": "float64", "float": "float64"}


def _padded(s: Column, flags: str, width: str) -> Column:
    if not width:
        return s
    side = F.rpad if "-" in flags else F.lpad
    return F.when(F.length(s) >= int(width), s).otherwise(side(s, int(width), " "))


def is_duration(s: Column) -> Column:
    return s.rlike(DURATION)


def duration_nanoseconds(s: Column) -> Column:
    """NULL if it is no duration, or too long for a bigint of nanoseconds."""
    terms = F.regexp_extract_all(s, F.lit(_UNIT), 0)
    one = lambda x: F.regexp_extract(x, r"^[0-9.]+", 0).cast("decimal(28,9)") * F.element_at(F.create_map(*[F.lit(y) for kv in NANOSECONDS.items() for y in kv]), F.regexp_extract(x, r"[^0-9.]+$", 0)).cast("decimal(14,0)")
    total = F.aggregate(terms, F.lit(0).cast("decimal(38,9)"), lambda a, x: (a + one(x)).cast("decimal(38,9)"))
    return F.when(is_duration(s), F.when(s.startswith("-"), -total).otherwise(total).try_cast("bigint"))


def date_modify(duration: str, at: Column) -> Column:
    """A timestamp moved by a duration; microseconds are the finest step."""
    sign, whole = (-1 if duration.startswith("-") else 1), duration.lstrip("+-")
    if not re.fullmatch(rf"0|({_UNIT})+", whole):
        raise ValueError(f"no duration: {duration!r}")
    total = sum(float(n) * NANOSECONDS[u] for n, _, u in re.findall(_UNIT, whole))
    return F.timestamp_add("MICROSECOND", F.lit(sign * int(total // 1000)), at)


def is_url(s: Column) -> Column:
    return s.rlike(URL)


def is_ipv4(s: Column) -> Column:
    """Four numbers up to 255, without leading zeros."""
    parts = F.split(s, r"\.")
    one = lambda p: p.rlike("^[0-9]{1,3}$") & (p.try_cast("int") <= 255) & ~p.rlike("^0[0-9]")
    return (F.size(parts) == 4) & F.forall(parts, one)


def is_ipv6(s: Column) -> Column:
    """Eight groups of up to four hexadecimal digits; one :: stands for one group of zeros or more; the last two groups may be an IPv4 address."""
    tail = F.regexp_extract(s, r"([0-9.]*\.[0-9.]*)$", 1)
    t = F.when(tail == "", s).when(is_ipv4(tail) & s.rlike(r":[0-9.]*$"), F.regexp_replace(s, r"[0-9.]*$", "0:0"))
    halves = F.split(t, "::")
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    found = F.flatten(F.transform(halves, groups))
    n = F.size(found)
    right = F.when(F.size(halves) == 1, n == 8).when(F.size(halves) == 2, n <= 7).otherwise(False)
    return F.coalesce(right & F.forall(found, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & s.contains(":"), F.lit(False))


def is_ip(s: Column) -> Column:
    return is_ipv4(s) | is_ipv6(s)


def url_part(s: Column, part: str) -> Column:
    return F.regexp_extract(s, URL, {"scheme": 1, "host": 3, "path": 4, "query": 5, "fragment": 6}[part])


def cert_contract(common_name: Column, addresses: Column, days: Column) -> Column:
    """What a certificate's generator asks of its operands: a name, addresses of machines, a number of days."""
    return common_name.isNotNull() & F.forall(F.coalesce(addresses, F.array().cast("array<string>")), is_ip) & (days >= 0)
