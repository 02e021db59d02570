"""List, map and number functions of the template language as Columns."""

from __future__ import annotations

import functools
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shalebed.functions import truth
from shalebed.functions.truth import truthy


def first(a: Column) -> Column:
    return F.get(a, F.lit(0))


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def initial(a: Column) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.greatest(F.size(a), F.lit(1)))


def compact(a: Column, item: str) -> Column:
    return F.filter(a, lambda x: truthy(x, item))


def append(a: Column, x: Column) -> Column:
    return F.array_append(a, x)


def prepend(a: Column, x: Column) -> Column:
    return F.array_prepend(a, x)


def concat(*a: Column) -> Column:
    return F.concat(*a)


def slice_of(a: Column, start: int, end: int) -> Column:
    return F.slice(a, F.lit(start + 1), F.lit(max(0, end - start)))


def uniq(a: Column) -> Column:
    return F.array_distinct(a)


def pick(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: k.isin(*keys))


def omit(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def keys(m: Column) -> Column:
    return F.array_sort(F.map_keys(m))


def values(m: Column) -> Column:
    """In the order of the keys."""
    return F.transform(keys(m), lambda k: F.element_at(m, k))


def get(m: Column, key: str) -> Column:
    """The member, or an empty string."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(""))


def pluck(key: str, *maps: Column) -> Column:
    return F.array_compact(F.array(*[F.try_element_at(m, F.lit(key)) for m in maps]))


def reverse(a: Column) -> Column:
    return F.reverse(a)


def has(item: Column, a: Column) -> Column:
    """A null list has nothing."""
    return F.coalesce(F.array_contains(a, item), F.lit(False))


def sort_alpha(a: Column) -> Column:
    """Items as text, in the order of their code points; null items are left out."""
    return F.array_sort(F.transform(F.array_compact(a), lambda x: x.cast("string")))


def list_of(*values: Column) -> Column:
    return F.array(*values)


def dict_of(*pairs: object) -> Column:
    """Keys and values in turn, of one type; a key without a value has an empty one, the last of equal keys wins."""
    kept: dict[str, Column] = {}
    for i in range(0, len(pairs), 2):
        kept.pop(pairs[i], None)
        kept[pairs[i]] = pairs[i + 1] if i + 1 < len(pairs) else F.lit("")
    return F.create_map(*[x for k, v in kept.items() for x in (F.lit(k), v)])


def put(m: Column, key: str, value: Column) -> Column:
    """set: the map with one member replaced or added at its end."""
    return F.map_concat(F.map_filter(m, lambda k, _: k != key), F.create_map(F.lit(key), value))


def unset(m: Column, key: str) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


def has_key(m: Column, key: str) -> Column:
    """A member of that name, even if it is null."""
    return F.coalesce(F.map_contains_key(m, key), F.lit(False))


def deep_copy(x: Column) -> Column:
    """Columns don't change, so a copy is the column itself."""
    return x


def length(x: Column, data_type: str) -> Column:
    """Bytes of a string, members of a collection; null is an error in the template language and NULL here."""
    return truth.size(x) if data_type == "variant" else F.octet_length(x) if data_type == "string" else F.size(x)


def index(x: Column, *keys: str | int) -> Column:
    """Step by step into lists (from 0) and maps; NULL past a list's end, and for what a map lacks."""
    for k in keys:
        x = F.get(x, F.lit(k)) if isinstance(k, int) else F.try_element_at(x, F.lit(k))
    return x


def index_variant(x: Column, *keys: str | int) -> Column:
    return truth.get(x, *keys)


def dig(document: Column, keys: list[str], default: Column, kind: str = "string") -> Column:
    """Value below literal keys of a VARIANT, or the default where a key is missing. A member on the way that is no object is an error."""
    wrong = F.lit(False)
    for i in range(1, len(keys)):
        host = truth.get(document, *keys[:i])
        wrong = wrong | (host.isNotNull() & ~F.coalesce(truth.kind_of(host) == "object", F.lit(False)))
    found = truth.get(document, *keys)
    return F.when(wrong, F.raise_error(F.lit("dig: a member on the way is no object"))).when(found.isNull(), default).otherwise(truth.get(document, *keys, kind=kind))


def merge(left: Column, right: Column) -> Column:
    """Of flat maps: earlier layers win."""
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(a, b))


def merge_overwrite(left: Column, right: Column) -> Column:
    return F.map_zip_with(left, right, lambda _, a, b: F.coalesce(b, a))


def merge_deep(left: Column, right: Column, depth: int = 3) -> Column:
    """Of VARIANT objects: members of both that are objects merge, down to `depth` levels (more are an error); else the left one wins, unless it is null or missing."""
    a, b = truth.members(left), truth.members(right)

    def both(x: Column, y: Column) -> Column:
        objects = F.coalesce((truth.kind_of(x) == "object") & (truth.kind_of(y) == "object"), F.lit(False))
        deeper = merge_deep(x, y, depth - 1) if depth > 1 else F.raise_error(F.lit("merge_deep: objects lie deeper than the levels asked for")).cast("variant")
        return F.when(objects, deeper).otherwise(F.when(truth.absent(x), F.coalesce(y, x)).otherwise(x))

    merged = F.map_zip_with(a, b, lambda _, x, y: both(x, y))
    return F.when(a.isNull(), F.coalesce(right, left)).when(b.isNull(), left).otherwise(F.to_variant_object(merged))


def to_int(s: Column) -> Column:
    """Total: what is no number becomes 0; fractions are cut. Whole numbers are read as such, so none is rounded."""
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"), F.lit(0))


def to_float(s: Column) -> Column:
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def add(*x: Column) -> Column:
    """Whole numbers: operands are cast first, and what is no number is 0."""
    return functools.reduce(lambda a, b: a + b, map(to_int, x))


def add1(x: Column) -> Column:
    return to_int(x) + 1


def sub(a: Column, b: Column) -> Column:
    return to_int(a) - to_int(b)


def mul(*x: Column) -> Column:
    return functools.reduce(lambda a, b: a * b, map(to_int, x))


def div(a: Column, b: Column) -> Column:
    """Cut towards 0; NULL where the template would abort, by a divisor of 0."""
    a, b = to_int(a), to_int(b)
    return F.when(b != 0, F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))


def mod(a: Column, b: Column) -> Column:
    return F.try_mod(to_int(a), to_int(b))


def biggest(*x: Column) -> Column:
    return F.greatest(*map(to_int, x)) if len(x) > 1 else to_int(x[0])


def smallest(*x: Column) -> Column:
    return F.least(*map(to_int, x)) if len(x) > 1 else to_int(x[0])


def floor(x: Column) -> Column:
    return F.floor(to_float(x)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(to_float(x)).cast("double")


def round_(x: Column, digits: int = 0) -> Column:
    """Half away from 0."""
    return F.round(to_float(x).cast("decimal(38,18)"), digits).cast("double")


def addf(*x: Column) -> Column:
    return functools.reduce(lambda a, b: a + b, map(to_float, x))


def add1f(x: Column) -> Column:
    return to_float(x) + 1.0


def subf(a: Column, b: Column) -> Column:
    return to_float(a) - to_float(b)


def mulf(*x: Column) -> Column:
    return functools.reduce(lambda a, b: a * b, map(to_float, x))


def maxf(*x: Column) -> Column:
    return F.greatest(*map(to_float, x)) if len(x) > 1 else to_float(x[0])


def minf(*x: Column) -> Column:
    return F.least(*map(to_float, x)) if len(x) > 1 else to_float(x[0])


def to_json(value: Column) -> Column:
    return F.to_json(value)


def from_json(text: Column) -> Column:
    """VARIANT of a text; NULL where it is no JSON. What follows a whole document is not read."""
    return F.try_parse_json(text)


def from_json_array(text: Column) -> Column:
    """array<variant>; NULL where the text is no JSON array."""
    return truth.items(F.try_parse_json(text))


# Flat mappings of plain scalars are written and read by these, 20 times as fast as PyYAML does and to the same texts; all else goes to PyYAML.
# Words parted by single blanks: no sign that YAML gives a meaning at their place (": ", " #", quotes, brackets), and by their first character neither number nor date.
_WORD = r"(?:[\w./@%+=,;()#-]|:(?=[^ ]))"
_PLAIN = re.compile(rf"[A-Za-z_/]{_WORD}*(?: (?!#){_WORD}+)*", re.ASCII)
_KEY = re.compile(r"[A-Za-z_][\w./-]{0,99}", re.ASCII)
_LINE = re.compile(rf"({_KEY.pattern}): (?:(-?(?:0|[1-9][0-9]{{0,17}}))|({_PLAIN.pattern}))", re.ASCII)
_CONSTANTS = {"true": True, "false": False, "null": None}
_OTHERS = frozenset({"true", "false", "null", "yes", "no", "on", "off", "y", "n"})  # in any case, no texts
_SORTED = json.JSONEncoder(sort_keys=True, default=str)


def _flat_yaml(value: object) -> str | None:
    """YAML of a flat mapping of plain scalars, as PyYAML writes it; None for anything else."""
    if type(value) is not dict or not value:
        return None
    lines = []
    for k in sorted(value):
        if not _KEY.fullmatch(k) or k.lower() in _OTHERS:
            return None
        x = value[k]
        if type(x) is str:
            if not _PLAIN.fullmatch(x) or x.lower() in _OTHERS:
                return None
        elif type(x) is int:
            x = str(x)
        elif x is None or type(x) is bool:
            x = "null" if x is None else "true" if x else "false"
        else:
            return None
        lines.append(f"{k}: {x}")
    return "\n".join(lines)


def _flat_mapping(text: str) -> dict | None:
    """The mapping that PyYAML reads from lines of a key and a plain scalar; None for any other text."""
    out = {}
    for line in text.removesuffix("\n").split("\n"):
        m = _LINE.fullmatch(line)
        if m is None:
            return None
        k, number, x = m.groups()
        if k.lower() in _OTHERS:
            return None
        if number is not None:
            x = int(number)
        elif x in _CONSTANTS:
            x = _CONSTANTS[x]
        elif x.lower() in _OTHERS:
            return None
        out[k] = x
    return out


@F.pandas_udf(StringType())
def _to_yaml(x: pd.Series) -> pd.Series:
    import yaml

    def one(v):
        if v is None:
            return None
        value = json.loads(v)
        flat = _flat_yaml(value)
        return yaml.safe_dump(value, default_flow_style=False, allow_unicode=True, sort_keys=True, width=2**31).removesuffix("\n...\n").removesuffix("\n") if flat is None else flat

    return x.map(one)


@F.pandas_udf(StringType())
def _from_yaml(x: pd.Series) -> pd.Series:
    import yaml

    def one(v):
        if v is None:
            return None
        flat = _flat_mapping(v)
        if flat is not None:
            return _SORTED.encode(flat)
        try:
            return json.dumps(yaml.safe_load(v), sort_keys=True, default=str)
        except yaml.YAMLError:
            return None

    return x.map(one)


def to_yaml(json_text: Column) -> Column:
    """YAML of a JSON text, keys in order, by Arrow batches."""
    return _to_yaml(json_text)


def from_yaml(text: Column) -> Column:
    """VARIANT of a YAML text; NULL where it can't be read."""
    return F.try_parse_json(_from_yaml(text))


def required(value: Column, data_type: str, message: str) -> Column:
    """The value; an error where it is null or an empty string."""
    bad = value.isNull() if data_type != "string" else value.isNull() | (value == "")
    return F.when(bad, F.raise_error(F.lit(message)).cast(data_type)).otherwise(value)


def violation(bad: Column, message: str) -> Column:
    """The message where a check fails, else NULL: an abort as a row to report."""
    return F.when(bad, F.lit(message))


def fail(message: Column) -> Column:
    return F.raise_error(message)


def capability_has(apis: DataFrame, api: str, asked: DataFrame, key: str) -> DataFrame:
    """asked with `present`: true where apis (column api) names the key; NULL, not false, where nothing at all is known."""
    known = apis.select(F.col(api).alias(key)).distinct().withColumn("_known", F.lit(True))
    j = asked.join(known, key, "left")
    return j.withColumn("present", F.when(F.lit(bool(apis.take(1))), F.col("_known").isNotNull())).drop("_known")


def files_get(files: DataFrame, path: str, text: str, asked: DataFrame, key: str) -> DataFrame:
    """asked with the text of the file that it names; an empty text where there is none."""
    held = files.select(F.col(path).alias(key), F.col(text).alias("file_text"))
    return asked.join(held, key, "left").withColumn("file_text", F.coalesce("file_text", F.lit("")))


def lookup_objects(objects: DataFrame, asked: DataFrame, keys: list[str], value: str) -> DataFrame:
    """asked with the live object of (apiVersion, kind, namespace, name); NULL where it is unknown."""
    return asked.join(objects.select(*keys, value), keys, "left")
