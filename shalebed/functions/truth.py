"""Truthiness, absence and kinds. Missing, null and falsy are three different things."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("array", "boolean", "integer", "null", "number", "object", "string")


def truthy(value: Column, data_type: str) -> Column:
    """Of a typed column: null, false, 0, '' and empty collections are falsy; NaN is truthy as it is not 0."""
    if data_type == "variant":
        return truthy_variant(value)
    if data_type == "boolean":
        test = value
    elif data_type in ("string", "binary"):
        test = value != F.lit("").cast(data_type)
    elif data_type.startswith(("array", "map")):
        test = F.size(value) > 0
    elif data_type.startswith("struct"):
        test = value.isNotNull()
    else:
        test = value != 0
    return F.coalesce(test, F.lit(False))


def get(value: Column, *segments: str | int, kind: str = "variant") -> Column:
    """Member of a VARIANT by keys and array places, or NULL; names are literal, dots in them are no steps."""
    path = "$"
    for s in segments:
        path += f"[{s}]" if isinstance(s, int) else f'["{s}"]' if "'" in s else f"['{s}']"
    return F.try_variant_get(value, path, kind)


def members(value: Column) -> Column:
    """map<string,variant> of an object; NULL for anything else."""
    return get(value, kind="map<string,variant>")


def items(value: Column) -> Column:
    """array<variant> of an array; NULL for anything else."""
    return get(value, kind="array<variant>")


def kind_of(value: Column, shape: Column | None = None) -> Column:
    """JSON kind of a VARIANT: array, boolean, integer, null, number, object, string; NULL when missing. shape: schema_of_variant of it, where a column holds that already."""
    t = F.schema_of_variant(value) if shape is None else shape
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(t == "VOID", "null")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .when(t == "BOOLEAN", "boolean")
        .when(t == "BIGINT", "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
        .otherwise("string")
    )


def truthy_variant(value: Column, shape: Column | None = None) -> Column:
    """By kind, and of containers by their first member: nothing below is rendered."""
    shape = F.schema_of_variant(value) if shape is None else shape
    kind = kind_of(value, shape)
    return F.coalesce(
        F.when(kind == "boolean", get(value, kind="boolean"))
        .when(kind.isin("integer", "number"), get(value, kind="double") != 0)
        .when(kind == "string", get(value, kind="string") != "")
        .when(kind == "array", get(value, 0).isNotNull())
        .when(kind == "object", shape != "OBJECT<>")
        .otherwise(False),
        F.lit(False),
    )


def absent(value: Column) -> Column:
    """Missing or an explicit null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))


def equals(value: Column, literal: object) -> Column:
    """A VARIANT equals a scalar literal of the same kind; 1 and 1.0 are the same number, "1" is none. NULL nowhere."""
    kind = kind_of(value)
    if literal is None:
        test = kind == "null"
    elif isinstance(literal, bool):
        test = (kind == "boolean") & (get(value, kind="boolean") == F.lit(literal))
    elif isinstance(literal, (int, float)):
        test = kind.isin("integer", "number") & (get(value, kind="double") == F.lit(float(literal)))
        if isinstance(literal, int) and -(2**63) <= literal < 2**63:  # whole numbers past 2 ** 53 are no doubles
            test = F.when(kind == "integer", get(value, kind="bigint") == F.lit(literal).cast("bigint")).otherwise(test)
    else:
        test = (kind == "string") & (get(value, kind="string") == F.lit(literal))
    return F.coalesce(test, F.lit(False))


def has_key(json_text: Column, key: str) -> Column:
    """A member of that name, even if it is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(json_text), key), F.lit(False))


def has_member(value: Column, key: str) -> Column:
    """As has_key, of a VARIANT."""
    return F.coalesce(get(value, key).isNotNull() & (kind_of(value) == "object"), F.lit(False))


def size(value: Column) -> Column:
    """Members of an array or object; NULL for other kinds."""
    return F.coalesce(F.when(items(value).isNotNull(), F.size(items(value))), F.when(members(value).isNotNull(), F.size(members(value))))


def default(value: Column, data_type: str, fallback: Column) -> Column:
    """The value if truthy, else the fallback; not SQL's coalesce."""
    return F.when(truthy(value, data_type), value).otherwise(fallback)


def first_truthy(values: list[tuple[Column, str]]) -> Column:
    """The first truthy operand, else the last one."""
    out = values[-1][0]
    for value, kind in reversed(values[:-1]):
        out = F.when(truthy(value, kind), value).otherwise(out)
    return out


def first_falsy(values: list[tuple[Column, str]]) -> Column:
    """`and`: the first falsy operand, else the last one."""
    out = values[-1][0]
    for value, kind in reversed(values[:-1]):
        out = F.when(~truthy(value, kind), value).otherwise(out)
    return out


def ternary(yes: Column, no: Column, test: Column) -> Column:
    return F.when(test, yes).otherwise(no)
