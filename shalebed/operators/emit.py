"""Emission: repeated subtrees to definitions, compact names, size metrics, policy marks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shalebed.operators.lattice import canonical, rebuilt

DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LIMIT_BYTES = 5 * 1024 * 1024


def base62(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
        if not n:
            return out


def savings(size: Column, uses: Column, reference: int = 24, overhead: int = 16) -> Column:
    return size * uses - (size + reference * uses + overhead)


def repeated_payloads(rows: DataFrame, text: str, min_bytes: int = 32) -> DataFrame:
    """(digest, size, uses, saved) of texts that are worth one definition."""
    size = F.octet_length(text)
    out = rows.where(size >= min_bytes).groupBy(F.sha2(text, 256).alias("digest"), size.alias("size")).agg(F.count("*").alias("uses"))
    return out.where("uses > 1").withColumn("saved", savings(F.col("size"), F.col("uses")).cast("bigint")).where("saved > 0")


def definition_plan(payloads: DataFrame, top: int) -> DataFrame:
    """The `top` definitions that save most, ranked: largest first, then the most used, then by digest. A limit is the feature here; only `top` rows meet in one task."""
    best = payloads.orderBy(F.desc("size"), F.desc("uses"), "digest").limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), F.desc("uses"), "digest")))


def intern(schema: dict, min_bytes: int = 64) -> dict:
    """Repeated subtrees of one schema under $defs, largest saving first."""
    while True:
        counts: dict[str, int] = {}

        def walk(s):
            if isinstance(s, dict):
                text = canonical(s)
                if len(text) >= min_bytes and "$ref" not in s:
                    counts[text] = counts.get(text, 0) + 1
                for k, v in s.items():
                    if k not in ("enum", "const", "default", "required"):
                        walk(v)
            elif isinstance(s, list):
                for v in s:
                    walk(v)

        walk({k: v for k, v in schema.items() if k != "$defs"})
        best = max(((len(t) * (n - 1) - 24 * n - 16, t) for t, n in counts.items() if n > 1), default=(0, ""))
        if best[0] <= 0:
            return schema
        name = "d" + base62(len(schema.get("$defs", {})))
        body = json.loads(best[1])

        def swap(s, text=best[1], ref="#/$defs/" + name):
            if isinstance(s, dict):
                return {"$ref": ref} if canonical(s) == text else {k: v if k in ("enum", "const", "default", "required") else swap(v) for k, v in s.items()}
            return [swap(v) for v in s] if isinstance(s, list) else s

        defs = schema.get("$defs", {})
        schema = swap({k: v for k, v in schema.items() if k != "$defs"}) | {"$defs": defs | {name: body}}


def metrics(schema: dict) -> dict:
    seen = {"objects": 0, "ifs": 0}
    payloads = set()

    def walk(s):
        if isinstance(s, dict):
            seen["objects"] += 1
            if "if" in s:
                seen["ifs"] += 1
                payloads.add(canonical([s["if"], s.get("then")]))
            for v in s.values():
                walk(v)
        elif isinstance(s, list):
            for v in s:
                walk(v)

    walk(schema)
    return {"bytes": len(canonical(schema).encode()), "distinct_ifs": len(payloads)} | seen


def render(schema: dict, policy: dict | None = None) -> str:
    """Pretty JSON, or compact where that passes the limit; with a fingerprint of the policy."""
    if policy is not None:
        schema = schema | {"x-policy": {"version": 1, "sha256": hashlib.sha256(canonical(policy).encode()).hexdigest()}}
    text = json.dumps(schema, indent=2, ensure_ascii=False, sort_keys=True)
    return text if len(text.encode()) <= LIMIT_BYTES else canonical(schema)


def rename_compact(schema: dict, prefix: str = "") -> dict:
    """Definitions renamed to the shortest names, the most used first; names that other references hold are not given out."""
    from shalebed.operators.refs import escape, reference_counts, unescape

    counts, definitions = reference_counts(schema), schema.get("$defs") or {}
    order = sorted(definitions, key=lambda k: (-counts.get(k, 0), k))
    names = {k: prefix + base62(i) for i, k in enumerate(order)}

    def walk(s):
        if not isinstance(s, dict):
            return s
        out = rebuilt(s, walk)
        r = s.get("$ref")
        if isinstance(r, str) and r.startswith("#/$defs/") and unescape(r.removeprefix("#/$defs/")) in names:
            out["$ref"] = "#/$defs/" + escape(names[unescape(r.removeprefix("#/$defs/"))])
        return out

    out = walk({k: v for k, v in schema.items() if k != "$defs"})
    return out | {"$defs": {names[k]: walk(definitions[k]) for k in sorted(order, key=lambda k: names[k])}} if definitions else out


def free_name(base: str, taken: set[str]) -> str:
    """The base, or it with the next free number."""
    name, n = base, 1
    while name in taken:
        n += 1
        name = f"{base}{n}"
    return name


def structural(value) -> tuple[str, int]:
    """(hash, length of the canonical text) of a value, from its members up: equal values are equal in both."""
    if isinstance(value, dict):
        parts = [(json.dumps(k, ensure_ascii=False), *structural(v)) for k, v in sorted(value.items())]
        return hashlib.sha256(("{" + ",".join(f"{k}:{h}" for k, h, _ in parts) + "}").encode()).hexdigest(), 2 + sum(len(k) + 1 + n for k, _, n in parts) + max(0, len(parts) - 1)
    if isinstance(value, list):
        found = [structural(v) for v in value]
        return hashlib.sha256(("[" + ",".join(h for h, _ in found) + "]").encode()).hexdigest(), 2 + sum(n for _, n in found) + max(0, len(found) - 1)
    text = canonical(value)
    return hashlib.sha256(text.encode()).hexdigest(), len(text)


def subtrees(rows, json_col: str, min_bytes: int = 32):
    """(digest, size, uses) of equal subtrees of JSON texts, all rows together: a text's own subtrees are counted in Python, the rest by Spark."""
    from collections import Counter

    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found: Counter = Counter()

            def walk(v):
                for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
                    walk(x)
                if isinstance(v, (dict, list)):
                    h, n = structural(v)
                    if n >= min_bytes:
                        found[h, n] += 1

            for text in pdf["j"]:
                if text is not None:
                    walk(json.loads(text))
            yield pd.DataFrame([(h, n, c) for (h, n), c in found.items()], columns=["digest", "size", "uses"])

    part = rows.select(F.col(json_col).alias("j")).mapInPandas(run, "digest string, size long, uses long")
    return part.groupBy("digest", "size").agg(F.sum("uses").alias("uses"))


CLASSES = ("guard", "range", "fail", "hint")


def selects(policy: dict[str, bool], kind: str) -> bool:
    """Does a policy keep facts of a class? Classes that it doesn't name are kept."""
    return policy.get(kind, True)


def select_classes(rows, kind: str, policy: dict[str, bool]):
    """Rows of the classes that a policy keeps."""
    from pyspark.sql import functions as F

    dropped = [c for c in CLASSES if not selects(policy, c)]
    return rows.where(~F.col(kind).isin(*dropped)) if dropped else rows
