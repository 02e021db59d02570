"""Operator 9: URL rules judged by a cascade of Bloom filters.

Every key that a url of the corpus can match (each suffix of its host joined with each rule-path length of its
path) belongs to the key universe. Level 1 holds the listed keys; level 2 holds the keys of the universe that level 1
wrongly passes; level 3 the listed keys that level 2 wrongly passes; and so on until nothing is wrong. Membership
of any key of the universe is then exact, from bits alone, without a join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import keep


class Bloom:
    def __init__(self, keys: list[str], rate: float, seed: int):
        self.size = max(64, int(-len(keys) * math.log(rate) / math.log(2) ** 2) + 1)
        self.hashes, self.seed = max(1, round(-math.log2(rate))), seed
        self.bits = bytearray(-(-self.size // 8))
        for k in keys:
            for p in self._at(k):
                self.bits[p >> 3] |= 1 << (p & 7)

    def _at(self, key: str):
        h = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"), self.seed)
        a, b = h & 0xFFFFFFFFFFFFFFFF, (h >> 64) | 1
        return ((a + i * b) % self.size for i in range(self.hashes))

    def __contains__(self, key: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._at(key))


def _passing(levels: list[Bloom], key: str) -> int:
    """How many levels pass the key before one refuses it."""
    for i, f in enumerate(levels):
        if key not in f:
            return i
    return len(levels)


class Cascade:
    """Exact on its universe: a key is listed if the first level that refuses it is an even one."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def __contains__(self, key: str) -> bool:
        return _passing(self.levels, key) % 2 == 1

    def nbytes(self) -> int:
        return sum(len(f.bits) for f in self.levels)


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and / ? # or the end, A-Z lower-cased; path up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2**31 - 1))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: str, path: str, lengths: list[int]) -> list[str]:
    """Longest first: every suffix of the host at a label, with every beginning of the path that has a rule path's length."""
    labels = host.split(".")
    found = {".".join(labels[i:]) + "\t" + path[:n] for i in range(len(labels)) for n in lengths if len(path) >= n}
    return sorted(found, key=lambda k: (-len(k), -k.index("\t"), k))


def judge_urls(pages: DataFrame, rules: dict[tuple[str, str], str], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_rules: int = 1_000_000, max_wrong: int = 4_000_000) -> DataFrame:
    """One row per row of pages: (id_col, host, path, rule, verdict); extra columns are not read.

    rules: (host, path prefix) -> verdict, at most max_rules of them (more are refused, since the cascade is broadcast;
    then split the list and judge in turn). The longest matching rule wins; of equal length, the longer host. Null urls
    and urls without :// have empty host and path. Without a rule: default, which is the verdict of a key that the
    cascade does not hold. Repeated rows each get their row.
    """
    spark = pages.sparkSession
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; at most {max_rules} are broadcast at once")
    listed = sorted({h.lower() + "\t" + p for h, p in rules})
    lengths = sorted({len(p) for _, p in rules})
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def keys(batches):
        schema = pa.schema([("key", pa.string())])
        seen = set()
        for b in batches:
            new = []
            for h, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k in candidate_keys(h, p, lengths):
                    if k not in seen:
                        new.append(k)
                        seen.add(k)
            if len(seen) > 300_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], schema=schema)

    universe = keep(parts.select("host", "path").mapInArrow(keys, "key string").distinct(), "universe")
    total = universe.count()
    own = set(listed)
    rate = min(0.5, max(1e-9, len(listed) / max(1, total)))
    levels = [Bloom(listed, rate, 1)]
    bc = spark.sparkContext.broadcast(levels[0])

    def wrong(batches):
        for b in batches:
            yield b.filter(pa.array([k in bc.value for k in b.column(0).to_pylist()], pa.bool_()))

    bad = universe.mapInArrow(wrong, "key string")
    bad = [r[0] for r in bad.limit(max_wrong + len(own) + 1).collect() if r[0] not in own]  # about as many as are listed: the rate sees to it
    if len(bad) > max_wrong:
        raise ValueError("the first level passes too many keys; lower its rate")
    good, seed = listed, 2
    while bad:
        levels.append(Bloom(bad, 0.5, seed))
        good, bad, seed = bad, [k for k in good if k in levels[-1]], seed + 1
    cascade = spark.sparkContext.broadcast((Cascade(levels), {h.lower() + "\t" + p: ((h + p), v) for (h, p), v in rules.items()}))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(batches):
        held, verdicts = cascade.value
        known: dict[str, bool] = {}
        for b in batches:
            rule, verdict = [], []
            if len(known) > 300_000:
                known.clear()
            for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hit = None
                for k in candidate_keys(h, p, lengths):
                    if k not in known:
                        known[k] = k in held
                    if known[k]:
                        hit = k
                        break
                name, v = verdicts[hit] if hit is not None else (None, default)
                rule.append(name)
                verdict.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    return parts.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string").withColumnRenamed("page_id", id_col)
