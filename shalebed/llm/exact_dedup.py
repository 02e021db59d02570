"""Operator 4: exact deduplication against a minimal perfect hash of historical digests.

The history (rows up to the middle of the id range, or a frame given by the caller) is reduced to distinct
SHA-256 digests with winner and count. They are dealt by digest into shards of a bounded number of keys; each
shard gets a minimal perfect hash (a cascade of collision-free bit levels, ranked by popcount) whose slots hold the
whole digest and the winner's locator. Later rows are reduced to distinct digests first, looked up in their shard's
slot and compared byte for byte; nonmembers are grouped apart. Nothing is broadcast; no group of copies meets in
one task, since copies are pre-aggregated and the last join can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import keep, mix

GAMMA, LEVELS = 1.6, 40


def _places(d: np.ndarray, level: int, size: int) -> np.ndarray:
    """d: digests as rows of four uint64."""
    return (mix(d[:, level % 4] ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


def as_words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in digests), np.uint64).reshape(-1, 4)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte digests: rank over levels of bits that one key alone has set."""

    def __init__(self, d: np.ndarray):
        self.levels, rest, before = [], np.arange(len(d)), 0
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, int(GAMMA * len(rest)) + 1)
            at = _places(d[rest], level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((np.packbits(alone), size, before, np.cumsum(alone) - alone))
            before += int(alone.sum())
            rest = rest[~alone[at]]
        if len(rest):
            raise ValueError("digests of a shard are not distinct")
        self.n = before

    def __call__(self, d: np.ndarray) -> np.ndarray:
        """The slot of each digest; -1 where no level has it. A nonmember may get a slot too: compare its bytes."""
        out, rest = np.full(len(d), -1, np.int64), np.arange(len(d))
        for level, (bits, size, before, rank) in enumerate(self.levels):
            if not len(rest):
                break
            at = _places(d[rest], level, size)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            out[rest[hit]] = before + rank[at[hit]]
            rest = rest[~hit]
        return out


def _lookup(key, history, later):
    """One shard: build the perfect hash and its slots, look every later digest up, and return all of both."""
    import pandas as pd

    h = as_words(history["digest"].tolist())
    mph = PerfectHash(h)
    slot = mph(h)
    slots, winner, size = np.zeros((mph.n, 4), np.uint64), np.zeros(mph.n, np.int64), np.zeros(mph.n, np.int64)
    slots[slot], winner[slot], size[slot] = h, history["winner"].to_numpy(np.int64), history["size"].to_numpy(np.int64)
    member = np.zeros(len(later), bool)
    if len(later) and mph.n:
        x = as_words(later["digest"].tolist())
        at = mph(x)
        member = (at >= 0) & (slots[np.maximum(at, 0)] == x).all(axis=1)
        np.maximum.at(winner, at[member], later["winner"].to_numpy(np.int64)[member])
        np.add.at(size, at[member], later["size"].to_numpy(np.int64)[member])
    found = pd.DataFrame({"digest": [r.tobytes() for r in slots], "winner": winner, "size": size, "historical": True})
    new = later[~member]
    return pd.concat([found, pd.DataFrame({"digest": new["digest"], "winner": new["winner"], "size": new["size"], "historical": False})])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: DataFrame | None = None, shard_keys: int = 100_000) -> DataFrame:
    """One row per row of docs: (id_col, keep_id, group_size, kept, text_sha256, in_history).

    Null texts count as empty. The row with the largest id of a group stays; if rows repeat that id too, all of them
    have kept true (they are one row to this operator) and group_size counts each. A null id is less than any other.
    history: (digest binary(32), winner long, size long), distinct; without it, rows up to the middle of the ids are
    the history. Extra columns of docs are not read.
    """
    low = -(2**63)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")), "digests")
    known = rows.withColumn("winner", F.coalesce("doc_id", F.lit(low)))
    if history is None:
        ends = known.where("doc_id is not null").agg(F.min("winner").alias("a"), F.max("winner").alias("b")).first()
        middle = (ends["a"] + ends["b"]) // 2 if ends["a"] is not None else 0
        old, later = known.where(F.col("winner") <= middle), known.where(F.col("winner") > middle)
        history = old.groupBy("digest").agg(F.max("winner").alias("winner"), F.count("*").alias("size"))
    else:
        later = known
    later = later.groupBy("digest").agg(F.max("winner").alias("winner"), F.count("*").alias("size"))
    total = rows.agg(F.approx_count_distinct("digest", 0.05).alias("n")).first()["n"]
    shards = max(48, -(-total // shard_keys))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    groups = history.select(shard, "digest", "winner", "size").groupBy("shard").cogroup(later.select(shard, "digest", "winner", "size").groupBy("shard")).applyInPandas(_lookup, "digest binary, winner long, size long, historical boolean")
    groups = keep(groups, "winners")
    out = rows.join(groups, "digest")
    keep_id = F.when(F.col("winner") != low, F.col("winner"))
    return out.select(F.col("doc_id").alias(id_col), keep_id.alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), F.col("historical").alias("in_history"))


def digest_of(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()
