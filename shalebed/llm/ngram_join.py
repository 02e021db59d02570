"""Operator 2: self-join of documents on the Jaccard similarity of their distinct 5-word shingles.

Method: token-combination prefixes. Shingles get one global order, rare classes first. A set of n shingles
that must share t of them with a partner shares its smallest common shingle within its first n-t+1; a rare
one is indexed alone. If no rare shingle is shared, all shared ones are frequent. Two sets with e unshared shingles
between them, put in order, have more than e gaps between the shared ones, so in some gap neither set has anything:
two shared shingles are neighbours in both. With the prefix extended to twice the unshared shingles a set may have,
that pair lies in it, so sets of every size index the pairs of neighbours among their frequent shingles: about n/2
keys. (Below 67 percent there may be too few gaps; there frequent shingles are indexed alone.) Candidates are
verified on whole sets.

Links are wanted as components, so no group is expanded into all its pairs: equal sets are one class; each index
key first proposes a star; what stars leave in different components is proposed after that, exactly.

Rare keys have a proven bound (the count of their class); frequent keys go through joins that Spark can split.
"""

from __future__ import annotations

import functools
import gc
import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import WordHashes, as_i64, batch, drop, keep, mix, small_batches, sum_arrays, words_of

WIDTH = 5
CLASS_BITS = 20
SLICES = 16
KEY_ROWS = 256  # members of a key in one task, about
LEAST_FOR_PAIRS = 67  # percent, from which e unshared shingles come with at least e + 2 shared ones
PAIRS_UP_TO = 32
BLOCK = 1024
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("sig2", pa.int64()), ("small", pa.binary()), ("sketch", pa.binary()), ("shingles", pa.binary())])
_SETS_DDL = "doc_id long, text_hash long, n int, sig long, sig2 long, small binary, sketch binary, shingles binary"
MOST_CLASHING = 10_000
SKETCH_BITS = 8  # a shingle, at least; a power of two in all
FOLD = 4  # times that a small sketch is shorter


def shingle_hashes(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than width count as one shingle."""
    n = len(hashes)
    if n == 0:
        return hashes
    hashes = mix(hashes)
    if n < width:
        return mix(np.array([sum(int(h) * int(_MULT[j % 5]) for j, h in enumerate(hashes)) + n & 0xFFFFFFFFFFFFFFFF], np.uint64))
    total = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * (_MULT[j % 5] + np.uint64(2 * (j // 5)))
    return np.unique(mix(total))


def sketch_of(h: np.ndarray) -> bytes:
    """A bitmap with the bit of each shingle's low hash bits set."""
    bits = np.zeros(max(64, 1 << (SKETCH_BITS * len(h) - 1).bit_length()), np.bool_)
    bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(sketch: bytes) -> bytes:
    """The same bitmap over fewer low hash bits. Of two sets with nothing in common it still tells about half the shingles apart."""
    bits = np.frombuffer(sketch, np.uint8)
    return np.bitwise_or.reduce(bits.reshape(-1, max(8, len(bits) // FOLD)), axis=0).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int) -> int:
    """An upper bound on the shared shingles of two sets, from their sketches: each bit of one that the other lacks is a shingle that it lacks."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return min(n_x - int(np.bitwise_count(x & ~y).sum()), n_y - int(np.bitwise_count(y & ~x).sum()))


def signature(blob: bytes, clashing: frozenset[int] = frozenset(), bits: int = 64) -> tuple[int, int]:
    """(sig, sig2): a set's name and another digest of it. Names that two sets would share give way to both digests at once."""
    digest = xxhash.xxh3_128_digest(blob)
    sig, sig2 = (int.from_bytes(digest[k : k + 8], "little", signed=True) for k in (0, 8))
    sig &= (1 << bits) - 1 if bits < 64 else -1
    return (sig ^ sig2 if sig in clashing else sig), sig2


def _sets(width: int, with_counts: bool, clashing: frozenset[int] = frozenset(), bits: int = 64):
    """A row per text; with_counts: no shingles, but the counts of the classes at the end."""

    def run(batches):
        words = WordHashes()
        counts, held, n_held = np.zeros(1 << CLASS_BITS, np.int64), [], 0
        for b in batches:
            out = {f.name: [] for f in _SETS}
            for doc_id, text, text_hash in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                h = shingle_hashes(words.of(words_of(text.as_py())), width)
                sig = sig2 = blob = small = sketch = None
                if len(h):
                    blob = h.tobytes()
                    if not with_counts:
                        sketch = sketch_of(h)
                        small = folded(sketch)
                    sig, sig2 = signature(blob, clashing, bits)
                if len(h) and with_counts:
                    blob = None
                    held.append((h >> np.uint64(64 - CLASS_BITS)).astype(np.int32))
                    n_held += len(h)
                for k, v in (("doc_id", doc_id), ("text_hash", text_hash), ("n", len(h)), ("sig", sig), ("sig2", sig2), ("small", small), ("sketch", sketch), ("shingles", blob)):
                    out[k].append(v)
            if n_held > 2_000_000:
                counts += np.bincount(np.concatenate(held), minlength=1 << CLASS_BITS)
                held, n_held = [], 0
            yield batch(_SETS, **out)
        if not with_counts:
            return
        if held:
            counts += np.bincount(np.concatenate(held), minlength=1 << CLASS_BITS)
        parts = np.minimum(counts, 65535).astype(np.uint16).reshape(SLICES, -1)
        yield batch(_SETS, doc_id=[None] * SLICES, text_hash=[None] * SLICES, n=[-1 - k for k in range(SLICES)], sig=[None] * SLICES, sig2=[None] * SLICES, small=[None] * SLICES, sketch=[None] * SLICES, shingles=[zlib.compress(p.astype(np.uint32).tobytes(), 1) for p in parts])

    return run


_KEYS = pa.schema([("pid", pa.int32()), ("tok", pa.binary()), ("sig", pa.binary()), ("n", pa.binary()), ("left", pa.binary()), ("rare", pa.binary()), ("prev", pa.binary())])
_KEYS_DDL = "pid int, tok binary, sig binary, n binary, left binary, rare binary, prev binary"


def prefix_keys(h: np.ndarray, classes: np.ndarray, percent: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, places) of a set of sorted shingle hashes for rare shingles, and (keys, places, shingles before) for pairs of frequent ones.

    A place is the (first) shingle's rank in the set: what comes before it is not shared if it is the smallest common
    one. Two sets that share the shingle before a pair as well share the pair before this one too, so a run of shared
    neighbours counts where it begins. Before a set's first frequent shingle there is a 0.
    """
    n = len(h)
    first = n - -(-percent * n // 100) + 1
    cls = classes[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]
    common = np.flatnonzero(cls)
    keys = h[cls == 0]
    single = keys[:first], np.arange(min(first, len(keys)))
    f = h[common]
    f = f[np.lexsort((f, cls[common]))]
    place = len(keys) + np.arange(len(f))
    if percent < LEAST_FOR_PAIRS:
        left = max(0, first - len(keys))
        return single, (f[:left], place[:left], mix(f[:left] ^ h[0]))
    # at most (100 - percent) n / 100 shingles are unshared, and if no rare one is shared, all rare ones are among them
    reach = max(0, -(-2 * (100 - percent) * n // 100) - 2 * len(keys)) + 2
    if 100 * len(keys) > (100 - percent) * n:
        reach = 0
    f, place = f[:reach], place[:reach]
    return single, (mix(f[:-1] * _MULT[0] + f[1:] * _MULT[1] + np.uint64(1)), place[:-1], np.r_[np.zeros(min(1, len(f)), np.uint64), f[:-1]][: max(0, len(f) - 1)])


def most_common(n: int, left: int, rare: int, m: int, left2: int, rare2: int) -> int:
    """The most shingles that two sets can share that share no rare one and whose first neighbours in both have left and left2 shingles from there on.

    Each shared shingle before has a gap after it that an unshared one fills, so shared ones are a third of the frequent ones before at most.
    """
    return min(n - rare, m - rare2, (n - left - rare + m - left2 - rare2) // 3 + min(left, left2))


def _index(classes_bc, percent: int, bits: int, width: int, clashing: frozenset[int], sig_bits: int):
    def run(batches):
        classes = np.frombuffer(zlib.decompress(classes_bc.value), np.uint8)
        words, seen, buffered, rows = WordHashes(), set(), [], 0

        def flush():
            if not buffered:
                return
            sizes = [len(x[0]) for x in buffered]
            tok, hot = np.concatenate([x[0] for x in buffered]), np.repeat([x[3] for x in buffered], sizes)
            left = np.concatenate([np.maximum(x[2] - x[4], 0).astype(np.uint16) for x in buffered])
            sig, n, rare = (np.repeat(np.array([x[i] for x in buffered], t), sizes) for i, t in ((1, np.int64), (2, np.uint16), (6, np.uint16)))
            prev = np.concatenate([x[5] for x in buffered])
            pid = (mix(tok ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - bits)).astype(np.int32)
            pid[hot] = -1 - (mix(sig[hot].view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            pid, tok, sig, n, left, rare, prev = (x[order] for x in (pid, tok, sig, n, left, rare, prev))
            cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]])
            ends = np.r_[cuts[1:], len(pid)]
            spans = list(zip(cuts, ends, strict=True))
            yield batch(_KEYS, pid=pid[cuts], **{k: [x[a:b].tobytes() for a, b in spans] for k, x in (("tok", tok), ("sig", sig), ("n", n), ("left", left))}, **{k: [x[a:b].tobytes() if pid[a] < 0 else b"" for a, b in spans] for k, x in (("rare", rare), ("prev", prev))})

        for b in batches:
            for text in b.column(0):
                h = shingle_hashes(words.of(words_of(text.as_py())), width)
                if len(h) < 2:
                    continue
                sig, _ = signature(h.tobytes(), clashing, sig_bits)
                if sig in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(sig)
                (keys, places), (pairs, starts, before) = prefix_keys(h, classes, percent)
                n_rare = min(65535, int((classes[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)] == 0).sum()))
                for k, p, q, is_hot in ((keys, places, np.zeros(len(keys), np.uint64), False), (pairs, starts, before, True)):
                    if len(k):
                        buffered.append((k, sig, min(len(h), 65535), is_hot, p, q, n_rare))
                        rows += len(k)
            if rows >= 1_500_000:
                yield from flush()
                buffered, rows = [], 0
        yield from flush()

    return run


_FOUND = "kind int, a long, b long, n int, rest int, rare int, prev long"


def _propose(percent: int):
    """Of one group of index rows: stars (kind 0), other pairs of small buckets (1), rows of larger ones (2: key, member)."""

    def run(pdf):
        import pandas as pd

        tok = np.frombuffer(b"".join(pdf["tok"]), np.uint64)
        sig = np.frombuffer(b"".join(pdf["sig"]), np.int64)
        n = np.frombuffer(b"".join(pdf["n"]), np.uint16).astype(np.int32)
        left = np.frombuffer(b"".join(pdf["left"]), np.uint16).astype(np.int32)
        is_hot = int(pdf["pid"].iloc[0]) < 0
        if is_hot:
            prev, rare = np.frombuffer(b"".join(pdf["prev"]), np.int64), np.frombuffer(b"".join(pdf["rare"]), np.uint16).astype(np.int32)
        else:  # the rows of a rare shingle have nothing before it in common
            prev, rare = as_i64(mix(tok ^ sig.view(np.uint64))), n - left
        order = np.lexsort((sig, tok))
        tok, sig, n, left, rare, prev = (x[order] for x in (tok, sig, n, left, rare, prev))
        new = np.r_[True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1])]
        tok, sig, n, left, rare, prev = (x[new] for x in (tok, sig, n, left, rare, prev))
        out = []
        if is_hot:
            out.append((2, as_i64(tok), sig, n, left, rare, prev))
        else:
            cuts = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]])
            sizes = np.diff(np.r_[cuts, len(tok)])

            def pairs(kind, i, j):
                a, b, na, nb = sig[i], sig[j], n[i].astype(np.int64), n[j].astype(np.int64)
                fits = (np.minimum(left[i], left[j]).astype(np.int64) * (100 + percent) >= percent * (na + nb)) | (na == 65535) | (nb == 65535)
                a, b = a[fits], b[fits]
                if len(a):
                    _, first = np.unique(mix(a.view(np.uint64)) ^ b.view(np.uint64), return_index=True)
                    out.append((kind, a[first], b[first], *[a[first] * 0] * 4))

            large = sizes >= 2
            starts, lengths = cuts[large], sizes[large]
            if len(starts):
                within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                centre = np.repeat(starts, lengths)
                member = centre + within
                pairs(0, centre[within > 0], member[within > 0])
                for m in np.unique(lengths[(lengths > 2) & (lengths <= PAIRS_UP_TO)]):
                    i, j = np.triu_indices(m - 1, 1)
                    s = starts[lengths == m][:, None] + 1
                    pairs(1, (s + i).ravel(), (s + j).ravel())
                for s, m in zip(starts[lengths > PAIRS_UP_TO], lengths[lengths > PAIRS_UP_TO], strict=True):
                    out.append((2, np.full(m, as_i64(tok[s : s + 1])[0]), *(x[s : s + m] for x in (sig, n, left, rare, prev))))
        return pd.DataFrame({k: np.concatenate([np.full(len(x[1]), x[0], np.int32) if c == 0 else x[c] for x in out]) if out else np.array([], np.int64) for c, k in enumerate(("kind", "a", "b", "n", "rest", "rare", "prev"))})

    return run


def _may_link(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            good = []
            for x, y, n, m in zip(b.column("ka"), b.column("kb"), b.column("na").to_pylist(), b.column("nb").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                good.append((100 + percent) * most_shared(x, y, n, m) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=schema).filter(pa.array(good, pa.bool_()))

    return run


def _overlaps(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            t = pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], schema=schema)
            yield t.filter(pa.array(good, pa.bool_()))

    return run


def components(edges: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that edges (a, b) reach. Large-star and small-star rounds, each written to the shared folder.

    Rounds grow with the logarithm of the nodes; an error is raised if `rounds` of them don't end it.
    """
    e = keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    for left in range(rounds, -1, -1):
        # done when the edges are stars: each u has one v, and no v is a u
        roles = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per = roles.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        state = per.agg(F.max(F.expr("up > 1 or (up = 1 and down > 0)")).alias("open"), F.max(F.col("up") + F.col("down")).alias("degree")).first()
        if not state["open"]:
            break
        if not left:
            raise RuntimeError(f"components are not connected after {rounds} rounds")
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        salts = max(1, min(64, -(-state["degree"] // KEY_ROWS)))  # the neighbours of a node of very many are no one task's work
        salt = F.pmod(F.xxhash64("v"), F.lit(salts))
        low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
        large = both.where("v > u").withColumn("salt", salt).join(low, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        before, e = e, keep(small, name)
        drop(before)
    return e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, width: int = WIDTH, broadcast_rows: int = 2_000_000, sig_bits: int = 64) -> DataFrame:
    """One row per row of docs: (id_col, n_shingles, component_id, class_sig, label, text_hash).

    Null or blank texts have no shingles and link with nothing; null ids are allowed (they are never a component's
    id unless it holds no other). Repeated rows are equal sets. Extra columns of docs are not read. class_sig names
    the set, label the component (both null without shingles); id and text_hash together tell rows apart whose ids repeat.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    sets = keep(src.mapInArrow(_sets(width, True, bits=sig_bits), _SETS_DDL), "shingles")
    rows = sets.where("n >= 0").select("doc_id", "text_hash", "n", "sig", "sig2")
    stats = rows.agg(F.sum(F.col("n").cast("long")).alias("n")).first()
    # n sets have about n * n / 2 ** 65 such names: a handful for any table that can be stored
    clashing = rows.where("sig is not null").groupBy("sig").agg(F.min("sig2").alias("x"), F.max("sig2").alias("y")).where("x <> y").select("sig").limit(MOST_CLASHING + 1).collect()
    if len(clashing) > MOST_CLASHING:
        raise ValueError(f"more than {MOST_CLASHING} names of shingle sets clash")
    clashing = frozenset(r["sig"] for r in clashing)
    if clashing:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*clashing), F.col("sig").bitwiseXOR(F.col("sig2"))).otherwise(F.col("sig")))
    totals = sum_arrays(sets.where("n < 0").select((-1 - F.col("n")).alias("slot"), F.col("shingles").alias("blob")), "uint32").collect()
    counts = np.zeros((SLICES, (1 << CLASS_BITS) // SLICES), np.int64)
    for r in totals:
        counts[r["slot"]] = np.frombuffer(zlib.decompress(r["blob"]), np.uint32)
    counts = counts.ravel()
    usual = float(np.median(counts)) if len(counts) else 0.0
    bound = 24 + usual + 6 * math.sqrt(usual + 1)
    classes = np.where(counts > bound, np.log2(np.maximum(counts / bound, 1)).astype(np.int64) + 1, 0).astype(np.uint8)
    bc = spark.sparkContext.broadcast(zlib.compress(classes.tobytes(), 1))  # 2 ** CLASS_BITS bytes at most, whatever the input
    expected = int((stats["n"] or 0) * (100 - percent) / 100) + 1
    bits = max(6, math.ceil(math.log2(max(1, expected / 1_000_000))))
    index = src.select("text").mapInArrow(_index(bc, percent, bits, width, clashing, sig_bits), _KEYS_DDL)
    found = keep(index.groupBy("pid").applyInPandas(_propose(percent), _FOUND), "candidates")
    del index
    gc.collect()
    spark.sparkContext._jvm.System.gc()  # lets Spark drop the index's shuffle files

    low = F.lit(-(2**63))
    each = rows.where("sig is not null").groupBy("sig", F.coalesce("doc_id", low).alias("id"), "text_hash").agg(F.count("*").alias("times"))
    holder = keep(each.groupBy("sig").agg(F.min(F.struct("id", "text_hash", "times")).alias("first")).select("sig", "first.*"), "holders")  # a row that has the set, and how often it is repeated

    pool: list[DataFrame] = []  # the sets that were read again so far

    def needed(p: DataFrame) -> tuple[DataFrame, object]:
        """The sets that pairs name, and broadcast() if they are few enough for it."""
        need = keep(p.select(F.explode(F.array("a", "b")).alias("sig")).distinct(), "needed")
        return need, F.broadcast if need.count() <= broadcast_rows else (lambda df: df)

    def with_sides(p: DataFrame, **cols: str) -> DataFrame:
        """p with columns of the sets that it names; cols: column of the pool -> its name before a or b. Few pairs go to the sets, not sets to the pairs."""
        held = functools.reduce(DataFrame.unionByName, pool).select("sig", *cols)
        pairs = F.broadcast(p) if p.count() <= broadcast_rows else p
        sides = [held.join(pairs, F.col("sig") == F.col(c)).select("a", "b", *[F.col(k).alias(v + c) for k, v in cols.items()]) for c in ("a", "b")]
        return sides[0].join(sides[1], ["a", "b"])

    def linked(pairs: DataFrame) -> DataFrame:
        p = keep(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
        need, small = needed(p)
        new = need.select("sig")
        for known in pool:
            new = new.join(known.select("sig"), "sig", "left_anti")
        new = keep(new.join(holder, "sig"), "new")
        again = src.withColumn("id", F.coalesce("doc_id", low)).join(small(new.select("id").distinct()), "id", "left_semi").select("doc_id", "text", "text_hash")
        again = again.mapInArrow(_sets(width, False, clashing, sig_bits), _SETS_DDL).select("sig", F.coalesce("doc_id", low).alias("id"), "text_hash", "n", "small", "sketch", "shingles")
        held = keep(again.join(small(new.drop("times")), ["sig", "id", "text_hash"], "left_semi").select("sig", "n", "small", "sketch", "shingles"), "held")
        repeated = new.where("times > 1").select("sig")  # rows that repeat id and text: one of them is enough
        if repeated.take(1):
            held = held.join(repeated, "sig", "left_anti").unionByName(held.join(repeated, "sig", "left_semi").dropDuplicates(["sig"]))
        else:
            drop(new)
        pool.append(held)
        drop(need)
        maybe = p
        for bitmap in ("small", "sketch"):  # most pairs fall to the small ones, so that few whole ones move
            before, maybe = maybe, keep(with_sides(maybe, n="n", **{bitmap: "k"}).mapInArrow(_may_link(percent), "a long, b long"), "maybe")
            drop(before)
        out = keep(with_sides(maybe, shingles="s").mapInArrow(_overlaps(percent), "a long, b long").distinct(), "links")
        drop(maybe)
        return out

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs of sets that link. Only texts that some pair needs are read into sets again, and once."""
        out = linked(pairs)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the sets' shuffle files
        return out

    fits = f"(least(n - rare, m - rare2, (n - rest - rare + m - rest2 - rare2) div 3 + least(rest, rest2)) * {100 + percent} >= {percent} * (n + m) or n = 65535 or m = 65535)"  # see most_common
    hot = keep(found.where("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("sig"), "n", "rest", "rare", "prev").dropDuplicates(["key", "sig"]), "hot")
    any_hot = bool(hot.take(1))
    few = keep(found.where("kind < 2").select("kind", "a", "b"), "few")
    drop(found)
    found = few
    largest = hot.groupBy("key").count().agg(F.max("count").alias("c")).first()["c"] or 0
    salts = max(1, min(64, -(-largest // KEY_ROWS)))

    def with_key(members: DataFrame, per_key: DataFrame, how: str = "inner") -> DataFrame:
        """members with what belongs to their keys; a key's members are dealt over salts, so that a hot key is no one task's work."""
        m = members.withColumn("salt", F.pmod(F.xxhash64("sig"), F.lit(salts)))
        return m.join(per_key.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))), ["key", "salt"], how).drop("salt")

    def star(members: DataFrame, salt: int) -> DataFrame:
        """Each key's least edited member (that with the fewest rare shingles; the keys of a group mostly agree on it), with every other member."""
        centre = keep(members.groupBy("key").agg(F.min_by(F.struct("sig", "n", "rest", "rare", *[c for c in ("label",) if c in members.columns]), F.struct(F.col("rare") / F.col("n"), F.xxhash64("sig", F.lit(salt)))).alias("c")), "centres")
        j = with_key(members, centre).select("*", F.col("c.n").alias("m"), F.col("c.rest").alias("rest2"), F.col("c.rare").alias("rare2")).where(fits)
        if "label" in members.columns:
            j = j.where("label <> c.label")
        return j.select(F.col("c.sig").alias("a"), F.col("sig").alias("b")).where("a <> b")

    pairs = found.where("kind = 0").select("a", "b")
    links = verified(pairs.union(star(hot, 0)) if any_hot else pairs)
    lab = keep(components(links), "labels")

    def joined(new: DataFrame) -> DataFrame:
        """Labels after more links: only the labels themselves are connected anew."""
        if not new.take(1):
            return lab
        up = components(labelled(labelled(new, "a", "la"), "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
        up = keep(up.select(F.col("node").alias("l0"), F.col("label").alias("l1")), "up")
        known = lab.unionByName(new.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(lab, "node", "left_anti").withColumn("label", F.col("node")))
        return keep(known.join(up, F.col("label") == F.col("l0"), "left").select("node", F.coalesce("l1", "label").alias("label")), "labels")

    def labelled(df: DataFrame, col: str, out: str) -> DataFrame:
        return df.join(lab.select(F.col("node").alias(col), F.col("label").alias("_l")), col, "left").withColumn(out, F.coalesce("_l", col)).drop("_l")

    def members_apart() -> DataFrame:
        """Rows of those frequent keys whose members are still in more than one component."""
        marked = labelled(hot, "sig", "label")
        mixed = keep(marked.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key"), "mixed")
        return keep(with_key(marked, mixed), "members")

    def all_apart(members: DataFrame) -> DataFrame:
        """Pairs of members of a key in different components, as far as place and size leave a link possible; large groups are split into blocks."""
        ends = keep(members.groupBy("key").agg(F.min("n").alias("least_n"), F.max(F.col("n") - F.col("rest") - F.col("rare")).alias("most_before")), "ends")
        left = with_key(members, ends).where(f"least(n - rare, rest + (n - rest - rare + most_before) div 3) * {100 + percent} >= {percent} * (n + least_n) or n = 65535").drop("least_n", "most_before")
        left = keep(left, "possible")
        sizes = left.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key", "blocks")
        left = with_key(left, sizes)
        other = left.select("key", F.col("sig").alias("s2"), F.col("n").alias("m"), F.col("rest").alias("rest2"), F.col("rare").alias("rare2"), F.col("prev").alias("prev2"), F.col("label").alias("l2"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return left.withColumn("block", F.pmod(F.xxhash64("sig"), "blocks").cast("int")).join(other, ["key", "block"]).where("sig < s2 and label <> l2 and (prev <> prev2 or prev = 0)").where(fits).select(F.col("sig").alias("a"), F.col("s2").alias("b"))

    rest = labelled(labelled(found.where("kind = 1").select("a", "b").distinct(), "a", "la"), "b", "lb").where("la <> lb").select("a", "b")
    if any_hot:
        rest = rest.union(star(members_apart(), 1))
    lab = joined(verified(rest))
    if any_hot:
        lab = joined(verified(all_apart(members_apart())))
    full = labelled(rows.where("sig is not null").select("doc_id", "text_hash", "n", "sig"), "sig", "comp")
    full = keep(full, "classes")
    least = keep(full.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "least")
    out = full.join(least, "comp").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("sig").alias("class_sig"), F.col("comp").alias("label"), "text_hash")
    empty = rows.where("sig is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("class_sig"), F.lit(None).cast("long").alias("label"), "text_hash")
    return out.unionByName(empty).withColumnRenamed("doc_id", id_col)
