"""Operator 8: language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of the training rows meet by hash partition, as packed arrays. Each partition turns its
counts c into levels 1 + floor(log2 c) and sets, for every level up to that, K bits in one of its 2**SUB_BITS slices of
the filter. A slice has BITS bits for each of its (n-gram, level) entries, however many there are. A filter of at most
max_filter_bytes is broadcast. A larger one stays where it is: the texts' distinct n-grams, chunk by chunk, are sent to
their slices and the levels come back to the chunk. Both ways probe the same bits, so scores don't depend on the way.
A count is read by probing level after level until one is missing. P(w | v) = L * c(vw) / c(v) + (1 - L) * (c(w) + 1) / (N + V + 1).

The base score needs exact counts: the most frequent words (at most top_words) are broadcast, all others are
sent to the partition that counted them, which returns partial sums.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import WordHashes, batch, crc_mod, keep, mix, small_batches, words_of

PARTS_BITS, SUB_BITS, BITS, K, LAMBDA = 6, 6, 8, 4, 0.7
PART_BYTES = 16 << 20  # text for each partition of the counts, about
END, START = 0x1D8E4E27C47D124F, 0x7B1C9F3A5E2D4C61  # hashes of the end and start marks, which no word can be
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_LOW48 = np.uint64((1 << 48) - 1)
_MOST = 65_535
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)


def pair_keys(prev: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(mix(prev) * _PAIR + word + np.uint64(2))


def single_keys(word: np.ndarray) -> np.ndarray:
    return mix(word + np.uint64(0x5851F42D4C957F2D))


def _probes(key48: np.ndarray, level: int, size):
    """K bit places in a slice of `size` bits for each key at a level."""
    a = mix(key48 + np.uint64(level * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF))
    step = (a >> np.uint64(33)) | np.uint64(1)
    return [((a >> np.uint64(1)) + np.uint64(j) * step) % size for j in range(K)]


def _slice_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The slice of mixed 64-bit keys: the partition by the highest bits, its part by the highest of the low 48."""
    return ((keys >> np.uint64(64 - bits)) << np.uint64(SUB_BITS) | (keys & _LOW48) >> np.uint64(48 - SUB_BITS)).astype(np.int64)


def token_arrays(texts, hashes: WordHashes):
    """(tokens, offsets): each text's word hashes and one end mark."""
    arrays = []
    for t in texts:
        w = hashes.of(words_of(t))
        arrays.append(np.append(w, np.uint64(END)))
    sizes = np.array([len(a) for a in arrays], np.int64)
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(sizes)]


def previous(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    prev = np.r_[np.uint64(START), tokens[:-1]]
    prev[offsets[:-1]] = np.uint64(START)
    return prev


def _spans(pid: np.ndarray):
    cuts = np.flatnonzero(np.r_[True, pid[1:] != pid[:-1]]) if len(pid) else np.zeros(0, np.int64)
    return list(zip(cuts, np.r_[cuts[1:], len(pid)], strict=True)) if len(pid) else []


_COUNTED = pa.schema([("kind", pa.int32()), ("pid", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _count(bits: int, room: int = 1_500_000):
    def run(batches):
        words, held, n = WordHashes(), [], 0

        def flush():
            tokens = np.concatenate([x[0] for x in held])
            prev = np.concatenate([x[1] for x in held])
            for kind, keys in ((0, tokens), (1, pair_keys(prev, tokens))):
                keys, counts = np.unique(keys, return_counts=True)
                if kind:  # 16 bits for a pair's count: a larger one goes as several, which add up again
                    times = -(-counts // _MOST)
                    last = np.cumsum(times) - 1
                    rest = counts - (times - 1) * _MOST
                    keys, counts = np.repeat(keys, times), np.full(times.sum(), _MOST)
                    counts[last] = rest
                pid = ((keys if kind else single_keys(keys)) >> np.uint64(64 - bits)).astype(np.int32)
                if not kind:
                    order = np.argsort(pid, kind="stable")
                    keys, counts, pid = keys[order], counts[order], pid[order]
                spans = _spans(pid)
                pack = (lambda k: (k & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) if kind else (lambda k: k.tobytes())
                c = np.minimum(counts, 2**32 - 1).astype(np.uint32) if not kind else counts.astype(np.uint16)
                yield batch(_COUNTED, kind=[kind] * len(spans), pid=[int(pid[a]) for a, _ in spans], keys=[pack(keys[a:b]) for a, b in spans], counts=[c[a:b].tobytes() for a, b in spans])

        for b in batches:
            tokens, offsets = token_arrays((x.as_py() for x in b.column(0)), words)
            if len(tokens):
                held.append((tokens, previous(tokens, offsets)))
                n += len(tokens)
            if n >= room:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    return run


def _unpack48(blobs) -> np.ndarray:
    raw = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray):
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.int64)
    cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[cuts], np.add.reduceat(counts, cuts) if len(cuts) else counts[:0]


def _build(top: int):
    """One partition: exact word counts as they are, and its slices of the filter (words and pairs)."""

    def run(pdf):
        import pandas as pd

        one, two = pdf[pdf["kind"] == 0], pdf[pdf["kind"] == 1]
        words, counts = _summed(np.frombuffer(b"".join(one["keys"]), np.uint64), np.frombuffer(b"".join(one["counts"]), np.uint32))
        pairs, pair_counts = _summed(_unpack48(two["keys"]), np.frombuffer(b"".join(two["counts"]), np.uint16))
        keys = np.concatenate([single_keys(words) & _LOW48, pairs])
        levels = (np.floor(np.log2(np.r_[counts, pair_counts].astype(float))) + 1).astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        order = np.argsort(keys)
        keys, levels = keys[order], levels[order]
        cuts = np.searchsorted(keys, np.arange(1, 1 << SUB_BITS, dtype=np.uint64) << np.uint64(48 - SUB_BITS))
        sizes, blobs = [], []
        for k, level in zip(np.split(keys, cuts), np.split(levels, cuts), strict=True):
            sizes.append(-(-max(64, BITS * int(level.sum())) // 8) * 8)
            bits = np.zeros(sizes[-1], bool)
            for at_level in range(1, int(level.max(initial=0)) + 1):
                for at in _probes(k[level >= at_level], at_level, np.uint64(sizes[-1])):
                    bits[at.astype(np.int64)] = True
            blobs.append(np.packbits(bits, bitorder="little").tobytes())
        frequent = np.argsort(-counts, kind="stable")[:top]
        return pd.DataFrame({"pid": [int(pdf["pid"].iloc[0])], "words": [words.tobytes()], "counts": [counts.tobytes()], "n": [int(counts.sum())], "v": [len(words)], "sizes": [np.array(sizes, np.int64).tobytes()], "bits": [b"".join(blobs)], "top_words": [words[frequent].tobytes()], "top_counts": [counts[frequent].tobytes()]})

    return run


def _levels(key48: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of levels, from the first up, that are all present: of keys whose slice starts at a byte of data and has size bits."""
    out, rest = np.zeros(len(key48), np.int64), np.arange(len(key48))
    level = 1
    while len(rest):
        found = np.ones(len(rest), bool)
        for at in _probes(key48[rest], level, size[rest]):
            found &= (data[start[rest] + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        rest = rest[found]
        out[rest] = level
        level += 1
        if level > 48:
            break
    return out


def _middle(level: np.ndarray) -> np.ndarray:
    return np.where(level == 0, 0.0, np.where(level == 1, 1.0, 1.5 * 2.0 ** (level - 1.0)))


class LogFrequencyFilter:
    """All slices of partitions' (sizes, bits); counts are read back as the middle of their level."""

    def __init__(self, parts: dict[int, tuple[bytes, bytes]], bits: int):
        self.bits = bits
        none = (np.full(1 << SUB_BITS, 64, np.int64).tobytes(), bytes(8 << SUB_BITS))
        held = [parts.get(p, none) for p in range(1 << bits)]
        sizes = np.frombuffer(b"".join(x[0] for x in held), np.int64)
        self.sizes, self.starts = sizes.astype(np.uint64), np.r_[0, np.cumsum(sizes // 8)][:-1]
        self.data = np.frombuffer(b"".join(x[1] for x in held), np.uint8)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        at = _slice_of(keys, self.bits)
        return _middle(_levels(keys & _LOW48, self.data, self.starts[at], self.sizes[at]))


class Answers:
    """Levels that slices have sent back for distinct keys, in place of the filter."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.levels = keys[order], levels[order].astype(np.int64)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return _middle(self.levels[np.searchsorted(self.keys, keys)])


def _questions(tokens: np.ndarray, prev: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, slices): the distinct keys that tokens after prev ask for, in the order of their slices."""
    keys = np.unique(np.r_[single_keys(np.unique(np.r_[tokens, prev])), pair_keys(prev, tokens)])
    at = _slice_of(keys, bits)
    order = np.argsort(at, kind="stable")
    return keys[order], at[order]


def log_probabilities(f: LogFrequencyFilter | Answers, tokens: np.ndarray, prev: np.ndarray, n: int, v: int) -> np.ndarray:
    u, at = np.unique(np.r_[tokens, prev], return_inverse=True)
    single = f.counts(single_keys(u))[at]
    word, context = single[: len(tokens)], single[len(tokens) :]
    pair = f.counts(pair_keys(prev, tokens))
    conditional = np.where(context > 0, np.minimum(pair, context) / np.maximum(context, 1), 0.0)
    # the start mark is no token of the corpus, so its context count is 0 and its pairs fall back to words
    return np.log10(LAMBDA * conditional + (1 - LAMBDA) * (word + 1) / (n + v + 1))


_SCORED = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("pid", pa.int32()), ("rows", pa.binary()), ("keys", pa.binary()), ("tf", pa.binary())])


def _score(model_bc, bits: int, room: int = 1_500_000):
    """Without a filter in the model, score is null and chunks ask: kind 2 is a chunk's keys for a slice, kind 3 its texts."""

    def run(batches):
        f, top_words, top_counts, n, v = model_bc.value
        words, first = WordHashes(), (TaskContext.get().partitionId() << 40)
        done, held, rows_held, asking, tokens_held = 0, [], 0, [], 0

        def column(m, **have):
            return batch(_SCORED, **{k.name: have.get(k.name, [None] * m) for k in _SCORED})

        def flush():
            row, key, tf = (np.concatenate([x[i] for x in held]) for i in range(3))
            pid = (single_keys(key) >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(pid, kind="stable")
            row, key, tf, pid = row[order], key[order], tf[order], pid[order]
            spans = _spans(pid)
            return column(len(spans), kind=[1] * len(spans), pid=[int(pid[a]) for a, _ in spans], rows=[row[a:b].tobytes() for a, b in spans], keys=[key[a:b].tobytes() for a, b in spans], tf=[tf[a:b].tobytes() for a, b in spans])

        def ask():
            row, tokens, sizes, prev = (np.concatenate([x[i] for x in asking]) for i in range(4))
            keys, at = _questions(tokens, prev, bits)
            spans = _spans(at)
            yield column(len(spans), kind=[2] * len(spans), row=[int(row[0])] * len(spans), pid=[int(at[a]) for a, _ in spans], keys=[keys[a:b].tobytes() for a, b in spans])
            yield column(1, kind=[3], row=[int(row[0])], rows=[row.tobytes()], keys=[tokens.tobytes()], tf=[sizes.tobytes()])

        for b in batches:
            m = b.num_rows
            if not m:
                continue
            tokens, offsets = token_arrays((x.as_py() for x in b.column(1)), words)
            sizes = np.diff(offsets)
            prev, score = previous(tokens, offsets), [None] * m
            if f is not None:
                score = np.add.reduceat(log_probabilities(f, tokens, prev, n, v), offsets[:-1])
            else:
                asking.append((first + done + np.arange(m), tokens, sizes, prev))
                tokens_held += len(tokens)
            at = np.minimum(np.searchsorted(top_words, tokens), max(0, len(top_words) - 1))
            hit = top_words[at] == tokens if len(top_words) else np.zeros(len(tokens), bool)
            base = np.where(hit, np.log10(top_counts[at] + 1.0) if len(top_words) else 0.0, 0.0)
            doc = np.repeat(np.arange(m), sizes)
            rare_doc, rare = doc[~hit], tokens[~hit]
            order = np.lexsort((rare, rare_doc))
            rare_doc, rare = rare_doc[order], rare[order]
            new = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])]) if len(rare) else np.zeros(0, np.int64)
            held.append((first + done + rare_doc[new], rare[new], np.diff(np.r_[new, len(rare)]).astype(np.uint32)))
            rows_held += len(new)
            yield column(m, kind=[0] * m, row=(first + done + np.arange(m)), doc_id=b.column(0), n_tokens=sizes, n_known=np.add.reduceat(hit.astype(np.int64), offsets[:-1]), base=np.add.reduceat(base, offsets[:-1]), score=score)
            done += m
            if rows_held > 1_000_000:
                yield flush()
                held, rows_held = [], 0
            if tokens_held >= room:
                yield from ask()
                asking, tokens_held = [], 0
        if rows_held:
            yield flush()
        if asking:
            yield from ask()

    return run


def _partial(bits: int):
    """The partition that counted some words adds up, for each row, what those words contribute."""

    def run(key, tokens, model):
        import pandas as pd

        words = np.frombuffer(b"".join(model["words"]), np.uint64)
        counts = np.frombuffer(b"".join(model["counts"]), np.int64)
        row, word, tf = np.frombuffer(b"".join(tokens["rows"]), np.int64), np.frombuffer(b"".join(tokens["keys"]), np.uint64), np.frombuffer(b"".join(tokens["tf"]), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(words, word), max(0, len(words) - 1))
        hit = words[at] == word if len(words) else np.zeros(len(word), bool)
        row, tf, c = row[hit], tf[hit], counts[at[hit]] if len(words) else counts[:0]
        order = np.argsort(row, kind="stable")
        row, known, base = row[order], tf[order], (tf * np.log10(c + 1.0))[order]
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        if not len(cuts):
            return pd.DataFrame({"pid": [], "rows": [], "known": [], "base": []})
        row, known, base = row[cuts], np.add.reduceat(known, cuts), np.add.reduceat(base, cuts)
        pid = (mix(row.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int32)
        order = np.argsort(pid, kind="stable")
        row, known, base, pid = row[order], known[order], base[order], pid[order]
        spans = _spans(pid)
        return pd.DataFrame({"pid": [int(pid[a]) for a, _ in spans], "rows": [row[a:b].tobytes() for a, b in spans], "known": [known[a:b].tobytes() for a, b in spans], "base": [base[a:b].tobytes() for a, b in spans]})

    return run


def _slices(batches):
    schema = pa.schema([("pid", pa.int32()), ("bits", pa.binary())])
    for b in batches:
        for pid, sizes, bits in zip(*(b.column(k) for k in range(3)), strict=True):
            ends, raw = np.cumsum(np.frombuffer(sizes.as_py(), np.int64) // 8), bits.as_py()
            for k, (x, y) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
                yield batch(schema, pid=[pid.as_py() << SUB_BITS | k], bits=[raw[x:y]])


def _answer(key, asked, held):
    """One slice's levels for the keys of each chunk."""
    import pandas as pd

    sizes = [len(k) // 8 for k in asked["keys"]]
    keys = np.frombuffer(b"".join(asked["keys"]), np.uint64)
    levels = np.zeros(len(keys), np.int64)
    for bits in held["bits"]:
        levels = _levels(keys & _LOW48, np.frombuffer(bits, np.uint8), np.zeros(len(keys), np.int64), np.full(len(keys), 8 * len(bits), np.uint64))
    parts = np.split(levels.astype(np.uint8), np.cumsum(sizes)[:-1]) if sizes else []
    return pd.DataFrame({"row": asked["row"].to_numpy(np.int64), "pid": asked["pid"].to_numpy(np.int32), "levels": [x.tobytes() for x in parts]})


def _rescore(n: int, v: int, bits: int):
    """One chunk: its texts' scores from the levels that its slices have sent back."""

    def run(key, texts, answers):
        import pandas as pd

        row, tokens, sizes = (np.frombuffer(texts[c].iloc[0], t) for c, t in (("rows", np.int64), ("keys", np.uint64), ("tf", np.int64)))
        offsets = np.r_[0, np.cumsum(sizes)]
        prev = previous(tokens, offsets)
        levels = np.frombuffer(b"".join(answers.sort_values("pid")["levels"]), np.uint8)
        f = Answers(_questions(tokens, prev, bits)[0], levels)
        return pd.DataFrame({"row": row, "sent_score": np.add.reduceat(log_probabilities(f, tokens, prev, n, v), offsets[:-1])})

    return run


def _gathered(pdf):
    import pandas as pd

    row, known, base = np.frombuffer(b"".join(pdf["rows"]), np.int64), np.frombuffer(b"".join(pdf["known"]), np.int64), np.frombuffer(b"".join(pdf["base"]), np.float64)
    u, at = np.unique(row, return_inverse=True)
    return pd.DataFrame({"row": u, "more_known": np.bincount(at, known).astype(np.int64), "more_base": np.bincount(at, base)})


def part_bits_for(n_bytes: int) -> int:
    """2 ** bits partitions, so that each counts about PART_BYTES of text: from 64 of them up to 65,536, which 1 TB needs."""
    return min(16, max(PARTS_BITS, math.ceil(math.log2(max(1, n_bytes / PART_BYTES)))))


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out_mod: int = 7, held_out_rest: int = 2, part_bits: int | None = None, max_filter_bytes: int = 384 << 20, top_words: int = 196_608) -> DataFrame:
    """One row per row of docs: (id_col, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Null or blank texts have one token, the end. Rows with a null id are training rows. Repeated rows count and score
    each. An empty table gives an empty result. Extra columns of docs are not read. Words are told apart by 64-bit hashes.
    The number of partitions follows the size of the texts unless part_bits is given.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest, F.lit(False))
    if part_bits is None:
        part_bits = part_bits_for(src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    parts = 1 << part_bits
    counted = src.where(~held_out).select("text").mapInArrow(_count(part_bits), "kind int, pid int, keys binary, counts binary")
    model = keep(counted.groupBy("pid").applyInPandas(_build(max(1, top_words // parts)), "pid int, words binary, counts binary, n long, v long, sizes binary, bits binary, top_words binary, top_counts binary"), "lm")
    slices = model.select("pid", "n", "v", "sizes", F.length("bits").alias("n_bytes"), "top_words", "top_counts").collect()  # top_words bounds it
    n, v = sum(r["n"] for r in slices), sum(r["v"] for r in slices)
    sent = sum(r["n_bytes"] for r in slices) > max_filter_bytes
    f = None if sent else LogFrequencyFilter({r["pid"]: (bytes(r["sizes"]), bytes(r["bits"])) for r in model.select("pid", "sizes", "bits").collect()}, part_bits)  # at most max_filter_bytes
    top = np.frombuffer(b"".join(r["top_words"] for r in slices), np.uint64)
    top_counts = np.frombuffer(b"".join(r["top_counts"] for r in slices), np.int64)
    del slices
    order = np.argsort(top)
    bc = spark.sparkContext.broadcast((f, top[order], top_counts[order], n, v))
    del f
    scored = keep(src.mapInArrow(_score(bc, part_bits), "kind int, row long, doc_id long, n_tokens long, n_known long, base double, score double, pid int, rows binary, keys binary, tf binary"), "scored")
    sums = scored.where("kind = 1").select("pid", "rows", "keys", "tf").groupBy("pid").cogroup(model.select("pid", "words", "counts").groupBy("pid")).applyInPandas(_partial(part_bits), "pid int, rows binary, known binary, base binary")
    sums = keep(sums.groupBy("pid").applyInPandas(_gathered, "row long, more_known long, more_base double"), "sums")
    out = scored.where("kind = 0").select("row", "doc_id", "n_tokens", "n_known", "base", "score").join(sums, "row", "left")
    if sent:
        held = model.select("pid", "sizes", "bits").mapInArrow(_slices, "pid int, bits binary")
        answers = scored.where("kind = 2").select("row", "pid", "keys").groupBy("pid").cogroup(held.groupBy("pid")).applyInPandas(_answer, "row long, pid int, levels binary")
        chunks = scored.where("kind = 3").select(F.col("row").alias("chunk"), "rows", "keys", "tf").groupBy("chunk")
        scores = keep(chunks.cogroup(answers.withColumnRenamed("row", "chunk").groupBy("chunk")).applyInPandas(_rescore(n, v, part_bits), "row long, sent_score double"), "scores")
        out = out.join(scores, "row").withColumn("score", F.col("sent_score"))
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select(F.col("doc_id").alias(id_col), held_out.alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
