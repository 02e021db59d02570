"""Operator 1: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs: a word is the sum of its own vector (if training saw it often enough) and of the vectors of its hashed
character n-grams. A window of WINDOW words goes through a GRU in each direction; attention pools the states; a logistic
unit judges. Windows overlap by half and cover the whole text; a text's score is that of its worst window.

The vocabulary of words with their own vectors has at most VOCABULARY words (the usual ones of the sample); all other
words have the vectors of their character n-grams alone.

Training, on a bounded sample of labelled rows: first every window carries its document's label; then, round after
round, a toxic document is held by its worst window alone and a clean one by the windows that scored worst.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.llm.common import crc_mod, keep, small_batches

WINDOW, STEP, DIM, HIDDEN, PIECE = 24, 12, 16, 8, 64
GRAM_BITS, VOCABULARY = 15, 20_000
_STRIP = ".,;:!?\"'()[]{}<>*#$%&~^_-+=/\\|`"
_P = np.uint32(0x9E3779B1)


def words(text: str | None) -> list[str]:
    """Lower-cased words between white space; those of more than PIECE characters as pieces that overlap by half."""
    found = text.lower().split() if text else []
    if not any(len(w) > PIECE for w in found):
        return found
    return [p for w in found for p in _pieces(w)]


def _pieces(word: str) -> list[str]:
    if len(word) <= PIECE or len(word.strip(_STRIP) or word) <= PIECE:
        return [word]
    return [word[s : s + PIECE] for s in range(0, len(word) - PIECE // 2, PIECE // 2)]


def gram_places(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(places, offsets): hashed character 3-, 4- and 5-grams of each word with its ends marked, word after word."""
    raw = [("\x02" + s + "\x03").encode("utf-32-le", "surrogatepass") for s in strings]
    sizes = np.array([len(r) // 4 for r in raw], np.int64)
    c = np.frombuffer(b"".join(raw), np.uint32)
    word = np.repeat(np.arange(len(raw)), sizes)
    places, owners = [], []
    h = c * _P
    for n in (2, 3, 4, 5):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * _P + c[n - 1 :] if len(h) > 1 else h[:0]
        if n >= 3 and len(h):
            inside = word[: len(h)] == word[n - 1 :]
            places.append((((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77 + 2 * n)) >> np.uint32(32 - GRAM_BITS))[inside])
            owners.append(word[: len(h)][inside])
    if not places:
        return np.zeros(0, np.int64), np.zeros(len(raw) + 1, np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(places)[order].astype(np.int64), np.r_[0, np.cumsum(np.bincount(owner, minlength=len(raw)))]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def summed_rows(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """n rows: the sums of those values whose place is that row."""
    return np.stack([np.bincount(at, values[:, k], n) for k in range(values.shape[1])], axis=1).astype(np.float32)


class Net:
    """Parameters p: W (word vectors, row 0 for unseen words), G (n-gram vectors), and per direction X, U, b; a, o, c."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 1):
        r = np.random.default_rng(seed)
        self.vocabulary = vocabulary
        f = np.float32
        self.p = {"W": (0.1 * r.standard_normal((len(vocabulary) + 1, DIM))).astype(f), "G": (0.1 * r.standard_normal((1 << GRAM_BITS, DIM))).astype(f)}
        self.p["W"][0] = 0
        for d in "fb":
            self.p["X" + d] = (r.standard_normal((DIM, 3 * HIDDEN)) / math.sqrt(DIM)).astype(f)
            self.p["U" + d] = (r.standard_normal((HIDDEN, 3 * HIDDEN)) / math.sqrt(HIDDEN)).astype(f)
            self.p["b" + d] = np.zeros(3 * HIDDEN, f)
        self.p["a"], self.p["o"], self.p["c"] = (0.3 * r.standard_normal(2 * HIDDEN)).astype(f), (0.3 * r.standard_normal(2 * HIDDEN)).astype(f), np.zeros(1, f)
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, strings: list[str]):
        """Vectors of distinct words, with what the backward pass needs."""
        clean = [s.strip(_STRIP) or s for s in strings]
        ids = np.array([self.vocabulary.get(s, 0) for s in clean], np.int64)
        places, offsets = gram_places(clean)
        n = np.maximum(np.diff(offsets), 1)
        total = np.zeros((len(clean), DIM), np.float32)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            total[full] = np.add.reduceat(self.p["G"][places], offsets[:-1][full])
        weight = (1 / np.sqrt(n)).astype(np.float32)[:, None]
        return self.p["W"][ids] + total * weight, (ids, places, offsets, weight)

    def run(self, x: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, tape: list | None = None) -> np.ndarray:
        """Logits of windows. x: pre-activations per word and direction; at, mask: windows x WINDOW places and presence."""
        b, h2 = at.shape[0], 2 * HIDDEN
        states = np.zeros((WINDOW, b, h2), np.float32)
        for d, order, part in (("f", range(WINDOW), slice(0, HIDDEN)), ("b", range(WINDOW - 1, -1, -1), slice(HIDDEN, h2))):
            h, U = np.zeros((b, HIDDEN), np.float32), self.p["U" + d]
            for t in order:
                pre = x[d][at[:, t]]
                zr = 0.5 + 0.5 * np.tanh(0.5 * (pre[:, :h2] + h @ U[:, :h2]))
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                rh = r * h
                g = np.tanh(pre[:, h2:] + rh @ U[:, h2:])
                m = mask[:, t : t + 1]
                z = z * m  # an absent word keeps the state
                new = h + z * (g - h)
                if tape is not None:
                    tape.append((d, t, h, z, r, g, rh, m))
                h = new
                states[t, :, part] = h
        e = np.where(mask.T > 0, states @ self.p["a"], -1e9)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", w, states)
        if tape is not None:
            tape.append((states, w, pooled))
        return pooled @ self.p["o"] + self.p["c"][0]

    def project(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        return {d: vectors @ self.p["X" + d] + self.p["b" + d] for d in "fb"}

    def gradients(self, strings: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        vectors, (ids, places, offsets, weight) = self.inputs(strings)
        x, tape = self.project(vectors), []
        logit = self.run(x, at, mask, tape)
        p, h2 = sigmoid(logit), 2 * HIDDEN
        loss = float(-(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)).mean())
        dl = ((p - y) / len(y)).astype(np.float32)
        states, w, pooled = tape.pop()
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in "WG"}
        g["o"], g["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpool = dl[:, None] * self.p["o"]
        dw = np.einsum("bh,tbh->tb", dpool, states)
        de = w * (dw - (w * dw).sum(axis=0))
        g["a"] = np.einsum("tb,tbh->h", de, states)
        ds = w[:, :, None] * dpool + de[:, :, None] * self.p["a"]
        parts = {"f": [], "b": []}
        carry = {d: np.zeros((len(y), HIDDEN), np.float32) for d in "fb"}
        for d, t, h, z, r, c, rh, m in reversed(tape):
            U, part = self.p["U" + d], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, h2)
            dh = carry[d] + ds[t, :, part]
            dz, dg = dh * (c - h), dh * z
            dpre_g = dg * (1 - c * c)
            drh = dpre_g @ U[:, h2:].T
            zz = np.where(m > 0, z, 0)
            dpre = np.concatenate([dz * m * zz * (1 - zz), drh * h * r * (1 - r), dpre_g], axis=1)
            g["U" + d][:, :h2] += h.T @ dpre[:, :h2]
            g["U" + d][:, h2:] += rh.T @ dpre_g
            carry[d] = dh * (1 - z) + drh * r + dpre[:, :h2] @ U[:, :h2].T
            parts[d].append((at[:, t], dpre * m))
        dx = {d: summed_rows(np.concatenate([p[0] for p in parts[d]]), np.concatenate([p[1] for p in parts[d]]), len(strings)) for d in "fb"}
        dv = 0
        for d in "fb":
            g["X" + d], g["b" + d] = vectors.T @ dx[d], dx[d].sum(axis=0)
            dv = dv + dx[d] @ self.p["X" + d].T
        seen = ids > 0
        g["W"] = (ids[seen], dv[seen])
        g["G"] = (places, np.repeat(dv * weight, np.diff(offsets), axis=0))
        return loss, g


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.m, self.v, self.t, self.rate = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0, rate

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        fix = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            if isinstance(d, tuple):  # rows of a table
                rows, at = np.unique(d[0], return_inverse=True)
                if not len(rows):
                    continue
                total = summed_rows(at, d[1], len(rows))
                self.m[k][rows] = 0.9 * self.m[k][rows] + 0.1 * total
                self.v[k][rows] = 0.999 * self.v[k][rows] + 0.001 * total**2
                p[k][rows] -= fix * self.m[k][rows] / (np.sqrt(self.v[k][rows]) + 1e-8)
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * d
                self.v[k] = 0.999 * self.v[k] + 0.001 * d**2
                p[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the overlapping windows over texts of these sizes laid end to end; an empty text has none."""
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1), 0)
    text = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.cumsum(sizes) - sizes
    return first[text] + k * STEP, np.minimum(WINDOW, sizes[text] - k * STEP), text


class Scorer:
    """Scores many texts at once; keeps the projected vectors of words it has met, up to a bound."""

    limit = 150_000

    def __init__(self, net: Net):
        self.net, self.ids, self.rows = net, {}, {d: np.zeros((0, 3 * HIDDEN), np.float32) for d in "fb"}
        self.filled = 0

    def _lookup(self, all_words: list[str]) -> np.ndarray:
        if self.filled > self.limit:
            self.ids, self.filled = {}, 0
        ids = self.ids
        new = [w for w in set(all_words) if w not in ids]
        if new:
            new.sort()
            for d in "fb":
                need = self.filled + len(new)
                if len(self.rows[d]) < need:
                    self.rows[d] = np.concatenate([self.rows[d], np.zeros((max(need, 2 * len(self.rows[d])) - len(self.rows[d]), 3 * HIDDEN), np.float32)])
            for s in range(0, len(new), 20_000):
                part = new[s : s + 20_000]
                x = self.net.project(self.net.inputs(part)[0])
                for d in "fb":
                    self.rows[d][self.filled : self.filled + len(part)] = x[d]
                for i, w in enumerate(part):
                    ids[w] = self.filled + i
                self.filled += len(part)
        return np.fromiter(map(ids.__getitem__, all_words), np.int64, len(all_words))

    def logits(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(worst logit of each text, the place of its worst window); texts without words get the lowest logit."""
        sizes = np.array([len(t) for t in texts], np.int64)
        at = self._lookup([w for t in texts for w in t])
        start, length, text = windows(sizes)
        best, where = np.full(len(texts), -30.0), np.zeros(len(texts), np.int64)
        out = np.zeros(len(start))
        reach = np.arange(WINDOW)
        for s in range(0, len(start), 8192):
            mask = reach < length[s : s + 8192, None]
            places = np.where(mask, start[s : s + 8192, None] + reach, 0)
            out[s : s + 8192] = self.net.run(self.rows, at[places], mask.astype(np.float32))
        if len(out):
            order = np.lexsort((-out, text))
            heads = order[np.r_[True, text[order][1:] != text[order][:-1]]]
            best[text[heads]] = out[heads]
            where[text[heads]] = (start - (np.cumsum(sizes) - sizes)[text])[heads]
        return best, where

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        return sigmoid(self.net.scale * self.logits(texts)[0] + self.net.shift)


def train(texts: list[str], labels: np.ndarray, seed: int = 1, first_steps: int = 200, rounds: int = 4, steps: int = 50, size: int = 192) -> Net:
    """Fits a net to whole texts and their labels."""
    r = np.random.default_rng(seed)
    toks = [words(t) for t in texts]
    counts: dict[str, int] = {}
    for t in toks:
        for w in set(t):
            w = w.strip(_STRIP) or w
            counts[w] = counts.get(w, 0) + 1
    usual = sorted((w for w, c in counts.items() if c >= 5), key=lambda w: (-counts[w], w))[:VOCABULARY]
    net = Net({w: i + 1 for i, w in enumerate(usual)}, seed)
    opt = Adam(net.p)
    bad, good = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    if not len(bad) or not len(good):
        net.shift = -5.0 if not len(bad) else 5.0
        net.scale = 0.0
        return net

    def learn(picked: list[tuple[int, int]]) -> None:
        spans = [toks[i][s : s + WINDOW] for i, s in picked]
        u = sorted({w for s in spans for w in s})
        ids = {w: k for k, w in enumerate(u)}
        at, mask = np.zeros((len(spans), WINDOW), np.int64), np.zeros((len(spans), WINDOW), np.float32)
        for k, s in enumerate(spans):
            at[k, : len(s)] = [ids[w] for w in s]
            mask[k, : len(s)] = 1
        _, g = net.gradients(u, at, mask, labels[[i for i, _ in picked]].astype(np.float32))
        opt.step(net.p, g)

    bad, good = [i for i in bad if toks[i]], [i for i in good if toks[i]]
    if not bad or not good:
        net.scale = 0.0
        return net
    some = lambda i: (i, STEP * int(r.integers(0, max(1, -(-(len(toks[i]) - WINDOW) // STEP) + 1))) if len(toks[i]) > WINDOW else 0)
    for _ in range(first_steps):
        learn([some(int(r.choice(g))) for g in (bad, good) for _ in range(size // 2)])
    opt.rate = 0.005
    known: list[tuple[int, int]] = []
    for _ in range(rounds):
        everyone = [*bad, *good]
        where = Scorer(net).logits([toks[i] for i in everyone])[1]
        worst = dict(zip(everyone, where, strict=True))
        known += [(i, int(worst[i])) for i in good]
        known = known[-4 * len(good) :]
        for _ in range(steps):
            hard = [known[k] for k in r.integers(0, len(known), size // 4)]
            learn([(int(i), int(worst[int(i)])) for i in r.choice(bad, size // 2)] + hard + [some(int(r.choice(good))) for _ in range(size // 4)])
    logit = Scorer(net).logits(toks)[0]
    # scores: a logistic fit of the worst logits, so that half-way between the classes is about a half
    a, b = float(np.median(logit[bad])), float(np.quantile(logit[good], 0.99))
    if a > b:
        net.scale, net.shift = 8 / (a - b), -8 * (0.5 * a + 0.5 * b) / (a - b)
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out_mod: int = 3, held_out_rest: int = 1, sample_toxic: int = 1500, sample_clean: int = 3000, sample_chars: int = 24_000_000, threshold: float = 0.7) -> DataFrame:
    """One row per row of docs: (id_col, held_out, score, predicted).

    The net is fitted on the whole texts of at most sample_toxic and sample_clean labelled rows, none of them held out,
    picked by a hash of the id; a text that would take their total past sample_chars characters is passed over. Every
    whole text is scored. Null and wordless texts get the lowest score. Labels that are null or not 0 or 1 are left out;
    if a document has several labels it counts as toxic if one says so; of texts that repeat an id the sample takes the
    least. Null ids are not held out. Repeated rows are scored each. Extra columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest, F.lit(False))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(n)
    chosen = pick(1, sample_toxic).union(pick(0, sample_clean))
    sample = src.join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sample = keep(sample.withColumn("n", F.length("text")), "sample")
    room, taken = sample_chars, []
    for r in sample.select("doc_id", "n").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").collect():  # sample_toxic + sample_clean rows at most
        if r["n"] <= room:
            taken.append(r["doc_id"])
            room -= r["n"]
    rows = sample.where(F.col("doc_id").isin(taken)).select("doc_id", "text", "y").collect() if taken else []
    rows.sort(key=lambda r: r["doc_id"])
    net = train([r["text"] for r in rows], np.array([r["y"] for r in rows], np.int64))
    bc = spark.sparkContext.broadcast(net)

    def run(batches):
        scorer, schema = Scorer(bc.value), pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for b in batches:
            texts = b.column(1)
            scores, held, n = [], [], 0
            for t in texts:
                w = words(t.as_py())
                held.append(w)
                n += len(w)
                if n > 300_000:
                    scores.append(scorer.scores(held))
                    held, n = [], 0
            if held:
                scores.append(scorer.scores(held))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else [], pa.float64())], schema=schema)

    out = src.mapInArrow(run, "doc_id long, score double")
    return out.select(F.col("doc_id").alias(id_col), held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))
