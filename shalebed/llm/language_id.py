"""Operator 3: language identification.

Sparse multinomial logistic regression on TF-IDF of hashed character 1- to 3-grams, trained by follow-the-regularised-
leader with elastic-net penalties, then calibrated by one temperature. Everything is learned from every training row:
labels and document frequencies are counted over all; rows are dealt by hash into groups of about sample_rows, each
group learns weights from four fifths of its rows, and the model is their mean. The other fifths together fit the
temperature and the least evidence.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from shalebed.llm.common import batch, crc_mod, drop, keep, pack, small_batches, sum_arrays

DIM_BITS = 14
DIM = 1 << DIM_BITS
LOW_SHARE, LOW_FACTOR = 0.002, 1 / 3
GRID = np.exp(np.linspace(math.log(0.02), math.log(5), 80))  # temperatures
SCALE = 1 << 20  # of sums of whole numbers, which are the same in any order
MOST_TASKS, RUN_BYTES = 4096, 1 << 26
PIECE = 1_000_000  # code points that are hashed at once, with the last two of the piece before
_WORD = re.compile(r"[^\W\d_]+")  # letters, and numerals that are no decimal digits
_A, _B = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed 1-, 2- and 3-grams of a whole text in lower case."""
    total = np.zeros(DIM, np.int64)
    text = text.lower()
    for start in range(0, len(text), PIECE):
        lead = min(2, start)
        c = np.frombuffer(text[start - lead : start + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = c * _A
        one = (h[lead:] ^ (h[lead:] >> np.uint32(15))) * _B
        two = (h[:-1] * _B + c[1:]) * _A
        three = (two[:-1] * _B + c[2:]) * _A
        for x in (one, two[max(0, lead - 1) :], three):
            total += np.bincount(x >> np.uint32(32 - DIM_BITS), minlength=DIM)
    return total


def has_letter(text: str) -> bool:
    """One of Unicode's letters; numerals such as a half or a superscript two are none."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m.group())


def weigh(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): TF-IDF with 1 + log tf, of length 1."""
    at = np.flatnonzero(counts)
    v = (1 + np.log(counts[at])) * idf[at]
    norm = math.sqrt(float(v @ v))
    return at, v / norm if norm else v


class Ftrl:
    """Multinomial logistic regression; per-coordinate FTRL-proximal with L1 and L2."""

    def __init__(self, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.z, self.n = np.zeros((DIM, classes)), np.zeros((DIM, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, v: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(v @ w)
        p[label] -= 1
        g = v[:, None] * p
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - s * w
        self.n[at] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def losses(logits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The negative log-likelihood of all rows together, for each temperature of the grid."""
    return np.array([-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).sum() for t in GRID])


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The one of a grid of temperatures with the least negative log-likelihood."""
    return float(GRID[int(np.argmin(losses(logits, labels)))])


def _frequencies(batches):
    """A task's document frequencies and number of rows, and the labels that it has seen."""
    df, n, labels = np.zeros(DIM, np.int64), 0, set()
    for b in batches:
        labels.update(b.column(1).to_pylist())
        for t in b.column(0):
            t = t.as_py()
            if t:
                df += gram_counts(t) > 0
            n += 1
    yield pa.RecordBatch.from_pydict({"slot": pa.array([0] + [None] * len(labels), pa.int32()), "blob": pa.array([pack(np.r_[df, n])] + [None] * len(labels), pa.binary()), "label": pa.array([None, *sorted(labels)], pa.string())})


def _sparse(batches):
    schema = pa.schema([("label", pa.string()), ("h", pa.int64()), ("at", pa.binary()), ("tf", pa.binary())])
    for b in batches:
        out = {"label": b.column(0).to_pylist(), "h": b.column(1).to_pylist(), "at": [], "tf": []}
        for t in b.column(2):
            c = gram_counts(t.as_py())
            at = np.flatnonzero(c)
            out["at"].append(at.astype(np.int16).tobytes())
            out["tf"].append(c[at].astype(np.min_scalar_type(c.max())).tobytes())
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def unpacked(at: bytes, tf: bytes, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """weigh() of the counts that _sparse() wrote, in the least type that holds them."""
    places = np.frombuffer(at, np.int16)
    c = np.zeros(DIM, np.int64)
    if len(places):
        c[places] = np.frombuffer(tf, f"u{len(tf) // len(places)}")
    return weigh(c, idf)


_LEARNED = pa.schema([("slot", pa.int32()), ("blob", pa.binary()), ("y", pa.int32()), ("at", pa.binary()), ("tf", pa.binary())])
_LEARNED_DDL = "slot int, blob binary, y int, at binary, tf binary"


def _learned(labels: list[str], idf: np.ndarray, epochs: int):
    """Rows (deal, h, label, at, tf), sorted: for each group a slot for each label, its weights times the rows they come from, a slot of that number, and the rows held back.

    A group of very long texts, or of many rows alike, learns in runs of bounded size. A run too short to hold rows
    back is judged by those that it learned from.
    """
    place = {x: k for k, x in enumerate(labels)}

    def learn(rows):
        cut = max(1, len(rows) // 5) if len(rows) > 4 else 0
        held, fitted = rows[:cut], rows[cut:]
        m = Ftrl(len(labels))
        for _ in range(epochs):
            for y, at, tf in fitted:
                m.learn(*unpacked(at, tf, idf), y)
        w = np.rint(m.weights() * SCALE).astype(np.int64) * len(fitted)
        check = held or fitted
        blobs = [*(pack(np.ascontiguousarray(w[:, k])) for k in range(len(labels))), pack(np.array([len(fitted)]))]
        none, more = [None] * len(check), [None] * len(blobs)
        return batch(_LEARNED, slot=[*range(len(blobs)), *none], blob=blobs + none, **{k: more + [r[i] for r in check] for i, k in enumerate(("y", "at", "tf"))})

    def run(batches):
        rows, size, group = [], 0, None
        for b in batches:
            for deal, label, at, tf in zip(*(b.column(k).to_pylist() for k in ("deal", "label", "at", "tf")), strict=True):
                if rows and (deal != group or size >= RUN_BYTES):
                    yield learn(rows)
                    rows, size = [], 0
                group, size = deal, size + 200 + len(at) + len(tf)
                rows.append((place[label], at, tf))
        if rows:
            yield learn(rows)

    return run


def _checked(idf: np.ndarray, w: np.ndarray):
    """The evidence of each row held back, and a task's losses() in whole numbers."""

    def run(batches):
        total = np.zeros(len(GRID), np.int64)
        for b in batches:
            seen = [unpacked(at, tf, idf) for at, tf in zip(b.column("at").to_pylist(), b.column("tf").to_pylist(), strict=True)]
            if not seen:
                continue
            logits = np.array([v @ w[at] for at, v in seen])
            total += np.rint(losses(logits, b.column("y").to_numpy()) * SCALE).astype(np.int64)
            evidence = [float(x.max()) / math.sqrt(max(1, len(at))) for x, (at, _) in zip(logits, seen, strict=True)]
            yield pa.RecordBatch.from_pydict({"evidence": pa.array(evidence, pa.float64()), "blob": pa.nulls(len(seen), pa.binary())})
        yield pa.RecordBatch.from_pydict({"evidence": pa.nulls(1, pa.float64()), "blob": pa.array([pack(total)], pa.binary())})

    return run


class Model:
    """lowest: the evidence that nearly all held-back rows of known languages pass, see fit()."""

    def __init__(self, labels: list[str], idf: np.ndarray, w: np.ndarray, t: float, lowest: float = 0.0):
        self.labels, self.idf, self.w, self.t, self.lowest = labels, idf, w, t, lowest

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(label, calibrated score, evidence).

        The evidence is the label's logit over the root of the number of distinct grams: about what a gram says for the
        label, in texts of any length. It is low for texts of no learned language, whatever the score.
        """
        if not text or not has_letter(text) or not self.labels:
            return "und", 0.0, 0.0
        at, v = weigh(gram_counts(text), self.idf)
        logits = v @ self.w[at]
        p = softmax(logits / self.t)
        k = int(p.argmax())
        return self.labels[k], float(p[k]), float(logits[k]) / math.sqrt(max(1, len(at)))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out_mod: int = 5, held_out_rest: int = 0, sample_rows: int = 4000, epochs: int = 3) -> Model:
    """Learns from rows with text and label whose crc32(id as text) modulo held_out_mod is not held_out_rest.

    All these rows are used: each group of about sample_rows of them, dealt by hash, learns weights from four fifths of
    its rows, and their mean counts. The fifths held back together give the temperature, and the evidence below which a
    text is hardly of any learned language: LOW_FACTOR of what all but LOW_SHARE of them reach. (The score can't tell:
    where no language fits, one may still be far likelier than the rest.) With one label there is no evidence.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rest = F.coalesce(crc_mod(F.col("doc_id"), held_out_mod), F.lit(-1))
    train = src.where(F.col("text").isNotNull() & F.col("label").isNotNull() & (rest != held_out_rest))
    small_batches(docs.sparkSession)
    seen = keep(train.select("text", "label").mapInArrow(_frequencies, "slot int, blob binary, label string"), "frequencies")
    blob = sum_arrays(seen.where("slot is not null").select("slot", "blob"), "int64").first()
    labels = sorted(r["label"] for r in seen.where("label is not null").select("label").distinct().collect())
    drop(seen)
    if not labels:
        return Model([], np.ones(DIM), np.zeros((DIM, 0)), 1.0)
    df = np.frombuffer(zlib.decompress(blob["blob"]), np.int64)
    n, df = int(df[-1]), df[:-1]
    idf = np.log((1 + n) / (1 + df)) + 1
    groups = max(1, round(n / sample_rows))
    rows = train.select("label", F.xxhash64("doc_id", "text", F.lit(7)).alias("h"), "text").mapInArrow(_sparse, "label string, h long, at binary, tf binary")
    rows = rows.withColumn("deal", F.pmod("h", F.lit(groups))).repartition(min(groups, MOST_TASKS), "deal").sortWithinPartitions("deal", "h", "label", "at", "tf")
    learned = keep(rows.mapInArrow(_learned(labels, idf, epochs), _LEARNED_DDL), "learned")
    sums = {r["slot"]: np.frombuffer(zlib.decompress(r["blob"]), np.int64) for r in sum_arrays(learned.where("slot is not null").select("slot", "blob"), "int64").collect()}
    w = (np.stack([sums[k] for k in range(len(labels))], axis=1) / (SCALE * int(sums[len(labels)][0]))).astype(np.float32)
    t, lowest = 1.0, 0.0
    if len(labels) > 1:
        checked = keep(learned.where("at is not null").select("y", "at", "tf").mapInArrow(_checked(idf, w), "evidence double, blob binary"), "checked")
        total = sum_arrays(checked.where("blob is not null").select(F.lit(0).alias("slot"), "blob"), "int64").first()
        t = float(GRID[int(np.argmin(np.frombuffer(zlib.decompress(total["blob"]), np.int64)))])
        lowest = lowest_evidence(least_of(checked.where("evidence is not null").select("evidence")), len(labels))
        drop(checked)
    drop(learned)
    return Model(labels, idf, w, t, lowest)


def least_of(rows: DataFrame) -> list[float]:
    """The LOW_SHARE quantile of a column, exactly: two neighbours in its order, and what lies between."""
    place = LOW_SHARE * max(0, rows.count() - 1)
    two = [r[0] for r in rows.orderBy(rows.columns[0]).offset(int(place)).limit(2).collect()]
    return [two[0] + (two[-1] - two[0]) * (place - int(place))] if two else []


def lowest_evidence(evidence: list[float], labels: int) -> float:
    return LOW_FACTOR * max(0.0, float(np.quantile(evidence, LOW_SHARE))) if labels > 1 and evidence else 0.0


def _predict(model_bc, place: int, names: tuple[str, ...]):
    def run(batches):
        m = model_bc.value
        for b in batches:
            got = [m.predict(t.as_py()) for t in b.column(place)]
            more = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64()))][: len(names)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *names])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", evidence_col: str | None = None) -> DataFrame:
    """docs with more columns, pred_col, score_col and evidence_col if it is given, whose names docs must not have yet.

    Null texts and texts without a letter are `und` with score and evidence 0, as is all text for a model that saw no label.
    """
    names = tuple(c for c in (pred_col, score_col, evidence_col) if c is not None)
    if {c.lower() for c in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column of {', '.join(names)} already; give other names")
    small_batches(docs.sparkSession)
    bc = docs.sparkSession.sparkContext.broadcast(model)  # DIM weights a language
    schema = StructType([*docs.schema.fields, *[StructField(c, StringType() if c == pred_col else DoubleType()) for c in names]])
    return docs.mapInArrow(_predict(bc, docs.columns.index(text_col), names), schema)


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", held_out_mod: int = 5, held_out_rest: int = 0, sample_rows: int = 4000) -> DataFrame:
    """One row per row of docs: (id_col, held_out, lang_pred, score). Null ids are never held out. Ties go to the first label in order."""
    model = fit(docs, id_col, text_col, label_col, held_out_mod, held_out_rest, sample_rows)
    out = identify(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), model)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), held_out_mod) == held_out_rest, F.lit(False))
    return out.select(F.col("doc_id").alias(id_col), held_out.alias("held_out"), "lang_pred", "score")
