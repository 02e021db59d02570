"""Helpers that the training-data operators share: shared scratch tables, word hashing, row conversion."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: dict[int, list[str]] = {}
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode alone (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shalebed-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # the table takes the place of the shuffle files that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_path = path
    _held.setdefault(id(spark), []).append(path)
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table that keep() wrote, once nothing reads it any more; other tables are left alone."""
    path = df.__dict__.get("kept_path")
    if path:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _held.get(id(spark), []):
        _held[id(spark)].remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables that keep() writes inside, at the end, except those written by the function that it yields."""
    held = _held.setdefault(id(spark), [])
    spared = set(held)

    def outlives(df: DataFrame, name: str) -> DataFrame:
        out = keep(df, name)
        spared.add(out.kept_path)
        return out

    yield outlives
    for path in [p for p in held if p not in spared]:
        _delete(spark, path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column of df has (names are compared as Spark does, without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name



def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows to an Arrow batch, so that batches of very long texts stay small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id written as text, modulo n."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(n))


def crc_mod_py(value, n: int) -> int | None:
    return None if value is None else zlib.crc32(str(int(value)).encode()) % n


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split know ASCII only)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, computed once for each word; emptied when it grows past a bound."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def as_i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.tobytes(), 1)


def sum_arrays(df: DataFrame, dtype: str, salts: tuple[int, ...] = (1024, 32)) -> DataFrame:
    """Rows (slot int, blob binary: compressed arrays of equal shape) added up, slot by slot, as a tree: a group holds few blobs in each round."""

    def add(pdf):
        import pandas as pd

        total = None
        for b in pdf["blob"]:
            x = np.frombuffer(zlib.decompress(b), dtype).astype(np.int64)
            total = x if total is None else total + x
        if total is not None:
            total = np.minimum(total, np.iinfo(dtype).max)
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "blob": [pack(total.astype(dtype))]})

    schema = "slot int, blob binary"
    for n in salts:
        df = df.withColumn("salt", F.pmod(F.xxhash64("blob"), F.lit(n))).groupBy("slot", "salt").applyInPandas(add, schema)
    return df.groupBy("slot").applyInPandas(add, schema)
