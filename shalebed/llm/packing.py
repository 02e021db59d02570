"""Operator 10: optimal length buckets and token-budget batches.

Token counts become one histogram of the whole corpus (at most max_len rows). Dynamic programming over it chooses
the bucket boundaries that minimise padding; then batches of at most `budget` padded tokens form inside each bucket.
A bucket is dealt over salts of about `group` rows, so a bucket that holds a third of all rows is no one task's work;
each (bucket, salt) ends with one batch that may be short.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most `buckets` buckets over the sorted distinct lengths with the least total padding."""
    if not lengths:
        return []
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    n, k = len(x), min(buckets, len(lengths))
    total, tokens = np.r_[0, np.cumsum(c)], np.r_[0, np.cumsum(c * x)]
    best = np.full(n + 1, np.iinfo(np.int64).max // 4)
    best[0] = 0
    back = np.zeros((k + 1, n + 1), np.int32)
    for b in range(1, k + 1):
        now = best.copy()
        back[b] = -1  # no further bucket used
        for j in range(1, n + 1):
            cost = best[:j] + x[j - 1] * (total[j] - total[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < now[j]:
                now[j], back[b, j] = cost[i], i
        best = now
    ends, j, b = [], n, k
    while j > 0:
        while back[b, j] == -1:
            b -= 1
        ends.append(int(x[j - 1]))
        j, b = int(back[b, j]), b - 1
    return ends[::-1]


def token_count(text):
    """Number of white-space separated words (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def pack_batches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 2048, buckets: int = 16, budget: int = 16384, group: int = 2000) -> DataFrame:
    """One row per piece of at most max_len tokens: (id_col, piece, n_tokens, padded_len, batch_id, place).

    Longer texts are cut into pieces, so no token is lost; a text without words is one piece of 0 tokens, padded to
    its bucket. Rows are told apart by id and text; repeated rows are packed as often as they occur. Null ids are
    kept. batch_id names bucket, salt and number. Extra columns are not read.
    """
    from shalebed.llm.common import keep

    spark = docs.sparkSession
    sized = docs.select(F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).cast("long").alias("n"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    pieces = sized.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / max_len) - 1, F.lit(0).cast("long")))).alias("piece"))
    pieces = keep(pieces.select("doc_id", "h", "piece", F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("int").alias("n_tokens")), "pieces")
    hist = sorted((r["n_tokens"], r["c"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("c")).collect())  # at most max_len + 1 rows
    ends = best_boundaries([a for a, _ in hist], [c for _, c in hist], buckets)
    rows, k = [], 0
    for k, end in enumerate(ends):
        low = ends[k - 1] if k else -1
        held = sum(c for a, c in hist if low < a <= end)
        rows += [(a, k, end, max(1, budget // max(1, end)), max(1, -(-held // group))) for a, _ in hist if low < a <= end]
    plan = spark.createDataFrame(rows, "n_tokens int, bucket int, padded_len int, room int, salts int")  # at most max_len + 1 rows
    dealt = pieces.join(F.broadcast(plan), "n_tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id", "h", "piece", F.monotonically_increasing_id()), F.col("salts")))
    w = Window.partitionBy("bucket", "salt").orderBy("doc_id", "piece", "h")
    at = F.row_number().over(w) - 1
    number = F.floor(F.col("at") / F.col("room"))
    return dealt.withColumn("at", at).select(F.col("doc_id").alias(id_col), "piece", "n_tokens", "padded_len", F.concat_ws("-", "bucket", "salt", number).alias("batch_id"), (F.col("at") % F.col("room")).cast("int").alias("place"))
