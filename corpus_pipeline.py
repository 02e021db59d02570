"""A corpus pipeline of five stages; each works on all that the one before it kept.

What holds for every stage: null texts count as empty; null ids, repeated ids and repeated rows are allowed, since rows
are told apart by id and text together; an empty table gives an empty one; columns of any name pass through, as the
stages name their own columns so that they don't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shalebed.llm import exact_dedup, language_id, mixing, ngram_join, packing
from shalebed.llm.common import drop, free_name, keep, scratch


def own(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts that fit no learned language.

    The least evidence that a text needs comes from the model's held-back rows. Where no row is labelled, there is no
    language to tell, and all texts go.
    """
    model = language_id.fit(docs)
    pred, score, evidence = (free_name(docs, c) for c in ("lang_pred", "lang_score", "lang_evidence"))
    out = language_id.identify(docs, model, pred_col=pred, score_col=score, evidence_col=evidence)
    return out.where((F.col(pred) != "und") & (F.col(evidence) >= model.lowest)).select(*own(docs))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, one with the largest doc_id (a null id is the least). Null equals empty."""
    sha, one = free_name(docs, "sha"), free_name(docs, "one")
    kept = exact_dedup.exact_groups(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_sha")).distinct()
    kept = kept.select(F.struct("kept_id", "kept_sha").alias(one))
    d = docs.withColumn(sha, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    both = d.join(kept, (F.col(sha) == F.col(f"{one}.kept_sha")) & F.col("doc_id").eqNullSafe(F.col(f"{one}.kept_id")))
    return both.dropDuplicates(["doc_id", sha]).select(*own(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates stays: the smallest doc_id (of equal ids, by a hash of the text).

    Texts without words stay. Rows that repeat both id and text are one row.
    """
    comps = keep(ngram_join.jaccard_components(docs).where("label is not null").select("doc_id", "text_hash", "label"), "components")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = comps.groupBy("label").agg(F.min(key).alias("first"))
    gone = comps.join(first, "label").where(key != F.col("first")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    gone = keep(gone, "gone")
    text_hash, row = free_name(docs, "text_hash"), free_name(docs, "gone")
    d = docs.withColumn(text_hash, F.xxhash64("text"))
    left = d.join(gone.select(F.struct("gone_id", "gone_hash").alias(row)), F.col("doc_id").eqNullSafe(F.col(f"{row}.gone_id")) & (F.col(text_hash) == F.col(f"{row}.gone_hash")), "left_anti")
    if comps.groupBy("doc_id", "text_hash").count().where("count > 1").take(1):
        worded = left.join(comps.select("text_hash").distinct().withColumnRenamed("text_hash", text_hash), text_hash, "left_semi")
        return left.join(comps.select("text_hash").distinct().withColumnRenamed("text_hash", text_hash), text_hash, "left_anti").unionByName(worded.dropDuplicates(["doc_id", text_hash])).select(*own(docs))
    return left.select(*own(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents by their rates; documents judged likeliest clean stay. Without labels all are alike."""
    return mixing.mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_clean=True)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of the pieces of every text; a text without words is one piece of no tokens. The columns are pack_batches()'s."""
    return packing.pack_batches(docs)


STAGES = [("language_id", language_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # language model, mixing rates and bucket boundaries are no SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; what a stage leaves behind goes when its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            before, docs = docs, kept(stage(spark, docs, sf_dir), name)
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
