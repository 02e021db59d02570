"""A path profile kept up to date over a stream: every batch is profiled and added to a table of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shalebed.operators.shred import profile, shred


def profile_batches(stream: DataFrame, id_col: str, json_col: str, path: str, checkpoint: str):
    """Starts a query that writes each batch's profile under path/batch=<n>; reading the folder and adding up gives the whole."""

    def add(batch: DataFrame, n: int) -> None:
        profile(shred(batch, id_col, F.try_parse_json(json_col))).write.mode("overwrite").parquet(f"{path}/batch={n}")  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def total(profiles: DataFrame) -> DataFrame:
    kinds = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("kinds", ","))))), ",")
    return profiles.groupBy("path").agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"), F.sum("truthy").alias("truthy"), kinds.alias("kinds"))
