"""Incremental resolution: a stream of new records against the keys of a static reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocking
from tessera.operators.normalise import normalise


def candidate_stream(new_records: DataFrame, s1_keys: DataFrame, max_s1_block: int = 200) -> DataFrame:
    """(oth_id, s1_id, type, w): a stream-static join on blocking keys; reference blocks are capped beforehand."""
    by = ["country", "type", "key"]
    keys = blocking.keys(normalise(new_records, True)).select(*by, F.col("entity_id").alias("oth_id"), "w")
    known = blocking.capped(s1_keys, max_s1_block).select(*by, F.col("entity_id").alias("s1_id")).distinct()
    return keys.join(known, by).select("oth_id", "s1_id", "type", "w")


def best_in_batch(batch: DataFrame, topk: int = 60) -> DataFrame:
    """For foreachBatch: summed weights and the best S1 options of each new record."""
    from pyspark.sql.window import Window

    total = batch.groupBy("oth_id", "s1_id").agg(F.sum("w").alias("w"))
    order = Window.partitionBy("oth_id").orderBy(F.desc("w"), "s1_id")
    return total.withColumn("k", F.row_number().over(order)).where(F.col("k") <= topk).drop("k")
