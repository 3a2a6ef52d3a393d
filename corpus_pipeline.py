"""A corpus pipeline of five stages; each reads what its predecessor wrote.

Defined cases: an empty table passes every stage empty; null and empty texts go where the stages' docstrings say; repeated
rows are rows like any other; extra columns, whatever their names, pass all stages but the last, which returns a row of
packing for each document.  The stages' tables go when the driver's JVM ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, linededup, neardup, packing, quality
from tessera.sources.staging import delete_at_exit, scratch_dir


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: each document's bucket, batch and slot."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality.kept_documents),
    ("line_dedup", linededup.cleaned),
    ("near_dedup", neardup.first_of_groups),
    ("decontamination", decontam.decontaminated),
    ("packing", packed),
]

#: The classifier's scores are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_dir(spark)}/tessera/pipeline-{uuid.uuid4().hex}"
    delete_at_exit(spark, folder)
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}_{name}"
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
