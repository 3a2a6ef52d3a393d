"""Helpers shared by the text-corpus operators.

Staging (``tessera.sources.staging``): lineage is cut by writing narrow tables to the folder that the cluster shares, so a
lost executor costs a re-read and never a recomputation of the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.sources.staging import delete_at_exit, released, scratch_dir, staged

__all__ = ["delete_at_exit", "released", "scratch_dir", "staged"]

#: Bounds of what a Python stage handles at a time.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: bytes.translate table: A-Z to lower case, all other ASCII but letters and digits to a space.
ALNUM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: bytes.translate table: A-Z to lower case, nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: bytes.translate table: A-Z to lower case, and white space as [\x20\x09-\x0D] only.
SPACED_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null."""
    return utf8(text).translate(ALNUM_WORDS).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; none for null."""
    return utf8(text).translate(SPACED_WORDS).split() if text else []


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in zero-copy slices of at most SLICE_ROWS rows and, beyond one row, SLICE_BYTES bytes."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            n = min(SLICE_ROWS, b.num_rows - at)
            while n > 1 and b.slice(at, n).nbytes > SLICE_BYTES:
                n = (n + 1) // 2
            yield b.slice(at, n)
            at += n


def mapped(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` over slices bounded by bytes.

    Spark bounds an Arrow batch by rows, so the Python objects and the output of a batch of long texts could outgrow an
    executor; a slice's cannot, whatever the session's settings, which stay as they are.
    """
    return df.mapInArrow(lambda batches: run(slices(batches)), schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have."""
    tag = uuid.uuid4().hex[:8]
    return [f"__{n}_{tag}" for n in names]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once a row however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def spread(n_rows: int, per_bucket: int = 100_000, least: int = 64) -> int:
    """Number of hash buckets that keeps a bucket near per_bucket rows."""
    return max(least, -(-n_rows // per_bucket))


def gapless(df: DataFrame, group: str, order: list[str], out: str, n_rows: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, whatever the group's size.

    A group is split into hash buckets of bounded size; a bucket's rows are numbered in its own task and its
    offset is the running count of the buckets before it, so a group that holds most rows never meets in
    one task.  ``order`` must tell rows apart (a stored row number does), as equal rows share a bucket.  ``df`` is read
    twice: stage it first if it is dear.
    """
    n = spread(n_rows)
    rows = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)))
    counts = rows.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy(group, "__bucket").orderBy(*order)
    return (
        rows.join(offsets, [group, "__bucket"])
        .withColumn(out, (F.col("__off") + F.row_number().over(inside) - 1).cast("long"))
        .drop("__bucket", "__off")
    )
