"""Exact deduplication by a tree merge of sorted digest runs.

The text is read once, into a narrow table of digests that remembers the partition each row came from: that is its run (by
number modulo MOST_RUNS).  A run is sorted by digest where it lies and merged to one row per digest: the best identifier and a count.
Then partitions exchange runs in binomial rounds: in a round the runs that differ in the next FAN_BITS bits meet, eight at a time,
dealt over tasks by digest prefix; the sort brings them into one sorted stream and the merge keeps the best identifier
of each digest.  After the last round one run, sorted by digest within each prefix, holds one row per text.  On the
way back the first round's runs pick up the result and hand it to their own rows, so a text that a third of all rows hold meets in
no task: not on the way up, where each run has it once, and not on the way down, where each run is its own key.

A merge counts two texts as equal when SHA-256, byte length and a second independent hash all agree, and fails if its stream is
not sorted; so what is kept is verified at every level.

Defined cases: null text counts as empty; rows repeated with the same identifier each give a result row and are kept
or dropped alike; a null identifier never wins over another, and a group with only null identifiers keeps
them; ties are between equal identifiers and need no rule; very long texts are read whole, by their hashes; an empty table gives an
empty table; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import released, staged, table

SAME = ["digest", "n_bytes", "check"]
RUN = ["run", *SAME, "keep_id", "n"]
RUN_SCHEMA = "run int, digest binary, n_bytes long, check long, keep_id long, n long"
#: Runs that meet in a round: 2 to this power.
FAN_BITS = 3
#: Partitions beyond this number share runs, so that rounds stay at most four.
MOST_RUNS = 4096


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run, digest, n_bytes, check): everything that is needed of a text, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.pmod(F.spark_partition_id(), F.lit(MOST_RUNS)).cast("int").alias("run"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def merge_stream(batches: Iterator[pa.RecordBatch], keep: str) -> Iterator[pa.RecordBatch]:
    """Merge a stream sorted by run and digest: one row for each, its best identifier and the sum of counts."""
    pick, worst = (np.maximum, np.iinfo(np.int64).min) if keep == "max" else (np.minimum, np.iinfo(np.int64).max)
    tail: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.RecordBatch.from_arrays(b.columns, names=RUN)  # fields that are not null here and may be null in the tail
        rows = pa.Table.from_batches([b] if tail is None else [tail, b]).combine_chunks().to_batches()[0]
        n = rows.num_rows
        digest = np.frombuffer(b"".join(rows.column(1).to_pylist()), dtype=">u8").reshape(n, 4).astype(np.uint64)
        order = [rows.column(0).to_numpy(), *digest.T, rows.column(2).to_numpy(), rows.column(3).to_numpy()]
        new, rising = np.zeros(n, dtype=bool), np.ones(n - 1, dtype=bool)
        new[0], equal = True, np.ones(n - 1, dtype=bool)
        for c in order:
            rising &= ~(equal & (c[1:] < c[:-1]))
            equal &= c[1:] == c[:-1]
        if not rising.all():
            raise ValueError("a run of digests is not sorted")
        new[1:] = ~equal
        at = np.flatnonzero(new)
        known = rows.column(4).is_valid().to_numpy(zero_copy_only=False)
        ids = np.where(known, rows.column(4).fill_null(worst).to_numpy(), worst)
        some = np.logical_or.reduceat(known, at)
        merged = rows.take(pa.array(at)).to_pydict()
        out = pa.RecordBatch.from_arrays(
            [
                *(pa.array(merged[k], t) for k, t in zip(RUN[:4], (pa.int32(), pa.binary(), pa.int64(), pa.int64()), strict=True)),
                pa.array(pick.reduceat(ids, at), mask=~some),
                pa.array(np.add.reduceat(rows.column(5).to_numpy(), at)),
            ],
            names=RUN,
        )
        yield out.slice(0, len(at) - 1)
        tail = out.slice(len(at) - 1)
    if tail is not None:
        yield tail


def merged(runs: DataFrame, keep: str) -> DataFrame:
    """One row per run and digest of runs that are sorted here, partition by partition."""
    ordered = runs.select(*RUN).sortWithinPartitions("run", *SAME)
    return ordered.mapInArrow(lambda batches: merge_stream(batches, keep), RUN_SCHEMA)


def merge_round(runs: DataFrame, keep: str) -> DataFrame:
    """Runs whose numbers differ in the lowest bits meet, dealt by digest prefix, and become one."""
    met = runs.withColumn("run", F.shiftright("run", FAN_BITS))
    return merged(met.repartition("run", F.substring("digest", 1, 2)), keep)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min"
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each input row."""
    if keep not in ("min", "max"):
        raise ValueError("keep is 'min' or 'max'")
    rows = staged(digest_table(docs, id_col, text_col), "digests")
    last = rows.agg(F.max("run")).first()[0] or 0
    leaves = merged(rows.withColumnRenamed("id", "keep_id").withColumn("n", F.lit(1).cast("long")), keep)
    first = top = staged(merge_round(leaves, keep), "digest_runs")
    last >>= FAN_BITS
    while last:
        above = staged(merge_round(top, keep), "digest_runs")
        if top is not first:
            released(top)
        top, last = above, last >> FAN_BITS
    result = top.select(*SAME, "keep_id", "n")
    down = first.select("run", *SAME).join(result, SAME) if first is not top else result.withColumn("run", F.lit(0))
    own = rows.withColumn("run", F.shiftright("run", FAN_BITS))
    return own.join(down, ["run", *SAME]).select(
        "id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
