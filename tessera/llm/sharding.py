"""Sharding by longest-processing-time scheduling.

Groups of rows that must stay together (rows with equal text) are sorted by size, largest first, and each goes to the
shard with the least bytes so far.  This is plain LPT over all groups, at any number of them: groups of one size are
interchangeable, so the heap runs over size classes, of which the driver sees one row each (size, number of groups).  A class's
groups go one by one to the top of the heap; how many each shard gets until none is left follows from one threshold
load, so a class costs a few steps whatever its number of groups.  A single group, as large ones are, is a push and a pop.  The
groups of a class are then numbered without gaps, by key, and a number says the shard.

Size classes are bounded by the bytes: k different sizes add up to at least k * k / 2 bytes, so 100 TB has at most 14 million of
them, and far fewer as texts' lengths repeat.

Defined cases: null text has no bytes and size 1, and shares a group with the empty text; rows repeated are rows like
any other; null identifiers are placed by their text; of equal loads the lower shard is first, of equal sizes the smaller key; very
long texts are read whole; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import gapless, released, staged, table

#: Size classes that are sent to every task: 4 MB at most.  More of them are joined by a shuffle.
SENT_CLASSES = 25_000


def takes(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of one size each shard takes, if each goes to the least load (then the lower shard)."""
    lo, hi = min(loads), max(loads) + size * (count + 1)

    def below(top: int) -> int:  # groups that find a load under top
        return sum(max(0, -((x - top) // size)) for x in loads)

    while lo < hi:  # the largest threshold that does not need more groups than there are
        mid = (lo + hi + 1) // 2
        if below(mid) <= count:
            lo = mid
        else:
            hi = mid - 1
    out = [max(0, -((x - lo) // size)) for x in loads]
    left = count - sum(out)
    for s, x in enumerate(loads):
        if left and x + out[s] * size == lo:
            out[s] += 1
            left -= 1
    return out


def lpt(classes: list[tuple[int, int]], shards: int) -> dict[int, list[int]]:
    """size -> for each shard, the number of groups that it and the shards before it take of that size.

    classes: (size, number of groups).  The heap holds (load, shard).
    """
    heap = [(0, s) for s in range(shards)]
    out = {}
    for size, count in sorted(classes, reverse=True):
        own = [0] * shards
        if count == 1:
            load, s = heapq.heappop(heap)
            own[s] = 1
            heapq.heappush(heap, (load + size, s))
        else:
            loads = [load for _, load in sorted((s, load) for load, s in heap)]
            own = takes(loads, size, count)
            heap = [(load + n * size, s) for s, (load, n) in enumerate(zip(loads, own, strict=True))]
            heapq.heapify(heap)
        out[size] = [sum(own[: s + 1]) for s in range(shards)]
    return out


def shard_rows(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) for each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long").alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard_rows",
    )
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard_groups")
    classes = [(r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).toLocalIterator()]
    n_groups, placed = sum(n for _, n in classes), lpt(classes, shards)
    upto = spark.createDataFrame(list(placed.items()), "bytes long, upto array<long>")
    if len(placed) <= SENT_CLASSES:
        upto = F.broadcast(upto)
    ranked = gapless(groups, "bytes", ["key"], "rank", n_groups).join(upto, "bytes")
    shard = F.size(F.filter("upto", lambda n: n <= F.col("rank")))
    where = staged(ranked.select("key", shard.cast("int").alias("shard")), "shard_of_group")
    out = staged(rows.join(where, "key").select("id", "size", "text_crc32", "row", "shard"), "sharded")
    released(rows, groups, where)
    return gapless(out, "shard", ["id", "row"], "slot", out.count()).drop("row")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
