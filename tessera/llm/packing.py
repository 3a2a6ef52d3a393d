"""Packing into length buckets whose boundaries minimise padding.

The lengths of all documents form one histogram.  Dynamic programming over it, exact in integers, finds the
boundaries of up to ``buckets`` buckets with the least total padding; inside a bucket, batches hold as many documents
as fit the token budget at the bucket's padded length.

The histogram that reaches the driver has a bin for each length that occurs, so the boundaries are the true optimum at any
size.  Its size is bounded by the tokens: k different lengths add up to at least k * (k - 1) / 2 tokens, so 100 TB of text (some 2e13
tokens) has at most 6.4 million bins of 24 bytes, and needs a document of that many tokens for each; real corpora have some ten
thousands.  No document is cut, dropped or capped: one longer than the budget is a batch by itself.

Defined cases: null and empty texts have length 0 and sit in the first bucket; rows repeated are packed
like any other; null identifiers are packed too; of boundaries with equal padding the fewer buckets win, and equal lengths are
batched by a hash of identifier and row number; very long texts are counted whole; an empty table gives an empty table; other columns, whatever
their names, are not read.
"""

from __future__ import annotations

from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import gapless, staged, table

def best_boundaries(hist: list[tuple[int, int, int]], buckets: int) -> tuple[list[int], int]:
    """Boundaries (largest length of each bucket) and total padding, from (largest length, count, sum of lengths).

    d[j] = least padding of the first j bins; with a new bucket over bins i+1..j that is
    d'[j] = min_i d[i] + S[i] - L[j]*N[i], plus L[j]*N[j] - S[j]: lines of falling slope -N[i] asked at rising L[j],
    so a monotone hull answers each layer in linear time.  Of equal costs, fewer buckets win.
    """
    hist = sorted(hist)
    m = len(hist)
    if not m:
        return [], 0
    length, n, s = [h[0] for h in hist], [0], [0]
    for _, count, total in hist:
        n.append(n[-1] + count)
        s.append(s[-1] + total)
    cost = [0] + [length[j - 1] * n[j] - s[j] for j in range(1, m + 1)]
    layers, best, best_k = [array("i", [0]) * (m + 1)], cost[m], 1
    prev = cost
    for k in range(2, min(buckets, m) + 1):
        cur, back, hull, head = [0] * (m + 1), array("i", [0]) * (m + 1), [], 0
        for j in range(1, m + 1):
            i = j - 1
            if i >= k - 1:
                a, b = -n[i], prev[i] + s[i]
                while len(hull) - head >= 2:
                    (a1, b1, _), (a2, b2, _) = hull[-2], hull[-1]
                    if (b - b1) * (a1 - a2) <= (b2 - b1) * (a1 - a):
                        hull.pop()
                    else:
                        break
                hull.append((a, b, i))
            if j < k:
                cur[j] = prev[j]
                continue
            x = length[j - 1]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            a, b, i = hull[head]
            cur[j], back[j] = a * x + b + x * n[j] - s[j], i
        layers.append(back)
        if cur[m] < best:
            best, best_k = cur[m], k
        prev = cur
    out, j = [], m
    for k in range(best_k, 0, -1):
        out.append(length[j - 1])
        j = layers[k - 1][j]
    return out[::-1], best


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 16,
    token_budget: int = 65_536,
    n_tokens: F.Column | None = None,
) -> DataFrame:
    """(id, n_tokens, bucket, bucket_tokens, batch, slot, padding) for each row.

    ``n_tokens`` is any column expression that counts a row's tokens; runs of non-space characters by default.
    """
    count = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")) if n_tokens is None else n_tokens
    # The row number tells repeated rows apart.
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(count, F.lit(0)).cast("long").alias("n_tokens"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = staged(rows, "token_counts")
    hist = rows.groupBy("n_tokens").agg(F.count("*").alias("n"))
    hist = [(r.n_tokens, r.n, r.n * r.n_tokens) for r in hist.toLocalIterator()]
    bounds, _ = best_boundaries(hist, buckets)
    bucket, tokens = F.lit(0), F.lit(bounds[0] if bounds else 0).cast("long")
    for i in range(1, len(bounds)):
        over = F.col("n_tokens") > bounds[i - 1]
        bucket, tokens = F.when(over, i).otherwise(bucket), F.when(over, F.lit(bounds[i]).cast("long")).otherwise(tokens)
    # `when` chains read outside in: the last boundary passed decides.
    rows = rows.select("id", "n_tokens", "row", bucket.cast("int").alias("bucket"), tokens.alias("bucket_tokens"))
    ranked = gapless(rows, "bucket", ["id", "n_tokens", "row"], "rank", sum(h[1] for h in hist))
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(token_budget) / F.greatest("bucket_tokens", F.lit(1))))
    return ranked.select(
        "id",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.floor(F.col("rank") / fit).cast("long").alias("batch"),
        F.pmod("rank", fit).cast("long").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
