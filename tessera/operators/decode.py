"""Competition features, assignment and decoders over scored pairs (s1_id, oth_id, p)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def competition(scored: DataFrame, p: str = "p1", more: dict[str, str] | None = None) -> DataFrame:
    """Rank, gap, strongest option and sum of rivals of a pair in its S1's list and among its record's options.

    ``more``: further scores, each with the ending of the columns that it gives.
    """
    s1, oth = Window.partitionBy("s1_id"), Window.partitionBy("oth_id")
    by = {p: ""} | (more or {})
    # S1 windows first, record windows second: two exchanges in all.
    out = scored.withColumns(
        {
            f"{name}{end}": value
            for c, end in by.items()
            for name, value in {
                "rk_s1": F.rank().over(s1.orderBy(F.desc(c))),
                "gap_s1": F.col(c) - F.max(c).over(s1),
                "sum_s1": F.sum(c).over(s1) - F.col(c),
            }.items()
        }
    )
    return out.withColumns(
        {
            f"{name}{end}": value
            for c, end in by.items()
            for name, value in {
                "rk_o": F.rank().over(oth.orderBy(F.desc(c))),
                "gap_o": F.col(c) - F.max(c).over(oth),
                "max_o_other": F.max(c).over(oth),
                "sum_o": F.sum(c).over(oth) - F.col(c),
            }.items()
        }
    )


def best_per_record(scored: DataFrame, p: str = "p") -> DataFrame:
    """(s1_id, oth_id, p, p_next): each record's best S1 and its runner-up's score (0 if there is none); ties by s1_id."""
    order = Window.partitionBy("oth_id").orderBy(F.desc(p), "s1_id")
    out = scored.select(
        "s1_id",
        "oth_id",
        F.col(p).alias("p"),
        F.coalesce(F.lead(p, 1).over(order), F.lit(0.0)).alias("p_next"),
        F.row_number().over(order).alias("k"),
    )
    return out.where("k = 1").drop("k")


def decode_threshold(best: DataFrame, thr: float, margin: float) -> DataFrame:
    return best.where((F.col("p") >= thr) & (F.col("p") - F.col("p_next") >= margin)).select("s1_id", "oth_id", "p")


#: Knots that are written into the plan, as a balanced tree of comparisons; more of them go to NumPy.
INLINE_KNOTS = 128


def interpolate(p: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise linear through given knots, ends clamped."""
    xs, ys = [float(x) for x in xs], [float(y) for y in ys]
    if len(xs) > INLINE_KNOTS:

        @F.pandas_udf(DoubleType())
        def by_search(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values, xs, ys))

        return by_search(p.cast("double"))

    def between(lo: int, hi: int) -> Column:  # of the lines that end at knots lo..hi
        if lo == hi:
            x0, x1, y0, y1 = xs[lo - 1], xs[lo], ys[lo - 1], ys[lo]
            return F.lit(y0) + (p - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1)
        mid = (lo + hi) // 2
        return F.when(p < xs[mid], between(lo, mid)).otherwise(between(mid + 1, hi))

    inner = between(1, len(xs) - 1) if len(xs) > 1 else F.lit(ys[0])
    return F.when(p <= xs[0], ys[0]).when(p >= xs[-1], ys[-1]).otherwise(inner)


def decode_expected_f(best: DataFrame, decoder: dict) -> DataFrame:
    """Of each S1's assigned records, the first k by calibrated probability that maximise expected F-beta."""
    lam, b2 = float(decoder["lam"]), float(decoder.get("beta2", 0.25))
    rows = best.select("s1_id", "oth_id", interpolate(F.col("p"), decoder["cal_x"], decoder["cal_y"]).alias("q"))
    part = Window.partitionBy("s1_id")
    order = part.orderBy(F.desc("q"), "oth_id")
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("k"),
        F.sum("q").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.sum("q").over(part).alias("total"),
        F.exp(F.sum(F.log1p(-F.least("q", F.lit(1 - 1e-6)))).over(part) - lam).alias("p_none"),
    )
    rows = rows.withColumn("ef", (1 + b2) * F.col("run") / (b2 * (F.col("total") + lam) + F.col("k")))
    rows = rows.withColumn("top", F.max("ef").over(part))
    rows = rows.withColumn("k_best", F.min(F.when(F.col("ef") >= F.col("top"), F.col("k"))).over(part))
    return rows.where((F.col("top") > F.col("p_none")) & (F.col("k") <= F.col("k_best"))).select("s1_id", "oth_id", "q")


def sweep(
    best: DataFrame, truth: DataFrame, truth_pairs: DataFrame, thrs: list[float], margins: list[float], by: str | None = None
) -> DataFrame:
    """(thr, margin, f05), or one such table per value of the truth's column ``by``: the metric at each point of a grid.

    An entity's assigned pairs (at most its candidates) are brought together once; the grid is evaluated inside its task,
    which hands on one sum per point.
    """
    thr_grid, margin_grid = np.array(thrs, dtype=float), np.array(margins, dtype=float)
    hit = truth_pairs.select("s1_id", "oth_id", F.lit(1.0).alias("hit"))
    lists = best.join(hit, ["s1_id", "oth_id"], "left").groupBy("s1_id")
    item = F.struct("p", (F.col("p") - F.col("p_next")).alias("gap"), F.coalesce("hit", F.lit(0.0)).alias("hit"))
    lists = lists.agg(F.collect_list(item).alias("pairs"))
    label = F.col(by).cast("string") if by else F.lit("")
    rows = truth.select("s1_id", F.col("n_true").cast("long").alias("n_true"), label.alias("part")).join(lists, "s1_id", "left")
    rows = rows.select("part", "n_true", "pairs.p", "pairs.gap", "pairs.hit")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        counts: dict[str, int] = {}
        for b in batches:
            for part, n, p, gap, hits in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                total = sums.setdefault(part, np.zeros((len(thr_grid), len(margin_grid))))
                counts[part] = counts.get(part, 0) + 1
                if not p:
                    total += n == 0
                    continue
                over = (np.array(p)[:, None] >= thr_grid).astype(float)
                apart = (np.array(gap)[:, None] >= margin_grid).astype(float)
                n_pred, tp = over.T @ apart, (over * np.array(hits)[:, None]).T @ apart
                precision, recall = tp / np.maximum(n_pred, 1), tp / max(n, 1)
                score = 1.25 * precision * recall / np.where(tp > 0, 0.25 * precision + recall, 1.0)
                total += np.where((n_pred == 0) & (n == 0), 1.0, np.where(tp == 0, 0.0, score))
        size = len(thr_grid) * len(margin_grid)
        for part, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * size, pa.string()),
                    pa.array(np.repeat(thr_grid, len(margin_grid))),
                    pa.array(np.tile(margin_grid, len(thr_grid))),
                    pa.array(total.ravel()),
                    pa.array([counts[part]] * size, pa.int64()),
                ],
                names=["part", "thr", "margin", "total", "n"],
            )

    parts = rows.mapInArrow(evaluate, "part string, thr double, margin double, total double, n long")
    out = parts.groupBy("part", "thr", "margin").agg((F.sum("total") / F.sum("n")).alias("f05"))
    return out.withColumnRenamed("part", by) if by else out.drop("part")


def best_of_sweep(grid: DataFrame) -> tuple[float, float, float]:
    """(thr, margin, f05) of the best point, the first of equals; without entities (0.5, 0, 0)."""
    r = grid.orderBy(F.desc(F.round("f05", 12)), "thr", "margin").first()
    return (r.thr, r.margin, r.f05) if r else (0.5, 0.0, 0.0)


def best_by_part(grid: DataFrame, by: str) -> DataFrame:
    """(by, thr, margin, f05): the best point of each part, the first of equals."""
    order = Window.partitionBy(by).orderBy(F.desc(F.round("f05", 12)), "thr", "margin")
    return grid.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def decode_by_part(best: DataFrame, points: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """Threshold decoding with each part's own point; entities (s1_id, by)."""
    rows = best.join(entities.select("s1_id", by), "s1_id").join(points.select(by, "thr", "margin"), by)
    return rows.where((F.col("p") >= F.col("thr")) & (F.col("p") - F.col("p_next") >= F.col("margin"))).select("s1_id", "oth_id", "p")


def f_beta(n_pred: Column, n_true: Column, tp: Column, b2: float = 0.25) -> Column:
    precision, recall = tp / F.greatest(n_pred, F.lit(1)), tp / F.greatest(n_true, F.lit(1))
    score = (1 + b2) * precision * recall / (b2 * precision + recall)
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when(tp == 0, 0.0).otherwise(score)
