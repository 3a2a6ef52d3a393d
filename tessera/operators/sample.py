"""Samples that keep real competition: rivals of sampled records stay as context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.splits import in_sample, name_bucket, sample_hash
from tessera.sources import files


def rival_sample(cand: DataFrame, truth: DataFrame, true_pairs: DataFrame, fraction: float) -> dict[str, DataFrame]:
    """pairs: all candidate pairs of records that a sampled S1 has as candidates; kept ids of both sides; truth rows."""
    sampled = truth.where(in_sample(F.col("s1_id"), fraction)).select("s1_id")
    of_sampled = cand.where(in_sample(F.col("s1_id"), fraction))
    kept_o = of_sampled.select("oth_id").distinct()
    pairs = cand.join(kept_o, "oth_id", "left_semi")
    true_o = true_pairs.join(sampled, "s1_id", "left_semi").select("oth_id")
    return {
        "pairs": pairs,
        "s1": pairs.select("s1_id").union(sampled).distinct(),
        "oth": kept_o.union(true_o).distinct(),
        "truth": sampled,
    }


def bucket_sample(s1: DataFrame, oth: DataFrame, truth: DataFrame, true_pairs: DataFrame, mod: int) -> dict[str, DataFrame]:
    """Normalised records whose name falls into one of ``mod`` buckets: S1, others of the bucket or true matches, truth rows."""

    def of_bucket(records: DataFrame, column: str) -> DataFrame:
        return records.where(name_bucket(F.col("country"), F.col("core"), mod)).select(F.col("entity_id").alias(column)).distinct()

    kept = of_bucket(s1, "s1_id")
    true_o = true_pairs.join(kept, "s1_id", "left_semi").select("oth_id")
    return {"s1": kept, "oth": of_bucket(oth, "oth_id").union(true_o).distinct(), "truth": truth.select("s1_id").join(kept, "s1_id", "left_semi")}


def record_hashes(cand: DataFrame) -> DataFrame:
    """(oth_id, h): least sample hash of the S1 records that have a record as candidate."""
    return cand.groupBy("oth_id").agg(F.min(sample_hash(F.col("s1_id"))).alias("h"))


def shrink_counts(cand: DataFrame, fractions: list[float]) -> DataFrame:
    """(fraction, n): rows that a smaller sample would have, for each fraction, in one pass."""
    rows = cand.join(record_hashes(cand), "oth_id")
    one = rows.agg(*[F.count_if(F.col("h") < f * 1e6).alias(str(i)) for i, f in enumerate(fractions)])
    pairs = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.col(str(i)).alias("n")) for i, f in enumerate(fractions)])
    return one.select(F.explode(pairs).alias("x")).select("x.fraction", "x.n")


def picked(counts: DataFrame, max_rows: int, smallest: float = 0.01) -> DataFrame:
    """(fraction): the largest one with at most max_rows rows, or the smallest."""
    best = F.max(F.when(F.col("n") <= max_rows, F.col("fraction")))
    return counts.agg(F.coalesce(best, F.lit(smallest)).alias("fraction"))


def shrink(cand: DataFrame, fraction: float) -> DataFrame:
    """The pairs of the smaller sample: the same rows as building it directly, as hash thresholds nest."""
    kept = record_hashes(cand).where(F.col("h") < fraction * 1e6)
    return cand.join(kept.select("oth_id"), "oth_id", "left_semi")


def shrunk(parts: dict[str, DataFrame], true_pairs: DataFrame, fraction: float) -> dict[str, DataFrame]:
    """A smaller sample cut from a larger one, with the true matches of its S1 put back: as if built directly."""
    truth = parts["truth"].where(in_sample(F.col("s1_id"), fraction))
    pairs = shrink(parts["pairs"], fraction)
    true_o = true_pairs.join(truth, "s1_id", "left_semi").select("oth_id")
    return {
        "pairs": pairs,
        "s1": pairs.select("s1_id").union(truth.select("s1_id")).distinct(),
        "oth": pairs.select("oth_id").union(true_o).distinct(),
        "truth": truth,
    }


def checks(parts: dict[str, DataFrame], true_pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """(check, n): what is wrong with a sample, 0 where nothing is.  kept: the S1 (s1_id) that it was drawn for."""

    def count(name: str, rows: DataFrame) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")

    def repeated(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy(column).agg(F.count("*").alias("c")).where("c > 1")

    true = true_pairs.join(kept.select("s1_id").distinct(), "s1_id", "left_semi")
    rows = [
        count("missing_true_matches", true.join(parts["oth"], "oth_id", "left_anti")),
        count("extra_truth_rows", parts["truth"].select("s1_id").distinct().join(kept, "s1_id", "left_anti")),
        count("missing_truth_rows", kept.select("s1_id").distinct().join(parts["truth"], "s1_id", "left_anti")),
        count("repeated_s1", repeated(parts["s1"], "s1_id")),
        count("repeated_other", repeated(parts["oth"], "oth_id")),
        count("repeated_truth_rows", repeated(parts["truth"], "s1_id")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_sample(
    parts: dict[str, DataFrame], s1: DataFrame, oth: DataFrame, truth_lists: DataFrame, path: str
) -> None:
    """A sample as files: records of both sides, its truth rows and, where it has them, its recorded pairs."""
    files.write_table(files.filtered(s1, parts["s1"].withColumnRenamed("s1_id", "entity_id")), f"{path}/s1")
    files.write_table(files.filtered(oth, parts["oth"].withColumnRenamed("oth_id", "entity_id")), f"{path}/other")
    own = parts["truth"].select(F.col("s1_id").alias("source1_entity_id")).distinct()
    files.write_table(truth_lists.join(own, "source1_entity_id", "left_semi"), f"{path}/truth")
    if "pairs" in parts:
        parts["pairs"].write.mode("overwrite").parquet(f"{path}/pairs")


def rivals_per_record(cand: DataFrame) -> DataFrame:
    return cand.groupBy("oth_id").count().agg(F.avg("count").alias("rivals"))
