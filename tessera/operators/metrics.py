"""Macro F0.5, loss breakdown, recall of blocking, audit of misses, and checks of result lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.splits import is_validation

from . import blocking
from .decode import f_beta


def truth_sizes(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """(s1_id, n_true) for every labelled S1 (s1_id), singletons too."""
    n = pairs.groupBy("s1_id").agg(F.count("*").alias("n_true"))
    return truth.select("s1_id").join(n, "s1_id", "left").select("s1_id", F.coalesce("n_true", F.lit(0)).alias("n_true"))


def per_entity(truth: DataFrame, pairs: DataFrame, predicted: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(s1_id, n_true, n_pred, tp, n_blk, f05) for every labelled S1."""
    hit = pairs.select("s1_id", "oth_id", F.lit(1).alias("hit"))
    pred = predicted.join(hit, ["s1_id", "oth_id"], "left").groupBy("s1_id")
    pred = pred.agg(F.count("*").alias("n_pred"), F.count("hit").alias("tp"))
    out = truth_sizes(truth, pairs).join(pred, "s1_id", "left")
    if blocked is not None:
        found = blocked.join(hit, ["s1_id", "oth_id"]).groupBy("s1_id").agg(F.count("*").alias("n_blk"))
        out = out.join(found, "s1_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_pred", "tp", "n_blk") if c in out.columns}
    return out.withColumns(zero).withColumn("f05", f_beta(F.col("n_pred"), F.col("n_true"), F.col("tp")))


def macro_f05(entities: DataFrame) -> DataFrame:
    return entities.agg(F.coalesce(F.avg("f05"), F.lit(0.0)).alias("f05"), F.count("*").alias("n"))


def loss_breakdown(entities: DataFrame) -> DataFrame:
    """(category, n, lost): points lost by kind of miss, per labelled S1."""
    category = (
        F.when((F.col("n_true") == 0) & (F.col("n_pred") > 0), "singleton_predicted")
        .when(F.col("n_true") == 0, "singleton_ok")
        .when(F.col("n_blk") == 0, "none_blocked")
        .when(F.col("tp") == 0, "blocked_but_rejected")
        .when(F.col("f05") < 1, "partial")
        .otherwise("perfect")
    )
    kinds = entities.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.sum(1 - F.col("f05")).alias("points"))
    total = F.sum("n").over(Window.partitionBy())  # six rows at most
    return kinds.select("category", "n", (F.col("points") / total).alias("lost"))


def quality_totals(entities: DataFrame) -> DataFrame:
    """Pair precision and recall, ceiling of a perfect matcher on the blocked pairs, singleton accuracy."""
    ceiling = f_beta(F.col("n_blk"), F.col("n_true"), F.col("n_blk"))
    return entities.agg(
        (F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("precision"),
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("recall"),
        F.avg(ceiling).alias("ceiling"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_rate"),
    )


def blocking_recall(truth: DataFrame, pairs: DataFrame, blocked: DataFrame) -> DataFrame:
    """(n_s1, n_true, n_found, recall, n_candidates, per_s1, zero_rate), from one aggregate per S1."""
    hit = pairs.select("s1_id", "oth_id").distinct().withColumn("true", F.lit(1))
    listed = blocked.select("s1_id", "oth_id").withColumn("listed", F.lit(1))
    both = hit.join(listed, ["s1_id", "oth_id"], "full")
    per = both.groupBy("s1_id").agg(
        F.count("true").alias("n_true"), F.count("listed").alias("n_candidates"), F.count_if(F.col("true") + F.col("listed") == 2).alias("n_found")
    )
    per = truth.select("s1_id", F.lit(1).alias("own")).join(per, "s1_id", "full")
    total = per.agg(
        F.count("own").alias("n_s1"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_true", "n_found", "n_candidates")],
        F.count_if(F.col("own").isNotNull() & (F.coalesce("n_candidates", F.lit(0)) == 0)).alias("n_zero"),
    )
    one = F.greatest("n_s1", F.lit(1))
    return total.select(
        "n_s1",
        "n_true",
        "n_found",
        (F.col("n_found") / F.greatest("n_true", F.lit(1))).alias("recall"),
        "n_candidates",
        (F.col("n_candidates") / one).alias("per_s1"),
        (F.col("n_zero") / one).alias("zero_rate"),
    )


def audit(
    pairs: DataFrame,
    blocked: DataFrame,
    s1_keys: DataFrame,
    oth_keys: DataFrame,
    max_block: int,
    max_s1_block: int,
    topk: int = 60,
) -> DataFrame:
    """(s1_id, oth_id, mode, rank) of true pairs that are not among the blocked ones.

    A: no shared key; B: every shared key is in an oversized block of the other side; C: of the S1 side; D: an admissible
    key, but a rank beyond the top K of the S1's list; E: a rank within it, so the pair was lost elsewhere.
    """
    by = ["country", "type", "key"]
    size1 = s1_keys.groupBy(*by).agg(F.count("*").alias("b1"))
    size2 = oth_keys.groupBy(*by).agg(F.count("*").alias("b2"))
    missed = pairs.select("s1_id", "oth_id").distinct().join(blocked.select("s1_id", "oth_id"), ["s1_id", "oth_id"], "left_anti")
    k1 = s1_keys.select(*by, F.col("entity_id").alias("s1_id")).distinct()
    k2 = oth_keys.select(*by, F.col("entity_id").alias("oth_id")).distinct()
    shared = missed.join(k1, "s1_id").join(k2, [*by, "oth_id"]).join(size1, by).join(size2, by)
    ok1, ok2 = F.col("b1") <= max_s1_block, F.col("b2") <= max_block
    per = shared.groupBy("s1_id", "oth_id").agg(
        F.count_if(ok1 & ok2).alias("good"), F.count_if(ok2).alias("good2"), F.count("*").alias("n")
    )
    # Caps are by whole blocks, lists only of the S1 that miss a pair.
    few = blocking.capped(s1_keys, max_s1_block)
    few = few.join(missed.select(F.col("s1_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    ranks = blocking.ranked_pairs(few, oth_keys, max_block, max_s1_block).select("s1_id", "oth_id", F.col("k").alias("rank"))
    rows = missed.join(per, ["s1_id", "oth_id"], "left").join(ranks, ["s1_id", "oth_id"], "left")
    mode = (
        F.when(F.col("n").isNull(), "A")
        .when((F.col("good") == 0) & (F.col("good2") == 0), "B")
        .when(F.col("good") == 0, "C")
        .when(F.col("rank") > topk, "D")
        .otherwise("E")
    )
    return rows.select("s1_id", "oth_id", mode.alias("mode"), "rank")


def audit_summary(recall: DataFrame, modes: DataFrame) -> DataFrame:
    """(metric, value): the totals of ``blocking_recall`` and the number of misses of each mode of ``audit``."""
    names = {
        "total_s1_entities": "n_s1", "total_gt_pairs": "n_true", "total_recovered_pairs": "n_found", "blocking_recall": "recall",
        "total_candidates": "n_candidates", "avg_candidates_per_s1": "per_s1", "zero_candidate_rate": "zero_rate",
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in names.items()])
    counts = modes.agg(*[F.count_if(F.col("mode") == m).cast("double").alias(m) for m in "ABCDE"])
    kinds = F.array(*[F.struct(F.lit(f"failure_{m}_count").alias("metric"), F.col(m).alias("value")) for m in "ABCDE"])
    return recall.select(F.explode(rows).alias("x")).unionByName(counts.select(F.explode(kinds).alias("x"))).select("x.metric", "x.value")


def scored_entities(entities: DataFrame, excluded: DataFrame | None = None, val_split: bool = False) -> DataFrame:
    """Entities (s1_id, ...) that are scored: labelled ones, without the excluded, of the held-out part if asked."""
    if excluded is not None:
        entities = entities.join(excluded.select("s1_id").distinct(), "s1_id", "left_anti")
    return entities.where(is_validation(F.col("s1_id"))) if val_split else entities


def evaluation(entities: DataFrame) -> DataFrame:
    """(part, n, f05, precision, recall, ceiling) of per_entity rows with a country: one row each, and ALL."""
    rows = entities.select("*", F.explode(F.array(F.col("country"), F.lit("ALL"))).alias("part"))
    return rows.groupBy("part").agg(
        F.count("*").alias("n"),
        F.avg("f05").alias("f05"),
        (F.sum("tp") / F.greatest(F.sum("n_pred"), F.lit(1))).alias("precision"),
        (F.sum("tp") / F.greatest(F.sum("n_true"), F.lit(1))).alias("recall"),
        F.avg(f_beta(F.col("n_blk"), F.col("n_true"), F.col("n_blk"))).alias("ceiling"),
    )


def run_summary(s1: DataFrame, matched: DataFrame) -> DataFrame:
    """(country, n_s1, n_matched, n_empty, n_pairs) of a prediction, for each country of the S1 records."""
    per = matched.groupBy("s1_id").agg(F.count("*").alias("n"))
    rows = s1.select(F.col("entity_id").alias("s1_id"), "country").join(per, "s1_id", "left")
    return rows.groupBy("country").agg(
        F.count("*").alias("n_s1"),
        F.count("n").alias("n_matched"),
        (F.count("*") - F.count("n")).alias("n_empty"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"),
    )


def header_violation(first_line: str | None, expected: list[str]) -> str | None:
    """What is wrong with a list file's header, if anything: such a file is not read further."""
    if not first_line:
        return "empty_file"
    if "\t" not in first_line and "," in first_line:
        return "comma_header"
    return None if [c.strip().lower() for c in first_line.rstrip("\n").split("\t")] == expected else "wrong_header"


def row_violations(lines: DataFrame) -> DataFrame:
    """(rule, severity, value) of a list file's lines (value) after the header: rows that are not blank and have no TAB."""
    bad = lines.where(~F.contains("value", F.lit("\t")) & F.rlike("value", F.lit(r"\S")))
    return bad.select(F.lit("row_without_tab").alias("rule"), F.lit("error").alias("severity"), "value")


def list_file(spark: SparkSession, path: str, names: list[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Rows of a list file, or None if it cannot be read, and what is wrong with it as a file: (rule, what)."""
    try:
        lines = spark.read.text(path)
        first = lines.first()
    except AnalysisException:
        return None, [("missing_file", path)]
    head = first.value if first else None
    wrong = header_violation(head, names)
    if wrong:
        return None, [(wrong, head or "")]
    body = lines.where(F.col("value") != head)  # every part of a written list repeats its header
    tabbed = body.where(F.contains("value", F.lit("\t")))
    cut = F.split("value", "\t", 2)
    rows = tabbed.select(cut[0].alias(names[0]), cut[1].alias(names[1]))
    return rows, [(r.rule, f"{r.n} times") for r in row_violations(body).groupBy("rule").agg(F.count("*").alias("n")).collect()]


def violations(
    required: DataFrame, matching: DataFrame, candidate: DataFrame | None = None, known: DataFrame | None = None
) -> DataFrame:
    """(rule, severity, s1_id, oth_id) of result lists (source1_entity_id, ids).  required: s1_id that must be listed."""
    def lists(df: DataFrame) -> DataFrame:
        s1, ids = df.columns[:2]
        return df.select(F.col(s1).alias("s1_id"), F.filter(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: x != "").alias("ids"))

    def found(df: DataFrame, rule: str, severity: str, oth: str | None = None) -> DataFrame:
        other = F.col(oth) if oth else F.lit(None).cast("string")
        return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "s1_id", other.alias("oth_id"))

    rows = lists(matching)
    pairs = rows.select("s1_id", F.explode("ids").alias("oth_id"))
    repeated = pairs.groupBy("s1_id", "oth_id").count().where("count > 1")
    out = [
        found(rows.groupBy("s1_id").count().where("count > 1"), "duplicate_row", "error"),
        found(repeated, "repeated_id", "error", "oth_id"),
        found(pairs.where(F.col("oth_id").startswith("S1-")), "reference_id_in_list", "error", "oth_id"),
        found(pairs.where(~F.col("oth_id").rlike("^S[123]-")), "bad_prefix", "error", "oth_id"),
        found(required.select("s1_id").distinct().join(rows, "s1_id", "left_anti"), "missing_row", "error"),
        found(rows.select("s1_id").distinct().join(required, "s1_id", "left_anti"), "unexpected_row", "error"),
    ]
    if known is not None:
        out.append(found(pairs.distinct().join(known.select("oth_id"), "oth_id", "left_anti"), "unknown_id", "error", "oth_id"))
    if candidate is not None:
        allowed = lists(candidate).select("s1_id", F.explode("ids").alias("oth_id"))
        out.append(found(pairs.distinct().join(allowed, ["s1_id", "oth_id"], "left_anti"), "not_a_candidate", "warning", "oth_id"))
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total
