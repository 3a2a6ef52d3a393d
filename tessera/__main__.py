"""Command line: ``python -m tessera COMMAND --help``.

COMMAND is predict, train, compare, importance, evaluate, validate, sample, bucket-sample, shrink or audit.
Inputs are tab-separated: {data}/{prefix}_source1.tsv to _source3.tsv, and train_ground_truth.tsv where truth is needed.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import blocking, features, metrics, models, sample
from tessera.operators.normalise import normalise
from tessera.plans import linkage
from tessera.sources import files


def sides(spark: SparkSession, data: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    s1, s2, s3 = (files.read_records(spark, f"{data}/{prefix}_source{i}.tsv", f"S{i}") for i in (1, 2, 3))
    return s1, s2.unionByName(s3)


def truth_of(spark: SparkSession, data: str) -> DataFrame:
    return files.read_tsv(spark, f"{data}/train_ground_truth.tsv", files.LISTS)


def labelled(truth: DataFrame) -> DataFrame:
    return truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()


def config(a: argparse.Namespace) -> linkage.Config:
    return linkage.Config(addr_stop_frac=a.addr_stop_frac, keys_v2=a.keys_v2, feat_v3=a.feat_v3, learn_suffix=a.learn_suffix)


def run_train(spark: SparkSession, a: argparse.Namespace) -> int:
    density = files.read_records(spark, a.density_src, "S1") if a.density_src else None
    model = linkage.train(
        *sides(spark, a.data, "train"), truth_of(spark, a.data), config(a), a.train_frac, density_source=density, thr=a.thr, margin=a.margin,
        final=a.final,
    )
    linkage.save(model, a.models)
    print(json.dumps(model.report))
    return 0


def run_compare(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg = linkage.Config(30, 200, 30, addr_stop_frac=0.0, keys_v2=False, feat_v3=False)
    for row in linkage.compare(*sides(spark, a.data, "train"), truth_of(spark, a.data), cfg, a.candidates.split(",")):
        print(json.dumps(row))
    return 0


def run_importance(spark: SparkSession, a: argparse.Namespace) -> int:
    model = linkage.load(spark, a.models)
    first = features.F1_V3 if model.cfg.feat_v3 else features.F1
    for stage, fitted, names in (("stage1", model.stage1, first), ("stage2", model.stage2, linkage.second_features(model.cfg))):
        for name, share in models.importance(fitted, names):
            print(f"{stage}\t{name}\t{share:.6f}")
    return 0


def run_predict(spark: SparkSession, a: argparse.Namespace) -> int:
    model = linkage.load(spark, a.models)
    model.cfg = replace(model.cfg, keys_v3=model.cfg.keys_v3 or a.keys_v3, keys_v3_topk=a.keys_v3_topk)
    out = linkage.predict(*sides(spark, a.data, "test"), model, a.thr, a.margin)
    files.write_scores(out["scores"], f"{a.out}/scores")
    files.write_lists(out["matching"], f"{a.out}/matching_results.tsv")
    files.write_lists(out["candidates"], f"{a.out}/candidate_pairs.tsv")
    files.write_table(out["summary"], f"{a.out}/summary.tsv")
    return 0


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    model = linkage.load(spark, a.models)
    model.cfg = replace(model.cfg, keys_v3=model.cfg.keys_v3 or a.keys_v3, keys_v3_topk=a.keys_v3_topk)
    s1, oth = sides(spark, a.data, "train")
    if a.countries:
        s1, oth = s1.where(F.col("country").isin(a.countries)), oth.where(F.col("country").isin(a.countries))
    excluded = files.read_tsv(spark, a.exclude, ["entity_id"]).withColumnRenamed("entity_id", "s1_id") if a.exclude else None
    out = linkage.evaluate(s1, oth, truth_of(spark, a.data), model, excluded, a.val_split, a.cache)
    print(json.dumps(out["summary"]))
    out["by_country"].orderBy("part").show(1000, False)
    out["losses"].orderBy("category").show(10, False)
    out["country_points"].orderBy("country").show(1000, False)
    print(f"f05 with each country's own point: {out['country_score'].first().f05}")
    return 0


def run_validate(spark: SparkSession, a: argparse.Namespace) -> int:
    required = files.read_records(spark, f"{a.test_dir}/test_source1.tsv", "S1").select(F.col("entity_id").alias("s1_id"))
    known = sides(spark, a.test_dir, "test")[1].select(F.col("entity_id").alias("oth_id")) if a.check_ids else None
    lists, bad = [], False
    for path, names in ((a.matching, files.LISTS), (a.candidate, files.CANDIDATE_LISTS)):
        rows, found = metrics.list_file(spark, path, names)
        for rule, value in found:
            bad = True
            print(f"error: {path}: {rule} {value}")
        lists.append(rows)
    if lists[0] is not None:
        found = metrics.violations(required, lists[0], lists[1], known)
        for r in found.groupBy("rule", "severity").agg(F.count("*").alias("n"), F.min("s1_id").alias("first")).collect():
            bad |= r.severity == "error"
            print(f"{r.severity}: {r.rule}: {r.n} times, first {r.first}")
    print("failed" if bad else "passed")
    return int(bad)


def run_sample(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, oth = sides(spark, a.data, "train")
    truth = truth_of(spark, a.data)
    built = linkage.build_candidates(s1, oth, linkage.Config(addr_stop_frac=a.addr_stop_frac, keys_v2=a.keys_v2, feat_v3=False))
    true = files.truth_pairs(truth)
    parts = sample.rival_sample(built.pairs, labelled(truth), true, a.frac)
    sample.write_sample(parts, s1, oth, truth, a.out)
    wrong = [r for r in sample.checks(parts, true, parts["truth"]).collect() if r.n]
    print("\n".join(f"{r.check}: {r.n}" for r in wrong) or "all checks passed")
    return int(bool(wrong))


def run_bucket_sample(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, oth = sides(spark, a.data, "train")
    truth = truth_of(spark, a.data)
    parts = sample.bucket_sample(normalise(s1, False), normalise(oth, False), labelled(truth), files.truth_pairs(truth), a.mod)
    sample.write_sample(parts, s1, oth, truth, a.out)
    return 0


def run_shrink(spark: SparkSession, a: argparse.Namespace) -> int:
    pairs, truth = spark.read.parquet(f"{a.src}/pairs"), files.read_tsv(spark, f"{a.src}/truth", files.LISTS)
    s1, oth = (files.read_tsv(spark, f"{a.src}/{x}", [*files.RECORD, "source"]) for x in ("s1", "other"))
    steps = [i / 100 for i in range(1, 101)]
    frac = a.frac or sample.picked(sample.shrink_counts(pairs, steps), int(a.max_rows)).first().fraction
    parts = sample.shrunk({"pairs": pairs, "truth": labelled(truth)}, files.truth_pairs(truth), frac)
    sample.write_sample(parts, s1, oth, truth, a.out)
    print(f"fraction {frac}")
    return 0


def run_audit(spark: SparkSession, a: argparse.Namespace) -> int:
    s1, oth = sides(spark, a.data, "train")
    cfg = linkage.Config(a.max_block, a.max_s1_block, a.topk, addr_stop_frac=0.0, keys_v2=False, feat_v3=False)
    built = linkage.build_candidates(s1, oth, cfg)
    truth = truth_of(spark, a.data)
    true = files.truth_pairs(truth)
    keys = (blocking.keys(built.s1, False), blocking.keys(built.oth, False))
    modes = metrics.audit(true, built.pairs, *keys, a.max_block, a.max_s1_block, a.topk)
    files.write_table(modes, f"{a.out}/blocking_audit_report")
    recall = metrics.blocking_recall(s1.select(F.col("entity_id").alias("s1_id")), true, built.pairs)
    files.write_table(metrics.audit_summary(recall, modes), f"{a.out}/blocking_audit_summary")
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tessera")
    commands = out.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        c.set_defaults(run=run)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        return c

    def point(c: argparse.ArgumentParser) -> None:
        c.add_argument("--thr", type=float)
        c.add_argument("--margin", type=float)

    def more_keys(c: argparse.ArgumentParser) -> None:
        c.add_argument("--keys-v3", action="store_true")
        c.add_argument("--keys-v3-topk", type=int, default=5)

    c = command("predict", run_predict, "data", "models", "out")
    point(c)
    more_keys(c)
    c = command("train", run_train, "data", "models")
    point(c)
    c.add_argument("--final", action="store_true")
    c.add_argument("--addr-stop-frac", type=float, default=0.0)
    c.add_argument("--train-frac", type=float, default=1.0)
    for flag in ("--keys-v2", "--feat-v3", "--learn-suffix"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--density-src")
    c = command("compare", run_compare, "data")
    c.add_argument("--candidates", default=",".join(["current", *models.model_zoo(["x"]), "gbt_mid+logreg"]))
    command("importance", run_importance, "models")
    c = command("evaluate", run_evaluate, "data", "models")
    more_keys(c)
    c.add_argument("--exclude")
    c.add_argument("--cache")
    c.add_argument("--countries", nargs="*")
    c.add_argument("--val-split", action="store_true")
    c = command("validate", run_validate)
    for short, flag in (("-m", "--matching"), ("-c", "--candidate"), ("-t", "--test-dir")):
        c.add_argument(short, flag, required=True)
    c.add_argument("--check-ids", action="store_true")
    c = command("sample", run_sample, "data", "out")
    c.add_argument("--frac", type=float, default=0.05)
    c.add_argument("--addr-stop-frac", type=float, default=0.01)
    c.add_argument("--keys-v2", action="store_true")
    command("bucket-sample", run_bucket_sample, "data", "out").add_argument("--mod", type=int, default=20)
    c = command("shrink", run_shrink, "src", "out")
    c.add_argument("--max-rows", type=float, default=33e6)
    c.add_argument("--frac", type=float)
    c = command("audit", run_audit, "data", "out")
    for flag, value in (("--max_block", 30), ("--max_s1_block", 200), ("--topk", 30)):
        c.add_argument(flag, type=int, default=value)
    return out


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(SparkSession.builder.appName("tessera").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
