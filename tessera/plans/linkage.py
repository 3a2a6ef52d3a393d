"""The whole linkage as one plan, for all countries at once: normalise, block, score in two stages, decode, list."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.splits import is_early_stop, is_validation, learning_curve, oof_fold
from tessera.operators import blocking, boosting, decode, features, learn, metrics, models
from tessera.operators.normalise import normalise
from tessera.sources import files
from tessera.sources.staging import released, staged


#: The grid that training chooses from: dense where balanced scores lie.
THRS = [round(0.30 + 0.02 * i, 2) for i in range(34)] + [0.98, 0.985, 0.99, 0.993, 0.996, 0.998]
MARGINS = [round(0.02 * i, 2) for i in range(23)]
#: The coarser grid of an evaluation.
EVAL_THRS = [round(0.50 + 0.02 * i, 2) for i in range(25)]
EVAL_MARGINS = [round(0.03 * i, 2) for i in range(11)]


@dataclass(frozen=True)
class Config:
    max_block: int = 60
    max_s1_block: int = 200
    topk: int = 60
    addr_stop_frac: float = 0.01
    keys_v2: bool = True
    keys_v3: bool = False
    keys_v3_topk: int = 5
    feat_v3: bool = True
    learn_suffix: bool = False
    cross_source: bool = False

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class Built:
    s1: DataFrame
    oth: DataFrame
    pairs: DataFrame
    idf: DataFrame | None
    density: DataFrame | None


def build_candidates(
    s1: DataFrame, oth: DataFrame, cfg: Config, density_source: DataFrame | None = None, recorded: DataFrame | None = None
) -> Built:
    """Normalised records and candidate pairs of all countries.  ``recorded`` pairs replace blocking where given."""
    suffixes = learn.suffix_lists(learn.learned_suffixes(s1)) if cfg.learn_suffix else None
    n1, n2 = normalise(s1, cfg.keys_v2, suffixes), normalise(oth, cfg.keys_v2, suffixes)
    if cfg.addr_stop_frac:
        # One row per country: far below any broadcast limit, and AQE decides by its real size.
        stop = learn.stop_lists(learn.generic_words(s1, cfg.addr_stop_frac))
        n1, n2 = n1.join(stop, "country", "left"), n2.join(stop, "country", "left")
    # Keys, weights, densities and features all read the records: written once, not normalised again for each.
    n1, n2 = staged(n1, "records_s1"), staged(n2, "records_other")
    idf = density = None
    if cfg.feat_v3:
        base = n1 if density_source is None else normalise(density_source, cfg.keys_v2, suffixes)
        idf, density = learn.idf(base), learn.density(base, n2)
    if recorded is not None:
        return Built(n1, n2, files.load_pairs(recorded, s1, oth), idf, density)
    k1, k2 = blocking.keys(n1, cfg.keys_v2), blocking.keys(n2, cfg.keys_v2)
    pairs = blocking.candidates(k1, k2, cfg.max_block, cfg.max_s1_block, cfg.topk)
    if cfg.keys_v3:
        x1, x2 = blocking.keys(n1, extra=True), blocking.keys(n2, extra=True)
        pairs = staged(pairs, "base_pairs")
        more = blocking.extra_candidates(x1, x2, pairs, cfg.max_block, cfg.max_s1_block, cfg.keys_v3_topk)
        pairs = pairs.unionByName(more)
    return Built(n1, n2, staged(pairs, "pairs"), idf, density)


def feature_rows(built: Built, cfg: Config) -> DataFrame:
    return features.packed_features(built.pairs, built.s1, built.oth, built.idf if cfg.feat_v3 else None)


def second_stage_rows(rows: DataFrame, built: Built, cfg: Config, main: bool = False) -> DataFrame:
    """``main``: rows have a second score, main, whose columns end in MAIN."""
    if main:
        rows = rows.withColumnRenamed("main", f"p1{MAIN}")
    out = decode.competition(rows, "p1", {f"p1{MAIN}": MAIN} if main else None)
    if cfg.cross_source:
        out = models.with_strong_sources(out)
        out = models.with_strong_sources(out, p=f"p1{MAIN}", out=f"n_sources{MAIN}") if main else out
    return models.with_density(out, built.density) if cfg.feat_v3 and built.density is not None else out


@dataclass
class Trained:
    stage1: PipelineModel
    stage2: PipelineModel
    cfg: Config
    thr: float
    margin: float
    decoder: dict | None
    report: dict


def second_features(cfg: Config) -> list[str]:
    return models.STAGE2 + (models.DENSITY if cfg.feat_v3 else []) + (["n_sources"] if cfg.cross_source else [])


def _half_scores(sizes: DataFrame, true: DataFrame, pred: DataFrame) -> dict[str, float]:
    """Macro F0.5 of the early-stop half, the report half and both, from one aggregate."""
    rows = metrics.per_entity(sizes, true, pred).withColumn("es", is_early_stop(F.col("s1_id")))
    r = rows.agg(F.avg(F.when(F.col("es"), F.col("f05"))).alias("es"), F.avg(F.when(~F.col("es"), F.col("f05"))).alias("rep"), F.avg("f05").alias("all"))
    return {k: float(v) if v is not None else 0.0 for k, v in r.first().asDict().items()}


@dataclass
class Prepared:
    """Candidates and their feature rows, for training and prediction on the same records with the same configuration.

    After training: second, rows with the second stage's features, by the out-of-fold scores and (ending MAIN) by the first stage, ``by``.
    """

    built: Built
    rows: DataFrame
    second: DataFrame | None = None
    by: PipelineModel | None = None


#: Ending of the second stage's columns that come from the first stage's own scores.
MAIN = "_main"


def labelled_pairs(pairs: DataFrame, true: DataFrame, labelled: DataFrame) -> DataFrame:
    """pairs plus label and known (the S1 has a truth row)."""
    rows = pairs.join(true.withColumn("label", F.lit(1)), ["s1_id", "oth_id"], "left").fillna(0, ["label"])
    return rows.join(labelled.withColumn("known", F.lit(True)), "s1_id", "left").fillna(False, ["known"])


def labelled_entities(truth: DataFrame) -> DataFrame:
    return truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()


def prepare(s1: DataFrame, oth: DataFrame, cfg: Config, truth: DataFrame | None = None) -> Prepared:
    """With ``truth`` pairs get their labels before they get features, so that no wide row is dealt out for them."""
    built = build_candidates(s1, oth, cfg)
    if truth is not None:
        built = replace(built, pairs=labelled_pairs(built.pairs, files.truth_pairs(truth), labelled_entities(truth)))
    return Prepared(built, staged(feature_rows(built, cfg), "feature_rows"))


def training_rows(
    built: Built, cfg: Config, true: DataFrame, labelled: DataFrame, final: bool = False, features: DataFrame | None = None
) -> DataFrame:
    """Feature rows with label, known (the S1 has a truth row), val (held out) and es (its early-stop half), staged."""
    held = F.lit(False) if final else is_validation(F.col("s1_id"))
    splits = {"val": held, "es": held & is_early_stop(F.col("s1_id"))}
    if features is None:
        features = feature_rows(replace(built, pairs=labelled_pairs(built.pairs, true, labelled)), cfg)
    elif "label" in features.columns:
        return features.withColumns(splits)
    else:
        features = labelled_pairs(features, true, labelled)
    return staged(features.withColumns(splits), "training_rows")


def train(
    s1: DataFrame, oth: DataFrame, truth: DataFrame, cfg: Config, fraction: float = 1.0,
    trees: tuple[int, int] | None = None, recorded: DataFrame | None = None, density_source: DataFrame | None = None,
    thr: float | None = None, margin: float | None = None, final: bool = False, prepared: Prepared | None = None,
) -> Trained:
    """Fit both stages on labelled S1 (out-of-fold p1), choose thr and margin on the early-stop half, compare decoders there.

    The early-stop half of the held-out S1 also ends the trees of both stages; the fold models have as many as the main
    one.  The report half takes part in no choice.  Pairs of unlabelled S1 are context: scored, never trained on.  With thr and
    margin given there is no sweep and no expected-F decoder; ``final`` needs them, trains on all labelled S1 and holds nothing out.
    ``trees`` bounds the trees (by default MOST_TREES); where no held-out rows of both labels end the training, as in final training, it is
    their number (by default BLIND_TREES).  ``prepared``: what ``prepare`` made of the same records and configuration.
    """
    if final and (thr is None or margin is None):
        raise ValueError("final training needs thr and margin")
    names = features.F1_V3 if cfg.feat_v3 else features.F1
    built = prepared.built if prepared else build_candidates(s1, oth, cfg, density_source, recorded)
    true = files.truth_pairs(truth)
    labelled = labelled_entities(truth)
    rows = training_rows(built, cfg, true, labelled, final, prepared.rows if prepared else None)
    own = F.col("known") & ~F.col("val")
    if fraction < 1:
        own = own & learning_curve(F.col("s1_id"), fraction)
    part = F.when(own, oof_fold(F.col("s1_id"))).when(F.col("known") & F.col("es"), boosting.HELD).otherwise(boosting.REST)
    parts = boosting.counts(rows, "label", part)
    n_held, held_pos = parts.get(boosting.HELD, (0, 0))
    stops = not final and 0 < held_pos < n_held
    trees = trees or (models.MOST_TREES if stops else models.BLIND_TREES)

    keep = ["s1_id", "oth_id", "country", "label", "known", "val", "es"]
    stage1, scores = models.fit_stage1_folded(rows.withColumn("__part", part), names, "__part", parts, keep, trees[0], stops)
    both = staged(second_stage_rows(scores, built, cfg, main=True), "second_stage_rows")
    if prepared:
        prepared.second, prepared.by = both, stage1
    if stops:
        stage2 = models.fit_stage2(both.where(own | (F.col("known") & F.col("es"))), second_features(cfg), trees=trees[1], validation="es")
    else:
        stage2 = models.fit_stage2(both.where(own), second_features(cfg), trees=trees[1])
    report = {"trees": [models.n_trees(stage1), models.n_trees(stage2)], "final": final}
    if final:
        return Trained(stage1, stage2, cfg, thr, margin, None, report)
    needed = ["s1_id", "oth_id", *second_features(cfg)]
    best = staged(decode.best_per_record(models.scored(stage2, both.select(*needed), "p"), "p"), "assigned")
    sizes = metrics.truth_sizes(labelled, true).where(is_validation(F.col("s1_id")))
    es = sizes.where(is_early_stop(F.col("s1_id")))
    fixed = thr is not None and margin is not None
    if not fixed:
        thr, margin, _ = decode.best_of_sweep(decode.sweep(best, es, true, THRS, MARGINS))
    scores = _half_scores(sizes, true, decode.decode_threshold(best, thr, margin))
    report |= {"thr": thr, "margin": margin} | {f"{k}_threshold": v for k, v in scores.items()}
    decoder = None
    mine = best.join(es.select("s1_id"), "s1_id", "left_semi").join(true.withColumn("label", F.lit(1)), ["s1_id", "oth_id"], "left")
    mine = mine.fillna(0, ["label"])
    if not fixed and not mine.isEmpty():
        found = mine.groupBy("s1_id").agg(F.sum("label").alias("n_found"))
        decoder = models.fit_expected_f(mine, es.join(found, "s1_id", "left").fillna(0, ["n_found"]))
        other = _half_scores(sizes, true, decode.decode_expected_f(best, decoder))
        report |= {f"{k}_expected_f": v for k, v in other.items()}
        if other["es"] <= scores["es"]:  # the expected-F decoder is used only if it is strictly better
            decoder = None
    return Trained(stage1, stage2, cfg, thr, margin, decoder, report)


def compare(
    s1: DataFrame, oth: DataFrame, truth: DataFrame, cfg: Config, names: list[str], trees: int = models.BLIND_TREES[1]
) -> list[dict]:
    """Other first-stage models by the F0.5 of the held-out S1, best first; second stage, decoder and split are the same for all.

    names: of ``models.model_zoo``, several joined by + are blended, or ``current`` for the production model.  Each result holds
    name, f05, thr, margin, and the seconds of the fit on all training rows and in all.
    """
    columns = features.F1_V3 if cfg.feat_v3 else features.F1
    built = build_candidates(s1, oth, cfg)
    true = files.truth_pairs(truth)
    labelled = truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()
    rows = training_rows(built, cfg, true, labelled)
    own = F.col("known") & ~F.col("val")
    fit = rows.where(own)
    rest = rows.join(fit.select("s1_id").distinct(), "s1_id", "left_anti")
    held = metrics.truth_sizes(labelled, true).where(is_validation(F.col("s1_id")))

    def fitted(name: str, table: DataFrame) -> list[PipelineModel]:
        if name == "current":
            return [models.fit_stage1(table, columns, trees=models.BLIND_TREES[0])]
        return models.fit_other(table, columns, name)

    out = []
    for name in names:
        began = time.monotonic()
        folds = models.out_of_fold(fit, columns, lambda seen, own, name=name: models.scored_by(fitted(name, seen), own, "p1"))
        start = time.monotonic()
        stage1 = fitted(name, fit)
        train_s = time.monotonic() - start
        both = folds.unionByName(models.scored_by(stage1, rest, "p1"))
        both = staged(second_stage_rows(both, built, cfg), "compared_rows")
        stage2 = models.fit_stage2(both.where(own), second_features(cfg), trees=trees)
        best = staged(decode.best_per_record(models.scored(stage2, both, "p"), "p"), "compared_best")
        thr, margin, f05 = decode.best_of_sweep(decode.sweep(best, held, true, THRS, MARGINS))
        released(both, best)
        out.append({"name": name, "f05": f05, "thr": thr, "margin": margin, "train_s": train_s, "total_s": time.monotonic() - began})
    return sorted(out, key=lambda r: -r["f05"])


def country_points(best: DataFrame, entities: DataFrame, true: DataFrame, thrs: list[float], margins: list[float]) -> tuple[DataFrame, DataFrame]:
    """Each country's own best point of a grid, and the metric when every country decodes with its own: (points, score).

    entities: scored S1 (s1_id, country, n_true).
    """
    points = staged(decode.best_by_part(decode.sweep(best, entities, true, thrs, margins, "country"), "country"), "country_points")
    kept = decode.decode_by_part(best, points, entities, "country")
    return points, metrics.macro_f05(metrics.per_entity(entities.select("s1_id"), true.join(entities.select("s1_id"), "s1_id", "left_semi"), kept))


def score(s1: DataFrame, oth: DataFrame, model: Trained, prepared: Prepared | None = None) -> tuple[Built, DataFrame]:
    built = prepared.built if prepared else build_candidates(s1, oth, model.cfg)
    if prepared and prepared.second is not None and prepared.by is model.stage1:
        own = [f"{c}{MAIN}" if f"{c}{MAIN}" in prepared.second.columns else c for c in second_features(model.cfg)]
        rows = prepared.second.select("s1_id", "oth_id", "country", *[F.col(c).alias(c.removesuffix(MAIN)) for c in own])
    else:
        rows = models.unpacked(prepared.rows if prepared else feature_rows(built, model.cfg))
        rows = models.scored(model.stage1, rows, "p1")
        rows = second_stage_rows(rows.select("s1_id", "oth_id", "country", "p1", *models.RAW2), built, model.cfg)
    return built, staged(models.scored(model.stage2, rows, "p"), "scores")


def predict(
    s1: DataFrame, oth: DataFrame, model: Trained, thr: float | None = None, margin: float | None = None,
    prepared: Prepared | None = None,
) -> dict[str, DataFrame]:
    """matching and candidate lists over all S1 records; given thr or margin, the threshold decoder is used."""
    built, rows = score(s1, oth, model, prepared)
    best = decode.best_per_record(rows, "p")
    if model.decoder and thr is None and margin is None:
        kept = decode.decode_expected_f(best, model.decoder)
    else:
        kept = decode.decode_threshold(best, model.thr if thr is None else thr, model.margin if margin is None else margin)
    return {
        "scores": rows.select("s1_id", "oth_id", "country", "p"),
        "matching": files.list_rows(s1, kept),
        "candidates": files.list_rows(s1, built.pairs, "candidate_entity_ids"),
        "summary": metrics.run_summary(s1, kept),
    }


def evaluate(
    s1: DataFrame, oth: DataFrame, truth: DataFrame, model: Trained, excluded: DataFrame | None = None, val_split: bool = False,
    cache: str | None = None,
) -> dict:
    """Score a model on labelled records: tables by country, of losses, and the best point of a grid (diagnosis only).

    Only S1 with a truth row count, without the excluded ones (s1_id).  ``cache``: a folder for the scores, the entities and the
    summary.
    """
    spark = s1.sparkSession
    built, rows = score(s1, oth, model)
    best = staged(decode.best_per_record(rows, "p"), "assigned")
    true = files.truth_pairs(truth)
    labelled = truth.select(F.col("source1_entity_id").alias("s1_id")).distinct()
    entities = metrics.per_entity(labelled, true, decode.decode_threshold(best, model.thr, model.margin), built.pairs)
    entities = metrics.scored_entities(entities, excluded, val_split)
    entities = staged(entities.join(s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id"), "scored_entities")
    base = metrics.macro_f05(entities).first().f05
    thr, margin, f05 = decode.best_of_sweep(decode.sweep(best, entities, true, EVAL_THRS, EVAL_MARGINS))
    if f05 <= base:
        thr, margin, f05 = model.thr, model.margin, base
    summary = {
        "cfg": model.cfg.as_dict(), "thr": model.thr, "margin": model.margin, "f05_at_config": base,
        "best_f05": f05, "best_thr": thr, "best_margin": margin,
        "countries": [r.country for r in files.countries(s1).collect()],
    }
    if cache:
        files.write_scores(rows.select("s1_id", "oth_id", "country", "p1", "p"), f"{cache}/scores")
        entities.write.mode("overwrite").parquet(f"{cache}/entities")
        files.save_json(spark, summary, f"{cache}/summary")
    points, own = country_points(best, entities, true, EVAL_THRS, EVAL_MARGINS)
    return {
        "summary": summary, "by_country": metrics.evaluation(entities), "losses": metrics.loss_breakdown(entities),
        "country_points": points, "country_score": own,
    }


def save(model: Trained, path: str) -> None:
    spark = SparkSession.active()
    model.stage1.write().overwrite().save(f"{path}/stage1")
    model.stage2.write().overwrite().save(f"{path}/stage2")
    files.save_json(spark, {"cfg": model.cfg.as_dict(), "thr": model.thr, "margin": model.margin, "decoder": model.decoder, "report": model.report}, f"{path}/config")


def load(spark, path: str) -> Trained:
    c = files.load_json(spark, f"{path}/config")
    s1, s2 = PipelineModel.load(f"{path}/stage1"), PipelineModel.load(f"{path}/stage2")
    return Trained(s1, s2, Config(**c["cfg"]), c["thr"], c["margin"], c["decoder"], c["report"])
