"""The engine's queries over the driver tables, and SQL twins for those that SQL can express.

``documents`` is adapted to records: the language is the country, the first five words are the name, a number and the next
four words are the address, and the source is dealt by the identifier.  Truth, for measures only: records of the two noisy
sources whose name is that of an S1 record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import similarity, splits
from tessera.functions import text as T
from tessera.operators import blocking, decode, features, learn, metrics, models, sample
from tessera.operators.normalise import normalise
from tessera.plans import linkage
from tessera.sources import files
from tessera.sources.staging import scratch_path, staged

STOP = 0.1
DECODER = {"cal_x": [0.2, 0.5, 0.8, 1.0], "cal_y": [0.02, 0.3, 0.9, 0.99], "lam": 0.2, "beta2": 0.25}
THRS, MARGINS = [0.4, 0.5, 0.6, 0.7], [0.0, 0.05, 0.1]


#: The audit has caps and a list length so small that pairs are lost in every way.
AUDIT = {"max_block": 3, "max_s1_block": 2, "topk": 2}
#: Base lists of the extra candidates are short, so that there are new pairs.
FEW = 2
FRACTIONS = [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Nine words are needed: one empty piece may come before them, and the last piece is what follows.
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n\t\r]+", 11), lambda x: x != "")
    source = F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"))
    address = F.concat(
        (F.col("n_chars") % 1000).cast("string"), F.lit(" "), F.translate(F.array_join(F.slice(w, 6, 4), " "), "ßẞ", "ss")
    )
    return docs.select(
        F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.translate(F.array_join(F.slice(w, 1, 5), " "), "ßẞ", "ss").alias("business_name"),
        F.when(F.col("doc_id") % 11 == 0, "").otherwise(address).alias("business_address"),
        F.col("lang").alias("country"),
        source.alias("source"),
    )


class Chain:
    """The steps of one query, each made at most once; what several steps read is staged."""

    def __init__(self, spark: SparkSession, sf_dir: str, once: bool = False):
        """``once``: texts are read once and the records staged, for queries of many steps."""
        self.records = staged(records(spark, sf_dir), "records") if once else records(spark, sf_dir)
        self.s1, self.oth = self.records.where("source = 'S1'"), self.records.where("source <> 'S1'")

    @cached_property
    def normalised(self) -> tuple[DataFrame, DataFrame]:
        stop = learn.stop_lists(learn.generic_words(self.s1, STOP))
        both = (normalise(x, True).join(stop, "country", "left") for x in (self.s1, self.oth))
        return tuple(staged(x, "normalised") for x in both)  # type: ignore[return-value]

    def keys(self, extra: bool = False) -> tuple[DataFrame, DataFrame]:
        return tuple(blocking.keys(x, True, extra) for x in self.normalised)  # type: ignore[return-value]

    @cached_property
    def candidates(self) -> DataFrame:
        return staged(blocking.candidates(*self.keys()), "candidates")

    @cached_property
    def truth(self) -> tuple[DataFrame, DataFrame]:
        a = self.s1.select(F.col("entity_id").alias("s1_id"), "country", "business_name")
        # A name's S1 with the smallest identifier is the true one.
        first = a.groupBy("country", "business_name").agg(F.min("s1_id").alias("s1_id"))
        b = self.oth.select(F.col("entity_id").alias("oth_id"), "country", "business_name")
        return a.select("s1_id"), first.join(b, ["country", "business_name"]).select("s1_id", "oth_id")

    def paired(self, idf: DataFrame | None = None) -> DataFrame:
        return features.paired(self.candidates, *self.normalised, idf)

    @cached_property
    def scored(self) -> DataFrame:
        """A fixed rule in place of a model: p1 from native features."""
        f = features.native_features()
        p = F.round(0.4 * f["nlev"] + 0.3 * f["ncore_jac"] + 0.2 * f["ajac"] + 0.1 * f["alev"], 6)
        return self.paired().select("s1_id", "oth_id", "country", p.alias("p1"))

    @cached_property
    def best(self) -> DataFrame:
        return decode.best_per_record(self.scored, "p1")

    @cached_property
    def kept(self) -> DataFrame:
        return decode.decode_threshold(self.best, 0.6, 0.05)

    @cached_property
    def entities(self) -> DataFrame:
        t, pairs = self.truth
        return metrics.per_entity(t, pairs, self.kept, self.candidates)

    @cached_property
    def audited(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Truth with neighbours by number, lists with some pairs taken out, and what the audit says of the missing ones."""
        number = F.substring_index("entity_id", "-", -1).cast("long")
        near = self.s1.select(F.col("entity_id").alias("s1_id"), F.concat(F.lit("S2-"), number + 1).alias("oth_id"))
        near = near.join(self.oth.select(F.col("entity_id").alias("oth_id")), "oth_id", "left_semi").select("s1_id", "oth_id")
        pairs = self.truth[1].unionByName(near).distinct()
        k1, k2 = self.keys()
        blocked = blocking.candidates(k1, k2, **AUDIT).where(~F.col("oth_id").endswith("7"))
        blocked = staged(blocked, "audit_lists")
        return pairs, blocked, metrics.audit(pairs, blocked, k1, k2, **AUDIT)


def _r6(c: str) -> F.Column:
    return F.round(F.col(c), 6).alias(c)


def q_scan_records(spark, d):
    return records(spark, d)


def q_country_inventory(spark, d):
    return records(spark, d).groupBy("country", "source").agg(F.count("*").alias("n"))


def q_tsv_round_trip(spark, d):
    """Records written as tab-separated text and scanned again, one country of them."""
    path = scratch_path(spark, "records_tsv")
    files.write_table(records(spark, d).select(*files.RECORD), path)
    return files.read_country(spark, path, "en")


def q_norm_name(spark, d):
    n = normalise(records(spark, d), True)
    return n.select("entity_id", "nclean", F.array_join("core", " ").alias("core"), F.array_join("fcore", " ").alias("fcore"))


def q_skeleton(spark, d):
    return normalise(records(spark, d), True).select("entity_id", "nskel")


def q_norm_addr(spark, d):
    return normalise(records(spark, d), True).select("entity_id", "aclean")


def q_generic_words(spark, d):
    return learn.generic_words(Chain(spark, d).s1, STOP).select("country", "token", _r6("share"))


def q_learned_suffixes(spark, d):
    return learn.learned_suffixes(Chain(spark, d).s1)


def q_blocking_keys(spark, d):
    a, b = Chain(spark, d).keys()
    return a.unionByName(b)


def q_extra_keys(spark, d):
    a, b = Chain(spark, d).keys(True)
    return a.unionByName(b)


def q_block_sizes(spark, d):
    a, b = Chain(spark, d).keys()
    size = a.unionByName(b).groupBy("country", "type", "key", (F.col("source") == "S1").alias("is_s1")).agg(F.count("*").alias("n"))
    return size.groupBy("type", "is_s1", "n").agg(F.count("*").alias("blocks"))


def q_candidates(spark, d):
    return Chain(spark, d).candidates


def q_extra_candidates(spark, d):
    c = Chain(spark, d)
    return blocking.extra_candidates(*c.keys(True), blocking.candidates(*c.keys(), topk=FEW))


def q_all_candidates(spark, d):
    """Base lists and the extra ones, as one table."""
    c = Chain(spark, d)
    base = staged(blocking.candidates(*c.keys(), topk=FEW), "base_lists")
    return base.unionByName(blocking.extra_candidates(*c.keys(True), base))


def q_recorded_pairs(spark, d):
    """Recorded pairs of which some records do not exist."""
    c = Chain(spark, d)
    known = c.oth.where(~F.col("entity_id").endswith("3"))
    return files.load_pairs(c.candidates, c.s1.where(~F.col("entity_id").endswith("5")), known)


def q_native_features(spark, d):
    f = features.native_features()
    return Chain(spark, d).paired().select("s1_id", "oth_id", *[F.round(c, 6).alias(k) for k, c in f.items()])


def q_text_similarities(spark, d):
    s = similarity.similarities_udf("nclean1", "nclean2", "j1", "j2", "aclean1", "aclean2", "nskel1", "nskel2")
    rows = Chain(spark, d).paired().withColumn("s", s)
    return rows.select("s1_id", "oth_id", *[F.round(F.col(f"s.{k}"), 6).alias(k) for k in similarity.NAMES])


def q_jaro_winkler(spark, d):
    rows = Chain(spark, d).paired()
    return rows.select("s1_id", "oth_id", F.round(similarity.jaro_winkler_udf("j1", "j2"), 6).alias("njw"))


def q_pair_features(spark, d):
    c = Chain(spark, d)
    rows = features.pair_features(c.candidates, *c.normalised, learn.idf(c.normalised[0]))
    return rows.select("s1_id", "oth_id", *[_r6(x) for x in features.F1_V3])


def q_idf_table(spark, d):
    return learn.idf(Chain(spark, d).normalised[0]).select("country", "field", "token", _r6("idf"), _r6("miss"), _r6("mx"))


def q_idf_features(spark, d):
    c = Chain(spark, d)
    rows = features.idf_features(c.paired(learn.idf(c.normalised[0])))
    return rows.select("s1_id", "oth_id", *[_r6(x) for x in features.IDF])


def q_density(spark, d):
    return learn.density(*Chain(spark, d).normalised).select("oth_id", _r6("addr_density"), _r6("name_density"))


def q_stage1_scores(spark, d):
    return Chain(spark, d).scored


def q_score_dump(spark, d):
    """Scores written by country and read back."""
    path = scratch_path(spark, "scores")
    files.write_scores(Chain(spark, d).scored, path)
    return spark.read.schema("s1_id string, oth_id string, p1 double, country string").parquet(path)


def q_competition(spark, d):
    out = decode.competition(Chain(spark, d).scored)
    names = ["gap_s1", "sum_s1", "gap_o", "max_o_other", "sum_o"]
    ranks = [F.col(c).cast("long").alias(c) for c in ("rk_s1", "rk_o")]
    return out.select("s1_id", "oth_id", "p1", *ranks, *[_r6(c) for c in names])


def q_corroboration(spark, d):
    """Each pair with the number of sources that hold a strong candidate of its S1."""
    return models.with_strong_sources(Chain(spark, d).scored, 0.3).select("s1_id", "oth_id", "n_sources")


def q_best_per_record(spark, d):
    return Chain(spark, d).best


def q_decode_threshold(spark, d):
    return Chain(spark, d).kept


def q_decode_expected_f(spark, d):
    return decode.decode_expected_f(Chain(spark, d).best, DECODER).select("s1_id", "oth_id", _r6("q"))


def _sweep(c: Chain, thrs: list[float], margins: list[float], by: str | None = None) -> DataFrame:
    t, pairs = c.truth
    sizes = metrics.truth_sizes(t, pairs)
    if by:
        sizes = sizes.join(c.s1.select(F.col("entity_id").alias("s1_id"), by), "s1_id")
    return decode.sweep(c.best, sizes, pairs, thrs, margins, by)


def q_sweep(spark, d):
    return _sweep(Chain(spark, d), THRS, MARGINS).select("thr", "margin", _r6("f05"))


def q_sweep_full_grid(spark, d):
    """The grid that training uses."""
    return _sweep(Chain(spark, d), linkage.THRS, linkage.MARGINS).select(_r6("thr"), _r6("margin"), _r6("f05"))


def q_country_thresholds(spark, d):
    points = decode.best_by_part(_sweep(Chain(spark, d), THRS, MARGINS, "country"), "country")
    return points.select("country", "thr", "margin", _r6("f05"))


def q_country_threshold_score(spark, d):
    """The metric when every country decodes with its own best point."""
    c = Chain(spark, d)
    points = decode.best_by_part(_sweep(c, THRS, MARGINS, "country"), "country")
    own = c.s1.select(F.col("entity_id").alias("s1_id"), "country")
    t, pairs = c.truth
    return metrics.macro_f05(metrics.per_entity(t, pairs, decode.decode_by_part(c.best, points, own, "country"))).select(_r6("f05"), "n")


def q_entity_f05(spark, d):
    return Chain(spark, d).entities.select("s1_id", "n_true", "n_pred", "tp", "n_blk", _r6("f05"))


def q_macro_f05(spark, d):
    return metrics.macro_f05(Chain(spark, d).entities).select(_r6("f05"), "n")


def q_loss_breakdown(spark, d):
    return metrics.loss_breakdown(Chain(spark, d).entities).select("category", "n", _r6("lost"))


def q_quality_totals(spark, d):
    return metrics.quality_totals(Chain(spark, d).entities).select(*[_r6(c) for c in ("precision", "recall", "ceiling", "singleton_rate")])


def q_full_evaluation(spark, d):
    """Held-out entities that are not excluded, by country and in all."""
    c = Chain(spark, d)
    entities = c.entities.join(c.s1.select(F.col("entity_id").alias("s1_id"), "country"), "s1_id")
    excluded = c.s1.where(F.substring_index("entity_id", "-", -1).cast("long") % 7 == 0).select(F.col("entity_id").alias("s1_id"))
    out = metrics.evaluation(metrics.scored_entities(entities, excluded, val_split=True))
    return out.select("part", "n", *[_r6(c) for c in ("f05", "precision", "recall", "ceiling")])


def q_unseen_matches(spark, d):
    """Mean number of true matches that no list holds: the decoder's lambda."""
    return Chain(spark, d).entities.agg(F.round(F.greatest(F.avg(F.col("n_true") - F.col("tp")), F.lit(0.0)), 6).alias("lam"))


def q_run_summary(spark, d):
    c = Chain(spark, d)
    return metrics.run_summary(c.s1, c.kept)


def q_blocking_recall(spark, d):
    c = Chain(spark, d)
    out = metrics.blocking_recall(*c.truth, c.candidates)
    return out.select("n_true", "n_found", _r6("recall"), "n_candidates", _r6("per_s1"), _r6("zero_rate"))


def q_audit_modes(spark, d):
    return Chain(spark, d).audited[2].groupBy("mode").agg(F.count("*").alias("n"))


def q_audit_ranks(spark, d):
    return Chain(spark, d).audited[2].select("s1_id", "oth_id", "mode", F.coalesce(F.col("rank").cast("long"), F.lit(0).cast("long")).alias("rank"))


def q_audit_report(spark, d):
    """The audit's summary, written as a tab-separated file and read back."""
    c = Chain(spark, d)
    pairs, blocked, modes = c.audited
    path = scratch_path(spark, "audit")
    out = metrics.audit_summary(metrics.blocking_recall(c.truth[0], pairs, blocked), modes).select("metric", _r6("value"))
    files.write_table(out, path)
    return files.read_tsv(spark, path, out.columns).select("metric", F.col("value").cast("double").alias("value"))


def q_hash_splits(spark, d):
    e = F.col("entity_id")
    return records(spark, d).select(
        "entity_id",
        splits.is_early_stop(e).alias("early_stop"),
        splits.learning_curve(e, 0.5).alias("curve_half"),
    )


def q_crc_splits(spark, d):
    e = F.col("entity_id")
    n = normalise(records(spark, d), True)
    return n.select(
        "entity_id",
        splits.is_validation(e).alias("val"),
        splits.oof_fold(e).cast("long").alias("fold"),
        splits.in_sample(e, 0.05).alias("sampled"),
        splits.name_bucket(F.col("country"), F.col("core"), 5).alias("bucket"),
    )


def _sample(c: Chain) -> dict[str, DataFrame]:
    return sample.rival_sample(c.candidates, *c.truth, 0.2)


def q_rival_sample(spark, d):
    return _sample(Chain(spark, d))["pairs"]


def q_sample_records(spark, d):
    """Identifiers of all parts of a sample: records of both sides and truth rows."""
    s = _sample(Chain(spark, d))
    parts = [s["s1"].select(F.lit("s1").alias("part"), F.col("s1_id").alias("id")), s["oth"].select(F.lit("oth").alias("part"), F.col("oth_id").alias("id"))]
    return parts[0].unionByName(parts[1]).unionByName(s["truth"].select(F.lit("truth").alias("part"), F.col("s1_id").alias("id")))


def q_sample_checks(spark, d):
    """The self-checks of a sample, here of one that was damaged."""
    c = Chain(spark, d)
    s = _sample(c)
    s["oth"] = s["oth"].where(~F.col("oth_id").endswith("4"))
    s["truth"] = s["truth"].where(~F.col("s1_id").endswith("2")).union(s["truth"].where(F.col("s1_id").endswith("1")))
    return sample.checks(s, c.truth[1], c.truth[0].where(splits.in_sample(F.col("s1_id"), 0.2)))


def q_filtered_copy(spark, d):
    """Records of a keep list that names some of them twice, one row each."""
    r = records(spark, d)
    keep = r.where(F.col("entity_id").endswith("5")).select("entity_id")
    return files.filtered(r.unionByName(r.where("source = 'S2'")), keep.unionByName(keep)).select(*files.RECORD)


def q_rivals(spark, d):
    return sample.rivals_per_record(Chain(spark, d).candidates).select(_r6("rivals"))


def q_shrink_counts(spark, d):
    return sample.shrink_counts(Chain(spark, d).candidates, FRACTIONS)


def q_shrunk_sample(spark, d):
    """A smaller sample cut from a larger one."""
    return sample.shrink(_sample(Chain(spark, d))["pairs"], 0.1)


def q_picked_fraction(spark, d):
    c = Chain(spark, d)
    return sample.picked(sample.shrink_counts(c.candidates, FRACTIONS), 500)


def q_truth_lists(spark, d):
    """Truth as lists and back: one row per true match."""
    c = Chain(spark, d)
    lists = files.list_rows(c.s1, c.truth[1])
    return files.truth_pairs(lists)


def q_list_rows(spark, d):
    c = Chain(spark, d)
    return files.list_rows(c.s1, c.kept)


def q_file_rules(spark, d):
    """Rules of a list file as a file: its header, and rows without a TAB."""
    lists = files.list_rows(Chain(spark, d).s1, Chain(spark, d).truth[1])
    own = F.col("source1_entity_id")
    line = F.when(own.endswith("9"), "  ").when(own.endswith("5"), own).otherwise(F.concat(own, F.lit("\t"), F.col("matched_entity_ids")))
    heads = [None, "source1_entity_id,matched_entity_ids", "source1_entity_id\tids", " Source1_Entity_Id\tMATCHED_ENTITY_IDS\n"]
    found = [(r, "error", h) for h in heads if (r := metrics.header_violation(h, files.LISTS))]
    rows = metrics.row_violations(lists.select(line.alias("value")))
    return rows.unionByName(spark.createDataFrame(found, "rule string, severity string, value string")).fillna("", ["value"])


def q_violations(spark, d):
    c = Chain(spark, d)
    lists = files.list_rows(c.s1, c.kept)
    # Every list gets two wrong identifiers and every fifth an unknown one; some rows are missing, doubled or unexpected.
    own, more = F.col("source1_entity_id"), F.concat_ws(",", "matched_entity_ids", F.lit("S1-1"), F.lit("X-9"))
    broken = lists.select(own, F.when(own.endswith("5"), F.concat_ws(",", more, F.lit("S2-none"), F.lit("S2-none"))).otherwise(more).alias("ids"))
    broken = broken.where(~own.endswith("8")).unionByName(broken.where(own.endswith("3")))
    required = c.s1.where(~F.col("entity_id").endswith("6")).select(F.col("entity_id").alias("s1_id"))
    known = c.oth.select(F.col("entity_id").alias("oth_id"))
    cand = files.list_rows(c.s1, c.candidates, "candidate_entity_ids")
    return metrics.violations(required, broken, cand, known).fillna("", ["oth_id"])


def q_linkage_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the records' own truth, up to the model's full number of trees, and predict with the trained two-stage model."""
    c = Chain(spark, sf_dir, once=True)
    t, pairs = c.truth
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.collect_list("oth_id"), ",").alias("matched_entity_ids"))
    labelled = t.join(lists, "s1_id", "left").fillna("").withColumnRenamed("s1_id", "source1_entity_id")
    cfg = linkage.Config(addr_stop_frac=STOP)
    labelled = staged(labelled, "truth")
    prepared = linkage.prepare(c.s1, c.oth, cfg, labelled)
    model = linkage.train(c.s1, c.oth, labelled, cfg, prepared=prepared)
    return linkage.predict(c.s1, c.oth, model, prepared=prepared)["matching"]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records to result lists: normalise, block, score, assign, decode, list."""
    return q_list_rows(spark, sf_dir)


# ---- SQL twins -------------------------------------------------------------------------------------------------


def _strings(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({x}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"


def _skeletons(toks: str) -> str:
    one = "t"
    for a, b in C.SKELETON_REWRITES:
        one = f"replace({one}, '{a}', '{b}')"
    plain = f"list_transform({toks}, lambda t: regexp_replace({one}, '[aeiouyh]', '', 'g'))"
    return (
        f"list_transform({plain}, lambda x: coalesce(array_to_string(list_filter(string_split(x, ''), "
        "lambda c, i: i = 1 OR c <> string_split(x, '')[i - 1]), ''), ''))"
    )


def _address(x: str) -> str:
    s = f"replace(lower(strip_accents({x})), '.', '')"
    for n in sorted((n for n in C.STATES if " " in n), key=len, reverse=True):
        s = rf"regexp_replace({s}, '\b{n}\b', '{C.STATES[n]}', 'g')"
    return _tokens(s)


def _longest(x: str, n: int) -> str:
    return (
        f"list_transform(list_sort(list_transform(list_distinct({x}), lambda t: {{'k': -length(t), 't': t}})), "
        f"lambda z: z.t)[1:{n}]"
    )


_DIGIT, _ALPHA = r"regexp_matches(t, '\p{Nd}')", r"regexp_matches(t, '^\p{L}+$')"
_TABLE = dict(C.ABBREVIATIONS) | {n: C.ABBREVIATIONS.get(c, c) for n, c in C.STATES.items() if " " not in n}

_RECORDS = r"""
docs AS (
  SELECT 'S' || (1 + doc_id % 3) AS source, doc_id, lang AS country, n_chars,
         list_filter(string_split_regex(coalesce(text, ''), '[ \n\t\r]+'), lambda x: x <> '') AS w
  FROM documents
),
rec AS MATERIALIZED (
  SELECT source || '-' || doc_id AS entity_id, translate(coalesce(array_to_string(w[1:5], ' '), ''), 'ßẞ', 'ss') AS business_name,
         CASE WHEN doc_id % 11 = 0 THEN '' ELSE (n_chars % 1000) || ' ' || translate(coalesce(array_to_string(w[6:9], ' '), ''), 'ßẞ', 'ss') END AS business_address,
         country, source
  FROM docs
)"""

_NORM = f"""{_RECORDS},
n1 AS (
  SELECT *, {_tokens("replace(replace(replace(lower(strip_accents(business_name)), '&', ' and '), '''', ''), '.', '')")} AS ntoks,
         {_address("business_address")} AS at0
  FROM rec
),
n2 AS (
  SELECT *, {_skeletons("ntoks")} AS nsk,
         list_transform(at0, lambda t: coalesce(({_map(_TABLE)})[t], t)) AS at1
  FROM n1
),
n3 AS (
  SELECT *,
         list_filter(ntoks, lambda t, i: t NOT IN ({_strings(C.LEGAL)}) AND nsk[i] NOT IN ({_strings(C.LEGAL_SKELETONS)})) AS core0,
         list_filter(ntoks, lambda t: t NOT IN ({_strings(C.LEGAL)})) AS fcore0,
         list_transform(at1, lambda t: coalesce(({_map(C.ORDINALS)})[t], t)) AS at2
  FROM n2
),
zero AS (
  SELECT *, CASE WHEN len(core0) > 0 THEN core0 ELSE ntoks END AS core, CASE WHEN len(fcore0) > 0 THEN fcore0 ELSE ntoks END AS fcore,
         list_transform(at2, lambda t: CASE WHEN regexp_matches(t, '^0+$') THEN '0' WHEN regexp_matches(t, '^\\p{{Nd}}')
                                            THEN regexp_replace(t, '^0+', '') ELSE t END) AS atoks,
         list_transform(at1, lambda t: CASE WHEN regexp_matches(t, '^0+$') THEN '0' WHEN regexp_matches(t, '^\\p{{Nd}}')
                                            THEN regexp_replace(t, '^0+', '') ELSE t END) AS gtoks
  FROM n3
),
norm AS MATERIALIZED (
  SELECT *, coalesce(array_to_string(ntoks, ' '), '') AS nclean, coalesce(array_to_string(atoks, ' '), '') AS aclean,
         {_skeletons("core")} AS csk,
         coalesce(array_to_string(list_filter({_skeletons("core")}, lambda x: x <> ''), ' '), '') AS nskel,
         coalesce(array_to_string(fcore, ' '), '') AS j
  FROM zero
)"""

_GENERIC = rf"""{_NORM},
gw AS (
  SELECT country, token, count(*) AS df FROM (
    SELECT country, unnest(list_filter(list_distinct(gtoks), lambda t: {_ALPHA})) AS token FROM norm WHERE source = 'S1'
  ) GROUP BY ALL
),
gt AS (SELECT country, count(*) AS n FROM norm WHERE source = 'S1' GROUP BY ALL),
generic AS MATERIALIZED (SELECT country, token, df / n AS share FROM gw JOIN gt USING (country) WHERE df / n > {STOP})"""


def _specific(least: int) -> str:
    return (
        f"list_filter(atoks, lambda t: length(t) >= {least} AND {_ALPHA} AND t NOT IN ({_strings(C.ADDRESS_STOP)}) "
        "AND NOT list_contains(stop, t))"
    )


_FITS = rf"regexp_matches(w, '^\p{{L}}+$') AND length(w) > 2 AND w NOT IN ({_strings(C.ADDRESS_STOP)}) AND NOT list_contains(stop, w)"
_SHORT = rf"list_filter(atoks, lambda t: {_DIGIT} AND length(t) <= 8)[1:2]"
_LONG = f"list_filter(core, lambda t: length(t) >= 5 AND {_ALPHA})"
_SK2 = "list_filter(csk, lambda x: length(x) >= 2)"
_PLAIN = lambda v: f"length({v}) <= 8 AND {v} NOT IN ({_strings(C.ADDRESS_STOP)}) AND NOT list_contains(stop, {v})"
_PAIRS = "flatten(list_transform({0}, lambda x, i: list_transform({0}[i + 1:], lambda y: x || '|' || y)))"
_AKEYS = rf"""list_filter(list_transform(atoks, lambda t, i: CASE WHEN {_DIGIT} AND length(t) <= 8 THEN
  t || '|' || list_filter(atoks[i + 1:i + CASE WHEN len(stop) > 0 THEN 5 ELSE 3 END], lambda w: {_FITS})[1] END), lambda k: k IS NOT NULL)"""
_KEY_LISTS = {
    "A": f"{_AKEYS}[1:3]",
    "N": "CASE WHEN len(core) > 0 THEN [array_to_string(list_sort(core), ' ')] ELSE [] END",
    "P": "CASE WHEN len(core) > 0 THEN [left(core[1], 5) || '|' || left(core[-1], 4)] ELSE [] END",
    "Q": "CASE WHEN len(core) > 1 THEN [left(array_to_string(list_sort(core), ''), 9)] ELSE [] END",
    "T": f"list_transform({_longest(_LONG, 2)}, lambda t: left(t, 4))",
    "U": f"list_transform({_longest(_LONG, 2)}, lambda t: right(t, 4))",
    "V": f"CASE WHEN len({_SK2}) > 0 THEN [array_to_string(list_sort({_SK2}), '')] ELSE [] END",
    "K": f"list_transform(list_filter({_longest(_SK2, 2)}, lambda x: length(x) >= 3), lambda t: left(t, 3))",
    "R": f"CASE WHEN len({_longest(_specific(5), 2)}) = 2 THEN [array_to_string(list_sort({_longest(_specific(5), 2)}), '|')] ELSE [] END",
    "S": f"list_transform({_longest(_specific(5), 1)}, lambda t: left(t, 5))",
    "X": f"""flatten(list_transform(
        list_concat(list_concat(CASE WHEN len({_SK2}) > 0 THEN ['v' || array_to_string(list_sort({_SK2}), '')] ELSE [] END,
                    list_transform({_longest("list_filter(csk, lambda x: length(x) >= 3)", 2)}, lambda x: 'k' || left(x, 3))),
                    list_transform({_longest(_LONG, 1)}, lambda x: 't' || left(x, 4))),
        lambda a: list_transform(list_concat(list_transform({_SHORT}, lambda t: 'd' || t),
                    list_transform({_longest(_specific(5), 2)}, lambda t: 'w' || t)), lambda b: a || '|' || b)))""",
    "B": rf"""list_filter(list_transform(atoks[1:len(atoks) - 1], lambda t, i: CASE WHEN ({_DIGIT} OR regexp_matches(atoks[i + 1], '\p{{Nd}}'))
        AND {_PLAIN("t")} AND {_PLAIN("atoks[i + 1]")} THEN t || '|' || atoks[i + 1] END), lambda k: k IS NOT NULL)[1:3]""",
    "Y": f"flatten(list_transform({_SHORT}, lambda n: list_transform({_longest(_specific(4), 4)}, lambda w: n || '|' || w)))",
    "C": """CASE WHEN len(core) = 1 AND length(core[1]) >= 7 AND right(core[1], 3) IN ('com', 'net', 'org') THEN [left(core[1], length(core[1]) - 3)]
        ELSE list_filter([CASE WHEN length(array_to_string(core, '')) >= 6 THEN array_to_string(core, '') END,
          CASE WHEN len(core) >= 2 AND length(ini) >= 6 AND ini <> array_to_string(core, '') THEN ini END], lambda k: k IS NOT NULL) END""",
    "M": _PAIRS.format(f"list_sort({_longest(f'list_filter(core, lambda t: length(t) >= 4 AND {_ALPHA})', 3)})"),
    "L": _PAIRS.format(f"list_sort({_longest(_specific(5), 4)})"),
}


def _key_rows(kinds: str) -> str:
    return " UNION ALL ".join(
        f"SELECT entity_id, source, country, '{k}' AS type, unnest({_KEY_LISTS[k]}) AS key, {C.KEY_WEIGHTS[k]} AS w FROM stopped" for k in kinds
    )


_STOPPED = f"""{_GENERIC},
stopped AS MATERIALIZED (
  SELECT norm.*, coalesce(g.stop, []) AS stop,
         coalesce(array_to_string(list_transform(core[1:len(core) - 1], lambda t: left(t, 1)), ''), '') || core[-1] AS ini
  FROM norm LEFT JOIN (SELECT country, list(token) AS stop FROM generic GROUP BY country) g USING (country)
)"""
_KEYS = f"{_STOPPED},\nkeys AS MATERIALIZED ({_key_rows('ANPQTUVKRSXBYC')})"


def _candidates(keys: str, out: str, topk: int, max_block: int = 60, max_s1_block: int = 200) -> str:
    return f"""
{out}_k1 AS (SELECT * FROM {keys} WHERE source = 'S1' QUALIFY count(*) OVER (PARTITION BY country, type, key) <= {max_s1_block}),
{out}_k2 AS (SELECT * FROM {keys} WHERE source <> 'S1' QUALIFY count(*) OVER (PARTITION BY country, type, key) <= {max_block}),
{out}_p AS (
  SELECT a.entity_id AS s1_id, b.entity_id AS oth_id, country, CAST(sum(b.w) AS BIGINT) AS w
  FROM {out}_k1 a JOIN (SELECT DISTINCT country, type, key, entity_id, w FROM {out}_k2) b USING (country, type, key) GROUP BY ALL
),
{out}_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY w DESC, oth_id) AS k FROM {out}_p),
{out} AS MATERIALIZED (SELECT s1_id, oth_id, country, w FROM {out}_r WHERE k <= {topk})"""


_CAND = f"{_KEYS},{_candidates('keys', 'cand', 60)}"
_EXTRA = f"""{_KEYS},{_candidates("keys", "cand", FEW)},
xkeys AS MATERIALIZED ({_key_rows("ML")}),{_candidates("xkeys", "xcand", 205)},
extra AS (
  SELECT x.* FROM xcand x ANTI JOIN cand c ON x.s1_id = c.s1_id AND x.oth_id = c.oth_id
  QUALIFY row_number() OVER (PARTITION BY x.s1_id ORDER BY x.w DESC, x.oth_id) <= 5
)"""


def _crc(x: str) -> str:
    """CRC-32 of an ASCII or UTF-8 string, bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    bytes_of = f"list_transform(range(octet_length(encode({x}))), lambda i: CAST('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {bytes_of}), lambda a, b: {byte}), 4294967295)"


def _jac(a: str, b: str) -> str:
    return (
        f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / "
        f"len(list_distinct(list_concat({a}, {b}))) END"
    )


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END"


_PART = ", ".join(["nclean", "aclean", "nskel", "fcore AS c", "j", "atoks AS t", f"list_filter(atoks, lambda t: {_DIGIT}) AS d",
                   f"list_distinct({_AKEYS}[1:3]) AS k", r"list_distinct(regexp_extract_all(aclean, '\p{Nd}+')) AS spans"])
_COLS = "nclean aclean nskel c j t d k spans".split()
_FEAT = f"""{_CAND},
parts AS MATERIALIZED (SELECT entity_id, {_PART} FROM stopped),
pr AS MATERIALIZED (
  SELECT cand.*, {", ".join(f"a.{c} AS {c}1, b.{c} AS {c}2" for c in _COLS)}
  FROM cand JOIN parts a ON a.entity_id = s1_id JOIN parts b ON b.entity_id = oth_id
)"""
_BOTH = "aclean1 <> '' AND aclean2 <> ''"
_NEAR = "list_sort(list_transform(d2, lambda y, i: {'d': levenshtein(d1[1], y), 'i': i, 'y': y}))[1]"
_DIG = lambda x: rf"CAST(left(regexp_replace({x}, '\P{{Nd}}', '', 'g'), 9) AS BIGINT)"
_NATIVE = {
    "nlev": _lev("j1", "j2"),
    "ncore_eq": "CAST(list_sort(c1) = list_sort(c2) AS DOUBLE)",
    "ncore_jac": _jac("c1", "c2"),
    "nlen_d": "abs(length(j1) - length(j2)) / greatest(length(j1), length(j2), 1)",
    "nfirst_eq": "CAST(coalesce(c1[1] = c2[1], false) AS DOUBLE)",
    "ajac": _jac("t1", "t2"),
    "anum_jac": _jac("d1", "d2"),
    "anum_eq": "CAST(list_has_any(d1, d2) AS DOUBLE)",
    "a2_empty": "CAST(aclean2 = '' AS DOUBLE)",
    "akey_eq": "CAST(list_has_any(k1, k2) AS DOUBLE)",
    "a_exact": f"CAST({_BOTH} AND aclean1 = aclean2 AS DOUBLE)",
    "anum_first_eq": "CAST(coalesce(d1[1] = d2[1], false) AS DOUBLE)",
    "w": "CAST(w AS DOUBLE)",
    "alev": f"CASE WHEN {_BOTH} THEN {_lev('aclean1', 'aclean2')} ELSE 0.0 END",
    "alen_d": f"CASE WHEN {_BOTH} THEN abs(length(aclean1) - length(aclean2)) / greatest(length(aclean1), length(aclean2), 1) ELSE 0.0 END",
    "ncontain": "CAST(length(j1) >= 4 AND length(j2) >= 4 AND (contains(j1, j2) OR contains(j2, j1)) AS DOUBLE)",
    "akey_jac": _jac("k1", "k2"),
    "wcount_d": "abs(len(c1) - len(c2)) / greatest(len(c1), len(c2), 1)",
    "a1_empty": "CAST(aclean1 = '' AS DOUBLE)",
    "both_empty": "CAST(aclean1 = '' AND aclean2 = '' AS DOUBLE)",
    "hnum_edit": f"CASE WHEN len(d1) = 0 OR len(d2) = 0 THEN -1.0 ELSE CAST(least(({_NEAR}).d, 3) AS DOUBLE) END",
    "hnum_logdiff": f"CASE WHEN len(d1) = 0 OR len(d2) = 0 THEN -1.0 ELSE ln(1 + abs({_DIG('d1[1]')} - {_DIG(f'({_NEAR}).y')})) END",
    "nspan_jac": _jac("spans1", "spans2"),
    "sk_eq": "CAST(nskel1 <> '' AND nskel1 = nskel2 AS DOUBLE)",
}
_SCORED = f"""{_FEAT},
sc AS MATERIALIZED (
  SELECT s1_id, oth_id, country,
         round(0.4 * ({_NATIVE["nlev"]}) + 0.3 * ({_NATIVE["ncore_jac"]}) + 0.2 * ({_NATIVE["ajac"]}) + 0.1 * ({_NATIVE["alev"]}), 6) AS p1
  FROM pr
),
best AS MATERIALIZED (
  SELECT s1_id, oth_id, p1 AS p, coalesce(lead(p1) OVER o, 0.0) AS p_next FROM sc
  WINDOW o AS (PARTITION BY oth_id ORDER BY p1 DESC, s1_id) QUALIFY row_number() OVER o = 1
),
pred AS MATERIALIZED (SELECT s1_id, oth_id, p FROM best WHERE p >= 0.6 AND p - p_next >= 0.05)"""
_TRUTH = """
tp AS MATERIALIZED (
  SELECT f.s1_id, b.entity_id AS oth_id FROM rec b JOIN
    (SELECT country, business_name, min(entity_id) AS s1_id FROM rec WHERE source = 'S1' GROUP BY ALL) f USING (country, business_name)
  WHERE b.source <> 'S1'
),
ts AS MATERIALIZED (
  SELECT entity_id AS s1_id, coalesce(n, 0) AS n_true FROM rec LEFT JOIN (SELECT s1_id, count(*) AS n FROM tp GROUP BY ALL) x ON x.s1_id = entity_id
  WHERE source = 'S1'
)"""


def _f05(p: str, n: str, t: str) -> str:
    return (
        f"CASE WHEN {n} = 0 AND {p} = 0 THEN 1.0 WHEN {t} = 0 THEN 0.0 ELSE "
        f"1.25 * ({t} / {p}) * ({t} / {n}) / (0.25 * ({t} / {p}) + ({t} / {n})) END"
    )


_ENT = f"""{_SCORED},{_TRUTH},
e0 AS (
  SELECT ts.s1_id, n_true, coalesce(n_pred, 0) AS n_pred, coalesce(hits, 0) AS tp, coalesce(n_blk, 0) AS n_blk
  FROM ts LEFT JOIN (SELECT pred.s1_id, count(*) AS n_pred, count(tp.oth_id) AS hits FROM pred LEFT JOIN tp USING (s1_id, oth_id) GROUP BY ALL) a USING (s1_id)
  LEFT JOIN (SELECT s1_id, count(*) AS n_blk FROM cand SEMI JOIN tp USING (s1_id, oth_id) GROUP BY ALL) b USING (s1_id)
),
ent AS MATERIALIZED (SELECT *, {_f05("n_pred", "n_true", "tp")} AS f05 FROM e0)"""
_IDF = f"""{_FEAT},
it AS (SELECT country, count(*) AS n FROM stopped WHERE source = 'S1' GROUP BY ALL),
iw AS (
  SELECT country, field, token, count(*) AS df FROM (
    SELECT country, 'n' AS field, unnest(list_distinct(fcore)) AS token FROM stopped WHERE source = 'S1'
    UNION ALL SELECT country, 'a', unnest(list_distinct(atoks)) FROM stopped WHERE source = 'S1'
  ) GROUP BY ALL HAVING count(*) >= 3
),
idf AS MATERIALIZED (
  SELECT country, field, token, ln((n + 1) / (df + 1)) AS idf, ln((n + 1) / 3.0) AS miss, greatest(ln(n + 1), 1e-6) AS mx
  FROM iw JOIN it USING (country)
)"""


_AUDIT = f"""{_KEYS},{_candidates("keys", "acand", AUDIT["topk"], AUDIT["max_block"], AUDIT["max_s1_block"])},{_TRUTH},
atp AS MATERIALIZED (
  SELECT * FROM tp UNION SELECT a.entity_id, b.entity_id FROM rec a JOIN rec b ON b.entity_id = 'S2-' || (CAST(split_part(a.entity_id, '-', 2) AS BIGINT) + 1)
  WHERE a.source = 'S1'
),
ablk AS MATERIALIZED (SELECT * FROM acand WHERE NOT ends_with(oth_id, '7')),
b1 AS (SELECT country, type, key, count(*) AS b1 FROM keys WHERE source = 'S1' GROUP BY ALL),
b2 AS (SELECT country, type, key, count(*) AS b2 FROM keys WHERE source <> 'S1' GROUP BY ALL),
ms AS MATERIALIZED (SELECT * FROM atp ANTI JOIN ablk USING (s1_id, oth_id)),
sh AS (SELECT DISTINCT ms.s1_id, ms.oth_id, x.country, x.type, x.key FROM ms JOIN keys x ON x.entity_id = s1_id
       JOIN keys y ON y.entity_id = oth_id AND x.country = y.country AND x.type = y.type AND x.key = y.key),
pm AS (SELECT s1_id, oth_id, count(*) FILTER (b1 <= {AUDIT["max_s1_block"]} AND b2 <= {AUDIT["max_block"]}) AS good,
              count(*) FILTER (b2 <= {AUDIT["max_block"]}) AS good2
       FROM sh JOIN b1 USING (country, type, key) JOIN b2 USING (country, type, key) GROUP BY ALL),
au AS MATERIALIZED (
  SELECT ms.s1_id, ms.oth_id, k AS rank, CASE WHEN good IS NULL THEN 'A' WHEN good = 0 AND good2 = 0 THEN 'B' WHEN good = 0 THEN 'C'
         WHEN k > {AUDIT["topk"]} THEN 'D' ELSE 'E' END AS mode
  FROM ms LEFT JOIN pm USING (s1_id, oth_id) LEFT JOIN (SELECT s1_id, oth_id, k FROM acand_r) USING (s1_id, oth_id)
)"""
_SAMPLED = f"""{_CAND},{_TRUTH},
drawn AS MATERIALIZED (SELECT s1_id FROM ts WHERE {_crc("s1_id")} % 1000000 < 200000),
sp AS MATERIALIZED (SELECT * FROM cand WHERE oth_id IN (SELECT oth_id FROM cand SEMI JOIN drawn USING (s1_id))),
so AS (SELECT oth_id FROM cand SEMI JOIN drawn USING (s1_id) UNION SELECT oth_id FROM tp SEMI JOIN drawn USING (s1_id))"""
_HASHED = f"""{_CAND},
s1h AS MATERIALIZED (SELECT s1_id, {_crc("s1_id")} % 1000000 AS h FROM (SELECT DISTINCT s1_id FROM cand)),
oh AS (SELECT oth_id, min(h) AS h, count(*) AS c FROM cand JOIN s1h USING (s1_id) GROUP BY ALL),
counts AS (SELECT CAST(f AS DOUBLE) AS fraction, CAST(coalesce(sum(c) FILTER (h < f * 1e6), 0) AS BIGINT) AS n
           FROM (VALUES {", ".join(f"({f})" for f in FRACTIONS)}) x(f), oh GROUP BY f)"""


def _grid(thrs: list[float], margins: list[float]) -> str:
    """gf: the metric of every entity at every point."""
    points = ", ".join(f"({t}, {m})" for t in thrs for m in margins)
    return f"""
c1 AS (SELECT entity_id AS s1_id, country FROM rec WHERE source = 'S1'),
g AS (SELECT CAST(t AS DOUBLE) AS thr, CAST(m AS DOUBLE) AS margin FROM (VALUES {points}) x(t, m)),
gk AS (SELECT thr, margin, s1_id, count(*) AS n_pred, count(tp.oth_id) AS hits FROM g JOIN best ON p >= thr AND p - p_next >= margin
       LEFT JOIN tp USING (s1_id, oth_id) GROUP BY ALL),
gf AS MATERIALIZED (SELECT thr, margin, country, {_f05("coalesce(n_pred, 0)", "n_true", "coalesce(hits, 0)")} AS f
       FROM g CROSS JOIN ts JOIN c1 USING (s1_id) LEFT JOIN gk USING (thr, margin, s1_id))"""


_BEST_POINTS = f"""{_SCORED},{_TRUTH},{_grid(THRS, MARGINS)},
bp AS MATERIALIZED (
  SELECT * FROM (SELECT country, thr, margin, avg(f) AS f05 FROM gf GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY country ORDER BY round(f05, 12) DESC, thr, margin) = 1
)"""
_WORDS_OF = "list_sort(list_filter(string_split({0}, ' '), lambda t: t <> ''))"
#: Common subsequences by bits of a HUGEINT, as strings here are far under 120 characters.
_LCS = """CASE WHEN a = '' OR b = '' THEN 0 ELSE length(a) - bit_count(list_reduce(list_concat([ones],
  list_transform(string_split(b, ''), lambda c: list_sum(list_transform(string_split(a, ''), lambda x, i: CASE WHEN x = c THEN (1::HUGEINT << (i - 1)::INT) ELSE 0::HUGEINT END)))),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ones)) END"""
_SIMILAR = f"""{_FEAT},
pairs_of AS (
  SELECT s1_id, oth_id, unnest(['n', 'j', 'a', 'k']) AS kind, unnest([nclean1, j1, aclean1, nskel1]) AS x, unnest([nclean2, j2, aclean2, nskel2]) AS y FROM pr
),
u AS MATERIALIZED (
  SELECT DISTINCT x, y, {_WORDS_OF.format("x")} AS tx, {_WORDS_OF.format("y")} AS ty FROM pairs_of
),
w AS MATERIALIZED (
  SELECT *, array_to_string(tx, ' ') AS sx, array_to_string(ty, ' ') AS sy, list_sort(list_distinct(tx)) AS dx, list_sort(list_distinct(ty)) AS dy,
         CASE WHEN length(x) <= length(y) THEN x ELSE y END AS short, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS long
  FROM u
),
z AS MATERIALIZED (
  SELECT *, coalesce(array_to_string(list_filter(dx, lambda t: list_contains(dy, t)), ' '), '') AS s,
         coalesce(array_to_string(list_filter(dx, lambda t: NOT list_contains(dy, t)), ' '), '') AS ox,
         coalesce(array_to_string(list_filter(dy, lambda t: NOT list_contains(dx, t)), ' '), '') AS oy
  FROM w
),
todo AS (
  SELECT x AS a, y AS b FROM z UNION SELECT coalesce(sx, ''), coalesce(sy, '') FROM z UNION SELECT ox, oy FROM z
  UNION SELECT short, substr(long, greatest(i, 0) + 1, least(i + length(short), length(long)) - greatest(i, 0)) FROM z, range(1 - 200, 200) r(i)
    WHERE i > -length(short) AND i < length(long)
  UNION SELECT long, substr(short, greatest(i, 0) + 1, least(i + length(long), length(short)) - greatest(i, 0)) FROM z, range(1 - 200, 200) r(i)
    WHERE i > -length(long) AND i < length(short) AND length(short) = length(long)
),
lcs AS MATERIALIZED (SELECT a, b, CAST({_LCS} AS DOUBLE) AS n FROM (SELECT a, b, (1::HUGEINT << length(a)) - 1 AS ones FROM todo)),
part AS (
  SELECT x, y, max(200.0 * n / (length(a) + length(b))) AS v FROM (
    SELECT x, y, short AS a, substr(long, greatest(i, 0) + 1, least(i + length(short), length(long)) - greatest(i, 0)) AS b FROM z, range(1 - 200, 200) r(i)
      WHERE i > -length(short) AND i < length(long)
    UNION ALL
    SELECT x, y, long, substr(short, greatest(i, 0) + 1, least(i + length(long), length(short)) - greatest(i, 0)) FROM z, range(1 - 200, 200) r(i)
      WHERE i > -length(long) AND i < length(short) AND length(short) = length(long)
  ) JOIN lcs USING (a, b) GROUP BY x, y
),
val AS MATERIALIZED (
  SELECT z.x, z.y,
    CASE WHEN z.x = '' AND z.y = '' THEN 100.0 ELSE 200.0 * r.n / (length(z.x) + length(z.y)) END AS ratio,
    CASE WHEN sx = '' AND sy = '' THEN 100.0 ELSE 200.0 * o.n / (length(sx) + length(sy)) END AS sort,
    CASE WHEN len(dx) = 0 OR len(dy) = 0 THEN 0.0 WHEN s <> '' AND (ox = '' OR oy = '') THEN 100.0 ELSE greatest(
      100.0 * (1 - (length(ox) + length(oy) - 2 * d.n) / (2 * length(s) + 2 * (s <> '')::INT + length(ox) + length(oy))),
      CASE WHEN s = '' THEN 0.0 ELSE 100.0 * (1 - (1 + length(ox)) / (2 * length(s) + 1 + length(ox))) END,
      CASE WHEN s = '' THEN 0.0 ELSE 100.0 * (1 - (1 + length(oy)) / (2 * length(s) + 1 + length(oy))) END) END AS sets,
    CASE WHEN z.x = '' OR z.y = '' THEN CASE WHEN z.x = z.y THEN 100.0 ELSE 0.0 END ELSE part.v END AS parts,
    CASE WHEN z.x = z.y THEN 1.0 ELSE jaro_winkler_similarity(z.x, z.y) END AS jw
  FROM z JOIN lcs r ON r.a = z.x AND r.b = z.y JOIN lcs o ON o.a = coalesce(sx, '') AND o.b = coalesce(sy, '')
  JOIN lcs d ON d.a = ox AND d.b = oy LEFT JOIN part ON part.x = z.x AND part.y = z.y
)
SELECT pr.s1_id, pr.oth_id, round(n.ratio, 6) AS nr, round(n.sort, 6) AS nsort, round(n.sets, 6) AS nset, round(n.parts, 6) AS npart,
  round(j.jw, 6) AS njw, round(j.sets, 6) AS ncomp, {", ".join(f"round(CASE WHEN {_BOTH} THEN a.{c} ELSE 0.0 END, 6) AS {k}" for c, k in
  (("ratio", "ar"), ("sort", "asort"), ("sets", "aset"), ("parts", "apart"), ("jw", "ajw")))},
  round(k.ratio, 6) AS sk_r, round(k.sets, 6) AS sk_set, round(k.parts, 6) AS sk_part
FROM pr JOIN val n ON n.x = nclean1 AND n.y = nclean2 JOIN val j ON j.x = pr.j1 AND j.y = pr.j2
JOIN val a ON a.x = aclean1 AND a.y = aclean2 JOIN val k ON k.x = nskel1 AND k.y = nskel2"""


def _cal(p: str) -> str:
    xs, ys = DECODER["cal_x"], DECODER["cal_y"]
    out = f"CASE WHEN {p} <= {xs[0]} THEN {ys[0]} "
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:]):
        out += f"WHEN {p} < {x1} THEN {y0} + ({p} - {x0}) * CAST({(y1 - y0) / (x1 - x0)!r} AS DOUBLE) "
    return out + f"ELSE {ys[-1]} END"


def _r(names: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names.split())


SQL = {
    "scan_records": f"WITH {_RECORDS} SELECT * FROM rec",
    "country_inventory": f"WITH {_RECORDS} SELECT country, source, count(*) AS n FROM rec GROUP BY ALL",
    "norm_name": f"WITH {_NORM} SELECT entity_id, nclean, coalesce(array_to_string(core, ' '), '') AS core, j AS fcore FROM norm",
    "skeleton": f"WITH {_NORM} SELECT entity_id, nskel FROM norm",
    "norm_addr": f"WITH {_NORM} SELECT entity_id, aclean FROM norm",
    "generic_words": f"WITH {_GENERIC} SELECT country, token, round(share, 6) AS share FROM generic",
    "learned_suffixes": f"""WITH {_NORM},
e AS (SELECT country, csk[-1] AS suffix FROM norm WHERE source = 'S1' AND len(core) > 0),
t AS (SELECT country, count(*) AS total FROM e GROUP BY ALL)
SELECT country, suffix, count(*) AS n FROM e JOIN t USING (country)
WHERE suffix <> '' AND length(suffix) <= 10 AND suffix NOT IN ({_strings(C.LEGAL_SKELETONS)})
GROUP BY country, suffix, total HAVING count(*) >= greatest(2, floor(0.005 * total))""",
    "blocking_keys": f"WITH {_KEYS} SELECT * FROM keys",
    "extra_keys": f"WITH {_STOPPED} {_key_rows('ML')}",
    "block_sizes": f"""WITH {_KEYS} SELECT type, is_s1, n, count(*) AS blocks FROM
(SELECT type, source = 'S1' AS is_s1, count(*) AS n FROM keys GROUP BY country, type, key, source = 'S1') GROUP BY ALL""",
    "candidates": f"WITH {_CAND} SELECT * FROM cand",
    "extra_candidates": f"WITH {_EXTRA} SELECT * FROM extra",
    "native_features": f"WITH {_FEAT} SELECT s1_id, oth_id, {', '.join(f'round({e}, 6) AS {k}' for k, e in _NATIVE.items())} FROM pr",
    "jaro_winkler": f"WITH {_FEAT} SELECT s1_id, oth_id, round(CASE WHEN j1 = j2 THEN 1.0 ELSE jaro_winkler_similarity(j1, j2) END, 6) AS njw FROM pr",
    "idf_table": f"WITH {_IDF} SELECT country, field, token, {_r('idf miss mx')} FROM idf",
    "idf_features": f"""WITH {_IDF},
d AS (SELECT country, max(miss) AS miss, max(mx) AS mx FROM idf GROUP BY ALL),
side AS (
  SELECT s1_id, oth_id, country, 'n' AS field, 1 AS s, unnest(list_distinct(c1)) AS token FROM pr
  UNION ALL SELECT s1_id, oth_id, country, 'n', 2, unnest(list_distinct(c2)) FROM pr
  UNION ALL SELECT s1_id, oth_id, country, 'a', 1, unnest(list_distinct(t1)) FROM pr WHERE {_BOTH}
  UNION ALL SELECT s1_id, oth_id, country, 'a', 2, unnest(list_distinct(t2)) FROM pr WHERE {_BOTH}
),
tok AS (
  SELECT s1_id, oth_id, country, field, token, coalesce(idf, d.miss, d.mx, 1.0) AS v, coalesce(d.mx, 1.0) AS mx, count(*) AS sides, max(s) AS s
  FROM side LEFT JOIN d USING (country) LEFT JOIN (SELECT country, field, token, idf FROM idf) i USING (country, field, token)
  GROUP BY s1_id, oth_id, country, field, token, v, d.mx
),
agg AS (
  SELECT s1_id, oth_id, field, sum(CASE WHEN sides = 2 THEN v * v END) / nullif(sqrt(sum(CASE WHEN sides = 2 OR s = 1 THEN v * v END) *
         sum(CASE WHEN sides = 2 OR s = 2 THEN v * v END)), 0) AS cos, max(CASE WHEN sides = 2 THEN v END) / max(mx) AS top
  FROM tok GROUP BY ALL
)
SELECT pr.s1_id, pr.oth_id, round(coalesce(n.cos, 0.0), 6) AS n_idf_cos, round(coalesce(n.top, 0.0), 6) AS n_idf_max,
       round(coalesce(a.cos, 0.0), 6) AS a_idf_cos, round(coalesce(a.top, 0.0), 6) AS a_idf_max
FROM pr LEFT JOIN agg n ON n.s1_id = pr.s1_id AND n.oth_id = pr.oth_id AND n.field = 'n'
LEFT JOIN agg a ON a.s1_id = pr.s1_id AND a.oth_id = pr.oth_id AND a.field = 'a'""",
    "density": f"""WITH {_NORM}, s AS (SELECT * FROM norm WHERE source = 'S1'),
k AS (SELECT country, 1e5 / count(*) AS k FROM s GROUP BY ALL),
ca AS (SELECT country, aclean, count(*) AS c FROM s GROUP BY ALL), cn AS (SELECT country, nskel, count(*) AS c FROM s GROUP BY ALL)
SELECT entity_id AS oth_id, round(coalesce(ca.c, 0) * k, 6) AS addr_density, round(coalesce(cn.c, 0) * k, 6) AS name_density
FROM norm JOIN k USING (country) LEFT JOIN ca USING (country, aclean) LEFT JOIN cn USING (country, nskel) WHERE source <> 'S1'""",
    "stage1_scores": f"WITH {_SCORED} SELECT * FROM sc",
    "competition": f"""WITH {_SCORED} SELECT s1_id, oth_id, p1, rank() OVER (PARTITION BY s1_id ORDER BY p1 DESC) AS rk_s1,
rank() OVER (PARTITION BY oth_id ORDER BY p1 DESC) AS rk_o, round(p1 - max(p1) OVER a, 6) AS gap_s1, round(sum(p1) OVER a - p1, 6) AS sum_s1,
round(p1 - max(p1) OVER b, 6) AS gap_o, round(max(p1) OVER b, 6) AS max_o_other, round(sum(p1) OVER b - p1, 6) AS sum_o
FROM sc WINDOW a AS (PARTITION BY s1_id), b AS (PARTITION BY oth_id)""",
    "best_per_record": f"WITH {_SCORED} SELECT * FROM best",
    "decode_threshold": f"WITH {_SCORED} SELECT * FROM pred",
    "decode_expected_f": f"""WITH {_SCORED}, a AS (SELECT s1_id, oth_id, {_cal("p")} AS q FROM best),
r AS (SELECT *, row_number() OVER w AS k, sum(q) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cs, sum(q) OVER (PARTITION BY s1_id) AS tot,
      exp(sum(ln(1 - least(q, 1 - 1e-6))) OVER (PARTITION BY s1_id) - {DECODER["lam"]}) AS p0 FROM a WINDOW w AS (PARTITION BY s1_id ORDER BY q DESC, oth_id)),
e AS (SELECT *, 1.25 * cs / (0.25 * (tot + {DECODER["lam"]}) + k) AS ef FROM r),
b AS (SELECT *, max(ef) OVER (PARTITION BY s1_id) AS top FROM e),
z AS (SELECT *, min(CASE WHEN ef >= top THEN k END) OVER (PARTITION BY s1_id) AS kb FROM b)
SELECT s1_id, oth_id, round(q, 6) AS q FROM z WHERE top > p0 AND k <= kb""",
    "sweep": f"""WITH {_SCORED},{_TRUTH},
g AS (SELECT CAST(t.thr AS DOUBLE) AS thr, CAST(m.margin AS DOUBLE) AS margin FROM (VALUES {", ".join(f"({t})" for t in THRS)}) t(thr), (VALUES {", ".join(f"({m})" for m in MARGINS)}) m(margin)),
k AS (SELECT thr, margin, s1_id, count(*) AS n_pred, count(tp.oth_id) AS hits FROM g JOIN best ON p >= thr AND p - p_next >= margin
      LEFT JOIN tp USING (s1_id, oth_id) GROUP BY ALL)
SELECT thr, margin, round(avg({_f05("coalesce(n_pred, 0)", "n_true", "coalesce(hits, 0)")}), 6) AS f05
FROM g CROSS JOIN ts LEFT JOIN k USING (thr, margin, s1_id) GROUP BY thr, margin""",
    "entity_f05": f"WITH {_ENT} SELECT s1_id, n_true, n_pred, tp, n_blk, round(f05, 6) AS f05 FROM ent",
    "macro_f05": f"WITH {_ENT} SELECT round(coalesce(avg(f05), 0.0), 6) AS f05, count(*) AS n FROM ent",
    "loss_breakdown": f"""WITH {_ENT} SELECT CASE WHEN n_true = 0 AND n_pred > 0 THEN 'singleton_predicted' WHEN n_true = 0 THEN 'singleton_ok'
WHEN n_blk = 0 THEN 'none_blocked' WHEN tp = 0 THEN 'blocked_but_rejected' WHEN f05 < 1 THEN 'partial' ELSE 'perfect' END AS category,
count(*) AS n, round(sum(1 - f05) / (SELECT count(*) FROM ent), 6) AS lost FROM ent GROUP BY ALL""",
    "quality_totals": f"""WITH {_ENT} SELECT round(sum(tp) / greatest(sum(n_pred), 1), 6) AS precision, round(sum(tp) / greatest(sum(n_true), 1), 6) AS recall,
round(avg({_f05("n_blk", "n_true", "n_blk")}), 6) AS ceiling, round(avg(CASE WHEN n_true = 0 THEN f05 END), 6) AS singleton_rate FROM ent""",
    "blocking_recall": f"""WITH {_CAND},{_TRUTH} SELECT t AS n_true, f AS n_found, round(f / greatest(t, 1), 6) AS recall, c AS n_candidates,
round(c / greatest(n, 1), 6) AS per_s1, round(z / greatest(n, 1), 6) AS zero_rate FROM (SELECT (SELECT count(*) FROM tp) AS t,
(SELECT count(*) FROM tp SEMI JOIN cand USING (s1_id, oth_id)) AS f, (SELECT count(*) FROM cand) AS c, (SELECT count(*) FROM ts) AS n,
(SELECT count(*) FROM ts ANTI JOIN cand USING (s1_id)) AS z)""",
    "audit_modes": f"WITH {_AUDIT} SELECT mode, count(*) AS n FROM au GROUP BY ALL",
    "audit_ranks": f"WITH {_AUDIT} SELECT s1_id, oth_id, mode, coalesce(rank, 0) AS rank FROM au",
    "audit_report": f"""WITH {_AUDIT},
v AS (SELECT (SELECT count(*) FROM ts) AS s, (SELECT count(*) FROM atp) AS t, (SELECT count(*) FROM atp SEMI JOIN ablk USING (s1_id, oth_id)) AS f,
      (SELECT count(*) FROM ablk) AS c, (SELECT count(*) FROM ts ANTI JOIN ablk USING (s1_id)) AS z),
m AS (SELECT unnest(['total_s1_entities', 'total_gt_pairs', 'total_recovered_pairs', 'blocking_recall', 'total_candidates', 'avg_candidates_per_s1',
      'zero_candidate_rate']) AS metric, unnest([s, t, f, f / greatest(t, 1), c, c / greatest(s, 1), z / greatest(s, 1)]::DOUBLE[]) AS value FROM v)
SELECT metric, round(value, 6) AS value FROM m UNION ALL
SELECT 'failure_' || k || '_count', CAST((SELECT count(*) FROM au WHERE mode = k) AS DOUBLE) FROM (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(k)""",
    "hash_splits": f"""WITH {_RECORDS} SELECT entity_id, CAST('0x' || left(md5(entity_id || 'e'), 2) AS INTEGER) % 2 = 0 AS early_stop,
CAST('0x' || left(md5(entity_id || 't'), 2) AS INTEGER) < 128 AS curve_half FROM rec""",
    "list_rows": f"""WITH {_SCORED} SELECT entity_id AS source1_entity_id, coalesce(string_agg(oth_id, ',' ORDER BY p DESC, oth_id), '') AS matched_entity_ids
FROM rec LEFT JOIN pred ON s1_id = entity_id WHERE source = 'S1' GROUP BY ALL""",
    "violations": f"""WITH {_SCORED}, s AS (SELECT entity_id AS s1_id, ends_with(entity_id, '5') AS five FROM rec WHERE source = 'S1'),
one AS (SELECT * FROM s WHERE NOT ends_with(s1_id, '8')),
l AS (
  SELECT s1_id, unnest(list_concat(ids, CASE WHEN five THEN ['S1-1', 'X-9', 'S2-none', 'S2-none'] ELSE ['S1-1', 'X-9'] END)) AS oth_id
  FROM (SELECT * FROM one UNION ALL SELECT * FROM one WHERE ends_with(s1_id, '3'))
  JOIN (SELECT s.s1_id, coalesce(list(oth_id) FILTER (oth_id IS NOT NULL), []) AS ids FROM s LEFT JOIN pred USING (s1_id) GROUP BY ALL) USING (s1_id)
)
SELECT 'duplicate_row' AS rule, 'error' AS severity, s1_id, '' AS oth_id FROM one WHERE ends_with(s1_id, '3')
UNION ALL SELECT 'repeated_id', 'error', s1_id, oth_id FROM l GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT 'reference_id_in_list', 'error', s1_id, oth_id FROM l WHERE starts_with(oth_id, 'S1-')
UNION ALL SELECT 'bad_prefix', 'error', s1_id, oth_id FROM l WHERE starts_with(oth_id, 'X-')
UNION ALL SELECT 'missing_row', 'error', s1_id, '' FROM s WHERE ends_with(s1_id, '8')
UNION ALL SELECT 'unexpected_row', 'error', s1_id, '' FROM one WHERE ends_with(s1_id, '6')
UNION ALL SELECT DISTINCT 'unknown_id', 'error', s1_id, oth_id FROM l WHERE oth_id NOT IN (SELECT entity_id FROM rec WHERE source <> 'S1')
UNION ALL SELECT DISTINCT 'not_a_candidate', 'warning', s1_id, oth_id FROM l ANTI JOIN cand USING (s1_id, oth_id)""",
    "tsv_round_trip": f"WITH {_RECORDS} SELECT entity_id, business_name, business_address, country FROM rec WHERE country = 'en'",
    "all_candidates": f"WITH {_EXTRA} SELECT * FROM cand UNION ALL SELECT * FROM extra",
    "recorded_pairs": f"WITH {_CAND} SELECT * FROM cand WHERE NOT ends_with(s1_id, '5') AND NOT ends_with(oth_id, '3')",
    "text_similarities": f"WITH {_SIMILAR}",
    "score_dump": f"WITH {_SCORED} SELECT * FROM sc",
    "corroboration": f"""WITH {_SCORED} SELECT s1_id, oth_id, n_sources FROM sc JOIN
(SELECT s1_id, count(DISTINCT CASE WHEN p1 >= 0.3 THEN left(oth_id, 2) END) AS n_sources FROM sc GROUP BY ALL) USING (s1_id)""",
    "sweep_full_grid": f"WITH {_SCORED},{_TRUTH},{_grid(linkage.THRS, linkage.MARGINS)} SELECT thr, margin, round(avg(f), 6) AS f05 FROM gf GROUP BY ALL",
    "country_thresholds": f"WITH {_BEST_POINTS} SELECT country, thr, margin, round(f05, 6) AS f05 FROM bp",
    "country_threshold_score": f"""WITH {_BEST_POINTS},
k2 AS (SELECT s1_id, count(*) AS n_pred, count(tp.oth_id) AS hits FROM best JOIN c1 USING (s1_id) JOIN bp USING (country) LEFT JOIN tp USING (s1_id, oth_id)
       WHERE p >= thr AND p - p_next >= margin GROUP BY s1_id)
SELECT round(avg({_f05("coalesce(n_pred, 0)", "n_true", "coalesce(hits, 0)")}), 6) AS f05, count(*) AS n FROM ts LEFT JOIN k2 USING (s1_id)""",
    "full_evaluation": f"""WITH {_ENT}, h AS (
  SELECT ent.*, unnest([country, 'ALL']) AS part FROM ent JOIN rec ON entity_id = s1_id
  WHERE CAST(split_part(s1_id, '-', 2) AS BIGINT) % 7 <> 0 AND {_crc("s1_id || 'v'")} % 10 < 3
)
SELECT part, count(*) AS n, round(avg(f05), 6) AS f05, round(sum(tp) / greatest(sum(n_pred), 1), 6) AS precision,
round(sum(tp) / greatest(sum(n_true), 1), 6) AS recall, round(avg({_f05("n_blk", "n_true", "n_blk")}), 6) AS ceiling FROM h GROUP BY part""",
    "unseen_matches": f"WITH {_ENT} SELECT round(greatest(avg(n_true - tp), 0.0), 6) AS lam FROM ent",
    "run_summary": f"""WITH {_SCORED}, m AS (SELECT s1_id, count(*) AS n FROM pred GROUP BY ALL)
SELECT country, count(*) AS n_s1, count(n) AS n_matched, count(*) - count(n) AS n_empty, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_pairs
FROM rec LEFT JOIN m ON s1_id = entity_id WHERE source = 'S1' GROUP BY country""",
    "crc_splits": f"""WITH {_NORM} SELECT entity_id, {_crc("entity_id || 'v'")} % 10 < 3 AS val, {_crc("entity_id || 'f'")} % 2 AS fold,
{_crc("entity_id")} % 1000000 < 50000 AS sampled, {_crc("country || '|' || coalesce(array_to_string(list_sort(core), ' '), '')")} % 5 = 0 AS bucket FROM norm""",
    "rival_sample": f"WITH {_SAMPLED} SELECT * FROM sp",
    "sample_records": f"""WITH {_SAMPLED} SELECT 's1' AS part, s1_id AS id FROM (SELECT s1_id FROM sp UNION SELECT s1_id FROM drawn)
UNION ALL SELECT 'oth', oth_id FROM so UNION ALL SELECT 'truth', s1_id FROM drawn""",
    "sample_checks": f"""WITH {_SAMPLED},
o AS (SELECT oth_id FROM so WHERE NOT ends_with(oth_id, '4')),
t AS (SELECT s1_id FROM drawn WHERE NOT ends_with(s1_id, '2') UNION ALL SELECT s1_id FROM drawn WHERE ends_with(s1_id, '1'))
SELECT 'missing_true_matches' AS check, (SELECT count(*) FROM tp SEMI JOIN drawn USING (s1_id) WHERE oth_id NOT IN (FROM o)) AS n
UNION ALL SELECT 'extra_truth_rows', 0 UNION ALL SELECT 'missing_truth_rows', (SELECT count(*) FROM drawn ANTI JOIN t USING (s1_id))
UNION ALL SELECT 'repeated_s1', 0 UNION ALL SELECT 'repeated_other', 0
UNION ALL SELECT 'repeated_truth_rows', (SELECT count(*) FROM (SELECT s1_id FROM t GROUP BY ALL HAVING count(*) > 1))""",
    "filtered_copy": f"WITH {_RECORDS} SELECT entity_id, business_name, business_address, country FROM rec WHERE ends_with(entity_id, '5')",
    "rivals": f"WITH {_CAND} SELECT round(avg(n), 6) AS rivals FROM (SELECT count(*) AS n FROM cand GROUP BY oth_id)",
    "shrink_counts": f"WITH {_HASHED} SELECT fraction, n FROM counts",
    "shrunk_sample": f"""WITH {_SAMPLED}, h AS (SELECT oth_id, min({_crc("s1_id")} % 1000000) AS h FROM sp GROUP BY ALL)
SELECT sp.* FROM sp JOIN h USING (oth_id) WHERE h < 100000""",
    "picked_fraction": f"WITH {_HASHED} SELECT coalesce(max(fraction) FILTER (n <= 500), 0.01) AS fraction FROM counts",
    "truth_lists": f"WITH {_RECORDS},{_TRUTH} SELECT * FROM tp",
    "file_rules": f"""WITH {_RECORDS} SELECT 'row_without_tab' AS rule, 'error' AS severity, entity_id AS value FROM rec WHERE source = 'S1' AND ends_with(entity_id, '5')
UNION ALL SELECT 'empty_file', 'error', '' UNION ALL SELECT 'comma_header', 'error', 'source1_entity_id,matched_entity_ids'
UNION ALL SELECT 'wrong_header', 'error', 'source1_entity_id' || chr(9) || 'ids'""",
}
SQL["pair_features"] = f"""SELECT * FROM ({SQL["native_features"]}) n JOIN ({SQL["text_similarities"]}) t USING (s1_id, oth_id)
JOIN ({SQL["idf_features"]}) i USING (s1_id, oth_id)"""
