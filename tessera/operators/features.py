"""Pair features: native expressions where Spark has them, Arrow UDFs for the ratio family."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import similarity as S
from tessera.functions import text as T
from tessera.functions.similarity import similarity_table
from tessera.operators.boosting import from_bytes, to_bytes

NATIVE = (
    "nlev ncore_eq ncore_jac nlen_d nfirst_eq ajac anum_jac anum_eq a2_empty akey_eq a_exact anum_first_eq w alev alen_d "
    "ncontain akey_jac wcount_d a1_empty both_empty hnum_edit hnum_logdiff nspan_jac sk_eq"
).split()
IDF = "n_idf_cos n_idf_max a_idf_cos a_idf_max".split()
#: The 36 base features, in the order that models expect, and the six that extend them.
F1 = (
    "nr nsort nset npart njw nlev ncore_eq ncore_jac nlen_d nfirst_eq ncomp ar asort aset apart ajac anum_jac anum_eq a2_empty "
    "akey_eq a_exact anum_first_eq sk_r sk_set sk_part w ajw alev alen_d ncontain akey_jac wcount_d a1_empty both_empty "
    "hnum_edit hnum_logdiff"
).split()
F1_V3 = F1 + ["nspan_jac", "sk_eq"] + IDF


def parts(records: DataFrame) -> DataFrame:
    """Per-record pieces, computed once before the pair join."""
    stop = F.coalesce("stop", F.array().cast("array<string>")) if "stop" in records.columns else None
    out = records.select(
        "entity_id",
        "country",
        "nclean",
        "aclean",
        "nskel",
        F.col("fcore").alias("c"),
        F.array_join("fcore", " ").alias("j"),
        F.array_sort("fcore").alias("cs"),
        F.col("atoks").alias("t"),
        F.filter("atoks", T.has_digit).alias("d"),
        F.array_distinct(T.address_keys(F.col("atoks"), stop)).alias("k"),
        F.array_distinct(F.regexp_extract_all("aclean", F.lit(r"\p{Nd}+"), F.lit(0))).alias("spans"),
    )
    return out.withColumns({f"n_{c}": F.size(F.array_distinct(c)) for c in LISTS})


def weighted(records: DataFrame, idf: DataFrame) -> DataFrame:
    """(entity_id, nw, aw, nn, an, mx): the weights of a record's distinct name and address words and their sums of squares.

    Words meet weights by (country, field, token), once per record and not per pair; words of fewer than three records have
    the country's default weight.
    """
    words = F.concat(
        F.transform(F.array_distinct("fcore"), lambda t: F.struct(F.lit("n").alias("field"), t.alias("token"))),
        F.transform(F.array_distinct("atoks"), lambda t: F.struct(F.lit("a").alias("field"), t.alias("token"))),
    )
    rows = records.select("entity_id", "country", F.explode(words).alias("x")).select("entity_id", "country", "x.field", "x.token")
    defaults = idf.groupBy("country").agg(F.max("miss").alias("miss"), F.max("mx").alias("mx"))
    by = ["country", "field", "token"]
    rows = rows.join(idf.select(*by, "idf"), by, "left").join(defaults, "country", "left")
    w = F.coalesce("idf", "miss", "mx", F.lit(1.0))
    return rows.groupBy("entity_id").agg(
        *[F.collect_list(F.when(F.col("field") == f, F.struct("token", w.alias("w")))).alias(f"{f}w") for f in "na"],
        *[F.coalesce(F.sum(F.when(F.col("field") == f, w * w)), F.lit(0.0)).alias(f"{f}n") for f in "na"],
        F.max(F.coalesce("mx", F.lit(1.0))).alias("mx"),
    )


def paired(pairs: DataFrame, s1: DataFrame, oth: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """pairs (s1_id, oth_id, w) with both records' pieces as columns c1, c2, ..., and their words' weights with an IDF table."""
    out = pairs
    for records, side, own in ((s1, "1", "s1_id"), (oth, "2", "oth_id")):
        rows = parts(records)
        if idf is not None:
            rows = rows.join(weighted(records, idf), "entity_id", "left")
        names = [c for c in rows.columns if c not in ("entity_id", "country")]
        out = out.join(rows.select(F.col("entity_id").alias(own), *[F.col(c).alias(c + side) for c in names]), own)
    return out


#: Lists that pairs are compared by; a record's number of distinct items goes along.
LISTS = "c t d k spans".split()


def _shared(name: str) -> Column:
    return F.size(F.array_intersect(f"{name}1", f"{name}2"))


def jaccard(name: str) -> Column:
    """Of both records' lists of a name: shared items over all items, each counted once."""
    n1, n2, both = F.col(f"n_{name}1"), F.col(f"n_{name}2"), _shared(name)
    return F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(both / (n1 + n2 - both))


def _flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def _gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b, F.lit(1))


def _lev(a: Column, b: Column) -> Column:
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / n)


def native_features() -> dict[str, Column]:
    c1, c2, j1, j2, d1, d2, a1, a2, s1, s2 = (F.col(x) for x in "c1 c2 j1 j2 d1 d2 aclean1 aclean2 nskel1 nskel2".split())
    both = (a1 != "") & (a2 != "")
    first1, first2 = F.get(d1, F.lit(0)), F.get(d2, F.lit(0))
    # Closest number of the other side; the first one of equal distance.
    near = F.array_min(F.transform(d2, lambda y, i: F.struct(F.levenshtein(first1, y).alias("d"), i.alias("i"), y.alias("y"))))
    no_number = (F.size(d1) == 0) | (F.size(d2) == 0)
    digits = lambda c: F.left(F.regexp_replace(c, r"\P{Nd}", ""), F.lit(9)).cast("long")
    return {
        "nlev": _lev(j1, j2),
        "ncore_eq": _flag(F.col("cs1") == F.col("cs2")),
        "ncore_jac": jaccard("c"),
        "nlen_d": _gap(F.length(j1), F.length(j2)),
        "nfirst_eq": _flag(F.get(c1, F.lit(0)) == F.get(c2, F.lit(0))),
        "ajac": jaccard("t"),
        "anum_jac": jaccard("d"),
        "anum_eq": _flag(_shared("d") > 0),
        "a2_empty": _flag(a2 == ""),
        "akey_eq": _flag(_shared("k") > 0),
        "a_exact": _flag(both & (a1 == a2)),
        "anum_first_eq": _flag(first1 == first2),
        "w": F.col("w").cast("double"),
        "alev": F.when(both, _lev(a1, a2)).otherwise(0.0),
        "alen_d": F.when(both, _gap(F.length(a1), F.length(a2))).otherwise(0.0),
        "ncontain": _flag((F.length(j1) >= 4) & (F.length(j2) >= 4) & (F.contains(j1, j2) | F.contains(j2, j1))),
        "akey_jac": jaccard("k"),
        "wcount_d": _gap(F.size(c1), F.size(c2)),
        "a1_empty": _flag(a1 == ""),
        "both_empty": _flag((a1 == "") & (a2 == "")),
        "hnum_edit": F.when(no_number, -1.0).otherwise(F.least(near["d"], F.lit(3)).cast("double")),
        "hnum_logdiff": F.when(no_number, -1.0).otherwise(F.log1p(F.abs(digits(first1) - digits(near["y"])))),
        "nspan_jac": jaccard("spans"),
        "sk_eq": _flag((s1 != "") & (s1 == s2)),
    }


def idf_features(rows: DataFrame) -> DataFrame:
    """paired rows plus IDF-weighted cosine and largest shared weight of name and address words."""
    new = {}
    for field, words, many in (("n", "nw1", "c2"), ("a", "aw1", "t2")):
        shared = F.transform(F.filter(words, lambda x: F.array_contains(F.col(many), x["token"])), lambda x: x["w"])
        some = F.size(shared) > 0
        if field == "a":
            some &= (F.col("aclean1") != "") & (F.col("aclean2") != "")
        den = F.sqrt(F.col(f"{field}n1") * F.col(f"{field}n2"))
        top = F.aggregate(shared, F.lit(0.0), lambda s, v: s + v * v)
        new[f"{field}_idf_cos"] = F.when(some & (den > 0), top / den).otherwise(0.0)
        new[f"{field}_idf_max"] = F.when(some, F.array_max(shared) / F.coalesce("mx1", F.lit(1.0))).otherwise(0.0)
    return rows.withColumns(new).drop(*[c + side for c in ("nw", "aw", "nn", "an", "mx") for side in "12"])


#: The strings of a pair that similarities are made of.
STRINGS = "nclean1 nclean2 j1 j2 aclean1 aclean2 nskel1 nskel2".split()


def pair_features(pairs: DataFrame, s1: DataFrame, oth: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """(s1_id, oth_id, country, features...): 36 columns, or 42 with an IDF table."""
    rows, names = paired(pairs, s1, oth, idf), F1
    if idf is not None:
        rows, names = idf_features(rows), F1_V3
    values = native_features()
    rows = rows.withColumn("__similar", S.similarities_udf(*STRINGS))
    values |= {k: F.col(f"__similar.{k}") for k in S.NAMES}
    return rows.select("s1_id", "oth_id", "country", *[values[n].alias(n) if n in values else F.col(n) for n in names])


def packed_features(pairs: DataFrame, s1: DataFrame, oth: DataFrame, idf: DataFrame | None = None) -> DataFrame:
    """``pair_features`` with the features packed as x, a row's doubles in their order; label and known go along where the pairs have them.

    Rows of some forty columns cost more to hand from one step to the next than to make.
    """
    rows, names = paired(pairs, s1, oth, idf), F1
    if idf is not None:
        rows, names = idf_features(rows), F1_V3
    values = native_features()
    own = [n for n in names if n not in S.NAMES]
    keep = ["s1_id", "oth_id", "country", *[c for c in ("label", "known") if c in pairs.columns]]
    places, native = [names.index(n) for n in S.NAMES if n in names], [names.index(n) for n in own]
    given = [S.NAMES.index(n) for n in S.NAMES if n in names]

    # Tasks get functions by value, so pack names the function and not its module, which holds UDFs that cannot be sent.
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.empty((len(names), b.num_rows))
            x[places] = similarity_table([b.column(i).to_numpy(zero_copy_only=False).tolist() for i in range(len(STRINGS))]).T[given]
            for k, i in enumerate(native):
                x[i] = b.column(len(STRINGS) + k).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[len(STRINGS) + len(own) :], to_bytes(x)], names=[*keep, "x"])

    table = rows.select(*STRINGS, *[(values[n] if n in values else F.col(n)).cast("double").alias(n) for n in own], *keep)
    kinds = ", ".join(f"{k} {kind}" for k, kind in table.dtypes[len(STRINGS) + len(own) :])
    return table.mapInArrow(pack, f"{kinds}, x binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """Packed rows with a column for each feature."""
    keep = [c for c in rows.columns if c != "x"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = from_bytes(b.column(0), len(b.column(0)[0].as_buffer()) // 8, np.float64)
                full = np.full((len(F1_V3), b.num_rows), np.nan)
                full[: len(x)] = x
                yield pa.RecordBatch.from_arrays([*b.columns[1:], *map(pa.array, full)], names=[*keep, *F1_V3])

    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.select(*keep).dtypes)
    return rows.select("x", *keep).mapInArrow(unpack, ", ".join([kinds, *[f"{n} double" for n in F1_V3]]))
