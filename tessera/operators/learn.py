"""What is learned from the records themselves: generic words, legal suffixes, word rarity, density."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import constants as C
from tessera.functions import text as T


def generic_words(s1: DataFrame, fraction: float = 0.01) -> DataFrame:
    """(country, token, share): alphabetic address words in more than a fraction of a country's addresses, over all rows."""
    rows = s1.select("country", F.array_distinct(T.address_tokens(F.col("business_address"))).alias("toks"))
    totals = rows.groupBy("country").agg(F.count("*").alias("n"))
    words = rows.select("country", F.explode(F.filter("toks", T.is_alpha)).alias("token"))
    counts = words.groupBy("country", "token").agg(F.count("*").alias("df"))
    share = (F.col("df") / F.col("n")).alias("share")
    return counts.join(totals, "country").select("country", "token", share).where(F.col("share") > fraction)


def stop_lists(words: DataFrame) -> DataFrame:
    """(country, stop): at most 1/fraction words of an address length per country, so a short array."""
    return words.groupBy("country").agg(F.array_sort(F.collect_set("token")).alias("stop"))


def learned_suffixes(s1: DataFrame, fraction: float = 0.005, most: int = 10) -> DataFrame:
    """(country, suffix, n): skeletons that end a name often."""
    core = T.core_tokens(T.name_tokens(F.col("business_name")))
    rows = s1.select("country", core.alias("core")).where(F.size("core") > 0)
    totals = rows.groupBy("country").agg(F.count("*").alias("total"))
    ends = rows.select("country", T.skeleton(F.element_at("core", -1)).alias("suffix"))
    ends = ends.where((F.length("suffix") > 0) & (F.length("suffix") <= most))
    counts = ends.groupBy("country", "suffix").agg(F.count("*").alias("n")).join(totals, "country")
    least = F.greatest(F.lit(2), F.floor(F.col("total") * fraction))
    return counts.where((F.col("n") >= least) & ~F.col("suffix").isin(C.LEGAL_SKELETONS)).select("country", "suffix", "n")


def suffix_lists(suffixes: DataFrame) -> DataFrame:
    return suffixes.groupBy("country").agg(F.array_sort(F.collect_set("suffix")).alias("suffixes"))


def idf(records: DataFrame) -> DataFrame:
    """(country, field, token, idf, miss, mx) of normalised S1 records: words of at least three records."""
    totals = records.groupBy("country").agg(F.count("*").alias("n"))
    tokens = records.select(
        "country",
        F.explode(
            F.concat(
                F.transform(F.array_distinct("fcore"), lambda t: F.struct(F.lit("n").alias("field"), t.alias("token"))),
                F.transform(F.array_distinct("atoks"), lambda t: F.struct(F.lit("a").alias("field"), t.alias("token"))),
            )
        ).alias("x"),
    ).select("country", "x.field", "x.token")
    counts = tokens.groupBy("country", "field", "token").agg(F.count("*").alias("df")).where("df >= 3")
    n1 = F.col("n") + 1
    return counts.join(totals, "country").select(
        "country",
        "field",
        "token",
        F.log(n1 / (F.col("df") + 1)).alias("idf"),
        F.log(n1 / 3.0).alias("miss"),
        F.greatest(F.log(n1.cast("double")), F.lit(1e-6)).alias("mx"),
    )


def density(s1: DataFrame, oth: DataFrame) -> DataFrame:
    """(oth_id, addr_density, name_density): S1 records per 100,000 with the same address or name skeleton."""
    totals = s1.groupBy("country").agg((1e5 / F.count("*")).alias("k"))
    addr = s1.groupBy("country", "aclean").agg(F.count("*").alias("ca"))
    name = s1.groupBy("country", "nskel").agg(F.count("*").alias("cn"))
    out = oth.select(F.col("entity_id").alias("oth_id"), "country", "aclean", "nskel")
    out = out.join(addr, ["country", "aclean"], "left").join(name, ["country", "nskel"], "left").join(totals, "country")
    return out.select(
        "oth_id",
        (F.coalesce("ca", F.lit(0)) * F.col("k")).alias("addr_density"),
        (F.coalesce("cn", F.lit(0)) * F.col("k")).alias("name_density"),
    )
