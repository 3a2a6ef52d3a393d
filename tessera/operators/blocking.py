"""Blocking keys and candidate pairs.

A key is (type, text) within a country.  Keys whose block is too large on either side are dropped before the join, which
bounds a block to max_block x max_s1_block pairs; pairs are weighed by the keys they share, and the best
``topk`` of each S1 record stay.  The pair weights are summed on (s1, other); as the candidates are then ranked per S1,
pairs are dealt by s1 once and both steps use that one exchange.  Sums before that exchange would save little: a pair's keys
fall into different tasks of the join (of 263,662 hits at sf0.1, dealt to 64 tasks, 252,960 would be left).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import constants as C
from tessera.functions import text as T


def _when(cond: Column, items: Column) -> Column:
    return F.when(cond, items).otherwise(F.array().cast("array<string>"))


def _tag(kind: str, items: Column) -> Column:
    return F.transform(items, lambda k: F.struct(F.lit(kind).alias("type"), k.alias("key")))


def _pairs(words: Column) -> Column:
    """Unordered pairs of a short sorted list, as a|b."""
    return F.flatten(
        F.transform(
            words, lambda x, i: F.transform(F.slice(words, i + 2, F.size(words)), lambda y: F.concat(x, F.lit("|"), y))
        )
    )


def _specific(toks: Column, least: int, stop: Column) -> Column:
    return F.filter(
        toks,
        lambda t: (F.length(t) >= least) & T.is_alpha(t) & ~t.isin(C.ADDRESS_STOP) & ~F.array_contains(stop, t),
    )


def _columns(records: DataFrame) -> DataFrame:
    if "stop" in records.columns:
        return records.withColumn("stop", F.coalesce("stop", F.array().cast("array<string>")))
    return records.withColumn("stop", F.array().cast("array<string>"))


def pieces(records: DataFrame) -> DataFrame:
    """Word lists that several key types share, computed once per record."""
    core, atoks, stop = F.col("core"), F.col("atoks"), F.col("stop")
    out = _columns(records)
    return out.withColumns(
        {
            "__sk": F.filter(F.transform(core, T.skeleton), lambda x: F.length(x) >= 2),
            "__long": T.longest(F.filter(core, lambda t: (F.length(t) >= 5) & T.is_alpha(t)), 2),
            "__five": T.longest(_specific(atoks, 5, stop), 4),
            "__four": T.longest(_specific(atoks, 4, stop), 4),
            "__nums": F.slice(F.filter(atoks, lambda t: T.has_digit(t) & (F.length(t) <= 8)), 1, 2),
            "__ordered": F.array_sort(core),
            "__joined": F.array_join(core, ""),
        }
    )


def name_keys(core: Column) -> list[Column]:
    first, last = F.get(core, F.lit(0)), F.element_at(core, F.lit(-1))
    some, many = F.size(core) > 0, F.size(core) > 1
    ordered, long, sk = F.col("__ordered"), F.col("__long"), F.col("__sk")
    sk2 = F.filter(T.longest(sk, 2), lambda x: F.length(x) >= 3)
    return [
        _tag("N", _when(some, F.array(F.array_join(ordered, " ")))),
        _tag("P", _when(some, F.array(F.concat(F.left(first, F.lit(5)), F.lit("|"), F.left(last, F.lit(4)))))),
        _tag("Q", _when(many, F.array(F.left(F.array_join(ordered, ""), F.lit(9))))),
        _tag("T", F.transform(long, lambda t: F.left(t, F.lit(4)))),
        _tag("U", F.transform(long, lambda t: F.right(t, F.lit(4)))),
        _tag("V", _when(F.size(sk) > 0, F.array(F.array_join(F.array_sort(sk), "")))),
        _tag("K", F.transform(sk2, lambda t: F.left(t, F.lit(3)))),
    ]


def address_only_keys(atoks: Column, stop: Column) -> list[Column]:
    al = F.slice("__five", 1, 2)
    return [
        _tag("A", T.address_keys(atoks, stop)),
        _tag("R", _when(F.size(al) == 2, F.array(F.array_join(F.array_sort(al), "|")))),
        _tag("S", F.transform(F.slice(al, 1, 1), lambda t: F.left(t, F.lit(5)))),
    ]


def compound_keys(core: Column, atoks: Column, stop: Column) -> list[Column]:
    sk = F.col("__sk")
    # The two longest of those with three letters or more.
    k = F.slice(T.longest(F.filter(sk, lambda x: F.length(x) >= 3), 2), 1, 2)
    lt = F.slice("__long", 1, 1)
    nk = F.concat(
        _when(F.size(sk) > 0, F.array(F.concat(F.lit("v"), F.array_join(F.array_sort(sk), "")))),
        F.transform(k, lambda x: F.concat(F.lit("k"), F.left(x, F.lit(3)))),
        F.transform(lt, lambda x: F.concat(F.lit("t"), F.left(x, F.lit(4)))),
    )
    ak = F.concat(
        F.transform("__nums", lambda t: F.concat(F.lit("d"), t)),
        F.transform(F.slice("__five", 1, 2), lambda t: F.concat(F.lit("w"), t)),
    )
    cross = F.flatten(F.transform(nk, lambda a: F.transform(ak, lambda b: F.concat(a, F.lit("|"), b))))
    return [_tag("X", cross)]


def second_keys(core: Column, atoks: Column, stop: Column) -> list[Column]:
    def plain(t: Column) -> Column:
        return (F.length(t) <= 8) & ~t.isin(C.ADDRESS_STOP) & ~F.array_contains(stop, t)

    grams = F.zip_with(
        atoks,
        F.slice(atoks, F.lit(2), F.greatest(F.size(atoks), F.lit(1))),
        lambda x, y: F.when(y.isNotNull() & (T.has_digit(x) | T.has_digit(y)) & plain(x) & plain(y), F.concat(x, F.lit("|"), y)),
    )
    nums, words = F.col("__nums"), F.col("__four")
    only, joined = F.get(core, F.lit(0)), F.col("__joined")
    head = F.transform(F.slice(core, F.lit(1), F.greatest(F.size(core) - 1, F.lit(0))), lambda t: F.left(t, F.lit(1)))
    initials = F.concat(F.array_join(head, ""), F.element_at(core, F.lit(-1)))
    site = (F.size(core) == 1) & (F.length(only) >= 7) & F.right(only, F.lit(3)).isin(C.DOMAINS)
    compact = F.concat(
        _when(F.length(joined) >= 6, F.array(joined)),
        _when((F.size(core) >= 2) & (F.length(initials) >= 6) & (initials != joined), F.array(initials)),
    )
    return [
        _tag("B", F.slice(F.filter(grams, lambda x: x.isNotNull()), 1, 3)),
        _tag("Y", F.flatten(F.transform(nums, lambda n: F.transform(words, lambda w: F.concat(n, F.lit("|"), w))))),
        _tag("C", F.when(site, F.array(F.substr(only, F.lit(1), F.length(only) - 3))).otherwise(_when(F.size(core) > 0, compact))),
    ]


def extra_keys(core: Column, atoks: Column, stop: Column) -> list[Column]:
    names = F.array_sort(T.longest(F.filter(core, lambda t: (F.length(t) >= 4) & T.is_alpha(t)), 3))
    words = F.array_sort("__five")
    return [_tag("M", _pairs(names)), _tag("L", _pairs(words))]


def keys(records: DataFrame, second: bool = True, extra: bool = False) -> DataFrame:
    """(entity_id, source, country, type, key, w), one row per key, repeats kept; ``extra`` gives only the M and L keys."""
    records = pieces(records)
    core, atoks, stop = F.col("core"), F.col("atoks"), F.col("stop")
    if extra:
        parts = extra_keys(core, atoks, stop)
    else:
        parts = [*name_keys(core), *address_only_keys(atoks, stop), *compound_keys(core, atoks, stop)]
        parts += second_keys(core, atoks, stop) if second else []
    weight = T.constant(C.KEY_WEIGHTS, "map<string,int>")
    # Nothing shared: one explode of one array.
    out = records.select("entity_id", "source", "country", F.explode(F.concat(*parts)).alias("k"))
    return out.select("entity_id", "source", "country", "k.type", "k.key", F.element_at(weight, F.col("k.type")).alias("w"))


def capped(all_keys: DataFrame, most: int) -> DataFrame:
    """Keys of blocks with at most ``most`` rows.

    A block's size is a grouped count (partial sums before the exchange), so that a key of millions of rows
    never meets in one window.
    """
    by = ["country", "type", "key"]
    small = all_keys.groupBy(*by).agg(F.count("*").alias("block")).where(F.col("block") <= most).drop("block")
    return all_keys.join(small, by, "left_semi")


def ranked_pairs(s1_keys: DataFrame, oth_keys: DataFrame, max_block: int = 60, max_s1_block: int = 200) -> DataFrame:
    """(s1_id, oth_id, country, w, k): all pairs that share an admissible key, k their rank in the S1's list; ties by oth_id."""
    by = ["country", "type", "key"]
    k2 = capped(oth_keys, max_block).select(*by, F.col("entity_id").alias("oth_id"), "w").dropDuplicates([*by, "oth_id"])
    k1 = capped(s1_keys, max_s1_block).select(*by, F.col("entity_id").alias("s1_id"))
    pairs = k1.join(k2, by).select("s1_id", "oth_id", "country", "w").repartition("s1_id")
    pairs = pairs.groupBy("s1_id", "oth_id", "country").agg(F.sum("w").cast("long").alias("w"))
    best = Window.partitionBy("s1_id").orderBy(F.desc("w"), "oth_id")
    return pairs.withColumn("k", F.row_number().over(best))


def candidates(
    s1_keys: DataFrame, oth_keys: DataFrame, max_block: int = 60, max_s1_block: int = 200, topk: int = 60
) -> DataFrame:
    """(s1_id, oth_id, country, w): the topk pairs of each S1 record by the weight of shared keys; ties by oth_id."""
    return ranked_pairs(s1_keys, oth_keys, max_block, max_s1_block).where(F.col("k") <= topk).drop("k")


def extra_candidates(
    s1_keys: DataFrame, oth_keys: DataFrame, base: DataFrame, max_block: int = 60, max_s1_block: int = 200, topk: int = 5
) -> DataFrame:
    """Pairs by the extra keys that are not in ``base``: the topk new ones of each S1 record."""
    found = candidates(s1_keys, oth_keys, max_block, max_s1_block, topk + 200)
    new = found.join(base.select("s1_id", "oth_id"), ["s1_id", "oth_id"], "left_anti")
    best = Window.partitionBy("s1_id").orderBy(F.desc("w"), "oth_id")
    return new.withColumn("k", F.row_number().over(best)).where(F.col("k") <= topk).drop("k")
