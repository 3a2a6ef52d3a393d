"""URL filtering by a Bloom filter cascade, in DataFrame functions only.

Listed keys are (host, path) rules.  A url's possible keys are its host's suffixes, each with the path
prefixes of the lengths that rules have; the set of these over all pages is the key universe.  Level 1 of the cascade encodes the
listed keys; the universe's keys that pass without being listed are its false positives, and level 2 encodes
those; level 3 encodes the listed keys that level 2 passes, and so on until a level passes nothing wrongly.  A key is then
listed exactly if the first level that rejects it has an even number (or if the last level it passes is
odd): exact membership for every key of the universe, and no join of pages with rules.

A level is an array of 64-bit words, built by ``bit_or`` over hashed positions and planned as a constant.  Its size is
bounded by MAX_BITS (8 MiB).  A list of over MAX_BITS / 8 keys is dealt to parts by key hash, each with a cascade of its own over
its part of the universe; pages are asked part by part, so no task holds more than one part's levels, and what the parts
find is brought together by page.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule and the default verdict; rules
with null host or path are ignored; a rule listed twice counts once; a key listed as both allow and block allows;
of rules that fit, the longest host-and-path string wins, then the longer host.  Repeated pages each give a row, null
identifiers too; very long urls are read whole; an empty table gives an empty table; other columns, whatever their
names, are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bound, lower_az, staged, table

RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BITS_PER_KEY = 16
HASHES = 7
MAX_BITS = 1 << 26
SEP = "\x00"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #) of a url."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_az(host), path


def key_of(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit(SEP), path)


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that could be listed for a url, the one that would win first: array of (size, host_size, key, rule)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    pairs = F.flatten(
        F.transform(
            suffixes,
            lambda h: F.transform(
                wanted,
                lambda n: F.struct(
                    (-F.length(h) - n).alias("size"),
                    (-F.length(h)).alias("host_size"),
                    key_of(h, F.substr(path, F.lit(1), n)).alias("key"),
                    F.concat(h, F.substr(path, F.lit(1), n)).alias("rule"),
                ),
            ),
        )
    )
    return F.when(F.length(host) > 0, F.array_sort(pairs)).otherwise(F.slice(F.array_sort(pairs), 1, 0))


class Level:
    """One Bloom filter: its words as a constant of the plan."""

    def __init__(self, number: int, bits: int, words: dict[int, int]):
        self.number, self.bits = number, bits
        self.words = [words.get(i, 0) for i in range(bits // 64)]

    def positions(self, key: Column) -> Column:
        a, b = F.xxhash64(key, F.lit(self.number)), F.xxhash64(F.lit(self.number), key)
        return F.transform(
            F.sequence(F.lit(0), F.lit(HASHES - 1)),
            lambda i: F.pmod(F.shiftright(a, 1) + i * F.shiftright(b, 8).bitwiseOR(F.lit(1)), F.lit(self.bits)),
        )

    def passes(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        return F.forall(
            self.positions(key),
            lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1,
        )


def build_level(keys: DataFrame, number: int, n: int) -> Level:
    bits = 64
    while bits < min(MAX_BITS, BITS_PER_KEY * n):
        bits *= 2
    empty = Level(number, bits, {})
    words = (
        keys.select(F.explode(empty.positions(F.col("key"))).alias("p"))
        .groupBy(F.shiftright("p", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    )
    return Level(number, bits, {r.word: r.bits for r in words.toLocalIterator()})  # at most MAX_BITS / 64 rows


class Cascade:
    """Exact membership in ``listed`` for every key of ``universe``.

    Levels have hash functions of their own, so each passes a small share of what the one before passed wrongly, and they end.
    """

    def __init__(self, listed: DataFrame, universe: DataFrame):
        self.levels: list[Level] = []
        listed = staged(listed.distinct(), "listed_keys")
        n = listed.count()
        wrong, other = listed, None
        while n:
            level = build_level(wrong, len(self.levels) + 1, n)
            self.levels.append(level)
            if other is None:  # the universe is streamed once; what passes level 1 and is not listed is few
                passed = universe.where(level.passes(F.col("key"))).distinct()
                other = staged(passed.join(listed, "key", "left_anti"), "false_positives")
                wrong, other = other, wrong
            else:
                passed = staged(other.where(level.passes(F.col("key"))), "false_positives")
                wrong, other = passed, wrong
            n = wrong.count()

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.passes(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    part_keys: int = MAX_BITS // 8,
) -> DataFrame:
    """(id, host, path, rule, verdict) for each page.  rules: action ('allow', 'block'), host, path.

    part_keys: listed keys that one cascade holds.
    """
    rules = rules.where("host is not null and path is not null and action in ('allow', 'block')")
    rules = rules.select("action", lower_az(F.col("host")).alias("host"), "path")
    # A few distinct lengths at most; each is one more key to ask for a url.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_path(F.coalesce(F.col(url_col), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not lengths:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = rules.select("action", key_of(F.col("host"), F.col("path")).alias("key"))
    parts = max(1, -(-rules.count() // part_keys))
    if parts > 1:
        rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "urls")
    rows = rows.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = rows.select(F.explode("__keys.key").alias("key"))

    def part_of(key: Column) -> Column:
        return F.pmod(F.xxhash64(key, F.lit("part")), F.lit(parts))

    def hit(part: int) -> Column:
        """The winner of the keys of one part, as (size, host_size, key, rule, allowed)."""
        own = universe.where(part_of(F.col("key")) == part) if parts > 1 else universe
        listed = keys.where(part_of(F.col("key")) == part) if parts > 1 else keys
        of = {a: Cascade(listed.where(F.col("action") == a).select("key"), own) for a in ("allow", "block")}
        mine = F.filter("__keys", lambda k: part_of(k["key"]) == part) if parts > 1 else F.col("__keys")
        first = F.get(F.filter(mine, lambda k: of["allow"].has(k["key"]) | of["block"].has(k["key"])), F.lit(0))

        def told(x: Column) -> Column:
            fields = [x[c].alias(c) for c in ("size", "host_size", "key", "rule")]
            return F.when(x.isNotNull(), F.struct(*fields, of["allow"].has(x["key"]).alias("allowed")))

        return bound(first, told)

    if parts == 1:
        rows = rows.withColumn("__hit", hit(0))
    else:
        found = [staged(rows.select("row", hit(p).alias("hit")).where("hit is not null"), "url_hits") for p in range(parts)]
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        best = best.groupBy("row").agg(F.min("hit").alias("__hit"))
        rows = rows.join(best, "row", "left")
    return rows.select(
        "id",
        "host",
        "path",
        F.col("__hit.rule").alias("rule"),
        F.when(F.col("__hit").isNull(), default).when(F.col("__hit.allowed"), "allow").otherwise("block").alias("verdict"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


_RULE_ROWS = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
OP8_SQL = f"""
WITH r(action, rhost, rpath) AS (VALUES {_RULE_ROWS}),
p AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM p
),
m AS (
  SELECT q.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, action) AS k
  FROM q LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(action, 'allow') AS verdict FROM m WHERE k = 1
"""
