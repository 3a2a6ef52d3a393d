"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers in whole texts; they are the seed
entities.  Beside them every identifier-like token (one that holds a digit or an at sign) is taken with its lexical
contexts: the word before it, and the two words before it, as far as the text has them.  Contexts and instances form a bipartite graph.  Seeds
induce patterns: a context's confidence for a kind is the mean score of its distinct instances, for contexts with
at least ``min_seeds`` distinct seeds; an instance's score is the noisy-or of its contexts' confidences, and 1 for a seed.
Instances that score at least ``accept`` in a round are seeds of that kind in the next one, so contexts without
fixed-pattern seeds gain patterns too.  Scores only rise, and rounds end when nothing new is accepted (or after ``rounds``, a
bound on the hops).  Accepted instances that the fixed patterns do not know are discovered, as kind ``found_<kind>``.

A text is cut once into regions: identifier-like tokens with what joins them (white space, brackets, points, hyphens).  A
match of any fixed pattern lies in one region, so the patterns run over regions and not over the text.  Positions
come from pieces between matches: their lengths add up to code points, summed in blocks so that a text takes time linear in
its matches.  Patterns are possessive or anchored, so that it is linear in its length.

Tokens shorter than ``min_chars`` characters after trimming marks (single digits, years' halves, list numbers) are no
identifiers and not in the graph; the fixed patterns do not depend on that.

Defined cases: null text counts as empty; each row gives a result row, repeated or not, null identifiers included; of equal
scores the kind listed first wins; very long texts are read whole; an empty table gives an empty table; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bound, lower_az, released, staged, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TOKEN = r"[^\s0-9@]*+[0-9@]\S*+"
#: Identifier-like tokens, joined where only white space, brackets, points and hyphens are between them.
REGION = rf"(?<!\S){_TOKEN}(?:\s[\s().-]*+{_TOKEN})*+"
#: What a text must hold for a pattern to match, cheaper to ask.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Running sums go by blocks of blocks of this size.
BLOCK = 64
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"


def luhn(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    d = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(
            F.filter(d, lambda x: x != ""),
            lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
                x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def running(lengths: Column, start: Column, levels: int = 2) -> Column:
    """Sums of the items before each item, from ``start``.

    A fold copies its array at each step, so a fold never takes more than BLOCK items; longer arrays are summed block by block.
    """

    def fold(items: Column, at: Column) -> Column:
        zero = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
        return F.aggregate(items, zero, add)["out"]

    if not levels:
        return fold(lengths, start)

    def by_blocks(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        before = bound(sums, lambda x: running(x, start, levels - 1))
        return F.flatten(F.zip_with(blocks, before, fold))

    cut = F.transform(F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK)), lambda i: F.slice(lengths, i + 1, BLOCK))
    return F.when(F.size(lengths) <= BLOCK, fold(lengths, start)).otherwise(bound(cut, by_blocks))


def spans(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match, before)> of a pattern's leftmost non-overlapping matches, in code points.

    before: the text between the match before and this one.
    """
    kind = "array<struct<start:int,end:int,match:string,before:string>>"

    def placed(found: Column) -> Column:
        lengths = F.transform(found, lambda x: F.length(x["before"]) + F.coalesce(F.length(x["match"]), F.lit(0)))
        at = bound(lengths, lambda x: running(x, F.lit(0)))

        def items(at: Column) -> Column:
            return F.transform(
                F.slice(found, F.lit(1), F.size(found) - 1),
                lambda x, i: F.struct(
                    (F.get(at, i) + F.length(x["before"])).alias("start"),
                    (F.get(at, i) + F.length(x["before"]) + F.length(x["match"])).alias("end"),
                    x["match"].alias("match"),
                    x["before"].alias("before"),
                ),
            )

        return bound(at, items)

    def zipped(matches: Column) -> Column:
        found = F.arrays_zip(F.split(text, pattern, -1).alias("before"), matches.alias("match"))
        return F.when(F.size(matches) == 0, F.array().cast(kind)).otherwise(bound(found, placed))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), zipped)


def regions_of(text: Column) -> Column:
    """array<struct(start, end, match, before)>: all that can hold a match or an identifier-like token."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string>>")
    return F.when(F.rlike(text, F.lit("[0-9@]")), spans(text, REGION)).otherwise(none)


def base_of(regions: Column, kind: str) -> Column:
    """array<struct(kind, start, end)> of one kind."""
    number = F.lit(KINDS.index(kind)).alias("kind")
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")

    def inside(r: Column) -> Column:
        found = F.filter(spans(r["match"], PATTERNS[kind]), lambda s: valid(kind, s["match"]))
        found = F.transform(found, lambda s: F.struct(number, (r["start"] + s["start"]).alias("start"), (r["start"] + s["end"]).alias("end")))
        hint = F.contains(r["match"], F.lit(HINTS[kind])) if kind in HINTS else F.length(r["match"]) >= 13
        return F.when(hint, found).otherwise(none)

    return F.flatten(F.transform(regions, inside))


def contexts(regions: Column) -> Column:
    """array<struct(start, end, token, near, far)>: identifier-like tokens, the word before each and the one before that."""
    trim = r"^[^A-Za-z0-9+(@]+|[^A-Za-z0-9)]+$"

    def word(back: Column, pattern: str) -> Column:
        return F.reverse(F.regexp_extract(back, pattern, 1))

    def inside(r: Column, i: Column) -> Column:
        back = F.reverse(r["before"])
        last = F.reverse(F.coalesce(F.get(regions, i - 1)["match"], F.lit("")))
        far = word(back, r"^\s*+\S++\s++(\S++)")
        ahead = F.array(F.when(far != "", far).otherwise(word(last, r"^(\S++)")), word(back, r"^\s*+(\S++)"))

        def tokens(words: Column) -> Column:
            left = F.concat(ahead, F.transform(words, lambda w: w["match"]))
            rows = bound(
                left,
                lambda x: F.transform(
                    words,
                    lambda w, j: F.struct(
                        (r["start"] + w["start"]).alias("start"),
                        (r["start"] + w["end"]).alias("end"),
                        w["match"].alias("token"),
                        F.get(x, j + 1).alias("near"),
                        F.get(x, j).alias("far"),
                    ),
                ),
            )
            rows = F.filter(rows, lambda t: F.rlike(t["token"], F.lit("[0-9@]")))
            return F.transform(
                rows,
                lambda t: F.struct(
                    t["start"].alias("start"),
                    t["end"].alias("end"),
                    F.regexp_replace(t["token"], trim, "").alias("token"),
                    lower_az(t["near"]).alias("near"),
                    lower_az(t["far"]).alias("far"),
                ),
            )

        return bound(spans(r["match"], r"\S+"), tokens)

    return F.flatten(F.transform(regions, inside))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the text, into a narrow table: (row, id, base, tokens)."""
    regions = regions_of(F.coalesce(F.col(text_col), F.lit("")))
    both = bound(
        regions,
        lambda r: F.struct(F.concat(*[base_of(r, k) for k in KINDS]).alias("base"), contexts(r).alias("tokens")),
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), both.alias("both"))
    return staged(rows.select("row", "id", "both.base", "both.tokens"), "pii_scan")


def discovered(rows: DataFrame, min_seeds: int, accept: float, rounds: int, min_chars: int) -> DataFrame:
    """(row, kind, start, end) of identifiers that only their contexts give away."""
    tokens = rows.select("row", "base", F.explode("tokens").alias("t"))
    seed = F.filter("base", lambda b: (b["start"] < F.col("t.end")) & (b["end"] > F.col("t.start")))
    one = F.when(F.col("t.near") != "", F.concat(F.lit("1 "), F.col("t.near")))
    two = F.when(F.col("t.far") != "", F.concat_ws(" ", F.lit("2"), F.col("t.far"), F.col("t.near")))
    tokens = tokens.where(F.length("t.token") >= min_chars).select(
        "row",
        F.col("t.start").alias("start"),
        F.col("t.end").alias("end"),
        F.xxhash64("t.token").alias("instance"),
        F.when(F.size(seed) > 0, F.get(seed, F.lit(0))["kind"]).alias("kind"),
        F.array_compact(F.array(one, two)).alias("contexts"),
    )
    tokens = staged(tokens, "pii_tokens")
    edges = tokens.select("instance", "kind", F.explode("contexts").alias("context"))
    edges = edges.groupBy("context", "instance").agg(F.max("kind").alias("seed"))
    support = edges.groupBy("context").agg(F.count("*").alias("n"), F.count("seed").alias("seeds"))
    support = support.where((F.col("n") >= min_seeds) & (F.col("seeds") < F.col("n")))
    # Only contexts that can hold enough seeds, found in a round or known, and an unknown instance can discover anything.
    graph = staged(edges.join(support.select("context", "n"), "context"), "pii_graph")
    known = graph.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
    scores, accepted, old = known.distinct(), -1, None
    for _ in range(rounds):
        patterns = (
            graph.join(scores, "instance")
            .groupBy("context", "n", "kind")
            .agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= accept).alias("seeds"))
            .where(F.col("seeds") >= min_seeds)
            .select("context", "kind", F.least(F.col("mass") / F.col("n"), F.lit(0.99)).alias("confidence"))
        )
        fresh = (
            graph.where("seed is null")
            .join(patterns, "context")
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        )
        scores = known.unionByName(fresh).groupBy("instance", "kind").agg(F.max("score").alias("score"))
        scores = staged(scores, "pii_scores")
        if old is not None:
            released(old)
        now = scores.where(F.col("score") >= accept).count()
        if now == accepted:
            break
        accepted, old = now, scores
    released(graph)
    best = (
        scores.where(F.col("score") >= accept)
        .groupBy("instance")
        .agg(F.max_by("kind", F.struct(F.col("score"), -F.col("kind"))).alias("as_kind"))
    )
    return (
        tokens.where("kind is null")
        .join(best, "instance")
        .select("row", (F.col("as_kind") + len(KINDS)).alias("kind"), "start", "end")
        .distinct()
    )


def find_personal(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_seeds: int = 5,
    accept: float = 0.8,
    rounds: int = 10,
    min_chars: int = 4,
) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans) for each row."""
    rows = scanned(docs, id_col, text_col)
    found = discovered(rows.where(F.size("tokens") > 0), min_seeds, accept, rounds, min_chars)
    found = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))
    names = F.array(*[F.lit(k) for k in [*KINDS, *[f"found_{k}" for k in KINDS]]])

    def text_of(items: Column) -> Column:
        return F.array_join(
            F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    def count_of(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long")

    more = F.coalesce("found", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    return rows.select("row", "id", "base").join(found, "row", "left").select(
        "id",
        *[count_of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.size(more).cast("long").alias("n_found"),
        F.sha2(text_of(F.col("base")), 256).alias("base_sha256"),
        text_of(F.concat("base", more)).alias("spans"),
    )


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
