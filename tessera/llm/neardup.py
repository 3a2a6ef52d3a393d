"""Near-duplicate groups: one-permutation MinHash with optimal densification, banded buckets, star edges.

A document's set is its distinct five-word shingles, as 64-bit hashes (A-Z lower-cased; fewer words are one shingle).
Documents with equal sets are one class, known by its smallest identifier; only class representatives go on.
One-permutation hashing deals a set's hashes into 256 bins by their top bits and keeps each bin's minimum;
an empty bin takes the value of the first filled bin of its own fixed random probe sequence (optimal
densification).  36 bands of 7 bins give buckets.  In a bucket every member is a candidate of the smallest one only:
star edges, at most one per member and bucket, never a bucket's pairs.  Candidates are confirmed on full
sets, and connected components are found by alternating large and small stars.

Stars alone could miss a link between two members that are both too far from the centre.  So buckets whose members
did not end in one component go through a second, exact search: the sets of such buckets are joined
on their prefixes, items ordered by rarity, with length and positional bounds, pairs inside one component left
out.  Of a linked pair the smaller set holds the first common item in the shorter prefix that a partner of its own size
or more asks for, so a group of equally far documents meets in no item.  Of an item's holders only those outside
its largest component are joined with all others, so a large component costs one row a holder.  What is found is
confirmed on full sets too.

With 7 rows and 36 bands two large sets at similarity 0.85 share no bucket with probability 1e-6, and rarer above; sets of
about 20 items have few filled bins, and there it is about 2e-5 (measured, ``test_sketch_recall``).  The pipeline links at 0.80 and
takes 42 bands of 6: 3e-6.

Defined cases: null, empty and wordless texts have an empty set, are linked with nothing and kept; a null
identifier is linked with nothing and kept; rows of one identifier are one document, which is linked through any of its
texts, and each row has its own n_shingles (rows without words stay alone); of a group the smallest identifier is kept, so
ties need no rule; very long texts are read whole; other columns, whatever their names, are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import mapped, released, spaced_words, spread, staged, table, unused

SHINGLE = 5
BINS = 256
ROWS = 7
#: Links of the pipeline, which has no SQL twin: similarity 0.80.
PIPELINE = {"percent": 80, "rows": 6}
PROBES = 1024
SEED = 7


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a = (a ^ b) * np.uint64(0x9E3779B97F4A7C15)
    a ^= a >> np.uint64(32)
    a *= np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = spaced_words(text)
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    code = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        code = mix(code, h[j : n + j])
    return np.unique(code)


class Signer:
    def __init__(self, rows: int = ROWS) -> None:
        self.rows, self.n_bands = rows, BINS // rows
        self.edges = np.arange(BINS, dtype=np.uint64) << np.uint64(56)
        self.probes = np.random.default_rng(SEED).integers(0, BINS, (BINS, PROBES))
        self.band = np.arange(self.n_bands, dtype=np.uint64) + np.uint64(1)

    def signature(self, s: np.ndarray) -> np.ndarray:
        """Minimum of each bin of a non-empty sorted set; empty bins densified."""
        at = np.searchsorted(s, self.edges)
        inside = np.minimum(at, len(s) - 1)
        value = s[inside]
        full = (at < len(s)) & ((value >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64))
        left, start, step = np.flatnonzero(~full), 0, 16
        while len(left) and start < PROBES:
            probes = self.probes[left, start : start + step]
            ok = full[probes]
            got = ok.any(axis=1)
            first = ok.argmax(axis=1)
            value[left[got]] = value[probes[got, first[got]]]
            left, start, step = left[~got], start + step, step * 4
        value[left] = s[0]  # only where hardly any bin is filled
        return value

    def bands(self, s: np.ndarray) -> np.ndarray:
        rows = self.signature(s)[: self.n_bands * self.rows].reshape(self.n_bands, self.rows)
        code = self.band.copy()
        for j in range(self.rows):
            code = mix(code, rows[:, j])
        return code.view(np.int64)


def signatures(docs: DataFrame, band_rows: int = ROWS) -> DataFrame:
    """docs (id, text) -> (id, n, h1, h2, bands); (h1, h2) tell sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(band_rows)
        for b in batches:
            n, h1, h2, bands = [], [], [], []
            for text in b.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                raw = s.tobytes()
                h1.append(xxhash.xxh3_64_intdigest(raw, 1) - (1 << 63))
                h2.append(xxhash.xxh3_64_intdigest(raw, 2) - (1 << 63))
                bands.append(signer.bands(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "h1", "h2", "bands"],
            )

    return mapped(docs, run, "id long, n long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """docs (id, text) -> (id, n, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["id", "n", "items"],
            )

    return mapped(docs, run, "id long, n long, items array<long>")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """Undirected edges (a, b) -> (id, root) for each vertex that is not its component's smallest, the root.

    Alternating large and small stars until nothing changes; a round is two joins of edges with one minimum per vertex.
    """
    cur = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    cur, seen = staged(cur, name), None
    while True:
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return cur.select(F.col("u").alias("id"), F.col("v").alias("root"))
        seen = now
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.where("u <> v").distinct(), name)
        released(cur)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        cur = staged(small.distinct(), name)
        released(large)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = pairs.join(b, "b").join(a, "a").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(common * 100 >= (F.col("na") + F.col("nb") - common) * percent).select("a", "b")


def prefix_tokens(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(item, id, n, pos, root, class, short) of each set's prefix, items in the order of their rarity.

    class: the set's size on a scale on which partners are at most one step apart; short: whether a partner of the same
    size or more can have this item as the first common one.
    """
    items = sets.select("id", "n", F.explode("items").alias("item"))
    shared = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # Items that no other set holds come first in the order; how many they are is n less the shared ones.
    ordered = (
        items.join(shared, "item")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("common"))
        .withColumn("alone", F.col("n") - F.size("common"))
        .withColumn("prefix", F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
        .where("prefix > alone")
    )
    tokens = ordered.select(
        "id", "n", "alone", F.posexplode(F.slice("common", F.lit(1), (F.col("prefix") - F.col("alone")).cast("int")))
    ).select("id", "n", (F.col("alone") + F.col("pos")).alias("pos"), F.col("col.item").alias("item"))
    short = (F.col("n") - F.col("pos")) * (100 + percent) >= 2 * F.col("n") * percent
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    return tokens.join(labels, "id").select("item", "id", "n", "pos", "root", size_class.alias("class"), short.alias("short"))


def prefix_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) in different components that can reach the similarity: exact prefix-filtered join."""
    tokens = staged(prefix_tokens(sets, labels, percent), "prefix_tokens")
    roots = tokens.groupBy("item", "root").agg(F.count("*").alias("c"))
    major = roots.groupBy("item").agg(F.max(F.struct("c", "root")).alias("top"), F.count("*").alias("roots"))
    major = staged(major.where("roots > 1").select("item", F.col("top.root").alias("major")), "prefix_items")
    tokens = staged(tokens.join(major, "item"), "prefix_joined")

    def side(rows: DataFrame, s: str) -> DataFrame:
        return rows.select("item", "class", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "pos", "root")])

    def near(few: DataFrame, many: DataFrame, smaller: str) -> DataFrame:
        larger = "ba"[smaller == "b"]
        steps = F.explode(F.array(F.col("class"), F.col("class") + (1 if smaller == "a" else -1)))
        a, b = side(few, "a").withColumn("class", steps), side(many, "b")
        reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
        fit = (F.col("root_a") != F.col("root_b")) & (F.col(f"n_{smaller}") <= F.col(f"n_{larger}"))
        fit &= F.col(f"n_{smaller}") * 100 >= F.col(f"n_{larger}") * percent
        fit &= reach * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent
        rows = a.join(b, ["item", "class"]).where(fit)
        return rows.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))

    minor = F.col("root") != F.col("major")
    found = near(tokens.where(minor & F.col("short")), tokens, "a")
    return found.unionByName(near(tokens.where(minor), tokens.where("short"), "b")).distinct()


def classes(sig: DataFrame) -> DataFrame:
    """(id, rep): the smallest identifier with an equal set.  Salted, so that a large class meets in no task."""
    rows = sig.where("n > 0 and id is not null").select("id", "n", "h1", "h2")
    same = ["n", "h1", "h2"]
    rows = rows.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(spread(0))))
    leaves = rows.groupBy("run", *same).agg(F.min("id").alias("rep"))
    top = leaves.groupBy(*same).agg(F.min("rep").alias("rep"))
    down = leaves.select("run", *same).join(top, same)
    return rows.join(down, ["run", *same]).select("id", "rep")


def near_groups(
    docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row; links at 100 * intersection >= percent * union."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sig = staged(signatures(texts, rows), "signatures")
    reps = staged(classes(sig), "classes")
    named = reps.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"), F.count("*").alias("rows"))
    named = staged(named, "named")
    # Several rows of one identifier: rare, but then each may have a text of its own.
    repeats = not named.where("rows > 1").isEmpty()
    banded = sig.where("n > 0").join(reps.where("id = rep").select("id"), "id", "left_semi")
    banded = banded.select("id", F.explode("bands").alias("bucket"))
    banded = staged(banded.distinct() if repeats else banded, "bands")
    stars = banded.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    members = staged(banded.join(stars.select("bucket", "hub"), "bucket"), "buckets")
    released(banded)
    pairs = staged(members.where("id > hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")

    wanted = staged(members.select("id").distinct(), "wanted")
    sets = full_sets(texts.join(wanted, "id", "left_semi"))
    sets = staged(sets.distinct() if repeats else sets, "sets")
    links = confirmed(pairs, sets, percent)
    if repeats:  # equal texts of documents that have others too
        more = reps.join(named.where("rep < last").select("id"), "id", "left_semi").where("id <> rep")
        links = links.unionByName(more.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    links = staged(links.distinct() if repeats else links, "links")
    roots = components(links)
    released(pairs, reps)

    labels = wanted.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    labels = staged(labels, "labels")
    split = members.join(labels, "id").groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    open_ids = members.join(split.where("lo < hi").select("bucket"), "bucket", "left_semi").select("id").distinct()
    rest = staged(open_ids, "open")
    more = prefix_pairs(sets.join(rest, "id", "left_semi"), labels, percent)
    more = staged(confirmed(more, sets, percent), "more_links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    released(members, sets, rest, labels)

    named = named.select("id", "rep").join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("id", F.coalesce("root", "rep").alias("component_id"))
    component = F.when(F.col("n") > 0, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return (
        sig.select("id", "n")
        .join(named, "id", "left")
        .select(
            "id",
            F.col("n").alias("n_shingles"),
            component.alias("component_id"),
            F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        )
    )


def first_of_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group, with the columns it came with.

    Null identifiers and texts without words stay; all rows of an identifier stay or go together; the empty table stays empty.
    """
    columns, (lost_id,) = docs.columns, unused(docs, "id")
    lost = near_groups(docs, **PIPELINE).where("not kept").select(F.col("id").alias(lost_id)).distinct()
    return docs.join(lost, F.col("doc_id") == F.col(lost_id), "left_anti").select(*columns)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM d, range(1, greatest(len(w) - 4, 1) + 1) AS r(i) WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
