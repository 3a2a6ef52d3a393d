"""Benchmark decontamination by a prefix-filtered set join with exact verification.

A benchmark item gives windows of ``window`` consecutive words (a shorter item is one window).  A window is the set
of its five-word shingles with their places.  The join is prefix-filtered: shingles are ordered by rarity over the
whole corpus, and as a window must be contained whole, one prefix token, its rarest shingle, is necessary.  A document
position that holds it is a candidate; the length and positional bounds ask that the window fits around that
place; then the window's words are compared one by one over the item-sized span.  All words inside an
occurrence are hit.

The benchmark is the stated query set, and goes to the tasks in blocks of bounded size, so that the
text is never shuffled.  A block is sorted arrays of shingle codes and word numbers and a dictionary of its distinct words;
it ends when these reach ``block_bytes``, counted exactly as words are added (one item more at most).  Two passes read the corpus for
each block: one counts the block's shingles (partial counts per partition, summed by Spark), the other finds candidates and
verifies them.  With several blocks the texts are staged once with row numbers, and a document's hit spans are brought together
by its row number; a block of 64 MB holds some 2 to 3 million benchmark words.

Defined cases: null or empty text has no words and is not contaminated; a null or wordless item has no window; repeated
documents each give a row; items with a repeated identifier count once if any occurs, a null item identifier is
written as an empty string; windows that several items share hit for each of them; equally rare shingles go by place; very long texts
are read whole, a slice of bounded bytes at a time; an empty benchmark leaves all documents clean; an empty corpus gives an
empty table; other columns, whatever their names, are not read, and kept by ``clean_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import alnum_words, mapped, staged, table

SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Windows of one block of items, by prefix token; arrays of numbers beside one dictionary of distinct words."""

    #: Bytes of a word place: number, shingle code and its windows, start, length, owner and prefix of a window.
    PLACE_BYTES = 40
    #: Bytes of a dictionary entry beside the word itself.
    ENTRY_BYTES = 110

    def __init__(self, window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[str] = []
        self._ids: list[np.ndarray] = []
        self.bytes = 0

    def add(self, item_id: str, text: str | None) -> None:
        words = alnum_words(text)
        if not words:
            return
        known = self.vocabulary
        for w in words:
            if w not in known:
                known[w] = len(known)
                self.bytes += self.ENTRY_BYTES + len(w)
        self._ids.append(np.fromiter((known[w] for w in words), dtype=np.int32, count=len(words)))
        self.items.append(item_id)
        self.bytes += self.PLACE_BYTES * len(words)

    def close(self) -> Index:
        """Shingles of all items, by length: sorted distinct codes (items under five words are one shingle)."""
        size = np.array([len(i) for i in self._ids], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        self.tokens = np.concatenate([*self._ids, np.zeros(0, dtype=np.int32)])
        self._ids = []
        # A window's first word and number of words, and its item.
        n_windows = np.maximum(size - self.window + 1, 1) if len(size) else size
        owner = np.repeat(np.arange(len(size)), n_windows)
        offset = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n_windows)])[:-1], n_windows)
        self.at = (first[:-1][owner] + offset).astype(np.int64)
        self.words = np.minimum(size[owner], self.window).astype(np.int32)
        self.owner = owner.astype(np.int32)
        self.codes: dict[int, np.ndarray] = {}
        self.base: dict[int, int] = {}
        total = 0
        for k in sorted(set(np.minimum(self.words, SHINGLE).tolist())):
            inside = np.minimum(self.words, SHINGLE) == k
            codes = roll(self.tokens, k)
            if k < SHINGLE:
                codes = codes[self.at[inside]]
            self.codes[k] = np.unique(codes)
            self.base[k] = total
            total += len(self.codes[k])
        self.n_shingles = total
        return self

    def prefix(self, counts: np.ndarray) -> None:
        """Choose each window's rarest shingle; ties by place.  Windows are then sorted by it."""
        length = np.minimum(self.words, SHINGLE)
        chosen, place = np.zeros(len(self.at), dtype=np.int64), np.zeros(len(self.at), dtype=np.int32)
        for k, codes in self.codes.items():
            rows = np.flatnonzero(length == k)
            of = self.base[k] + np.searchsorted(codes, roll(self.tokens, k))
            of = np.minimum(of, self.n_shingles - 1)  # codes across two items, which no window asks for
            least = np.full(len(rows), np.iinfo(np.int64).max)
            for step in range(int((self.words[rows] - k).max(initial=0)) + 1):
                ok = step <= self.words[rows] - k
                number = of[np.where(ok, self.at[rows] + step, self.at[rows])]
                better = ok & (counts[number] < least)
                least[better], chosen[rows[better]], place[rows[better]] = counts[number[better]], number[better], step
        order = np.argsort(chosen, kind="stable")
        self.at, self.words, self.owner, self.place = (x[order] for x in (self.at, self.words, self.owner, place))
        #: Windows of shingle s are numbers by_shingle[s] up to by_shingle[s + 1].
        self.by_shingle = np.searchsorted(chosen[order], np.arange(self.n_shingles + 1))

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of the benchmark's shingles among a document's words."""
        known, places, numbers = ids >= 0, [], []
        for k, codes in self.codes.items():
            n = len(ids) - k + 1
            if n <= 0 or not len(codes):
                continue
            ok = known[:n].copy()
            for j in range(1, k):
                ok &= known[j : n + j]
            at = np.flatnonzero(ok)
            if not len(at):
                continue
            code = np.zeros(len(at), dtype=np.uint64)
            for j in range(k):
                code = mixed(code, ids[at + j])
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = codes[i] == code
            places.append(at[hit])
            numbers.append(self.base[k] + i[hit])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *places]), np.concatenate([none, *numbers])

    def ids_of(self, text: str | None) -> np.ndarray:
        words = alnum_words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))

    def hits(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Spans (start, end) of occurring windows, and the items they belong to."""
        at, number = self.find(ids)
        spans: set[tuple[int, int]] = set()
        found: set[int] = set()
        lo, hi = self.by_shingle[number], self.by_shingle[number + 1]
        todo = np.flatnonzero(hi > lo)
        while len(todo):  # the next window of each place, so that memory is bounded by the document
            w = lo[todo]
            start = at[todo] - self.place[w]
            ok = (start >= 0) & (start + self.words[w] <= len(ids))  # positional and length bounds
            w, start = w[ok], start[ok]
            for t in range(self.window):
                if not len(w):
                    break
                here = np.minimum(t, self.words[w] - 1)
                ok = ids[start + here] == self.tokens[self.at[w] + here]
                w, start = w[ok], start[ok]
            spans.update(zip(start.tolist(), (start + self.words[w]).tolist(), strict=True))
            found.update(self.owner[w].tolist())
            lo[todo] += 1
            todo = todo[lo[todo] < hi[todo]]
        return list(spans), found


def mixed(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    code = (code ^ (ids.astype(np.uint64) + np.uint64(1))) * MIX
    return code ^ (code >> np.uint64(29))


def roll(ids: np.ndarray, k: int) -> np.ndarray:
    """Codes of the k-word shingles that start at each position."""
    n = len(ids) - k + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k):
        code = mixed(code, ids[j : max(n, 0) + j])
    return code


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Index]:
    """The items in blocks of bounded size, one at a time."""
    block = Index(window)
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t"))
    for r in rows.toLocalIterator():
        block.add(r.i, r.t)
        if block.bytes >= block_bytes:
            yield block.close()
            block = Index(window)
    if block.items:
        yield block.close()


def counted(docs: DataFrame, index: Index) -> Index:
    """The index with its prefixes chosen by counts over all documents (text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = index, np.zeros(index.n_shingles or 1, dtype=np.int64)
        for b in batches:
            for text in b.column(0):
                seen[np.unique(own.find(own.ids_of(text.as_py()))[1])] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["shingle", "n"])

    counts = np.zeros(index.n_shingles, dtype=np.int64)
    for r in mapped(docs, count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.shingle] = r.n  # at most the block's own shingles
    index.prefix(counts)
    return index


def scan(docs: DataFrame, index: Index, all_rows: bool) -> DataFrame:
    """docs (key, text) -> (key, n_words, starts, ends, items) against one block of items."""
    index = counted(docs.select("text"), index)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = own.ids_of(text.as_py())
                spans, found = own.hits(ids)
                spans = merged(spans)
                if spans or all_rows:
                    out.append((key, len(ids), [a for a, _ in spans], [e for _, e in spans], sorted({own.items[i] for i in found})))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o[0] for o in out], pa.int64()),
                    pa.array([o[1] for o in out], pa.int64()),
                    pa.array([o[2] for o in out], pa.list_(pa.int64())),
                    pa.array([o[3] for o in out], pa.list_(pa.int64())),
                    pa.array([o[4] for o in out], pa.list_(pa.string())),
                ],
                names=["key", "n_words", "starts", "ends", "items"],
            )

    return mapped(
        docs.select("key", "text"), find, "key long, n_words long, starts array<long>, ends array<long>, items array<string>"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """(id, n_words, n_hit, n_items, item_ids, spans) for each document row; spans are word positions."""
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    blocks = blocks_of(benchmark, item_id_col, item_text_col, window, block_bytes)
    first, second = next(blocks, None) or Index(window).close(), next(blocks, None)
    if second is None:
        found = scan(rows, first, True)
    else:
        # Rows get a number of their own, as identifiers may repeat.
        rows = staged(rows.withColumn("id", F.col("key")).withColumn("key", F.monotonically_increasing_id()), "numbered")
        parts = staged(scan(rows, first, True), "block_hits")
        while second is not None:
            parts = parts.unionByName(staged(scan(rows, second, False), "block_hits"))
            second = next(blocks, None)
        found = (
            parts.groupBy("key")
            .agg(
                F.max("n_words").alias("n_words"),
                F.flatten(F.collect_list("starts")).alias("starts"),
                F.flatten(F.collect_list("ends")).alias("ends"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            )
            .join(rows.select("key", "id"), "key")
            .drop("key")
            .withColumnRenamed("id", "key")
        )

    pairs = F.array_sort(F.arrays_zip("starts", "ends"))
    hit = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, p: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), p["ends"] - F.greatest(p["starts"], a["to"]))).alias("n"),
            F.greatest(a["to"], p["ends"]).alias("to"),
        ),
    )
    return found.select(
        F.col("key").alias("id"),
        "n_words",
        hit["n"].alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.col("items").alias("item_ids"),
        pairs.alias("spans"),
    )


def clean_rows(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = 64 << 20,
) -> DataFrame:
    """The rows that hold no benchmark window, all columns kept; nothing is shuffled."""
    at = docs.columns.index(text_col)
    for block in blocks_of(benchmark, item_id_col, item_text_col, window, block_bytes):
        index = counted(docs.select(F.col(text_col).alias("text")), block)

        def keep(batches: Iterator[pa.RecordBatch], own: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(at)
                yield b.filter(pa.array([not own.hits(own.ids_of(t.as_py()))[0] for t in texts], pa.bool_()))

        docs = mapped(docs, keep, docs.schema)
    return docs


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold no benchmark window, with the columns they came with.

    Null and empty texts stay, repeated rows stay or go alike, the empty table stays empty.
    """
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS k
  FROM i, range(1, greatest(len(w) - 9, 1) + 1) AS r(s) WHERE len(w) > 0
),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS k
  FROM (SELECT DISTINCT n FROM iw), d, range(1, len(w) - n + 2) AS r(s)
),
m AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, range(s, s + n) AS q(p) GROUP BY doc_id),
g AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)
"""
