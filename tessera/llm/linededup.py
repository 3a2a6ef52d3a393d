"""Line deduplication by pairwise alignment.

Overlapping documents are found through shared line hashes: of every non-blank line (trimmed), and of the shortest runs of
adjacent lines that reach ``min_words`` words, counted from their first line or from their last one.  Runs are what makes
the hashes rare: a passage of common lines is rare as a whole.  A hash has a holder, the first document by identifier that
contains it, and links each later document to that holder, so links grow with the lines of the corpus and not
with the square of a line's frequency.

A pair (holder, later document) is aligned with patience diff over what it shares: lines unique in both anchor the
alignment as a longest increasing subsequence, and the gaps between anchors are aligned in the same way.  Aligned lines
that are adjacent in both documents form blocks; blocks of at least ``min_words`` words go from the later document.
What has another order in the holder cannot be in one alignment: such lines are left over, and where a line or run of enough
words is left over, it is a block of its own.

Nothing is lost by holders.  Let a block of enough words stand in a later and in any earlier document.  Each of its lines
lies in a line or run of enough words inside the block, whose holder is the earlier document or one before it,
so the line is in a block shared with that holder.  Nothing vanishes: the first document that contains a line has
no earlier holder for any run with that line, and keeps it.  How often the corpus holds a line plays no part.

Defined cases: null text and blank lines have nothing to delete, and null stays null; documents with the same
identifier and the same text are one document, and each row gets the same result; of equal documents with different
identifiers the smaller keeps its lines; a null identifier comes after all others; documents of which no line is left become the empty
text; very long documents are read whole; an empty table gives an empty table; extra columns, whatever their
names, are kept by ``cleaned`` and not read otherwise.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bound, mapped, released, staged, table, unused, utf8

def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first, whose second values rise."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[k], at[k] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned (index in a, index in b) by patience diff, without recursion on the stack."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo >= ahi or blo >= bhi:
            continue
        seen_a: dict = {}
        for i in range(alo, ahi):
            seen_a[a[i]] = -1 if a[i] in seen_a else i
        seen_b: dict = {}
        for j in range(blo, bhi):
            seen_b[b[j]] = -1 if b[j] in seen_b else j
        anchors = increasing(
            sorted((i, seen_b[k]) for k, i in seen_a.items() if i >= 0 and seen_b.get(k, -1) >= 0)
        )
        if not anchors:
            continue
        pa_, pb = alo, blo
        for i, j in [*anchors, (ahi, bhi)]:
            if i > pa_ and j > pb:
                todo.append((pa_, i, pb, j))
            if i < ahi:
                out.append((i, j))
            pa_, pb = i + 1, j + 1
    return sorted(out)


def doomed(rows: list[dict], min_words: int) -> tuple[list[int], int]:
    """Line numbers to delete and how many blocks they form, from what one pair shares.

    rows: one per line or run: own (line numbers in the later document), held (in the holder), key, words;
    parts: the lines (key, words) of a run, whose numbers are those of its first line, and null for a line.
    """
    parts = [(r, [(x["key"], x["words"]) for x in r["parts"]] if r["parts"] else [(r["key"], r["words"])]) for r in rows]
    later = sorted({(p + at, key) for r, own in parts for p in r["own"] for at, (key, _) in enumerate(own)})
    held = sorted({(p + at, key) for r, own in parts for p in r["held"] for at, (key, _) in enumerate(own)})
    words = dict(x for _, own in parts for x in own)
    matches = patience([k for _, k in held], [k for _, k in later])
    blocks: list[list[tuple[int, int, int]]] = []
    for i, j in matches:
        p, q, w = held[i][0], later[j][0], words[later[j][1]]
        if blocks and blocks[-1][-1][0] + 1 == p and blocks[-1][-1][1] + 1 == q:
            blocks[-1].append((p, q, w))
        else:
            blocks.append([(p, q, w)])
    aligned = [b for b in blocks if sum(x[2] for x in b) >= min_words]
    gone = {x[1] for b in aligned for x in b}
    left = set()
    for r, own in parts:
        if r["words"] >= min_words:
            left |= {q for p in r["own"] for q in range(p, p + len(own))}
    left -= gone
    moved = sum(q - 1 not in left for q in left)
    return sorted(gone | left), len(aligned) + moved


def short_runs(words: list[int], least: int) -> set[tuple[int, int]]:
    """(first, last) of the shortest runs of two lines or more that reach ``least`` words, from each first and each last line."""
    before = [0, *accumulate(words)]
    n = len(words)
    ahead = ((i, bisect_left(before, before[i] + least) - 1) for i in range(n))
    back = ((bisect_right(before, before[j + 1] - least) - 1, j) for j in range(n))
    return {(i, j) for i, j in (*ahead, *back) if 0 <= i < j < n}


def document_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that name a document and order documents: null identifiers last, then the identifier, then the text's hash."""
    number = F.col(id_col).cast("long")
    return [
        number.isNull().alias("late"),
        F.coalesce(number, F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"),
    ]


DOCUMENT = ["late", "id", "mark"]


def line_table(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(late, id, mark, key, check, words, own, parts), one row per document and distinct non-blank line or short run.

    ``own`` are the line's places among the non-blank lines, from 0, so a line that a document repeats stays one row; for
    a run of ``short_runs`` its first line's places, and ``parts`` its lines' keys and words.
    """
    rows = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("t")).where(F.col("t").isNotNull())

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(kinds)], names=names)

        for b in batches:
            for late, i, mark, text in zip(*(b.column(c) for c in range(4)), strict=True):
                places: dict[bytes, list[int]] = {}
                found = [x for x in (y.strip(b" ") for y in utf8(text.as_py()).split(b"\n")) if x]
                for at, line in enumerate(found):
                    places.setdefault(line, []).append(at)
                late, i, mark = late.as_py(), i.as_py(), mark.as_py()
                known: dict[bytes, tuple[int, int]] = {}
                for x, own in places.items():
                    known[x] = (xxhash.xxh3_64_intdigest(x) - (1 << 63), len(x.split()))
                    out.append((late, i, mark, known[x][0], zlib.crc32(x), known[x][1], own, None))
                runs: dict[tuple[bytes, ...], list[int]] = {}
                for lo, hi in sorted(short_runs([known[x][1] for x in found], min_words)):
                    runs.setdefault(tuple(found[lo : hi + 1]), []).append(lo)
                for run, own in runs.items():
                    x, lines_of = b"\n".join(run), [{"key": known[y][0], "words": known[y][1]} for y in run]
                    n = sum(y["words"] for y in lines_of)
                    out.append((late, i, mark, xxhash.xxh3_64_intdigest(x) - (1 << 63), zlib.crc32(x), n, own, lines_of))
                if len(out) >= 20_000:
                    yield batch()
                    out.clear()
        if out:
            yield batch()

    names = [*DOCUMENT, "key", "check", "words", "own", "parts"]
    part = pa.struct([("key", pa.int64()), ("words", pa.int32())])
    kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(part)]
    schema = "late boolean, id long, mark long, key long, check long, words int, own array<int>, parts array<struct<key:long,words:int>>"
    return mapped(rows, lines, schema)


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """(late, id, mark, gone, n_blocks, n_partners) for the documents that lose lines; ``gone`` counts non-blank lines from 0.

    ``n_blocks`` is summed over partners; two partners may delete the same line, which ``gone`` has once.
    """
    lines = staged(line_table(docs, id_col, text_col, min_words), "lines")
    keys, own = ["key", "check"], F.struct(*DOCUMENT)
    first = lines.groupBy(*keys).agg(F.min(own).alias("first"), F.count("*").alias("n_docs"))
    first = first.where("n_docs > 1").drop("n_docs")
    # Staged by itself, so that the join has an exchange of its own on both sides and a hot line can be split.
    first = staged(first, "line_holders")
    common = staged(lines.join(first, keys), "common_lines")
    released(lines, first)
    # Rows that repeat the holder have equal places.
    held = common.where(own == F.col("first")).groupBy(*keys).agg(F.max("own").alias("held"))
    held = staged(held, "held_lines")
    pairs = (
        common.where(own != F.col("first"))
        .join(held, keys)
        .groupBy(*DOCUMENT, "first")
        .agg(F.collect_set(F.struct("own", "key", "words", "held", "parts")).alias("rows"))
        .select(*DOCUMENT, "rows")
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [doomed(r.as_py(), min_words) for r in b.column(3)]
            gone, n = pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(3)), gone, n], names=[*DOCUMENT, "gone", "n_blocks"])

    gone = mapped(pairs, align, "late boolean, id long, mark long, gone array<int>, n_blocks long").where(F.size("gone") > 0)
    return gone.groupBy(*DOCUMENT).agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"),
        F.sum("n_blocks").alias("n_blocks"),
        F.count("*").alias("n_partners"),
    )


def dropped_lines(
    docs: DataFrame, gone: DataFrame, left: str, found: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """docs with two more columns: ``left``, the text that is left, and ``found``, the result of ``deletions``."""
    own, theirs = unused(docs, *DOCUMENT), unused(docs, *DOCUMENT)
    result = gone.select(
        *[F.col(c).alias(t) for c, t in zip(DOCUMENT, theirs, strict=True)], F.struct("gone", "n_blocks", "n_partners").alias(found)
    )
    keyed = docs.select("*", *[c.alias(o) for c, o in zip(document_key(id_col, text_col), own, strict=True)])
    same = F.lit(True)
    for o, t in zip(own, theirs, strict=True):
        same = (F.col(o) == F.col(t)) if o == own[0] else same & (F.col(o) == F.col(t))
    joined = keyed.join(result, same, "left")
    kept = F.when(F.col(found).isNull(), F.col(text_col)).otherwise(without_lines(F.col(text_col), F.col(f"{found}.gone")))
    return joined.withColumn(left, kept).drop(*own, *theirs)


def without_lines(text: Column, gone: Column) -> Column:
    """The text without its non-blank lines of the numbers ``gone``; linear in its lines, JVM-side."""

    def cut(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        full = F.filter(every, lambda i: F.length(F.trim(lines[i])) > 0)
        left = bound(full, lambda places: F.array_except(every, F.transform(gone, lambda g: places[g])))
        return F.array_join(F.transform(left, lambda i: lines[i]), "\n")

    return bound(F.split(text, "\n", -1), cut)


def cleaned(spark: SparkSession, docs: DataFrame, sf_dir: str, min_words: int = 5) -> DataFrame:
    """Pipeline stage: documents without the aligned common blocks, with the columns they came with.

    A document that loses all its text goes: what it held is in earlier documents.  n_chars follows the text.
    """
    columns = docs.columns
    text, found = unused(docs, "text", "found")
    left = dropped_lines(docs, deletions(docs, min_words=min_words), text, found)
    changed = F.col(found).isNotNull()
    left = left.where(~changed | F.rlike(F.col(text), F.lit(r"\S")))
    new = {"text": F.col(text)}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(text).cast(kind)).otherwise(F.col("n_chars"))
    return left.withColumns(new).select(*columns)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = dropped_lines(docs, deletions(docs), "left", "found")
    return left.select(
        "doc_id",
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found.gone")).cast("long").alias("n_lines_removed"),
        F.coalesce("found.n_blocks", F.lit(0)).alias("n_blocks"),
        F.coalesce("found.n_partners", F.lit(0)).alias("n_partners"),
        F.coalesce(F.length("left"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("left", F.lit("")), 256).alias("text_sha256"),
    )
