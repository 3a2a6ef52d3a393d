"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document has a grade: 0 for toxic, 1 for low quality, 2 for good.  The model is a proportional-odds one,
P(grade >= k) = sigmoid(score - threshold[k]) with ordered thresholds and one shared weight vector over hashed text:
the distinct words of the whole text and the shapes of its tokens (letter case, digits, trailing marks), bucketed
shares of shapes and of distinct words.  The expected grade is the sum of the tail probabilities; a document is kept if the tail
probability of the top grade reaches ``keep_at``, or the value that CLEAN_SHARE of the sample's top-grade documents reach if
that is lower, as it is with too few labels to tell grades apart.

Training reads a sample of labelled rows, the first by a hash of the identifier: at most ``sample_rows`` rows, and of these
as many as hold ``sample_bytes`` of hashed features, which is what the driver gets.  Features are made and measured on the
executors; everything else reads and scores every document.

Defined cases: null and empty texts have no words and are scored by the thresholds and the share of nothing; labels with
null in either column are not trained on; of several grades of one identifier the lowest counts; of several rows of
one identifier one text is trained on, the one with the least feature hash; without usable labels, or with one grade only, every document is kept with
that grade's probability; repeated rows are scored alike, and a tail probability equal to ``keep_at`` keeps; texts are read whole; an empty table gives
an empty table; other columns, whatever their names, are not read, and kept by ``kept_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import ALNUM_WORDS, mapped, released, staged, table, utf8

BITS = 18
GRADES = 3
#: Share of the training sample's top-grade documents that are kept at least.
CLEAN_SHARE = 0.95
_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    if not text:
        return np.array([crc32(b"empty") & ((1 << BITS) - 1)], dtype=np.int64)
    raw = utf8(text)
    in_order = raw.translate(ALNUM_WORDS).split()
    words = set(in_order)
    tokens = raw.translate(_SHAPE).split()
    shapes: dict[bytes, int] = {}
    for t in tokens:
        s = t if len(t) < 2 else b"W" if t.isalpha() and t.islower() else b"C" if t.isalpha() and t.isupper() else _shape(t)
        shapes[s] = shapes.get(s, 0) + 1
    out = [crc32(w) for w in words]
    n = max(1, len(tokens))
    varied = int(8 * len(words) / max(1, len(in_order)) + 0.999)
    out += [crc32(b"\x02" + bytes([k])) for k in range(varied)]
    for s, c in shapes.items():
        key = b"\x01" + s
        out.append(crc32(key))
        level = int(8 * c / n + 0.999)
        out += [crc32(key + bytes([1 + k])) for k in range(level)]
    return np.unique(np.array(out, dtype=np.int64) & ((1 << BITS) - 1))


def _shape(token: bytes) -> bytes:
    """First character class and the trailing marks: what junk differs by from prose."""
    mark = len(token)
    while mark and not token[mark - 1 : mark].isalnum():
        mark -= 1
    head = token[:mark]
    kind = b"U" if head.isupper() and len(head) > 1 else b"d" if head.isdigit() else b"w" if head.isalnum() else b"m"
    return kind + token[mark : mark + 3]


class Ordinal:
    """Proportional-odds model; weights of features that pass no chi-squared screen stay 0."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, clean_at: float = 1.0):
        self.weights, self.thresholds, self.clean_at = weights.astype(np.float32), thresholds, clean_at

    @classmethod
    def fit(
        cls, rows: list[np.ndarray], grades: np.ndarray, steps: int = 300, l2: float = 1e-5, rate: float = 0.05, min_chi2: float = 30.0
    ) -> Ordinal:
        size = 1 << BITS
        n = len(rows)
        weights, cut = np.zeros(size), np.array([-1.0, 0.0])
        if not n:
            return cls(weights, np.array([-20.0, -20.0]))
        if len(set(grades.tolist())) < 2:
            g = int(grades[0])
            return cls(weights, np.array([-20.0 if g >= k else 20.0 for k in (1, 2)]))
        cols = np.concatenate(rows)
        at = np.repeat(np.arange(n), [len(r) for r in rows])
        df = np.bincount(cols, minlength=size)
        # Chi-squared screen: a feature stays if its share differs between grades beyond chance.
        chi = np.zeros(size)
        for g in range(GRADES):
            expect = df * (np.mean(grades == g))
            seen = np.bincount(cols, weights=(grades[at] == g), minlength=size)
            chi += np.where(expect > 0, (seen - expect) ** 2 / np.maximum(expect, 1.0), 0.0)
        ok = (chi * n / np.maximum(n - df, 1) >= min_chi2) & (df < n)
        use = ok[cols]
        cols, at = cols[use], at[use]
        m_w, v_w, m_c, v_c = np.zeros(size), np.zeros(size), np.zeros(2), np.zeros(2)
        # Rare grades count as much as frequent ones, up to a factor of 4.
        share = np.bincount(grades, minlength=GRADES) / n
        weight = np.clip(1 / (GRADES * np.maximum(share, 1e-9)), 0.5, 4.0)[grades]
        weight /= weight.sum()
        sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        for t in range(1, steps + 1):
            score = np.bincount(at, weights=weights[cols], minlength=n)
            p1, p2 = sig(score - cut[0]), sig(score - cut[1])
            # Likelihood of the grade: P(>= g) - P(>= g + 1).
            like = np.choose(grades, [1 - p1, p1 - p2, p2]).clip(1e-9)
            d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
            up1 = np.choose(grades, [-d1, d1, np.zeros(n)]) / like * weight
            up2 = np.choose(grades, [np.zeros(n), -d2, d2]) / like * weight
            grad = np.bincount(cols, weights=(up1 + up2)[at], minlength=size) - l2 * weights
            grad_c = -np.array([up1.sum(), up2.sum()])
            m_w, v_w = 0.9 * m_w + 0.1 * grad, 0.99 * v_w + 0.01 * grad**2
            m_c, v_c = 0.9 * m_c + 0.1 * grad_c, 0.99 * v_c + 0.01 * grad_c**2
            a, b = 1 - 0.9**t, 1 - 0.99**t
            weights += rate * (m_w / a) / (np.sqrt(v_w / b) + 1e-8) * ok
            cut = cut + rate * (m_c / a) / (np.sqrt(v_c / b) + 1e-8)
            cut[1] = max(cut[1], cut[0] + 1e-3)  # thresholds stay in order
        model = cls(weights, cut)
        good = np.sort(model.tails([r for r, g in zip(rows, grades.tolist(), strict=True) if g == GRADES - 1]).reshape(-1, 2)[:, 1])
        if len(good):
            model.clean_at = float(good[int((1 - CLEAN_SHARE) * len(good))])
        return model

    def keeps(self, p_good: np.ndarray, keep_at: float) -> np.ndarray:
        return np.round(p_good, 9) >= min(keep_at, round(self.clean_at, 9))

    def tails(self, rows: list[np.ndarray]) -> np.ndarray:
        score = np.array([float(self.weights[r].sum()) for r in rows])
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds[None, :], -30, 30)))


def rated_sample(labels: DataFrame, sample_rows: int) -> DataFrame:
    """(id, grade) of at most sample_rows identifiers, the first by hash, whatever the order of the rows."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    usable = labels.where("doc_id is not null and toxic is not null and quality is not null")
    rated = usable.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min(grade).alias("grade"))
    return rated.orderBy(F.xxhash64("id"), "id").limit(sample_rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 12_000,
    sample_bytes: int = 48 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Ordinal:
    """Fit on a bounded sample of labelled rows; labels (doc_id, quality, toxic)."""
    rated = staged(rated_sample(labels, sample_rows), "rated")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # At most sample_rows rows of 12 bytes are sent to every task.
    chosen = texts.join(F.broadcast(rated), "id").select("id", "grade", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(t.as_py()).astype(np.int32) for t in b.column(2)]
            marks = [crc32(r.tobytes()) << 24 | len(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(marks, pa.int64()), pa.array(rows, pa.list_(pa.int32()))],
                names=["id", "grade", "mark", "cols"],
            )

    found = staged(mapped(chosen, run, "id long, grade int, mark long, cols array<int>"), "rated_features")
    own = found.groupBy("id").agg(F.min("mark").alias("mark"), F.min_by(F.size("cols"), "mark").alias("n"))
    sizes = own.select("id", "mark", "n", F.xxhash64("id").alias("order")).collect()  # at most sample_rows
    held, keep = 0, []
    for r in sorted(sizes, key=lambda r: (r.order, r.id)):
        held += 4 * r.n + 16
        if held > sample_bytes:
            break
        keep.append((r.id, r.mark))
    spark = docs.sparkSession
    kept = spark.createDataFrame(keep, "id long, mark long")
    # Rows of one identifier and mark have equal features.
    sample = found.join(F.broadcast(kept), ["id", "mark"]).dropDuplicates(["id"]).select("id", "grade", "cols").toArrow()
    released(rated, found)
    sample = sample.sort_by([("id", "ascending")])
    rows = [r.values.to_numpy().astype(np.int64) for r in sample["cols"]]
    return Ordinal.fit(rows, sample["grade"].to_numpy().astype(np.int64))


def score(
    docs: DataFrame, model: Ordinal, keep_at: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, expected_grade, p_usable, p_good, kept) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.tails([features(t.as_py()) for t in b.column(1)])
            p = np.round(p.reshape(-1, 2), 9)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(model.keeps(p[:, 1], keep_at))],
                names=["id", "expected_grade", "p_usable", "p_good", "kept"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, run, "id long, expected_grade double, p_usable double, p_good double, kept boolean")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, keep_at: float = 0.5) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps, with the columns they came with.

    Null and empty texts are scored like any other, repeated rows stay or go alike, the empty table stays empty.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.tails([features(t.as_py()) for t in b.column(at)]).reshape(-1, 2)
            yield b.filter(pa.array(model.keeps(p[:, 1], keep_at)))

    return mapped(docs, run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
