"""Secret scan: fixed patterns, and a password guess-cost model for values in credential contexts.

Patterns find assignments of named secrets, access keys and long hex strings in whole texts.  Beside them, the value of
any credential-like assignment (``pwd``, ``passphrase``, ``auth``, ``client_secret``, ``bearer`` and such) is cut by
dynamic programming into the segments that a guesser would need the fewest tries for: words, dates,
repeats, keyboard walks, and brute-force characters.  The cut is the minimum over all segmentations: every part of a run is
offered as a repeat or walk, every form of a date, and a word as it stands and with look-alike signs undone.  A value whose least cost is at
least ``min_guesses`` (as a power of ten) is reported as kind ``guess``; ``password: changeme`` is not.

A word's guesses are its rank: ``WORDS`` come first, a seed of usual passwords, and then the words of the corpus by the
number of documents that hold them (``ranked_words``, counted over all documents; a guesser's dictionary has
``dictionary_size`` words, a parameter of the model).  A caller can pass any other table of words.

Defined cases: null text counts as empty; each row gives a result row, repeated or not, null identifiers included; spans are
code points; of equal costs the segmentation found first counts, which changes no cost; very long texts and values are read whole, in linear
time; an empty table gives an empty table; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import lower_az, mapped, table, utf8

KINDS = ["assign", "access", "hex", "guess"]


def _either(word: str) -> str:
    """Pattern for a word with ASCII letters in either case (no other case folding)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([_either("password"), _either("passwd"), _either("secret"), _either("token"), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_HEX_MAP = bytes(104 if c in b"0123456789abcdef" else 32 for c in range(256))
_CONTEXTS = [
    "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key",
    "credential", "authorization", "auth_key", "private_key", "access_key", "client_secret", "bearer",
]
_CONTEXT = re.compile(
    r"(?:" + "|".join(map(_either, _CONTEXTS)) + r")s?[\"']?[\x20\t]*(?:[:=]|(?<=[Rr])\x20)[\x20\t]*(?:[Bb]earer\x20)?[\"']?([!-~]{4,})"
)
_TRIM = "\"',;.)]}>"

#: Usual passwords and their parts, in order of use: the first ranks of every dictionary.
WORDS = (
    "password pass word admin root user login welcome letmein qwerty monkey dragon master shadow sunshine princess "
    "football baseball iloveyou love trustno superman batman michael jordan hunter soccer charlie george computer "
    "secret changeme change me default test testing guest example sample dummy temp demo hello world abc super "
    "summer winter spring autumn monday friday january december internet access server database oracle mysql "
    "postgres manager system service account private public company office cisco apple google none null true false "
    "your my the key token here value placeholder redacted insert string blank empty starwars freedom whatever "
    "cheese ginger maggie pepper killer tigger jessica ashley thomas robert daniel andrew matthew joshua"
).split()
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
NEXT = {(a, b) for row in ROWS for x, y in zip(row, row[1:]) for a, b in ((x, y), (y, x))} | {
    (a, b) for up, low in zip(ROWS, ROWS[1:]) for x, y in zip(up, low) for a, b in ((x, y), (y, x))
}
LEET = str.maketrans("013457@$", "oieastas")
_YEAR, _MONTH, _DAY, _SEP = r"(?:19|20)\d\d", r"(?:0\d|1[0-2])", r"(?:[0-2]\d|3[01])", r"[-/.]?"
DATES = [re.compile(x) for x in (f"{_YEAR}{_SEP}{_MONTH}{_SEP}{_DAY}", f"{_DAY}{_SEP}{_MONTH}{_SEP}{_YEAR}", _YEAR)]
LEAST_RUN = 3


class RunCosts:
    """Least best[i] + log10(end - i) over the starts i of parts of a run that end here.

    A logarithm's lead shrinks: once an earlier start is no dearer than a later one, it stays so, and an earlier start that
    is dearer to reach is never cheaper.  So the starts that can still win are few, in rising order of their cost.
    """

    def __init__(self) -> None:
        self.starts: list[tuple[int, float]] = []

    def add(self, start: int, cost: float) -> None:
        while self.starts and self.starts[-1][1] >= cost:
            self.starts.pop()
        self.starts.append((start, cost))

    def least(self, end: int) -> tuple[float, int]:
        best, kept = (math.inf, 0), []
        for start, cost in self.starts:
            total = cost + math.log10(end - start)
            if total < best[0]:
                best = (total, start)
                kept.append((start, cost))
        self.starts = kept
        return best


class GuessCost:
    """log10 of the guesses that a value needs, as the cheapest segmentation."""

    def __init__(self, words: list[str] | None = None):
        self.rank = {w: i + 1 for i, w in reversed(list(enumerate(words or WORDS)))}
        self.longest = max(map(len, self.rank))

    def __call__(self, value: str) -> float:
        return self.segments(value)[0]

    def word(self, value: str, low: str, plain: str) -> float:
        """Cost of a value as one word: by rank, dearer with capitals, dearer with look-alike signs."""
        cased = 0.3 + (0.0 if value == low else 0.6)
        own, other = self.rank.get(low), self.rank.get(plain) if plain != low else None
        costs = [math.log10(own + 1) + cased] if own else []
        return min([*costs, math.log10(other + 1) + cased + 0.6] if other else [*costs, math.inf])

    @staticmethod
    def per_character(value: str) -> float:
        classes = (str.islower, 26), (str.isupper, 26), (str.isdigit, 10)
        size = sum(k for f, k in classes if any(map(f, value))) + 33 * any(not c.isalnum() for c in value)
        return math.log10(max(size, 10))

    @staticmethod
    def repeat(brute: float, length: int) -> float:
        return brute + 0.3 + math.log10(length)

    @staticmethod
    def walk(length: int) -> float:
        return math.log10(47 * 4) + 0.3 + math.log10(length)

    @staticmethod
    def date(length: int) -> float:
        return math.log10(365 * 120 if length > 4 else 120) + 0.3

    def segments(self, value: str) -> tuple[float, list[tuple[str, int, int]]]:
        n = len(value)
        low = value.lower() if value.isascii() else value
        plain = low.translate(LEET)
        repeat, walk = [1] * n, [1] * n  # lengths of the runs that end here
        for i in range(1, n):
            if value[i] == value[i - 1]:
                repeat[i] = repeat[i - 1] + 1
            if (low[i - 1], low[i]) in NEXT:
                walk[i] = walk[i - 1] + 1
        dates: dict[int, list[int]] = {}
        for i in range(n):
            if value[i].isdigit():
                for form in DATES:
                    if m := form.match(value, i):
                        dates.setdefault(m.end(), []).append(i)
        brute = self.per_character(value)
        best, back = [0.0] + [math.inf] * n, [("", 0)] * (n + 1)

        def offer(end: int, start: int, total: float, kind: str) -> None:
            if total < best[end] - 1e-12:
                best[end], back[end] = total, (kind, start)

        repeats, walks = RunCosts(), RunCosts()
        for j in range(1, n + 1):
            offer(j, j - 1, best[j - 1] + brute, "brute")
            for i in range(max(0, j - self.longest), j - 1):
                offer(j, i, best[i] + self.word(value[i:j], low[i:j], plain[i:j]), "word")
            for kind, run, costs, fixed in (
                ("repeat", repeat[j - 1], repeats, self.repeat(brute, 1)),
                ("walk", walk[j - 1], walks, self.walk(1)),
            ):
                if run == 1:
                    costs.starts.clear()
                if run >= LEAST_RUN:
                    costs.add(j - LEAST_RUN, best[j - LEAST_RUN])
                    total, i = costs.least(j)
                    offer(j, i, total + fixed, kind)
            for i in dates.get(j, ()):
                offer(j, i, best[i] + self.date(j - i), "date")
        out, j = [], n
        while j:
            kind, i = back[j]
            if out and kind == "brute" and out[-1][0] == "brute":
                out[-1] = ("brute", i, out[-1][2])
            else:
                out.append((kind, i, j))
            j = i
        return best[n], out[::-1]


def ranked_words(docs: DataFrame, text_col: str = "text", dictionary_size: int = 20_000) -> list[str]:
    """A guesser's dictionary: WORDS, then the words of 4 to 20 letters that most documents hold, over all of them."""
    words = F.regexp_extract_all(lower_az(F.coalesce(F.col(text_col), F.lit(""))), F.lit("[a-z]{4,}+"), F.lit(0))
    found = docs.select(F.explode(F.array_distinct(words)).alias("word")).where(F.length("word") <= 20)
    counts = found.groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(dictionary_size)
    return list(dict.fromkeys([*WORDS, *(r.word for r in top.toLocalIterator())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns."""
    out, low = [], text.lower()
    if any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in utf8(text).translate(_HEX_MAP):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def guess_spans(text: str, cost: GuessCost, min_guesses: float) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(k in low for k in ("pass", "pwd", "secret", "token", "api", "credential", "auth", "_key", "bearer")):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m[1].rstrip(_TRIM)
        if len(value) >= 4 and cost(value) >= min_guesses:
            out.append((m.start(1), 3, m.start(1) + len(value)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_guesses: float = 8.0,
    words: list[str] | None = None,
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_sha256, spans) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost = GuessCost(words)
        for b in batches:
            counts, sha, spans = [[], [], [], []], [], []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = guess_spans(text, cost, min_guesses)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in (base if k < 3 else more)))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string())],
                names=["id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return mapped(
        rows, run, "id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, words=ranked_words(docs)).withColumnRenamed("id", "doc_id")
