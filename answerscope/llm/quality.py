"""Quality rules with risk-controlled thresholds.

Every text gets rule values (symbols per word, capitals, repeated lines, repeated words, word
length), each divided by a usual cutoff; the largest is its strictness score. Per stratum the
cutoff on that score is certified on labelled documents: going from lenient to strict, a
cutoff stands while the exact binomial test rejects "more than ``max_false`` of the good
documents would go" at level ``delta`` over the number of strata (fixed-sequence testing
inside a stratum, Bonferroni across strata). Of the certified cutoffs the one that rejects
most bad documents is taken, the most lenient on ties. A stratum with too few labels for any
certificate rejects nothing beyond the base rules.

Copies of one text count once in the holdout; documents with contradicting labels, and null
or unknown label values, are left out. Null or empty text has no words and fails the base
rules; a null stratum is one of its own; repeated rows get the same verdict; an empty label
table certifies nothing.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import plain_text, slices, stored, texts_in

SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
MAX_FALSE, DELTA = 0.02, 0.05
#: Usual cutoffs of the rules; only their proportions matter.
UNITS = {"symbols": 0.1, "capitals": 0.3, "lines": 0.3, "words": 0.5, "length": 20.0}
STEPS, LAST_BIN = 20, 400  # score steps per unit; the last bin holds all larger scores

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(text: str) -> tuple[int, int, int, int, int, float]:
    """The five base counts of a text and its strictness score."""
    raw = text.encode()
    words = raw.split()  # bytes.split() splits at [\\x20\\x09-\\x0D]+
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    if not n:
        return 0, 0, symbols, 0, 0, 0.0
    values = {
        "symbols": symbols / n,
        "capitals": (len(joined) - len(joined.translate(None, CAPITALS))) / chars,
        "lines": dup / len(lines),
        "words": repeated / n,
        "length": chars / n,
    }
    return n, chars, symbols, dup, repeated, max(values[k] / unit for k, unit in UNITS.items())


def _measured(inside: int | None):
    def run(batches):
        for batch in slices(batches):
            columns = list(zip(*[measure(t) for t in texts_in(batch, inside)]))
            out = {c: batch.column(c) for c in batch.schema.names if c != "text"}
            out |= {c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, columns)}
            yield pa.RecordBatch.from_pydict(out | {"score": pa.array(columns[5], pa.float64())})

    return run


def measured(df: DataFrame, inside: int | None = None) -> DataFrame:
    """``df`` with the base counts and the score of its column ``text``, which goes, or of that field of ``row``."""
    schema = df.drop("text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return df.mapInArrow(_measured(inside), schema.add("score", "double")).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def score_bin() -> Column:
    return F.least(F.floor(F.col("score") * STEPS), F.lit(LAST_BIN)).cast("int")


def holdout(rows: DataFrame, labels: DataFrame, label_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """(stratum, bin, good, bad): the labelled texts of ``rows`` (id, stratum, th, score) by score.

    At most ``LAST_BIN + 1`` rows for each stratum, summed before the shuffle.
    """
    marks = (
        labels.select(F.col(label_id).cast("long").alias("id"), F.col(label).cast("int").alias("q"))
        .filter("id IS NOT NULL AND q IN (0, 1)")
        .groupBy("id")
        .agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    )
    texts = (
        rows.select("id", "stratum", "th", score_bin().alias("bin"))
        .join(marks, "id")
        .groupBy("stratum", "th", "bin")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .filter("lo = hi")
    )
    return texts.groupBy("stratum", "bin").agg(F.sum("lo").alias("good"), F.sum(1 - F.col("lo")).alias("bad"))


def binomial_tail(n: int, x: int, p: float) -> float:
    """P(X <= x) for X ~ Binomial(n, p), as the incomplete beta I(1-p; n-x, x+1)."""
    if x >= n:
        return 1.0
    return _beta_inc(n - x, x + 1, 1 - p)


def _beta_inc(a: float, b: float, x: float) -> float:
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 10_000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, front * out)


def certified_cutoff(good: dict[int, int], bad: dict[int, int], max_false: float, level: float) -> int:
    """The cutoff of one stratum: documents of a higher bin go. ``LAST_BIN``: none goes."""
    n = sum(good.values())
    gone = caught = 0
    best, most = LAST_BIN, 0
    for cut in range(LAST_BIN - 1, -1, -1):
        gone += good.get(cut + 1, 0)
        caught += bad.get(cut + 1, 0)
        if n == 0 or binomial_tail(n, gone, max_false) > level:
            break
        if caught > most:
            best, most = cut, caught
    return best


def certify(counts: DataFrame, max_false: float = MAX_FALSE, delta: float = DELTA) -> dict[str, int]:
    """Cutoff by stratum from a ``holdout`` table, which is small: a few hundred rows a stratum."""
    good: dict[str, dict[int, int]] = {}
    bad: dict[str, dict[int, int]] = {}
    for row in counts.collect():
        good.setdefault(row["stratum"], {})[row["bin"]] = row["good"]
        bad.setdefault(row["stratum"], {})[row["bin"]] = row["bad"]
    return {s: certified_cutoff(good[s], bad[s], max_false, delta / len(good)) for s in good}


def kept(cutoffs: dict[str, int]) -> Column:
    """The verdict, from base_failed, score and stratum."""
    limit = F.lit(LAST_BIN)
    for stratum, cut in sorted(cutoffs.items()):
        limit = F.when(F.col("stratum") == stratum, cut).otherwise(limit)
    return ~F.col("base_failed") & (score_bin() <= limit)


def stratum(name: str = "lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit("none"))


def judged(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", by: str = "lang") -> DataFrame:
    """(id, stratum, base counts, score, base_failed, kept) for every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), stratum(by).alias("stratum"), plain_text(text).alias("text"))
    table = stored(measured(rows.withColumn("th", F.xxhash64("text"))), "quality")
    cutoffs = certify(holdout(table, labels))
    return table.withColumn("kept", kept(cutoffs))


def kept_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", by: str = "lang") -> DataFrame:
    """The rows that pass, all columns as they were.

    Texts are measured where they are read, once for the holdout and once for the verdict: only
    ids and scores are joined with the labels, and no text is shuffled.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), stratum(by).alias("stratum"), plain_text(text).alias("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), stratum(by).alias("stratum"))
    scores = measured(texts.withColumn("th", F.xxhash64("text"))).select("id", "stratum", "th", "score")
    cutoffs = certify(holdout(stored(scores, "holdout"), labels))
    return measured(rows, docs.columns.index(text)).filter(kept(cutoffs)).select("row.*")
