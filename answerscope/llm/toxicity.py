"""Toxicity as expected severity from a cumulative-link ordinal regression.

Grades are 0 (clean) to 3. Labels only say toxic or not, so toxic documents of the sample are
graded by the share of their words that carry marks of toxicity (features that stand far
more often in toxic than in clean documents), cut at the sample's terciles. The model is
P(grade > k) = sigmoid(w x - t_k) with one weight vector for all thresholds t_1 < t_2 < t_3.
Features are words and word beginnings (``STEMS`` letters), at most ``MAX_FEATURES`` of them,
chosen by a G test of association on document counts; a feature's value is log(1 + its count
for 100 words), so a chance hit weighs little in a long text. It is fitted on about ``MAX_LABELLED`` labelled documents, chosen by a
hash of the id; the counts behind word choice are summed in Spark. Scoring reads every text
once and looks up the words' weights.

Defined cases: null or empty text has no feature and gets the severity of a text without
marks; documents with contradicting or unknown labels are not learned from; without both
labels in the sample every severity is 0; repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.llm.common import plain_text

MAX_LABELLED, MAX_FEATURES = 20_000, 1024
GRADES = 3
WORD = re.compile(r"[^\W\d_]+")
STEMS = (4, 5, 6, 7)
LEAST_DOCS, LEAST_G = 4, 30.0  # a chosen feature's document count and G statistic (p below 1e-7)
MARK = 20.0  # a mark of toxicity has odds so many times as high in toxic documents
RIDGE = 1e-4
EXTRA = 20  # words added to a text's length, so that very short ones have no extreme rates
CACHED = 400_000


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features_of(word: str) -> list[str]:
    """The word and its beginnings, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


class Lookup(dict):
    """Word -> places of its chosen features; most words have none. Bounded."""

    def __init__(self, place: dict[str, int]):
        super().__init__()
        self.place = place

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.place[f] for f in features_of(word) if f in self.place)
        if len(self) >= CACHED:
            self.clear()
        self[word] = found
        return found

    def rates(self, text: str) -> tuple[dict[int, float], int, int]:
        """Feature values of a text, its words, and how many of them have a feature."""
        words = words_of(text)
        hits = [f for f in map(self.__getitem__, words) if f]
        scale = 100 / (len(words) + EXTRA)
        return {k: math.log1p(n * scale) for k, n in Counter(k for f in hits for k in f).items()}, len(words), len(hits)


def _present(batches):
    """Features of the texts, each counted once a text, with the text's label."""
    for batch in batches:
        seen: Counter = Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            seen.update((f, toxic) for f in {f for w in set(words_of(text)) for f in features_of(w)})
        words, labels = zip(*seen) if seen else ((), ())
        yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "toxic": pa.array(labels, pa.int32()), "n": pa.array(list(seen.values()), pa.int64())})


def _counted(place: dict[str, int], marks: frozenset[int]):
    def run(batches):
        lookup = Lookup(place)
        for batch in batches:
            ids, values, shares = [], [], []
            for text in batch.column("text").to_pylist():
                found, size, _ = lookup.rates(text)
                marked = sum(1 for f in map(lookup.__getitem__, words_of(text)) if marks.intersection(f))
                ids.append(list(found))
                values.append(list(found.values()))
                shares.append(marked / max(1, size))
            yield pa.RecordBatch.from_pydict(
                {"id": batch.column("id"), "toxic": batch.column("toxic"), "ids": pa.array(ids, pa.list_(pa.int32())), "values": pa.array(values, pa.list_(pa.float64())), "marked": pa.array(shares, pa.float64())}
            )

    return run


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = MAX_LABELLED) -> DataFrame:
    """(id, text, toxic): the documents to learn from, about ``bound`` of those with one clear label."""
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .filter("id IS NOT NULL AND toxic IN (0, 1)")
        .groupBy("id")
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
        .filter("toxic = most")
        .drop("most")
    )
    share = min(1.0, bound / max(1, marks.count()))
    chosen = marks.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), plain_text(text).alias("text"))
    return rows.join(chosen, "id")


def choose_features(rows: DataFrame, limit: int = MAX_FEATURES) -> list[tuple[str, float]]:
    """(feature, odds ratio) of the features that tell most, by the G test on document counts."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    t, c = sizes.get(1, 0), sizes.get(0, 0)
    if not t or not c:
        return []
    counts = rows.select("text", "toxic").mapInArrow(_present, "word string, toxic int, n long").groupBy("word").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b")
    )
    n = F.lit(float(t + c))
    with_, without = F.col("a") + F.col("b"), F.lit(t + c) - F.col("a") - F.col("b")
    term = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * n / (row * F.lit(float(column))))).otherwise(0.0)
    g = 2 * (term(F.col("a"), with_, t) + term(F.col("b"), with_, c) + term(F.lit(t) - F.col("a"), without, t) + term(F.lit(c) - F.col("b"), without, c))
    odds = (F.col("a") + 0.5) * (c - F.col("b") + 0.5) / ((F.col("b") + 0.5) * (t - F.col("a") + 0.5))
    best = counts.filter(with_ >= LEAST_DOCS).select("word", g.alias("g"), odds.alias("odds")).filter(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(limit)
    return [(r["word"], r["odds"]) for r in best.collect()]


def fit_ordinal(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, width: int, ridge: float = RIDGE, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model; x: (row, column, value) of its non-zeros.

    Accelerated gradient descent with restarts on the mean log-likelihood; thresholds stay
    ordered because all but the first are sums of exponentials.
    """
    rows, cols, vals = x
    n, levels = len(y), int(y.max())
    freq = np.array([np.mean(y > k) for k in range(levels)])
    first = -np.log(freq / (1 - freq))
    w = np.zeros(width)
    free = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-2))))

    def thresholds(free):
        return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))

    def loss(w, free):
        t = thresholds(free)
        s = np.bincount(rows, vals * w[cols], n)
        edge = np.concatenate(([-np.inf], t, [np.inf]))
        upper, lower = 1 / (1 + np.exp(np.clip(s - edge[y + 1], -500, 500))), 1 / (1 + np.exp(np.clip(s - edge[y], -500, 500)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper), lower * (1 - lower)
        ds = (du - dl) / p / n
        gw = np.bincount(cols, vals * ds[rows], width) + ridge * w
        gt = np.zeros(levels)
        for k in range(levels):
            gt[k] = (-(du / p)[y == k].sum() + (dl / p)[y == k + 1].sum()) / n
        gf = np.cumsum(gt[::-1])[::-1] * np.concatenate(([1.0], np.exp(free[1:])))
        return -np.log(p).mean() + ridge / 2 * w @ w, np.concatenate((gw, gf))

    z = v = np.concatenate((w, free))
    step, mom = 1.0, 1.0
    value, grad = loss(z[:width], z[width:])
    for _ in range(rounds):
        while True:
            new = v - step * grad
            now, g = loss(new[:width], new[width:])
            if now <= value - step / 2 * grad @ grad + 1e-12 or step < 1e-8:
                break
            step /= 2
        nxt = (1 + math.sqrt(1 + 4 * mom * mom)) / 2
        ahead = new + (mom - 1) / nxt * (new - z)
        if (v - new) @ (new - z) > 0:
            ahead, nxt = new, 1.0
        z, v, mom, step = new, ahead, nxt, step * 1.5
        value, grad = loss(v[:width], v[width:])
        if np.abs(grad).max() < 1e-7:
            break
    return z[:width], thresholds(z[width:])


def fit(rows: DataFrame) -> dict:
    """{"weights": feature -> weight, "thresholds": [t1, t2, t3]} from labelled documents."""
    rows = rows.persist()
    try:
        chosen = choose_features(rows)
        if not chosen:
            return {"weights": {}, "thresholds": []}
        place = {w: k for k, (w, _) in enumerate(chosen)}
        marks = frozenset(k for k, (_, odds) in enumerate(chosen) if odds >= MARK)
        table = rows.select("id", "text", "toxic").mapInArrow(_counted(place, marks), "id long, toxic int, ids array<int>, values array<double>, marked double").toArrow().sort_by("id")
    finally:
        rows.unpersist()
    toxic, marked = table.column("toxic").to_numpy(), table.column("marked").to_numpy()
    ids, values = table.column("ids").combine_chunks(), table.column("values").combine_chunks()
    owner = np.repeat(np.arange(len(toxic)), np.diff(ids.offsets.to_numpy()))
    cols, vals = ids.flatten().to_numpy(), values.flatten().to_numpy()
    cuts = np.quantile(marked[toxic == 1], [k / GRADES for k in range(1, GRADES)])
    grade = np.where(toxic == 1, 1 + (marked[:, None] > cuts[None, :]).sum(axis=1), 0)
    grade = np.unique(grade, return_inverse=True)[1]  # grades without a document are no grades
    scale = np.sqrt(np.bincount(cols, vals**2, len(chosen)) / np.maximum(np.bincount(cols, minlength=len(chosen)), 1)) + 1e-12
    weights, thresholds = fit_ordinal((owner, cols, vals / scale[cols]), grade, len(chosen))
    return {"weights": {w: float(weights[k] / scale[k]) for w, k in place.items()}, "thresholds": [float(t) for t in thresholds]}


def _scored(model: dict):
    weights, thresholds = list(model["weights"].values()), model["thresholds"]
    place = {f: k for k, f in enumerate(model["weights"])}

    def run(batches):
        lookup = Lookup(place)
        for batch in batches:
            severity, grade, toxic = [], [], []
            for text in batch.column("text").to_pylist():
                s = math.fsum(weights[k] * v for k, v in lookup.rates(text)[0].items()) if weights else 0.0
                above = [1 / (1 + math.exp(min(500.0, max(-500.0, t - s)))) for t in thresholds]
                severity.append(math.fsum(above))
                grade.append(sum(p > 0.5 for p in above))
                toxic.append(bool(above) and above[0] > 0.5)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "severity": pa.array(severity, pa.float64()), "grade": pa.array(grade, pa.int32()), "toxic": pa.array(toxic, pa.bool_())}
            )

    return run


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic): expected grade, most severe grade more likely passed than not, and whether that is not 0."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), plain_text(text).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, severity double, grade int, toxic boolean")
