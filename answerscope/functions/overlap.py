"""Word-overlap scores of text pairs (ROUGE-1, ROUGE-2, ROUGE-L F-measures).

The dynamic programme behind ROUGE-L has no built-in counterpart, so these run as
Arrow-batched functions; Spark decides which pairs meet in which task.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope.functions.aligned import PAIRS, Tokens, row_slices, scores
from answerscope.functions.stemming import stem_token

MEASURES = ("rouge1", "rouge2", "rougeL")
_TOKEN = re.compile("[a-z0-9]+")


def tokens_of(text: str, stem: bool) -> list[str]:
    found = _TOKEN.findall(text.lower())
    return [stem_token(t) for t in found] if stem else found


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows: one big-int step per token of ``b``."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, token in enumerate(a):
        places[token] = places.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & places.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _f_measure(common: int, n_a: int, n_b: int) -> float:
    if common == 0 or n_a == 0 or n_b == 0:
        return 0.0
    p, r = common / n_a, common / n_b
    return 2 * p * r / (p + r)


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(zip(*(tokens[i:] for i in range(n))))


def pair_score(a: list[str], b: list[str], measure: str) -> float:
    if measure == "rougeL":
        return _f_measure(lcs_length(a, b), len(a), len(b))
    n = int(measure[-1])
    ga, gb = _grams(a, n), _grams(b, n)
    common = sum(min(c, gb[g]) for g, c in ga.items() if g in gb)
    return _f_measure(common, ga.total(), gb.total())


@lru_cache(maxsize=None)
def _pair_udf(measure: str, stem: bool):
    @F.arrow_udf("double")
    def score(prediction: pa.Array, reference: pa.Array) -> pa.Array:
        done = [pa.array([], pa.float64())]
        for part in row_slices(prediction, reference):
            tokens = Tokens(stem)
            both = list(zip(*(x.to_pylist() for x in part)))
            told = np.array([p is not None and r is not None for p, r in both], bool)
            out = np.zeros(len(both))
            known = [both[i] for i in np.flatnonzero(told)]
            out[told] = scores([tokens(p) for p, _ in known], [tokens(r) for _, r in known], measure)
            done.append(pa.array(out, pa.float64(), mask=~told))
        return pa.concat_arrays(done)

    return score


def _best(predictions: list[list], references: list, measures, stem: bool) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For every prediction of every row the best score over the row's references, and whether there is one.

    Equal predictions of a row are compared once; about ``PAIRS`` pairs are listed at a time.
    """
    tokens = Tokens(stem)
    best: dict[str, list] = {m: [] for m in measures}
    left, right, count, at, some_ref, n = [], [], [], [], [], 0

    def settle() -> None:
        sizes = np.array(count, np.int64)
        some = np.flatnonzero(sizes)
        start = (np.cumsum(sizes) - sizes)[some]
        some_ref.append(sizes > 0)
        for m in measures:
            value = np.zeros(len(sizes))
            if len(some):
                value[some] = np.maximum.reduceat(scores(left, right, m), start)
            best[m].append(value)
        del left[:], right[:], count[:]

    for preds, refs in zip(predictions, references):
        texts = [tokens(r) for r in refs or () if r is not None]
        first: dict = {None: -1}
        for p in preds:
            if p not in first:
                first[p], n = n, n + 1
                left += [tokens(p)] * len(texts)
                right += texts
                count.append(len(texts))
                if len(left) >= PAIRS:
                    settle()
            at.append(first[p])
    settle()
    told = np.concatenate((*some_ref, [False]))  # the last one: no prediction
    at = np.array(at, np.int64)
    return {m: (np.append(np.concatenate(best[m]), 0.0)[at], told[at]) for m in measures}


def _joined(parts, measures) -> pa.StructArray:
    parts = list(parts)
    flat = lambda k, m, kind: np.concatenate([np.empty(0, kind), *(p[m][k] for p in parts)])
    columns = [pa.array(flat(0, m, np.float64), mask=~flat(1, m, bool)) for m in measures]
    return pa.StructArray.from_arrays(columns, names=list(measures))


@lru_cache(maxsize=None)
def _best_udf(measures: tuple[str, ...], stem: bool):
    @F.arrow_udf("struct<" + ",".join(f"{m}:double" for m in measures) + ">")
    def best(prediction: pa.Array, references: pa.Array) -> pa.Array:
        parts = (_best([[p] for p in ps.to_pylist()], rs.to_pylist(), measures, stem) for ps, rs in row_slices(prediction, references))
        return _joined(parts, measures)

    return best


@lru_cache(maxsize=None)
def _best_each_udf(measures: tuple[str, ...], stem: bool):
    @F.arrow_udf("array<struct<" + ",".join(f"{m}:double" for m in measures) + ">>")
    def best(predictions: pa.Array, references: pa.Array) -> pa.Array:
        parts, sizes = [], []
        for ps, rs in row_slices(predictions, references):
            lists = [x or [] for x in ps.to_pylist()]
            sizes += map(len, lists)
            parts.append(_best(lists, rs.to_pylist(), measures, stem))
        ends = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), _joined(parts, measures))

    return best


@lru_cache(maxsize=None)
def _stem_udf():
    @F.arrow_udf("string")
    def stem(tokens: pa.Array) -> pa.Array:
        return pa.array([None if t is None else stem_token(t) for t in tokens.to_pylist()], pa.string())

    return stem


def rouge_l(prediction: Column, reference: Column, stem: bool = False) -> Column:
    return _pair_udf("rougeL", stem)(prediction, reference)


def rouge_n(prediction: Column, reference: Column, n: int, stem: bool = False) -> Column:
    """Clipped n-gram overlap, n = 1 or 2, linear in the texts."""
    return _pair_udf(f"rouge{n}", stem)(prediction, reference)


def best_rouge(
    prediction: Column, references: Column, measures: tuple[str, ...] = MEASURES, stem: bool = False
) -> Column:
    """Struct with each measure's maximum over an array of references (NULL when empty).

    Each prediction is compared inside its own row, so no prediction-reference pair is
    ever emitted as a row.
    """
    return _best_udf(tuple(measures), stem)(prediction, references)


def best_rouge_each(
    predictions: Column, references: Column, measures: tuple[str, ...] = MEASURES, stem: bool = False
) -> Column:
    """``best_rouge`` for every entry of an array of predictions; equal ones are compared once."""
    return _best_each_udf(tuple(measures), stem)(predictions, references)


def stem_column(token: Column) -> Column:
    return _stem_udf()(token)


def lcs_native(a: Column, b: Column) -> Column:
    """LCS length of two token arrays without Python; for short arrays only.

    Folds one row of the usual table over the tokens of ``a``.
    """
    width = F.size(b)
    zero = F.array_repeat(F.lit(0), width + F.lit(1))

    def next_row(row: Column, x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), width),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(
                acc,
                F.array(
                    F.when(F.element_at(b, j) == x, F.element_at(row, j) + 1).otherwise(
                        F.greatest(F.element_at(row, j + 1), F.element_at(acc, j))
                    )
                ),
            ),
        )

    table = F.aggregate(a, zero, next_row)
    return F.when((F.size(a) == 0) | (width == 0), F.lit(0)).otherwise(F.array_max(table))
