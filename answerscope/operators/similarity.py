"""Similarity of the answers of one sample to each other and to reference answers."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import overlap
from answerscope.functions.aligned import PAIRS, Tokens, row_slices, scores
from answerscope.functions.arrays import let
from answerscope.functions.overlap import MEASURES
from answerscope.functions.text import caseless, drop_punctuation, rouge_tokens
from answerscope.operators.groups import oversized_groups, pair_tiles, pinned, positions
from answerscope.session import stored

# Texts per side of a comparison tile: at most 64·64 comparisons of whole texts per task step.
TEXT_TILE = 64

# Whole texts sorted by one task at most, and the characters by which the tasks are told apart.
TEXTS_PER_BUCKET, STEERING_CHARS = 20_000, 64

# Copies of one text in a sample beyond which its rows are not shuffled to meet its number.
HOT_COPIES = 1_000_000


def stem_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, stem) for the distinct tokens of a text column: one stemming per word."""
    words = df.select(F.explode(rouge_tokens(F.col(text))).alias("token")).distinct()
    return words.select("token", overlap.stem_column(F.col("token")).alias("stem"))


def reference_array(answer: Column, additional: Column | None) -> Column:
    """Answer and additional answers as one array; a missing or empty list adds nothing."""
    first = F.array(answer)
    if additional is None:
        return first
    return F.concat(first, F.coalesce(additional, F.array().cast("array<string>")))


def best_over_references(prediction: Column, references: Column, stem: bool = True) -> Column:
    """Largest ROUGE-L against any reference."""
    return overlap.best_rouge(prediction, F.array_distinct(references), ("rougeL",), stem)["rougeL"]


def score_generations(records: DataFrame, id_col: str = "id", stem: bool = False) -> DataFrame:
    """Every generation against all references of its record: exact match and ROUGE-1/2/L.

    Predictions equal up to case and leading space are scored once per record; references
    are compared in that form too. A record's answers and references sit in one row, so
    nothing is shuffled and no prediction-reference pair becomes a row.
    """
    rows = records.select(
        id_col,
        F.transform("generations", caseless).alias("_preds"),
        F.array_distinct(
            F.transform(reference_array(F.col("answer"), F.col("additional_answers")), caseless)
        ).alias("_refs"),
    )
    exact = let(
        F.transform("_refs", drop_punctuation),
        lambda refs: F.transform("_preds", lambda p: F.array_contains(refs, drop_punctuation(p)).cast("double")),
    )
    best = overlap.best_rouge_each(F.col("_preds"), F.col("_refs"), MEASURES, stem)
    each = F.arrays_zip(exact.alias("exact_match"), best.alias("r"))
    return rows.select(id_col, F.posexplode(each).alias("gen_id", "_s")).select(
        id_col, "gen_id", F.col("_s.exact_match").alias("exact_match"), *[F.col(f"_s.r.{m}").alias(m) for m in MEASURES]
    )


def distinct_answers(df: DataFrame, sample: str, text: str) -> DataFrame:
    """One row per sample and distinct text with its number of copies.

    Pre-aggregated before the shuffle, so a text that makes up much of the data is cheap.
    """
    return df.groupBy(sample, text).agg(F.count(F.lit(1)).alias("copies"))


def _other_side() -> Column:
    """A tile's right side; none on the diagonal, where it would be the left one again."""
    return F.when(F.col("lo") != F.col("hi"), F.col("right_items"))


def _tile_pairs(diagonal: bool, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of a tile meet: each with the later ones, or left with right."""
    if diagonal:
        return np.triu_indices(n_a, 1)
    return np.repeat(np.arange(n_a), n_b), np.tile(np.arange(n_b), n_a)


def _tile_lists(same: list, left: list, right: list, tokens: Tokens):
    """The pairs of some tiles at a time: pairs of each tile, texts of both sides, products of copies."""
    of, ta, tb, weight = [], [], [], []
    copies = lambda side: np.array([x["copies"] for x in side], np.float64)
    for diagonal, a, b in zip(same, left, right):
        b = a if diagonal else b
        i, j = _tile_pairs(diagonal, len(a), len(b))
        texts_a, texts_b = ([tokens(x["text"]) for x in side] for side in (a, b))
        of.append(len(i))
        ta += [texts_a[x] for x in i]
        tb += [texts_b[x] for x in j]
        weight.append(copies(a)[i] * copies(b)[j])
        if len(ta) >= PAIRS:
            yield of, ta, tb, np.concatenate(weight)
            of, ta, tb, weight = [], [], [], []
    if of:
        yield of, ta, tb, np.concatenate(weight)


@lru_cache(maxsize=None)
def _tile_sums(measures: tuple[str, ...], stem: bool):
    """Sum over a tile's pairs of score·copies·copies, for each measure.

    A tile on the diagonal pairs each text with the later ones, an off-diagonal tile pairs
    left with right, so every unordered pair counts once (the F-measure is symmetric).
    """

    @F.arrow_udf("struct<" + ",".join(f"{m}:double" for m in measures) + ">")
    def run(same: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        sums = {m: [np.empty(0)] for m in measures}
        for part in row_slices(same, left, right):
            for of, ta, tb, weight in _tile_lists(*(x.to_pylist() for x in part), Tokens(stem)):
                for m in measures:
                    sums[m].append(np.bincount(np.repeat(np.arange(len(of)), of), scores(ta, tb, m) * weight, len(of)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sums[m]), pa.float64()) for m in measures], names=list(measures))

    return run


def _pair_sums(df: DataFrame, sample: str, text: str, measures, stem: bool, limit: int) -> DataFrame:
    """Per sample: score sums over unordered pairs of different texts, and totals of copies.

    Each distinct text lies in exactly one diagonal tile, which therefore also yields the
    number of answers ``n``, Σ copies² (``sq``) and the pairs of equal texts with at least
    one token (``twins``).
    """
    answers = distinct_answers(df, sample, text)
    item = F.struct(F.col(text).alias("text"), F.col("copies"))
    tiles = pair_tiles(answers, [sample], item, F.col(text), limit, probe=df.select(sample))
    diagonal = F.col("lo") == F.col("hi")

    def total(of) -> Column:
        added = F.aggregate("left_items", F.lit(0).cast("bigint"), lambda acc, x: acc + of(x))
        return F.when(diagonal, added).otherwise(F.lit(0))

    pairs_of = lambda x: (x["copies"] * (x["copies"] - 1) / 2).cast("bigint")
    has_token = lambda x: F.lower(x["text"]).rlike("[a-z0-9]")
    per_tile = tiles.select(
        sample,
        _tile_sums(tuple(measures), stem)(diagonal, "left_items", _other_side()).alias("_s"),
        total(lambda x: x["copies"]).alias("n"),
        total(lambda x: x["copies"] * x["copies"]).alias("sq"),
        total(lambda x: F.when(has_token(x), pairs_of(x)).otherwise(F.lit(0))).alias("twins"),
    )
    return per_tile.groupBy(sample).agg(
        *[F.sum(F.col("_s")[m]).alias(m) for m in measures], *[F.sum(c).alias(c) for c in ("n", "sq", "twins")]
    )


def lexical_similarity(
    df: DataFrame, sample: str = "sample_id", text: str = "text", stem: bool = True, limit: int = TEXT_TILE
) -> DataFrame:
    """Mean ROUGE-L over the unordered pairs of a sample's answers; NULL for one answer.

    Copies of an answer are compared once and weighted: c copies of a text contribute
    c·(c-1)/2 pairs with score 1 (0 when the text has no token).
    """
    sums = _pair_sums(df, sample, text, ("rougeL",), stem, limit)
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.select(sample, F.try_divide(F.col("rougeL") + F.col("twins"), pairs).alias("lexical_similarity"))


def syntactic_similarity(
    df: DataFrame, sample: str = "sample_id", text: str = "text", stem: bool = False, limit: int = TEXT_TILE
) -> DataFrame:
    """Mean ROUGE-1/2/L over ordered pairs of answers with different text.

    NULL when all answers are equal. Copies weigh as often as they occur.
    """
    sums = _pair_sums(df, sample, text, MEASURES, stem, limit)
    unequal = (F.col("n") * F.col("n") - F.col("sq")) / 2
    return sums.select(sample, *[F.try_divide(F.col(m), unequal).alias(m) for m in MEASURES])


def numbered_answers(
    df: DataFrame, sample: str, text: str, rows_per_bucket: int = TEXTS_PER_BUCKET
) -> DataFrame:
    """Distinct answers of a sample, numbered from 0 in sorted order (``ans_id``).

    Large samples are sorted in pieces of whole texts, drawn by the texts' first characters.
    """
    distinct = df.select(sample, text).distinct()
    placed = positions(
        distinct, [sample], [text], rows_per_bucket=rows_per_bucket, probe=df.select(sample),
        steer=F.substring(text, 1, STEERING_CHARS),
    )
    return placed.withColumn("ans_id", (F.col("position") - 1).cast("int")).drop("position")


def answer_index(df: DataFrame, sample: str, gen: str, text: str, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(sample, generation, ans_id): which distinct answer every generation gave.

    Texts of more than ``hot_copies`` copies, found by one count over digests, meet their numbers where
    their rows are: a digest and a number for each goes to all tasks, at most one for ``hot_copies``
    rows of input. The others are joined by a shuffle.
    """
    key = [sample, "_digest"]
    rows = df.select(sample, gen, text, F.sha2(text, 256).alias("_digest"))
    hot = oversized_groups(rows.select(*key), key, hot_copies)
    numbers = numbered_answers(df, sample, text)
    if hot is None:
        return rows.drop("_digest").join(numbers, [sample, text]).drop(text)
    hot = hot.drop("group_rows")
    numbers = stored(numbers, "answers")
    few = pinned(numbers.withColumn("_digest", F.sha2(text, 256)).join(hot, key, "left_semi").drop(text))
    rest = rows.join(hot, key, "left_anti").drop("_digest").join(numbers, [sample, text]).drop(text)
    return rest.unionByName(rows.drop(text).join(few, key).drop("_digest"))


@lru_cache(maxsize=None)
def _tile_matrix(stem: bool):
    """Per tile, for every answer the ROUGE-L values to the answers on the other side."""
    row = "struct<ans_id:int,others:array<struct<j:int,value:double>>>"

    @F.arrow_udf(f"array<{row}>")
    def run(same: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
        kind = pa.list_(
            pa.struct(
                [
                    ("ans_id", pa.int32()),
                    ("others", pa.list_(pa.struct([("j", pa.int32()), ("value", pa.float64())]))),
                ]
            )
        )
        done, out, listed = [pa.array([], kind)], [], 0
        for part in row_slices(same, left, right):
            tokens = Tokens(stem)
            for diagonal, a, b in zip(*(x.to_pylist() for x in part)):
                ta, tb = ([tokens(x["text"]) for x in side] for side in (a, a if diagonal else b))
                i, j = _tile_pairs(diagonal, len(ta), len(tb))
                m = np.eye(len(ta)) if diagonal else np.zeros((len(ta), len(tb)))
                m[i, j] = scores([ta[x] for x in i], [tb[x] for x in j], "rougeL")
                if diagonal:
                    m[j, i] = m[i, j]
                ids_a = [x["ans_id"] for x in a]
                ids_b = ids_a if diagonal else [x["ans_id"] for x in b]
                rows = [(ids_a, ids_b, m)] if diagonal else [(ids_a, ids_b, m), (ids_b, ids_a, m.T)]
                out.append(
                    [
                        {"ans_id": i, "others": [{"j": j, "value": float(v)} for j, v in zip(cols, line)]}
                        for ids, cols, mat in rows
                        for i, line in zip(ids, mat)
                    ]
                )
                listed += m.size
                if listed >= PAIRS:
                    done.append(pa.array(out, kind))
                    out, listed = [], 0
        return pa.concat_arrays([*done, pa.array(out, kind)])

    return run


def lexical_similarity_matrix(
    df: DataFrame, sample: str = "sample_id", text: str = "text", stem: bool = False, limit: int = TEXT_TILE
) -> DataFrame:
    """Symmetric ROUGE-L matrix of the sorted distinct answers, unit diagonal.

    One output row per matrix row: (sample, ans_id, sims), ``sims`` ordered by the other
    answer's number. ``answer_index`` maps generations to these numbers.
    """
    answers = numbered_answers(df, sample, text)
    item = F.struct("ans_id", F.col(text).alias("text"))
    tiles = pair_tiles(answers, [sample], item, F.col(text), limit, probe=df.select(sample))
    lines = tiles.select(
        sample,
        F.explode(_tile_matrix(stem)(F.col("lo") == F.col("hi"), "left_items", _other_side())).alias("_l"),
    )
    parts = F.array_sort(F.flatten(F.collect_list("_l.others")))
    return lines.groupBy(sample, F.col("_l.ans_id").alias("ans_id")).agg(
        F.transform(parts, lambda p: p["value"]).alias("sims")
    )
