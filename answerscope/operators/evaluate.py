"""How well a score separates right from wrong answers.

Scores are evaluated in long form (group columns..., ``method``, ``score``, ``label``,
``similarity``). Rows are reduced to counts per distinct score before any shuffle of
consequence; curves are prefix sums over those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answerscope.functions.arrays import cosine_similarity
from answerscope.functions.overlap import rouge_l
from answerscope.functions.text import exact_match
from answerscope.operators.groups import ROWS_PER_BUCKET, pinned, running_totals
from answerscope.operators.similarity import best_over_references, reference_array
from answerscope.session import checkpointed

# Cut-offs that turn a similarity into a label.
COSINE_CUTOFF = 0.9
ROUGE_CUTOFF = 0.5

# Question sets whose additional answers count, by default.
MULTI_REFERENCE = ("coqa", "truthfulqa")

# The score columns and the sign that makes "larger" mean "more reliable".
ORIENTATION = {
    "perplexity": -1,
    "energy": -1,
    "entropy": -1,
    "lexical_similarity": 1,
    "sent_bertscore": -1,
    "spectral_score": -1,
    "output_spectral_score": -1,
}

# Rows of the summary table, in order, with their printed names.
PAPER_ROWS = (
    ("perplexity", "Perplexity"),
    ("energy", "Energy"),
    ("entropy", "Entropy"),
    ("lexical_similarity", "LexicalSim"),
    ("output_spectral_score", "SpectralOutput"),
)


def uses_references(dataset: str) -> bool:
    return dataset.lower() in MULTI_REFERENCE


# --- labels -------------------------------------------------------------------------


def correctness(
    df: DataFrame,
    measure: str,
    multi_reference: bool = False,
    stem: bool = True,
    prediction: str = "most_likely_generation",
    answer: str = "answer",
    additional: str = "additional_answers",
) -> DataFrame:
    """Adds ``similarity`` and ``label`` for one correctness measure.

    'rouge' and 'exact' compare texts; 'cosine' compares the embedding columns named by
    ``prediction`` and ``answer`` (``additional`` then is an array of vectors).
    """
    p, a = F.col(prediction), F.col(answer)
    extra = F.col(additional) if multi_reference else None
    if measure == "rouge":
        value = best_over_references(p, reference_array(a, extra), stem) if multi_reference else rouge_l(p, a, stem)
        return df.withColumn("similarity", value).withColumn(
            "label", (F.col("similarity") > ROUGE_CUTOFF).cast("int")
        )
    if measure == "exact":
        value = exact_match(p, a)
        if multi_reference:
            others = F.array_max(F.transform(extra, lambda r: exact_match(p, r)))
            value = F.greatest(value, others)
        return df.withColumn("similarity", value.cast("double")).withColumn(
            "label", (F.col("similarity") == 1).cast("int")
        )
    if measure == "cosine":
        value = cosine_similarity(p, a)
        if multi_reference:
            value = F.greatest(value, F.array_max(F.transform(extra, lambda r: cosine_similarity(p, r))))
        return df.withColumn("similarity", value).withColumn(
            "label", (F.col("similarity") > COSINE_CUTOFF).cast("int")
        )
    raise ValueError("measure is 'rouge', 'exact' or 'cosine'")


def accuracy(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return labelled.groupBy(*(keys or [])).agg(F.avg("label").alias("accuracy"))


def orient_and_melt(
    df: DataFrame, keep: list[str], orientation: dict[str, int] | None = None
) -> DataFrame:
    """Wide score columns to (keep..., method, score), signs turned so that larger is better."""
    signs = orientation or ORIENTATION
    turned = df.select(*keep, *[(F.col(c) * F.lit(float(s)) + F.lit(0.0)).alias(c) for c, s in signs.items()])
    return turned.unpivot(keep, list(signs), "method", "score")


# --- curves -------------------------------------------------------------------------


def score_counts(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives per distinct score; rows without a score are not comparable."""
    # + 0.0 lets -0.0 and 0.0 fall together
    rows = scored.filter(F.col("score").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy(*keys, (F.col("score") + F.lit(0.0)).alias("score")).agg(
        F.sum("label").cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col("label")).cast("bigint").alias("neg"),
    )


def _attached(df: DataFrame, per_group: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the columns of its group's row; without keys that one row becomes literals."""
    if keys:
        return df.join(pinned(per_group), keys)
    row = per_group.first()
    return df.select("*", *[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in per_group.schema])


def cumulative_counts(
    counts: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, size_bound: int | None = None
) -> DataFrame:
    """Adds positives and negatives with a score at least as high (``tp``, ``fp``) and totals."""
    down = counts.withColumn("_down", -F.col("score"))
    cum = running_totals(down, keys, "_down", ["pos", "neg"], rows_per_bucket, size_bound).drop("_down")
    if size_bound is not None and size_bound <= rows_per_bucket:
        whole = Window.partitionBy(*keys)  # the partitioning the running totals already have
        joined = cum.select("*", F.sum("pos").over(whole).alias("P"), F.sum("neg").over(whole).alias("N"))
    else:
        totals = counts.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
        joined = _attached(cum, totals, keys)
    return joined.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def _counted(
    scored: DataFrame, keys: list[str], rows_per_bucket: int, size_bound: int | None
) -> tuple[DataFrame, int]:
    """Counts per score and an upper bound of their number.

    Counting rows needs none of their columns, so scores and labels are not computed for
    it. Many counts are stored once in the shared folder, as several steps read them.
    """
    bound = scored.count() if size_bound is None else size_bound
    counts = score_counts(scored, keys)
    return (checkpointed(counts) if bound > rows_per_bucket else counts), bound


def _rates() -> tuple[Column, Column]:
    tpr = F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double"))
    fpr = F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double"))
    return tpr, fpr


def roc_curve(
    scored: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, size_bound: int | None = None
) -> DataFrame:
    """All curve points including the first one at +infinity; ties form one point."""
    counts, bound = _counted(scored, keys, rows_per_bucket, size_bound)
    cum = cumulative_counts(counts, keys, rows_per_bucket, bound)
    tpr, fpr = _rates()
    point = F.struct(F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"))
    start = F.struct(F.lit(float("inf")).alias("threshold"), (fpr * 0).alias("fpr"), (tpr * 0).alias("tpr"))
    # only the highest score has nothing above it: the starting point is put in front of it
    highest = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    points = F.when(highest, F.array(start, point)).otherwise(F.array(point))
    return cum.select(*keys, F.explode(points).alias("p")).select(*keys, "p.*")


def _auroc_value() -> Column:
    above = F.col("tp") - F.col("pos")
    area = F.sum(F.col("neg") * (above + F.col("pos") / 2.0))
    return F.try_divide(area, F.max(F.col("P").cast("double") * F.col("N")))


def _best_point(gmean_col: str = "_g") -> Column:
    return F.max_by(F.col("score"), F.struct(F.col(gmean_col), F.col("score")))


def separation(
    scored: DataFrame,
    keys: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
    size_bound: int | None = None,
    round_threshold: int | None = None,
) -> DataFrame:
    """AUROC, best threshold and detection accuracy per group from one pass over the curve.

    The threshold is the first (highest) score with the largest sqrt(tpr·(1-fpr)); if that
    is 0 everywhere it is the curve's starting point, +infinity. ``round_threshold`` rounds
    it before it is applied.
    """
    counts, bound = _counted(scored, keys, rows_per_bucket, size_bound)
    cum = cumulative_counts(counts, keys, rows_per_bucket, bound)
    tpr, fpr = _rates()
    with_g = cum.withColumn("_g", F.sqrt(tpr * (F.lit(1.0) - fpr)))
    if bound <= rows_per_bucket:
        whole = Window.partitionBy(*keys)
        best = with_g.select("*", F.max("_g").over(whole).alias("_top"), _best_point().over(whole).alias("_t"))
    else:
        found = with_g.groupBy(*keys).agg(F.max("_g").alias("_top"), _best_point().alias("_t"))
        best = _attached(with_g, found, keys)
    threshold = F.when(F.col("_top") == 0, F.lit(float("inf"))).when(F.col("_top").isNotNull(), F.col("_t"))
    if round_threshold is not None:
        threshold = F.round(threshold, round_threshold)
    tested = best.withColumn("_cut", threshold)
    right = F.when(F.col("score") >= F.col("_cut"), F.col("pos")).otherwise(F.col("neg"))
    accuracy = F.try_divide(F.sum(right).cast("double"), F.sum(F.col("pos") + F.col("neg")).cast("double"))
    return tested.groupBy(*keys).agg(
        _auroc_value().alias("auroc"),
        F.max("_cut").alias("threshold"),
        F.when(F.max("_cut").isNotNull(), accuracy).alias("detection_accuracy"),
    )


def auroc(
    scored: DataFrame, keys: list[str], rows_per_bucket: int = ROWS_PER_BUCKET, size_bound: int | None = None
) -> DataFrame:
    """P(score of a positive > of a negative) + half the ties; NULL with one class only."""
    counts, bound = _counted(scored, keys, rows_per_bucket, size_bound)
    cum = cumulative_counts(counts, keys, rows_per_bucket, bound)
    return cum.groupBy(*keys).agg(_auroc_value().alias("auroc"))


def best_threshold(scored: DataFrame, keys: list[str], digits: int | None = 4, **sizes) -> DataFrame:
    out = separation(scored, keys, round_threshold=digits, **sizes)
    return out.select(*keys, "threshold")


def detection_accuracy(scored: DataFrame, keys: list[str], digits: int | None = 4, **sizes) -> DataFrame:
    out = separation(scored, keys, round_threshold=digits, **sizes)
    return out.select(*keys, "detection_accuracy")


def pearson_value(x: str, y: str) -> Column:
    """Correlation as an aggregate; NULL when either side is constant.

    Constancy is read off minimum and maximum: merged partial deviations of a constant need
    not be exactly 0.
    """
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(both, F.col(x)), F.when(both, F.col(y))
    spread = F.stddev_samp(xs) * F.stddev_samp(ys)
    varies = (F.min(xs) < F.max(xs)) & (F.min(ys) < F.max(ys))
    return F.when(varies, F.try_divide(F.covar_samp(xs, ys), spread))


def pearson_wide(labelled: DataFrame, keys: list[str], signs: dict[str, int], x: str = "similarity") -> DataFrame:
    """PCC of ``x`` with every oriented score column: one aggregation over unmelted rows."""
    turned = labelled.select(
        *keys, x, *[(F.col(c) * F.lit(float(s)) + F.lit(0.0)).alias(c) for c, s in signs.items()]
    )
    wide = turned.groupBy(*keys).agg(*[pearson_value(x, c).alias(c) for c in signs])
    return wide.unpivot(keys, list(signs), "method", "pcc")


def pearson(scored: DataFrame, keys: list[str], x: str = "similarity", y: str = "score") -> DataFrame:
    return scored.groupBy(*keys).agg(pearson_value(x, y).alias("pcc"))


# --- reports ------------------------------------------------------------------------


def evaluate_run(
    labelled: DataFrame,
    keys: list[str] | None = None,
    orientation: dict[str, int] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    round_threshold: int | None = 4,
) -> DataFrame:
    """AUROC, threshold, detection accuracy and PCC of every score, per group of ``keys``.

    ``labelled`` is a wide table with ``similarity``, ``label`` and the score columns.
    """
    signs = orientation or ORIENTATION
    keys = keys or []
    rows = orient_and_melt(labelled, [*keys, "similarity", "label"], signs)
    bound = labelled.count() * len(signs)
    group = [*keys, "method"]
    curves = separation(rows, group, rows_per_bucket, bound, round_threshold)
    return curves.join(pearson_wide(labelled, keys, signs), group)


def paper_table(
    labelled: DataFrame, keys: list[str] | None = None, methods=PAPER_ROWS, orientation: dict[str, int] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per method AUCs, AUCr and PCC in percent, one decimal, in the fixed order.

    ``labelled`` carries ``measure`` ('cosine' or 'rouge') next to similarity, label and
    the score columns; PCC is that of the cosine measure. ``keys`` adds run columns.
    """
    keys = keys or []
    signs = {m: (orientation or ORIENTATION)[m] for m, _ in methods}
    rows = orient_and_melt(labelled, [*keys, "measure", "similarity", "label"], signs)
    bound = labelled.count() * len(signs)
    group = [*keys, "measure", "method"]
    linear = pearson_wide(labelled, [*keys, "measure"], signs)
    both = auroc(rows, group, rows_per_bucket, bound).join(linear, group)

    def of(measure: str, value: str) -> Column:
        return F.round(F.max(F.when(F.col("measure") == measure, F.col(value))) * 100, 1)

    order = F.lit(None).cast("int")
    name = F.lit(None).cast("string")
    for place, (method, printed) in enumerate(methods, 1):
        order = F.when(F.col("method") == method, F.lit(place)).otherwise(order)
        name = F.when(F.col("method") == method, F.lit(printed)).otherwise(name)
    return (
        both.groupBy(*keys, "method")
        .agg(
            of("cosine", "auroc").alias("auc_s"), of("rouge", "auroc").alias("auc_r"), of("cosine", "pcc").alias("pcc")
        )
        .select(*keys, order.alias("place"), name.alias("method"), "auc_s", "auc_r", "pcc")
    )


def compare_runs(
    labelled: DataFrame, method: str = "spectral_score", run: str = "run", rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One score of several runs side by side."""
    return paper_table(labelled, [run], ((method, method),), None, rows_per_bucket).drop("place")
