"""Token-level uncertainty from the long table of scores.

``token_scores``: sample_id, batch_id, gen_id, token_pos, target_id, logits. Each row is
reduced to a few numbers inside the JVM before anything is shuffled, and all sums combine
map-side, so logits never cross the network.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions.arrays import entropy, let, log_max_prob, logsumexp, max_prob
from answerscope.functions.ids import num_tokens
from answerscope.operators.groups import broadcast_narrow
from answerscope.operators.vectors import sum_vector

# Added to a probability before its logarithm.
PROBABILITY_FLOOR = 1e-6


def perplexity(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """-mean ln max softmax over positions (of the greedy answer); not exponentiated."""
    return scores.groupBy(sample).agg((-F.avg(log_max_prob(F.col("logits"))) + F.lit(0.0)).alias("perplexity"))


def energy(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """-mean logsumexp over positions."""
    return scores.groupBy(sample).agg((-F.avg(logsumexp(F.col("logits")))).alias("energy"))


def greedy_scores(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """``perplexity`` and ``energy`` of the greedy answer from one pass."""
    x = F.col("logits")
    return scores.groupBy(sample).agg(
        (-F.avg(log_max_prob(x)) + F.lit(0.0)).alias("perplexity"), (-F.avg(logsumexp(x))).alias("energy")
    )


def predictive_entropy(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """-Σ ln(max prob + 1e-6) over all positions and generations / number of generations."""
    lp = F.ln(max_prob(F.col("logits")) + F.lit(PROBABILITY_FLOOR))
    per_gen = scores.groupBy(sample, "gen_id").agg(F.sum(lp).alias("_s"))
    return per_gen.groupBy(sample).agg((-F.sum("_s") / F.count(F.lit(1))).alias("predictive_entropy"))


def token_counts(generations: DataFrame, sample: str = "sample_id", ids: str = "ids") -> DataFrame:
    return generations.select(sample, "gen_id", num_tokens(F.col(ids)).alias("num_tokens"))


def last_batch(rows: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Only the rows of each sample's last generation batch."""
    latest = rows.groupBy(sample).agg(F.max("batch_id").alias("batch_id"))
    return rows.join(latest, [sample, "batch_id"], "left_semi")


def length_normalized_entropy(
    scores: DataFrame, counts: DataFrame, sample: str = "sample_id", scope: str = "all"
) -> DataFrame:
    """-mean over generations of (Σ_{t < num_tokens} ln max prob / num_tokens).

    ``scope='last_batch'`` restricts a sample to its last batch of generations.
    ``counts``: sample, gen_id, num_tokens - one row per generation. Logits become one number
    a token before anything else happens.
    """
    batch = ["batch_id"] if scope == "last_batch" else []
    reduced = scores.select(sample, *batch, "gen_id", "token_pos", log_max_prob(F.col("logits")).alias("_lp"))
    if scope == "last_batch":
        reduced = last_batch(reduced, sample).drop("batch_id")
        ids = last_batch(scores.select(sample, "batch_id", "gen_id").distinct(), sample)
        counts = counts.join(ids, [sample, "gen_id"], "left_semi")
    elif scope != "all":
        raise ValueError("scope is 'all' or 'last_batch'")
    lengths = broadcast_narrow(counts.select(sample, "gen_id", "num_tokens"), counts.count())
    inside = reduced.join(lengths, [sample, "gen_id"]).filter(F.col("token_pos") < F.col("num_tokens"))
    sums = inside.groupBy(sample).agg(F.sum(F.col("_lp") / F.col("num_tokens")).alias("_s"))
    n = counts.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    value = -F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_n") + F.lit(0.0)
    return n.join(sums, sample, "left").select(sample, value.alias("entropy"))


def token_nll(logits: Column, target: Column) -> Column:
    """-log softmax of the target; NULL when the target is not a vocabulary index."""
    chosen = F.when(target >= 0, F.get(logits, target))
    return logsumexp(logits) - chosen


def token_entropy(logits: Column) -> Column:
    return entropy(logits)


def token_likelihoods(scores: DataFrame, keep: list[str]) -> DataFrame:
    """Per token: ``nll`` and ``token_entropy`` next to the ``keep`` columns.

    Rejects ignored targets (-100) instead of averaging over them.
    """
    ok = F.col("target_id") >= 0
    checked = F.when(ok, F.col("logits")).otherwise(F.raise_error(F.lit("a target id is the ignore index")))

    def both(logits: Column) -> Column:
        return F.struct(
            token_nll(logits, F.col("target_id")).alias("nll"), token_entropy(logits).alias("token_entropy")
        )

    return scores.select(*keep, let(checked, both).alias("_t")).select(*keep, "_t.nll", "_t.token_entropy")


def likelihood_summary(scores: DataFrame, sample: str = "sample_id") -> DataFrame:
    """Per (sample, generation, conditioned): Σ NLL, token count, mean token entropy.

    ``scores`` has a boolean ``conditioned`` (with or without the prompt in front). Rows
    whose gen_id is NULL describe the prompt itself; they form the prompt-only row of a
    sample, whose length counts the unscored first token too. The token arrays of the
    summary are the rows of ``token_likelihoods``.
    """
    keys = [sample, "gen_id", "conditioned"]
    tokens = token_likelihoods(scores, [*keys, "token_pos"])
    extra = F.when(F.col("gen_id").isNull(), F.lit(1)).otherwise(F.lit(0))
    return (
        tokens.groupBy(*keys)
        .agg(
            F.sum("nll").alias("neg_log_likelihood"),
            F.count(F.lit(1)).alias("_n"),
            F.avg("token_entropy").alias("mean_token_entropy"),
        )
        .withColumn("length", (F.col("_n") + extra).cast("bigint"))
        .drop("_n")
    )


def sequence_embedding(hidden: DataFrame, layer: int, keys: list[str]) -> DataFrame:
    """Mean last-layer vector over a sequence's positions, the last position excluded.

    One map-side pass: the sum of all vectors less the last one. A sequence of one position
    has no row.
    """
    rows = hidden.filter(F.col("layer") == layer).withColumn("vec", F.col("vec").cast("array<double>"))
    sums = sum_vector(
        rows, keys, "vec", "_sum", F.max_by("vec", "token_pos").alias("_last"), F.count(F.lit(1)).alias("_n")
    )
    mean = F.zip_with("_sum", "_last", lambda s, x: (s - x) / (F.col("_n") - 1))
    return sums.filter(F.col("_n") > 1).select(*keys, mean.alias("embedding"))
