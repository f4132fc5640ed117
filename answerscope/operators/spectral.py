"""Spectral consistency of a sample's generations.

Input is the long table ``hidden_states`` (sample_id, batch_id, gen_id, token_pos, layer,
vec) or any table with one vector per generation. Pooling selects or averages vectors with
column-pruned filters and map-side sums; scoring then needs, per sample, the K x K
covariance between generations (each vector centred by its own mean).

Samples of at most ``limit`` generations are scored from their collected vectors. A larger
sample is never collected: it is dealt into blocks, each block is reduced to its moments
(n, Σx, Σxxᵀ), the moments add up across blocks, and the score follows exactly from them,
because C = XXᵀ and XᵀX have the same non-zero eigenvalues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions import dense
from answerscope.functions.arrays import let, log10_det, softmax_weighted_mean, vec_distance, vec_stride
from answerscope.operators.groups import (
    GROUP_LIMIT,
    ROWS_PER_BUCKET,
    broadcast_narrow,
    hash_block,
    pair_tiles,
    positions,
    split_by_size,
)
from answerscope.operators.vectors import sum_vector

# Ridge of the scores, ridge of the determinant score's companion
# spectrum, stride over dimensions, and the default layer bands.
RIDGE = 1e-3
COMPANION_RIDGE = 1.0
DIMENSION_STRIDE = 40
BAND = (10, 35)

SAMPLE = "sample_id"


# --- pooling: one vector per (sample, generation[, layer]) -------------------------


def middle_layer(num_layers: int) -> int:
    return num_layers // 2


LENGTHS = {"num_tokens", "last_step"}


def with_lengths(hidden: DataFrame, counts: DataFrame) -> DataFrame:
    """``hidden`` with ``num_tokens`` and ``last_step`` of its generation on every row.

    For the job that writes the table, once: pooling then needs no join.
    """
    last = hidden.groupBy(SAMPLE, "gen_id").agg(F.max("token_pos").alias("last_step"))
    lengths = last.join(counts.select(SAMPLE, "gen_id", "num_tokens"), [SAMPLE, "gen_id"])
    return hidden.join(lengths, [SAMPLE, "gen_id"])


def pool_last_token(
    hidden: DataFrame, counts: DataFrame, layers: list[int] | None = None, compat: bool = False
) -> DataFrame:
    """Vector at step num_tokens-2 of each generation, per layer.

    Steps are clamped to the positions a generation has; ``compat`` wraps step -1 to the
    last position instead of clamping it to 0. ``last_step`` tells how long the generation
    was. A table written ``with_lengths`` carries both numbers, and the step is a filter at
    the scan: nothing is shuffled. Otherwise positions are resolved from the id columns and
    joined; beyond the broadcast bound that join moves the vectors.
    """
    rows = hidden if layers is None else hidden.filter(F.col("layer").isin(layers))
    if LENGTHS <= set(hidden.columns):
        step = F.col("num_tokens") - 2
        low = F.when(step < 0, F.col("last_step") if compat else F.lit(0)).otherwise(step)
        at_step = rows.filter(F.col("token_pos") == F.least(low, F.col("last_step")))
        return at_step.select(SAMPLE, "gen_id", "layer", "last_step", F.col("vec").cast("array<double>").alias("vec"))
    last = rows.groupBy(SAMPLE, "gen_id").agg(F.max("token_pos").alias("last_step"))
    step = F.col("num_tokens") - 2
    low = F.when(step < 0, F.col("last_step") if compat else F.lit(0)).otherwise(step)
    target = last.join(counts.select(SAMPLE, "gen_id", "num_tokens"), [SAMPLE, "gen_id"]).select(
        SAMPLE, "gen_id", "last_step", F.least(low, F.col("last_step")).alias("token_pos")
    )
    return rows.select(SAMPLE, "gen_id", "layer", "token_pos", "vec").join(
        broadcast_narrow(target, counts.count()), [SAMPLE, "gen_id", "token_pos"]
    ).select(SAMPLE, "gen_id", "layer", "last_step", F.col("vec").cast("array<double>").alias("vec"))


def _scaled(summed: DataFrame, divisor: Column, keep: list[str]) -> DataFrame:
    """Sum vector divided by ``divisor`` (NULL vector when the divisor is 0)."""
    d = F.nullif(divisor.cast("double"), F.lit(0.0))
    return summed.withColumn("_d", d).select(
        *keep, F.when(F.col("_d").isNotNull(), F.transform("vec", lambda x: x / F.col("_d"))).alias("vec")
    )


def pool_mean_tokens(
    hidden: DataFrame, counts: DataFrame, layers: list[int] | None = None, compat: bool = False
) -> DataFrame:
    """Mean over steps 1..num_tokens per generation and layer.

    ``compat`` divides by num_tokens-1 instead of the number of steps summed. Vectors of a
    table written ``with_lengths`` are summed map-side before anything moves.
    """
    rows = hidden if layers is None else hidden.filter(F.col("layer").isin(layers))
    inside = rows.filter(F.col("token_pos") >= 1)
    if not LENGTHS <= set(hidden.columns):
        lengths = broadcast_narrow(counts.select(SAMPLE, "gen_id", "num_tokens"), counts.count())
        inside = inside.join(lengths, [SAMPLE, "gen_id"])
    inside = inside.filter(F.col("token_pos") <= F.col("num_tokens"))
    keys = [SAMPLE, "gen_id", "layer"]
    summed = sum_vector(
        inside, keys, "vec", "vec", F.count(F.lit(1)).alias("_terms"), F.first("num_tokens").alias("_tokens")
    )
    return _scaled(summed, F.col("_tokens") - 1 if compat else F.col("_terms"), keys)


def pool_mean_all(hidden: DataFrame, layer: int) -> DataFrame:
    """Mean over all steps >= 1 of one layer."""
    rows = hidden.filter((F.col("layer") == layer) & (F.col("token_pos") >= 1))
    keys = [SAMPLE, "gen_id"]
    return _scaled(sum_vector(rows, keys, "vec", "vec", F.count(F.lit(1)).alias("_n")), F.col("_n"), keys)


def pool_layer_band(hidden: DataFrame, lo: int = BAND[0], hi: int = BAND[1], compat: bool = False) -> DataFrame:
    """Mean over layers lo..hi (inclusive) and steps >= 1.

    ``compat`` divides the layer sum by hi-lo instead of the number of layers.
    """
    rows = hidden.filter(F.col("layer").between(lo, hi) & (F.col("token_pos") >= 1))
    keys = [SAMPLE, "gen_id"]
    summed = sum_vector(
        rows, keys, "vec", "vec", F.count(F.lit(1)).alias("_n"), F.max("token_pos").alias("_steps")
    )
    return _scaled(summed, F.col("_steps") * (hi - lo) if compat else F.col("_n"), keys)


def greedy_features(hidden: DataFrame, layer: int) -> DataFrame:
    """Mean over steps >= 1 of the greedy answer, one vector per sample (``feature``)."""
    rows = hidden.filter((F.col("layer") == layer) & (F.col("token_pos") >= 1))
    summed = sum_vector(rows, [SAMPLE], "vec", "vec", F.count(F.lit(1)).alias("_n"))
    return _scaled(summed, F.col("_n"), [SAMPLE]).withColumnRenamed("vec", "feature")


def strided(pooled: DataFrame, step: int = DIMENSION_STRIDE, col: str = "vec") -> DataFrame:
    return pooled.withColumn(col, vec_stride(F.col(col), step))


# --- scoring: from vectors per generation to one number per sample -----------------


def _moments(big: DataFrame, keys: list[str], centre_rows: bool, limit: int) -> DataFrame:
    """Moments of oversized samples, summed over bounded blocks."""
    blocks = F.ceil(F.col("group_rows") / F.lit(limit)).cast("int")
    dealt = big.withColumn("_b", hash_block(F.col("gen_id"), blocks))
    per_block = dealt.groupBy(*keys, "_b").agg(F.collect_list("vec").alias("_v"))
    partial = per_block.select(*keys, dense.block_moments(centre_rows)("_v").alias("moments"))
    return sum_vector(partial, keys, "moments", "moments")


def _sized(
    pooled: DataFrame, keys: list[str], limit: int, probe: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Splits by the number of generations, which only needs the id columns.

    ``probe`` (one row per sample and generation) replaces the pooled rows when given.
    """
    by = keys if probe is None else [SAMPLE]
    small, big = split_by_size(pooled.select(*keys, "gen_id", "vec"), by, limit, probe)
    usable = F.col("vec").isNotNull()
    return small.filter(usable), None if big is None else big.filter(usable)


def _by_sample(
    pooled: DataFrame, keys: list[str], small_value, big_value, centre_rows: bool, limit: int, out: str,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Applies ``small_value`` to collected vectors and ``big_value`` to moments."""
    small, big = _sized(pooled, keys, limit, probe)
    grouped = small.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("k"),
        F.first(F.size("vec")).alias("dim"),
        F.collect_list("vec").alias("_v"),
    )
    scored = grouped.select(*keys, "k", "dim", small_value(F.col("_v")).alias(out))
    if big is None:
        return scored
    sums = _moments(big, keys, centre_rows, limit)
    k = F.col("moments")[0].cast("int")
    dim = F.floor((F.sqrt(4 * F.size("moments") - 3) - 1) / 2 + 0.5).cast("int")
    return scored.unionByName(
        sums.select(*keys, k.alias("k"), dim.alias("dim"), big_value(F.col("moments")).alias(out))
    )


def log10_det_score(
    pooled: DataFrame, keys: list[str] | None = None, ridge: float = RIDGE, limit: int = GROUP_LIMIT,
    probe: DataFrame | None = None,
) -> DataFrame:
    """log10 det(C + ridge·I) per sample, next to the number of generations ``k``."""
    keys = keys or [SAMPLE]
    return _by_sample(
        pooled, keys, dense.generation_log_det(ridge), dense.generation_log_det_from_moments(ridge),
        True, limit, "log10_det", probe,
    ).drop("dim")


def spectral_score(
    pooled: DataFrame, keys: list[str] | None = None, ridge: float = RIDGE, limit: int = GROUP_LIMIT,
    probe: DataFrame | None = None,
) -> DataFrame:
    """mean log10 of the spectrum of C + ridge·I per sample = log10 det / K."""
    keys = keys or [SAMPLE]
    det = log10_det_score(pooled, keys, ridge, limit, probe)
    return det.select(*keys, (F.col("log10_det") / F.col("k")).alias("spectral_score"))


def spectrum(
    pooled: DataFrame, keys: list[str] | None = None, ridge: float = RIDGE, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Singular values of C + ridge·I per sample, largest first."""
    keys = keys or [SAMPLE]
    return _by_sample(
        pooled, keys, dense.generation_spectrum(ridge), dense.generation_spectrum_from_moments(ridge),
        True, limit, "spectrum",
    ).select(*keys, "spectrum")


def with_short_samples(scores: DataFrame, hidden: DataFrame, score: str = "spectral_score") -> DataFrame:
    """Adds the samples that produced no step beyond the prompt: score 0, other columns NULL."""
    longest = hidden.groupBy(SAMPLE).agg(F.max("token_pos").alias("_last"))
    short = F.col("_last") < 1
    others = [F.when(~short, F.col(c)).alias(c) for c in scores.columns if c not in (SAMPLE, score)]
    value = F.when(short, F.lit(0.0)).otherwise(F.col(score))
    return longest.join(scores, SAMPLE, "left").select(SAMPLE, value.alias(score), *others)


def gen_covariance(
    pooled: DataFrame, keys: list[str] | None = None, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Covariance between generations: (sample, i, j, cov) with i <= j, each pair once.

    Computed by tiles: one for a sample within the limit, one for each pair of blocks of a
    larger one. The rows are the same either way.
    """
    keys = keys or [SAMPLE]
    rows = pooled.filter(F.col("vec").isNotNull())
    item = F.struct("gen_id", "vec")
    tiles = pair_tiles(rows, keys, item, F.col("gen_id"), limit, probe=pooled.select(*keys))
    blocks = tiles.select(
        *keys,
        (F.col("lo") == F.col("hi")).alias("same"),
        F.transform("left_items", lambda s: s["gen_id"]).alias("a"),
        F.transform("right_items", lambda s: s["gen_id"]).alias("b"),
        dense.cross_covariance()(
            F.transform("left_items", lambda s: s["vec"]), F.transform("right_items", lambda s: s["vec"])
        ).alias("cov"),
    )
    lines = blocks.select(*keys, "same", "b", F.explode(F.arrays_zip("a", "cov")).alias("r"))
    cells = lines.select(
        *keys, "same", F.col("r.a").alias("a"), F.explode(F.arrays_zip("b", F.col("r.cov").alias("cov"))).alias("c")
    )
    # a block with itself holds every pair in both orders, two blocks each pair in one of them
    once = cells.filter(~F.col("same") | (F.col("a") <= F.col("c.b")))
    return once.select(
        *keys, F.least("a", "c.b").alias("i"), F.greatest("a", "c.b").alias("j"), F.col("c.cov").alias("cov")
    )


def spectral_score_native(
    pooled: DataFrame, keys: list[str] | None = None, ridge: float = RIDGE, limit: int = GROUP_LIMIT,
    largest: int = GROUP_LIMIT,
) -> DataFrame:
    """``spectral_score`` from covariance rows and the JVM elimination alone.

    A sample's matrix stands in one row, so samples of more than ``largest`` generations
    are refused with an error; ``spectral_score`` has no such bound.
    """
    keys = keys or [SAMPLE]
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "cov")))
    rows = gen_covariance(pooled, keys, limit).groupBy(*keys).agg(
        F.count_if(F.col("i") == F.col("j")).cast("int").alias("k"), F.transform(cells, lambda c: c["cov"]).alias("flat")
    )
    fits = F.when(F.col("k") <= largest, F.col("k")).otherwise(
        F.raise_error(F.lit(f"a sample has more than {largest} generations")).cast("int")
    )
    rows = rows.withColumn("k", fits)

    def cell(r: Column, c: Column) -> Column:
        """The upper triangle lies in ``flat`` row by row."""
        lo, hi = F.least(r, c), F.greatest(r, c)
        value = F.get(F.col("flat"), (lo * F.col("k") - (lo * (lo - 1) / 2).cast("int") + hi - lo).cast("int"))
        return value + F.when(r == c, F.lit(ridge)).otherwise(F.lit(0.0))

    places = F.sequence(F.lit(0), F.col("k") - 1)
    matrix = F.transform(places, lambda r: F.transform(places, lambda c: cell(r, c)))
    return rows.select(*keys, (let(matrix, log10_det) / F.col("k")).alias("spectral_score"))


# --- scores over layers -------------------------------------------------------------


def layer_score_rows(
    hidden: DataFrame, counts: DataFrame, lo: int, hi: int, pool: str = "last_token", compat: bool = False,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """(sample, layer, spectral_score) for layers lo..hi, over all merged generations."""
    layers = list(range(lo, hi + 1))
    pooled = (pool_last_token if pool == "last_token" else pool_mean_tokens)(hidden, counts, layers, compat)
    return spectral_score(pooled, [SAMPLE, "layer"], limit=limit, probe=counts.select(SAMPLE))


def layer_score_array(rows: DataFrame) -> DataFrame:
    """One ordered array of per-layer scores per sample (one entry per model layer)."""
    packed = F.array_sort(F.collect_list(F.struct("layer", "spectral_score")))
    return rows.groupBy(SAMPLE).agg(F.transform(packed, lambda s: s["spectral_score"]).alias("layer_scores"))


def layer_mean_score(rows: DataFrame) -> DataFrame:
    return rows.groupBy(SAMPLE).agg(F.avg("spectral_score").alias("layer_mean_score"))


def layer_softmax_score(rows: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Σ softmax(E/T)·E over the layers."""
    return layer_score_array(rows).select(
        SAMPLE, softmax_weighted_mean(F.col("layer_scores"), temperature).alias("layer_softmax_score")
    )


def layer_gaussian_score(rows: DataFrame, num_layers: int) -> DataFrame:
    """Layer mean weighted by exp(-(l-μ)²/2σ²), μ = L/2, σ = L/4."""
    mu, sigma = num_layers / 2.0, num_layers / 4.0
    gap = F.col("layer") - F.lit(mu)
    w = F.exp(-(gap * gap) / F.lit(2.0 * sigma * sigma))
    return rows.groupBy(SAMPLE).agg(
        (F.sum(w * F.col("spectral_score")) / F.sum(w)).alias("layer_gaussian_score")
    )


def layer_band_mean_score(
    hidden: DataFrame, counts: DataFrame, num_layers: int, skip: int = 20, drop_last: int = 2, compat: bool = False
) -> DataFrame:
    """Mean over layers [skip, L - drop_last) of the mean-token score; other layers are not read."""
    rows = layer_score_rows(hidden, counts, skip, num_layers - drop_last - 1, "mean_tokens", compat)
    return rows.groupBy(SAMPLE).agg(F.avg("spectral_score").alias("layer_band_mean_score"))


def layer_band_pooled_score(
    hidden: DataFrame, lo: int = BAND[0], hi: int = BAND[1], compat: bool = False
) -> DataFrame:
    return spectral_score(pool_layer_band(hidden, lo, hi, compat)).withColumnRenamed(
        "spectral_score", "layer_band_pooled_score"
    )


# --- covariance between dimensions --------------------------------------------------


def feature_spectral_score(
    pooled: DataFrame, ridge: float = RIDGE, limit: int = GROUP_LIMIT
) -> DataFrame:
    """mean log10 of the spectrum of the D x D covariance between dimensions + ridge·I."""
    det = _by_sample(
        pooled, [SAMPLE], dense.feature_log_det(ridge), dense.feature_log_det_from_moments(ridge),
        False, limit, "_ld",
    )
    return det.select(SAMPLE, (F.col("_ld") / F.col("dim")).alias("feature_spectral_score"))


def gaussian_loglik_score(
    pooled: DataFrame, features: DataFrame, ridge: float = RIDGE, limit: int = GROUP_LIMIT
) -> DataFrame:
    """-Mahalanobis² of the sample's feature vector - ln det of the regularised covariance."""
    small, big = _sized(pooled, [SAMPLE], limit, None)
    grouped = small.groupBy(SAMPLE).agg(F.collect_list("vec").alias("_v")).join(features, SAMPLE)
    out = "gaussian_loglik_score"
    scored = grouped.select(SAMPLE, dense.gaussian_loglik(ridge)("_v", "feature").alias(out))
    if big is None:
        return scored
    sums = _moments(big, [SAMPLE], False, limit).join(features, SAMPLE)
    return scored.unionByName(
        sums.select(SAMPLE, dense.gaussian_loglik_from_moments(ridge)("moments", "feature").alias(out))
    )


def nearest_half(
    pooled: DataFrame, features: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The floor(K/2) generations of each sample closest (L2) to its feature vector.

    Equal distances are settled by the smaller generation number.
    """
    rows = pooled.join(features, SAMPLE).withColumn("distance", vec_distance(F.col("vec"), F.col("feature")))
    ranked = rows.select(SAMPLE, "gen_id", "distance")
    placed = positions(
        ranked, [SAMPLE], ["distance", "gen_id"],
        rows_per_bucket=rows_per_bucket, probe=pooled.select(SAMPLE), cut_lineage=True,
    )
    sizes = ranked.groupBy(SAMPLE).agg(F.count(F.lit(1)).alias("_k"))
    near = placed.join(sizes, SAMPLE).filter(F.col("position") <= F.floor(F.col("_k") / 2))
    return near.select(SAMPLE, "gen_id", "distance", F.col("position").cast("int").alias("position"))

