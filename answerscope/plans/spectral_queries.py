"""Registered queries: spectral scores over vectors and hidden states."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions.arrays import cosine_similarity, vec_dot, vec_norm, vec_stride
from answerscope.operators import spectral as S
from answerscope.operators.evaluate import auroc
from answerscope.operators.sampling import merge_batches
from answerscope.operators.vectors import encode_text, mean_vector
from answerscope.plans import views as V
from answerscope.plans.registry import query, r6
from answerscope.plans.sql import log_det_ctes

MID = S.middle_layer(V.NUM_LAYERS)
STRIDE = 4  # D' = 16 of 64 dimensions
LAST = V.NUM_LAYERS - 2

# --- shared oracle pieces -----------------------------------------------------------

_LAST_STEP = f"""
SELECT h.sample_id, h.gen_id, h.layer, h.vec
FROM ({V.HIDDEN_STATES}) h
JOIN ({V.TOKEN_COUNTS}) c USING (sample_id, gen_id)
JOIN (SELECT sample_id, gen_id, max(token_pos) AS top FROM ({V.HIDDEN_STATES}) GROUP BY ALL) l USING (sample_id, gen_id)
WHERE h.token_pos = least(greatest(c.num_tokens - 2, 0), l.top)"""


def _mean_of(where: str, keys: str, divisor: str = "count(*)", source: str = V.HIDDEN_STATES) -> str:
    """Element-wise sum / divisor over the rows selected by ``where``."""
    return f"""
SELECT {keys}, list(v ORDER BY d) AS vec FROM (
  SELECT {keys}, d, sum(x) / ({divisor}) AS v FROM (
    SELECT h.*, c.num_tokens, unnest(vec) AS x, generate_subscripts(vec, 1) AS d
    FROM ({source}) h JOIN ({V.TOKEN_COUNTS}) c USING (sample_id, gen_id) WHERE {where})
  GROUP BY {keys}, d) GROUP BY {keys}"""


_MEAN_TOKENS = _mean_of("token_pos >= 1 AND token_pos <= c.num_tokens", "sample_id, gen_id, layer")
_BAND = _mean_of("token_pos >= 1 AND layer BETWEEN 1 AND 3", "sample_id, gen_id")
_MEAN_ALL = _mean_of(f"token_pos >= 1 AND layer = {LAST}", "sample_id, gen_id")
_FEATURE = _mean_of(f"token_pos >= 1 AND layer = {LAST} AND gen_id = 0", "sample_id")
_EVERY = "list_filter({0}, lambda x, i: (i - 1) % " + str(STRIDE) + " = 0)"


def _score(pooled: str, key: str = "sample_id", name: str = "spectral_score") -> str:
    return f"WITH RECURSIVE {log_det_ctes(pooled, key)} SELECT {key}, round(ld / k, 6) AS {name} FROM det"


_LAYER_ROWS = f"{log_det_ctes(_LAST_STEP, 'sample_id, layer')}, scores AS (SELECT sample_id, layer, ld / k AS e FROM det)"


def _long(df, vec="vec", keys=("sample_id", "gen_id")):
    """A vector table as (keys, dim, value) rows for comparison."""
    rows = df.select(*keys, F.posexplode(vec).alias("dim", "value"))
    return rows.select(*keys, "dim", r6(F.col("value")).alias("value"))


def _long_sql(src: str, keys: str = "sample_id, gen_id", vec: str = "vec") -> str:
    return f"""SELECT {keys}, dim, round(value, 6) + 0 AS value
FROM (SELECT {keys}, unnest({vec}) AS value, CAST(generate_subscripts({vec}, 1) - 1 AS INT) AS dim FROM ({src}))"""


def _hidden(spark, sf):
    return V.hidden_states(spark, sf), V.token_counts(spark, sf)


def _greedy(hidden):
    """Generation 0 stands in for the greedy answer."""
    return S.greedy_features(hidden.filter("gen_id = 0"), LAST)


# --- flagship -----------------------------------------------------------------------


def flagship(spark, sf):
    """Spectral score of every sample's vectors, evaluated as a detector of one label."""
    scores = S.spectral_score(V.spectral_samples(spark, sf))
    truth = V.table(spark, sf, "embeddings").groupBy(F.expr("vec_id div 10").alias("sample_id")).agg(
        F.max((F.col("label") >= 9).cast("int")).alias("label")
    )
    rows = scores.join(truth, "sample_id").select((-F.col("spectral_score")).alias("score"), "label", F.lit("spectral_score").alias("method"))
    return auroc(rows, ["method"]).select("method", r6(F.col("auroc")).alias("auroc"))


query("spectral_auroc", f"""
WITH RECURSIVE {log_det_ctes(V.SPECTRAL_SAMPLES, 'sample_id')},
s AS (SELECT sample_id, -ld / k AS score, label FROM det
      JOIN (SELECT vec_id // 10 AS sample_id, max(CAST(label >= 9 AS INT)) AS label FROM embeddings GROUP BY 1) USING (sample_id))
SELECT 'spectral_score' AS method, round(avg(CASE WHEN p.score > n.score THEN 1.0::DOUBLE WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auroc
FROM s p JOIN s n ON p.label = 1 AND n.label = 0""")(flagship)


# --- vectors ------------------------------------------------------------------------


@query("vec_mean", f"""
SELECT sample_id, CAST(d - 1 AS INT) AS dim, round(avg(x), 6) + 0 AS value
FROM (SELECT sample_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d FROM ({V.SPECTRAL_SAMPLES})) GROUP BY 1, d""")
def _vec_mean(spark, sf):
    return _long(mean_vector(V.spectral_samples(spark, sf), ["sample_id"]), "vec", ("sample_id",))


@query("vec_dot_norm_stride", f"""
SELECT sample_id, gen_id, round(list_dot_product(vec, list_reverse(vec)), 6) + 0 AS dot,
       round(sqrt(list_dot_product(vec, vec)), 6) AS norm, round(list_sum({_EVERY.format('vec')}), 6) + 0 AS strided_sum
FROM ({V.SPECTRAL_SAMPLES})""")
def _vec_algebra(spark, sf):
    v = F.col("vec")
    return V.spectral_samples(spark, sf).select(
        "sample_id", "gen_id",
        r6(vec_dot(v, F.reverse(v))).alias("dot"),
        r6(vec_norm(v)).alias("norm"),
        r6(F.aggregate(vec_stride(v, STRIDE), F.lit(0.0), lambda a, x: a + x)).alias("strided_sum"),
    )


@query("cosine_similarity", f"""
SELECT a.sample_id, b.gen_id, round(list_cosine_similarity(a.vec, b.vec), 6) + 0 AS cosine,
       CAST(list_cosine_similarity(a.vec, b.vec) > 0.9 AS INT) AS similar
FROM ({V.SPECTRAL_SAMPLES}) a JOIN ({V.SPECTRAL_SAMPLES}) b ON a.sample_id = b.sample_id AND a.gen_id = 0""")
def _cosine(spark, sf):
    v = V.spectral_samples(spark, sf)
    first = v.filter("gen_id = 0").select("sample_id", F.col("vec").alias("best"))
    cos = v.join(first, "sample_id").select("sample_id", "gen_id", cosine_similarity(F.col("best"), F.col("vec")).alias("c"))
    return cos.select("sample_id", "gen_id", r6(F.col("c")).alias("cosine"), (F.col("c") > 0.9).cast("int").alias("similar"))


_LETTERS = "aeinrst"


@query("encode_text", f"""
SELECT sample_id, gen_id, length(text) + 0.0::DOUBLE AS n,
       {", ".join(f"length(text) - length(replace(text, '{c}', '')) + 0.0::DOUBLE AS n_{c}" for c in _LETTERS)} FROM ({V.CONV_ANSWERS})""")
def _encode(spark, sf):
    """An encoder that counts letters stands in for a sentence model."""

    def make_predict_fn():
        import numpy as np

        def predict(texts):
            return np.array([[len(t), *(t.count(c) for c in _LETTERS)] for t in texts], dtype=float)

        return predict

    out = encode_text(V.conv_answers(spark, sf), "text", make_predict_fn)
    names = ["n", *(f"n_{c}" for c in _LETTERS)]
    return out.select("sample_id", "gen_id", *[F.col("vec")[i].alias(c) for i, c in enumerate(names)])


# --- pooling ------------------------------------------------------------------------


@query("pool_last_token", _long_sql(f"SELECT * FROM ({_LAST_STEP}) WHERE layer = {MID}"))
def _pool_last(spark, sf):
    return _long(S.pool_last_token(*_hidden(spark, sf), layers=[MID]))


@query("pool_last_token_compat", _long_sql(_LAST_STEP.replace(
    "least(greatest(c.num_tokens - 2, 0), l.top)",
    f"CASE WHEN c.num_tokens < 2 THEN l.top ELSE least(c.num_tokens - 2, l.top) END AND h.layer = {MID}")))
def _pool_last_compat(spark, sf):
    """Step -1 wraps to the last position."""
    return _long(S.pool_last_token(*_hidden(spark, sf), layers=[MID], compat=True))


@query("pool_mean_tokens", _long_sql(f"SELECT * FROM ({_MEAN_TOKENS}) WHERE layer = {MID}"))
def _pool_mean(spark, sf):
    return _long(S.pool_mean_tokens(*_hidden(spark, sf), layers=[MID]))


@query("pool_mean_tokens_compat", _long_sql(_mean_of(
    f"token_pos >= 1 AND token_pos <= c.num_tokens AND layer = {MID} AND c.num_tokens > 1", "sample_id, gen_id", "max(num_tokens) - 1")))
def _pool_mean_compat(spark, sf):
    return _long(S.pool_mean_tokens(*_hidden(spark, sf), layers=[MID], compat=True))


@query("pool_mean_all", _long_sql(_MEAN_ALL))
def _pool_all(spark, sf):
    return _long(S.pool_mean_all(V.hidden_states(spark, sf), LAST))


@query("pool_layer_band", _long_sql(_BAND))
def _pool_band(spark, sf):
    return _long(S.pool_layer_band(V.hidden_states(spark, sf), 1, 3))


@query("pool_layer_band_compat", _long_sql(_mean_of(
    "token_pos >= 1 AND layer BETWEEN 1 AND 3", "sample_id, gen_id", "2 * max(token_pos)")))
def _pool_band_compat(spark, sf):
    return _long(S.pool_layer_band(V.hidden_states(spark, sf), 1, 3, compat=True))


@query("best_answer_features", _long_sql(_FEATURE, "sample_id"))
def _features(spark, sf):
    return _long(_greedy(V.hidden_states(spark, sf)), "feature", ("sample_id",))


@query("merge_batches", f"""
SELECT sample_id, layer, token_pos, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY batch_id, gen_id) - 1 AS INT) AS gen_id,
       batch_id, round(list_sum(vec), 6) + 0 AS total
FROM (SELECT * REPLACE (CAST(gen_id % 2 AS INT) AS gen_id) FROM ({V.HIDDEN_STATES}))""")
def _merge(spark, sf):
    """Generation numbers restart in every batch before the merge."""
    h = V.hidden_states(spark, sf).withColumn("gen_id", (F.col("gen_id") % 2).cast("int"))
    return merge_batches(h).select(
        "sample_id", "layer", "token_pos", F.col("gen_id"), "batch_id",
        r6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


# --- scores -------------------------------------------------------------------------


@query("gen_covariance", f"""
WITH RECURSIVE {log_det_ctes(V.SPECTRAL_SAMPLES, 'sample_id', 0.0)}
SELECT sample_id, i, j, round(v, 6) + 0 AS cov FROM cov WHERE i <= j""")
def _covariance(spark, sf):
    cells = S.gen_covariance(V.spectral_samples(spark, sf))
    return cells.select("sample_id", "i", "j", r6(F.col("cov")).alias("cov"))


@query("spectrum", f"""
WITH RECURSIVE {log_det_ctes(V.SPECTRAL_SAMPLES, 'sample_id')},
t AS (SELECT sample_id, sum(CASE WHEN i = j THEN v END) AS trace, sum(v * v) AS square FROM cov GROUP BY 1)
SELECT sample_id, k, round(trace, 6) AS trace, round(square, 6) AS square, round(ld, 6) AS log10_product, TRUE AS descending
FROM t JOIN det USING (sample_id)""")
def _spectrum(spark, sf):
    """The spectrum's size, sum, sum of squares and product pin it down for the oracle."""
    s = S.spectrum(V.spectral_samples(spark, sf))
    total = lambda f: F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + f(x))
    return s.select(
        "sample_id", F.size("spectrum").alias("k"),
        r6(total(lambda x: x)).alias("trace"), r6(total(lambda x: x * x)).alias("square"),
        r6(total(F.log10)).alias("log10_product"),
        (F.col("spectrum") == F.sort_array("spectrum", asc=False)).alias("descending"),
    )


@query("output_spectral_score", _score(V.SPECTRAL_SAMPLES, name="output_spectral_score"))
def _output(spark, sf):
    out = S.spectral_score(V.spectral_samples(spark, sf))
    return out.select("sample_id", r6(F.col("spectral_score")).alias("output_spectral_score"))


@query("spectral_score_native", _score(V.SPECTRAL_SAMPLES))
def _native(spark, sf):
    """The same score from covariance rows and the JVM elimination."""
    out = S.spectral_score_native(V.spectral_samples(spark, sf))
    return out.select("sample_id", r6(F.col("spectral_score")).alias("spectral_score"))


@query("spectral_score_last_token", _score(f"SELECT * FROM ({_LAST_STEP}) WHERE layer = {MID}"))
def _last_token(spark, sf):
    h, c = _hidden(spark, sf)
    s = S.spectral_score(S.pool_last_token(h, c, [MID]), probe=c.select("sample_id"))
    return S.with_short_samples(s, h).select("sample_id", r6(F.col("spectral_score")).alias("spectral_score"))


@query("spectral_score_last_batch", _score(f"""
SELECT p.* FROM ({_LAST_STEP}) p JOIN (SELECT DISTINCT sample_id, gen_id, batch_id FROM ({V.HIDDEN_STATES})) b USING (sample_id, gen_id)
WHERE layer = {MID} AND b.batch_id = (SELECT max(x.batch_id) FROM ({V.HIDDEN_STATES}) x WHERE x.sample_id = p.sample_id)"""))
def _last_batch(spark, sf):
    """Compatible scope: only the last batch of generations."""
    from answerscope.operators.tokens import last_batch

    h, c = _hidden(spark, sf)
    s = S.spectral_score(S.pool_last_token(last_batch(h), c, [MID]), probe=c.select("sample_id"))
    return s.select("sample_id", r6(F.col("spectral_score")).alias("spectral_score"))


@query("spectral_score_mean_tokens", _score(f"SELECT * FROM ({_MEAN_TOKENS}) WHERE layer = {MID}"))
def _mean_tokens(spark, sf):
    h, c = _hidden(spark, sf)
    s = S.spectral_score(S.pool_mean_tokens(h, c, [MID]), probe=c.select("sample_id"))
    return s.select("sample_id", r6(F.col("spectral_score")).alias("spectral_score"))


@query("log10_det_score", f"""
WITH RECURSIVE {log_det_ctes(_MEAN_ALL, 'sample_id')},
t AS (SELECT sample_id, sum(CASE WHEN i = j THEN v - 0.001 + 1.0 END) AS companion FROM cov GROUP BY 1)
SELECT sample_id, round(ld, 6) AS log10_det, round(companion, 6) AS companion_trace FROM det JOIN t USING (sample_id)""")
def _det(spark, sf):
    """Determinant score and the sum of its companion spectrum, whose ridge is 1."""
    pooled = S.pool_mean_all(V.hidden_states(spark, sf), LAST)
    det = S.log10_det_score(pooled)
    companion = S.spectrum(pooled, ridge=S.COMPANION_RIDGE)
    total = F.aggregate("spectrum", F.lit(0.0), lambda a, x: a + x)
    return det.join(companion, "sample_id").select(
        "sample_id", r6(F.col("log10_det")).alias("log10_det"), r6(total).alias("companion_trace")
    )


def _layers(spark, sf, lo=0, hi=V.NUM_LAYERS - 1):
    return S.layer_score_rows(*_hidden(spark, sf), lo, hi)


@query("layer_spectral_scores", f"WITH RECURSIVE {_LAYER_ROWS} SELECT sample_id, CAST(layer AS INT) AS layer, round(e, 6) AS score FROM scores")
def _layer_scores(spark, sf):
    arrays = S.layer_score_array(_layers(spark, sf))
    return arrays.select("sample_id", F.posexplode("layer_scores").alias("layer", "s")).select("sample_id", "layer", r6(F.col("s")).alias("score"))


@query("layer_mean_score", f"WITH RECURSIVE {_LAYER_ROWS} SELECT sample_id, round(avg(e), 6) AS layer_mean_score FROM scores WHERE layer BETWEEN 1 AND 3 GROUP BY 1")
def _layer_mean(spark, sf):
    out = S.layer_mean_score(_layers(spark, sf, 1, 3))
    return out.select("sample_id", r6(F.col("layer_mean_score")).alias("layer_mean_score"))


@query("layer_softmax_score", f"""
WITH RECURSIVE {_LAYER_ROWS}
SELECT sample_id, round(sum(exp(e / 0.5) * e) / sum(exp(e / 0.5)), 6) AS layer_softmax_score FROM scores GROUP BY 1""")
def _layer_softmax(spark, sf):
    out = S.layer_softmax_score(_layers(spark, sf), 0.5)
    return out.select("sample_id", r6(F.col("layer_softmax_score")).alias("layer_softmax_score"))


@query("layer_gaussian_score", f"""
WITH RECURSIVE {_LAYER_ROWS},
w AS (SELECT *, exp(-((layer - 2.5::DOUBLE) ** 2) / (2 * 1.25::DOUBLE ** 2)) AS g FROM scores)
SELECT sample_id, round(sum(g * e) / sum(g), 6) AS layer_gaussian_score FROM w GROUP BY 1""")
def _layer_gaussian(spark, sf):
    out = S.layer_gaussian_score(_layers(spark, sf), V.NUM_LAYERS)
    return out.select("sample_id", r6(F.col("layer_gaussian_score")).alias("layer_gaussian_score"))


@query("layer_band_mean_score", f"""
WITH RECURSIVE {log_det_ctes(_MEAN_TOKENS, 'sample_id, layer')}
SELECT sample_id, round(avg(ld / k), 6) AS layer_band_mean_score FROM det WHERE layer BETWEEN 1 AND 2 GROUP BY 1""")
def _band_mean(spark, sf):
    out = S.layer_band_mean_score(*_hidden(spark, sf), V.NUM_LAYERS, skip=1)
    return out.select("sample_id", r6(F.col("layer_band_mean_score")).alias("layer_band_mean_score"))


@query("layer_band_pooled_score", _score(_BAND, name="layer_band_pooled_score"))
def _band_pooled(spark, sf):
    out = S.layer_band_pooled_score(V.hidden_states(spark, sf), 1, 3)
    return out.select("sample_id", r6(F.col("layer_band_pooled_score")).alias("layer_band_pooled_score"))


_STRIDED = f"SELECT sample_id, gen_id, {_EVERY.format('vec')} AS vec FROM ({_MEAN_ALL})"
_FEATURE_STRIDED = f"SELECT sample_id, {_EVERY.format('vec')} AS y FROM ({_FEATURE})"


@query("feature_spectral_score", f"""
WITH RECURSIVE {log_det_ctes(_STRIDED, 'sample_id', centre='column')}
SELECT sample_id, round((ld + (16 - k) * log10(0.001::DOUBLE)) / 16, 6) AS feature_spectral_score FROM det""")
def _feature_score(spark, sf):
    pooled = S.strided(S.pool_mean_all(V.hidden_states(spark, sf), LAST), STRIDE)
    out = S.feature_spectral_score(pooled)
    return out.select("sample_id", r6(F.col("feature_spectral_score")).alias("feature_spectral_score"))


@query("gaussian_loglik_score", f"""
WITH RECURSIVE {log_det_ctes(_STRIDED, 'sample_id', centre='column', log='ln')},
mu AS (SELECT sample_id, list(m ORDER BY d) AS mu FROM (SELECT sample_id, d, avg(x) AS m FROM dims GROUP BY 1, 2) GROUP BY 1),
y AS (SELECT sample_id, list_transform(list_zip(f.y, mu), lambda p: p[1] - p[2]) AS y FROM ({_FEATURE_STRIDED}) f JOIN mu USING (sample_id)),
zy AS (SELECT c.sample_id, list(list_dot_product(c.c, y.y) / sqrt(c.dof) ORDER BY gen_id) AS b, any_value(list_dot_product(y.y, y.y)) AS yy
       FROM cent c JOIN y USING (sample_id) GROUP BY 1),
border AS (SELECT sample_id, k, yy, list_append(list_transform(list_zip(m, b), lambda r: list_append(r[1], r[2])), list_append(b, 0::DOUBLE)) AS m
           FROM mats JOIN zy USING (sample_id)),
el AS (SELECT sample_id, k, yy, m, 0::DOUBLE AS ld FROM border
       UNION ALL
       SELECT sample_id, k, yy, list_transform(m[2:], lambda r: list_transform(r[2:], lambda x, q: x - r[1] * m[1][q + 1] / m[1][1])),
              ld + ln(m[1][1]) FROM el WHERE len(m) > 1)
SELECT sample_id, round(-(yy + m[1][1]) / 0.001 - ld - (16 - k) * ln(0.001::DOUBLE), 4) AS gaussian_loglik_score FROM el WHERE len(m) = 1""")
def _loglik(spark, sf):
    h = V.hidden_states(spark, sf)
    pooled = S.strided(S.pool_mean_all(h, LAST), STRIDE)
    features = S.strided(_greedy(h), STRIDE, "feature")
    out = S.gaussian_loglik_score(pooled, features)
    return out.select("sample_id", (F.round("gaussian_loglik_score", 4) + F.lit(0.0)).alias("gaussian_loglik_score"))


@query("nearest_half", f"""
WITH f AS ({_FEATURE}), p AS ({_MEAN_ALL}),
d AS (SELECT p.sample_id, p.gen_id, list_distance(p.vec, f.vec) AS distance, count(*) OVER (PARTITION BY p.sample_id) AS n FROM p JOIN f USING (sample_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, gen_id) AS position FROM d)
SELECT sample_id, gen_id, round(distance, 6) AS distance, CAST(position AS INT) AS position FROM r WHERE position <= n // 2""")
def _nearest(spark, sf):
    h = V.hidden_states(spark, sf)
    out = S.nearest_half(S.pool_mean_all(h, LAST), _greedy(h))
    return out.select("sample_id", "gen_id", r6(F.col("distance")).alias("distance"), "position")
