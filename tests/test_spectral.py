import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from answerscope.functions import dense
from answerscope.functions.arrays import log10_det, logsumexp, softmax
from answerscope.operators import spectral as S
from answerscope.operators import tokens as T

RNG = np.random.default_rng(7)
SHAPES = {1: (10, 16), 2: (3, 5), 3: (40, 6), 4: (1, 8), 5: (25, 25)}
DATA = {s: RNG.normal(size=shape) for s, shape in SHAPES.items()}


@pytest.fixture(scope="module")
def pooled(spark):
    rows = [(s, g, [float(v) for v in x]) for s, m in DATA.items() for g, x in enumerate(m)]
    return spark.createDataFrame(rows, "sample_id int, gen_id int, vec array<double>").cache()


def ridged(m, ridge=S.RIDGE):
    return np.atleast_2d(np.cov(m)) + ridge * np.eye(len(m))


def values(df, col):
    return {r["sample_id"]: r[col] for r in df.collect()}


@pytest.mark.parametrize("limit", [4, 1024])
def test_score_spectrum_and_determinant(pooled, limit):
    score = values(S.spectral_score(pooled, limit=limit), "spectral_score")
    spec = values(S.spectrum(pooled, limit=limit), "spectrum")
    det = values(S.log10_det_score(pooled, limit=limit), "log10_det")
    for s, m in DATA.items():
        want = np.linalg.svd(ridged(m), compute_uv=False)
        assert spec[s] == pytest.approx(want, abs=1e-9)
        assert score[s] == pytest.approx(np.mean(np.log10(want)), abs=1e-9)
        assert det[s] == pytest.approx(np.log10(want).sum(), abs=1e-8)


def test_companion_ridge(pooled):
    spec = values(S.spectrum(pooled, ridge=S.COMPANION_RIDGE), "spectrum")
    assert spec[1] == pytest.approx(np.linalg.svd(ridged(DATA[1], 1.0), compute_uv=False))


@pytest.mark.parametrize("limit", [4, 1024])
def test_covariance_rows(pooled, limit):
    """The same rows in one tile or many: every pair once, i <= j."""
    cells = {(r["sample_id"], r["i"], r["j"]): r["cov"] for r in S.gen_covariance(pooled, limit=limit).collect()}
    assert S.gen_covariance(pooled, limit=limit).count() == len(cells) == sum(len(m) * (len(m) + 1) // 2 for m in DATA.values())
    for s, m in DATA.items():
        want = np.atleast_2d(np.cov(m))
        for i in range(len(m)):
            assert [cells[s, i, j] for j in range(i, len(m))] == pytest.approx(want[i, i:])


@pytest.mark.parametrize("limit", [4, 1024])
def test_native_score_through_tiles(pooled, limit):
    native, score = (values(f(pooled, limit=limit), "spectral_score") for f in (S.spectral_score_native, S.spectral_score))
    assert native == pytest.approx(score, abs=1e-9)
    with pytest.raises(Exception, match="more than 9 generations"):
        S.spectral_score_native(pooled, largest=9).collect()


@pytest.mark.parametrize("limit", [4, 1024])
def test_feature_scores(spark, pooled, limit):
    several = pooled.filter("sample_id <> 4")
    score = values(S.feature_spectral_score(several, limit=limit), "feature_spectral_score")
    points = {s: RNG.normal(size=m.shape[1]) for s, m in DATA.items()}
    features = spark.createDataFrame([(s, [float(v) for v in p]) for s, p in points.items()], "sample_id int, feature array<double>")
    loglik = values(S.gaussian_loglik_score(several, features, limit=limit), "gaussian_loglik_score")
    for s, m in DATA.items():
        if s == 4:
            continue
        c = np.cov(m.T) + S.RIDGE * np.eye(m.shape[1])
        sv = np.linalg.svd(c, compute_uv=False)
        assert score[s] == pytest.approx(np.mean(np.log10(sv)), abs=1e-8)
        y = points[s] - m.mean(axis=0)
        assert loglik[s] == pytest.approx(-(y @ np.linalg.inv(c) @ y) - np.log(sv).sum(), rel=1e-6)


def test_permutation_and_copies(spark):
    m = RNG.normal(size=(6, 12))
    same = np.tile(m[0], (6, 1))
    rows = [(k, g, x.tolist()) for k, mat in ((1, m), (2, m[::-1]), (3, same)) for g, x in enumerate(mat)]
    score = values(S.spectral_score(spark.createDataFrame(rows, "sample_id int, gen_id int, vec array<double>")), "spectral_score")
    assert score[1] == pytest.approx(score[2]) and score[3] < score[1]


@pytest.mark.parametrize("per_bucket", [5, 10_000])
def test_nearest_half(spark, pooled, per_bucket):
    features = spark.createDataFrame([(s, [0.0] * m.shape[1]) for s, m in DATA.items()], "sample_id int, feature array<double>")
    out = S.nearest_half(pooled, features, per_bucket).collect()
    for s, m in DATA.items():
        want = np.argsort(np.linalg.norm(m, axis=1), kind="stable")[: len(m) // 2]
        assert [r["gen_id"] for r in sorted(out, key=lambda r: r["position"]) if r["sample_id"] == s] == list(want)


HIDDEN = [  # sample, batch, gen, pos, layer: sample 9 has only the prompt step
    (s, g // 2, g, t, layer, [float(v) for v in RNG.normal(size=6)])
    for s, steps in ((1, 4), (9, 1)) for g in range(3) for t in range(steps) for layer in range(3)
]


def test_pooling_against_loops(spark):
    h = spark.createDataFrame(HIDDEN, "sample_id int, batch_id int, gen_id int, token_pos int, layer int, vec array<double>")
    tokens = {0: 1, 1: 3, 2: 9}
    counts = spark.createDataFrame([(s, g, n) for s in (1, 9) for g, n in tokens.items()], "sample_id int, gen_id int, num_tokens int")
    vec = {(s, g, t, layer): np.array(v) for s, _, g, t, layer, v in HIDDEN}
    last = {r["gen_id"]: r["vec"] for r in S.pool_last_token(h, counts, [1]).filter("sample_id = 1").collect()}
    wrap = {r["gen_id"]: r["vec"] for r in S.pool_last_token(h, counts, [1], compat=True).filter("sample_id = 1").collect()}
    mean = {r["gen_id"]: r["vec"] for r in S.pool_mean_tokens(h, counts, [1]).collect()}
    compat = {r["gen_id"]: r["vec"] for r in S.pool_mean_tokens(h, counts, [1], compat=True).collect()}
    for g, n in tokens.items():
        assert last[g] == pytest.approx(vec[1, g, min(max(n - 2, 0), 3), 1])
        assert wrap[g] == pytest.approx(vec[1, g, 3 if n == 1 else min(n - 2, 3), 1])
        steps = [vec[1, g, t, 1] for t in range(1, 4) if t <= n]
        assert mean[g] == pytest.approx(np.mean(steps, axis=0))
        assert compat[g] is None if n == 1 else compat[g] == pytest.approx(np.sum(steps, axis=0) / (n - 1))
    scores = S.with_short_samples(S.spectral_score(S.pool_mean_all(h, 1)), h)
    assert values(scores, "spectral_score")[9] == 0.0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 8), st.integers(2, 9), st.integers(0, 10_000))
def test_moments_identity(k, d, seed):
    x = np.random.default_rng(seed).normal(size=(1, k, d))
    c = dense._row_centred(x)[0]
    direct = np.log10(np.linalg.svd(c @ c.T + 1e-3 * np.eye(k), compute_uv=False)).sum()
    assert dense.log10_det_padded(c.T @ c, k, 1e-3) == pytest.approx(direct, abs=1e-7)


def test_native_determinant_and_softmax(spark):
    m = ridged(DATA[1])
    df = spark.createDataFrame([(m.tolist(), [1.0, 2.0, float("-inf")])], "m array<array<double>>, x array<double>")
    r = df.select(log10_det(F.col("m")).alias("ld"), softmax(F.col("x")).alias("p"), logsumexp(F.col("x")).alias("z")).first()
    assert r["ld"] == pytest.approx(np.linalg.slogdet(m)[1] / np.log(10))
    assert sum(r["p"]) == pytest.approx(1.0) and r["p"][2] == 0.0
    assert r["z"] == pytest.approx(np.logaddexp(1.0, 2.0))


def test_ignored_target_is_rejected(spark):
    df = spark.createDataFrame([(1, -100, [1.0, 2.0])], "k int, target_id int, logits array<double>")
    with pytest.raises(Exception, match="ignore index"):
        T.token_likelihoods(df, ["k"]).collect()
