import numpy as np
import pytest
from pyspark.sql import functions as F

from answerscope.operators import evaluate as H
from answerscope.operators import masks as J
from answerscope.operators import regress as I

RNG = np.random.default_rng(3)


def brute_auc(y, s):
    pos, neg = [v for v, l in zip(s, y) if l == 1], [v for v, l in zip(s, y) if l == 0]
    if not pos or not neg:
        return None
    return np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])


def brute_threshold(y, s):
    pts = [(float("inf"), 0.0, 0.0)]
    y, s = np.array(y), np.array(s)
    for t in sorted(set(s), reverse=True):
        pts.append((t, np.mean(s[y == 1] >= t), np.mean(s[y == 0] >= t)))
    g = [np.sqrt(tp * (1 - fp)) for _, tp, fp in pts]
    return pts[int(np.argmax(g))][0]


CASES = {
    "plain": (RNG.integers(0, 2, 200), RNG.normal(size=200)),
    "ties": (RNG.integers(0, 2, 300), RNG.integers(0, 5, 300) / 4.0),
    "constant": (RNG.integers(0, 2, 50), np.ones(50)),
    "one_class": (np.ones(20, dtype=int), RNG.normal(size=20)),
    "hot": (RNG.integers(0, 2, 300), np.where(RNG.random(300) < 0.5, 0.0, RNG.normal(size=300))),
    "reversed": (np.array([1, 1, 0, 0]), np.array([0.0, 0.1, 0.5, 0.6])),
}


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(m, int(y), float(s), float(s) * 2 + 1) for m, (ys, ss) in CASES.items() for y, s in zip(ys, ss)]
    return spark.createDataFrame(rows, "method string, label int, score double, similarity double").cache()


@pytest.mark.parametrize("per_bucket", [20, 1_000_000])
def test_separation(scored, per_bucket):
    out = {r["method"]: r for r in H.separation(scored, ["method"], rows_per_bucket=per_bucket).collect()}
    for m, (y, s) in CASES.items():
        want = brute_auc(y, s)
        if want is None:
            assert out[m]["auroc"] is None and out[m]["threshold"] is None and out[m]["detection_accuracy"] is None
            continue
        t = brute_threshold(y, s)
        assert out[m]["auroc"] == pytest.approx(want)
        assert out[m]["threshold"] == t
        assert out[m]["detection_accuracy"] == pytest.approx(np.mean((s >= t) == (y == 1)))


def test_auroc_invariances(scored):
    rows = scored.filter("method = 'plain'")
    base = H.auroc(rows, ["method"]).first()["auroc"]
    cubed = rows.withColumn("score", F.pow("score", F.lit(3)) + 5)
    flipped = rows.withColumn("score", -F.col("score"))
    assert H.auroc(cubed, ["method"]).first()["auroc"] == pytest.approx(base)
    assert H.auroc(flipped, ["method"]).first()["auroc"] == pytest.approx(1 - base)
    assert H.auroc(rows.drop("method"), []).first()["auroc"] == pytest.approx(base)


@pytest.mark.parametrize("per_bucket", [20, 1_000_000])
def test_curve(scored, per_bucket):
    rows = H.roc_curve(scored.filter("method = 'ties'"), ["method"], rows_per_bucket=per_bucket).orderBy(F.desc("threshold")).collect()
    assert len(rows) == 6 and rows[0]["threshold"] == float("inf") and (rows[0]["fpr"], rows[0]["tpr"]) == (0.0, 0.0)
    assert (rows[-1]["fpr"], rows[-1]["tpr"]) == (1.0, 1.0)
    area = sum((b["fpr"] - a["fpr"]) * (a["tpr"] + b["tpr"]) / 2 for a, b in zip(rows, rows[1:]))
    assert area == pytest.approx(brute_auc(*CASES["ties"]))


def test_pearson_of_constant_is_null(scored):
    out = {r["method"]: r["pcc"] for r in H.pearson(scored, ["method"]).collect()}
    assert out["constant"] is None and out["plain"] == pytest.approx(1.0)


def test_correctness(spark):
    df = spark.createDataFrame(
        [(1, "the cat", "a cat", ["dog"]), (2, "dog", "cat", ["dog", "x"]), (3, "cow", "pig", [])],
        "id int, most_likely_generation string, answer string, additional_answers array<string>",
    )
    one = {r["id"]: r["label"] for r in H.correctness(df, "exact").collect()}
    many = {r["id"]: r["label"] for r in H.correctness(df, "exact", multi_reference=True).collect()}
    rouge = {r["id"]: r["label"] for r in H.correctness(df, "rouge", multi_reference=True).collect()}
    assert one == {1: 1, 2: 0, 3: 0} and many == {1: 1, 2: 1, 3: 0} and rouge == {1: 0, 2: 1, 3: 0}
    assert H.uses_references("CoQA") and not H.uses_references("SQuAD")


# --- layer weights ------------------------------------------------------------------


def objective(x, y, w, b, c, mix):
    z = x @ w + b
    loss = np.logaddexp(0, z).sum() - (y * z).sum()
    return c * loss + mix * np.abs(w).sum() + (1 - mix) / 2 * (w @ w)


def proximal_fit(x, y, c, mix, steps=20000):
    """Plain proximal gradient descent on the summed-loss objective."""
    w, b = np.zeros(x.shape[1]), 0.0
    rate = 1.0 / (c * 0.25 * (np.linalg.norm(np.c_[x, np.ones(len(x))], 2) ** 2) + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w = w - rate * (c * x.T @ (p - y) + (1 - mix) * w)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * mix, 0)
        b -= rate * c * (p - y).sum()
    return w, b


@pytest.mark.parametrize("penalty,mix", [("elasticnet", 0.5), ("l1", 1.0), ("l2", 0.0)])
def test_regression_reaches_the_optimum(spark, penalty, mix):
    x = RNG.normal(size=(300, 6))
    true = np.array([1.5, 0, -1.0, 0, 0, 0.3])
    y = (RNG.random(300) < 1 / (1 + np.exp(-(x @ true)))).astype(int)
    df = spark.createDataFrame([(i, r.tolist(), int(l)) for i, (r, l) in enumerate(zip(x, y))], "id int, layer_scores array<double>, label int")
    model = I.fit_layer_weights(df, penalty, C=0.1)
    w, b = np.array(I.weights_of(model)), model.intercept
    best = objective(x, y, *proximal_fit(x, y, 0.1, mix), 0.1, mix)
    assert objective(x, y, w, b, 0.1, mix) == pytest.approx(best, rel=1e-4)
    if penalty != "l2":
        assert (np.abs(w) <= I.NONZERO).any()
    metrics = I.fit_metrics(model, df.withColumn("split", F.lit("train"))).first()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert metrics["accuracy"] == pytest.approx(np.mean((p > 0.5) == y))
    assert metrics["auroc"] == pytest.approx(brute_auc(y, p))


def test_weighted_vs_mean(spark):
    x = RNG.normal(size=(80, 3))
    rows = [(r.tolist(), float(r[0]), int(r[0] > 0), float(r[1]), int(r[1] > 0.3)) for r in x]
    df = spark.createDataFrame(rows, "layer_scores array<double>, rouge_score double, y_rouge int, sim_score double, y_sim int")
    out = {r["measure"]: r for r in I.weighted_vs_mean(df, [1.0, 0.0, 0.0]).collect()}
    assert out["rouge"]["auc_weighted"] == 1.0 and out["rouge"]["pcc_weighted"] == pytest.approx(1.0)
    want = brute_auc(x[:, 1] > 0.3, x.mean(axis=1))
    assert out["cosine"]["auc_baseline"] == pytest.approx(want)
    assert out["cosine"]["improvement"] == pytest.approx(out["cosine"]["auc_weighted"] - want)


# --- masks --------------------------------------------------------------------------


@pytest.mark.parametrize("per_bucket", [10, 1_000_000])
def test_masks(spark, per_bucket):
    imp = RNG.integers(0, 30, size=(6, 40)).astype(float)
    wt = RNG.normal(size=imp.shape)
    cells = spark.createDataFrame(
        [(i, j, float(imp[i, j]), float(wt[i, j])) for i in range(6) for j in range(40)], "row int, col int, importance double, weight double"
    )

    def grid(df):
        out = np.full(imp.shape, np.nan)
        for r in df.collect():
            out[r["row"], r["col"]] = r["weight"]
        return out

    k = int(0.2 * 40)
    per_row = np.array([np.where(r <= np.sort(r)[k - 1], 0.0, w) for r, w in zip(imp, wt)])
    assert (grid(J.mask_bottom_k_per_row(cells, 20.0, per_bucket)) == per_row).all()
    t = np.sort(imp.ravel())[int(0.1 * imp.size) - 1]
    assert (grid(J.mask_bottom_k_global(cells, 10.0, per_bucket)) == np.where(imp <= t, 0.0, wt)).all()
    weak = np.argsort(np.linalg.norm(imp, axis=0), kind="stable")[: int(0.25 * 40)]
    cut = wt.copy()
    cut[:, weak] = 0.0
    assert (grid(J.mask_weak_columns(cells, 25.0, per_bucket)) == cut).all()
    assert (grid(J.mask_bottom_k_global(cells, 0.1, per_bucket)) == wt).all()  # k = 0 masks nothing


@pytest.mark.parametrize("partitions", [1, 4, 200])
def test_pearson_of_a_constant_is_null(spark, partitions):
    """However the partial aggregates are merged."""
    df = spark.range(400).select(F.lit("m").alias("method"), (F.col("id") % 7 / 10).alias("similarity"), F.lit(0.1).alias("score"))
    df = df.repartition(partitions)
    assert H.pearson(df, ["method"]).first()["pcc"] is None
    assert H.pearson(df, ["method"], x="score", y="similarity").first()["pcc"] is None


def test_curves_without_keys_and_many_scores(spark):
    """One global curve, its totals as literals, in a window and in pieces."""
    df = spark.range(500).select(((F.col("id") * 37) % 251 / 10).alias("score"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    want = H.separation(df, []).first()
    got = H.separation(df, [], rows_per_bucket=20)
    assert tuple(got.first()) == pytest.approx(tuple(want))
    assert "NestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert H.auroc(df, [], rows_per_bucket=20).first()[0] == pytest.approx(H.auroc(df.withColumn("k", F.lit(1)), ["k"]).first()["auroc"])
    assert H.roc_curve(df, [], rows_per_bucket=20).count() == H.roc_curve(df, []).count()
