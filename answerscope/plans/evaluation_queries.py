"""Registered queries: labels, curves, reports, layer weights and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.operators import evaluate as H
from answerscope.operators import masks as J
from answerscope.operators import regress as I
from answerscope.operators.sampling import stratified_split, with_features
from answerscope.plans import views as V
from answerscope.plans.registry import query, r6
from answerscope.plans.sql import f_measure, lcs, logistic_ctes, stem_ctes, stemmed, tokens
from answerscope.plans.text_queries import _normal

SIGNS = ", ".join(f"{'-' if s < 0 else ''}{c} AS {c}" for c, s in H.ORIENTATION.items())
NAMES = ", ".join(H.ORIENTATION)


def _melt_sql(source: str, keep: str) -> str:
    return f"SELECT {keep}, method, score + 0.0::DOUBLE AS score FROM (SELECT {keep}, {SIGNS} FROM ({source})) UNPIVOT INCLUDE NULLS (score FOR method IN ({NAMES}))"


def _curve(rows: str, keys: str) -> str:
    """CTEs rows -> counts per score -> cumulative counts -> AUROC, threshold, accuracy."""
    return f"""
rows_ AS ({rows}),
cnt AS (SELECT {keys}, score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM rows_ GROUP BY {keys}, score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS "P", sum(neg) OVER g AS "N"
        FROM cnt WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC), g AS (PARTITION BY {keys})),
pts AS (SELECT *, CASE WHEN "P" > 0 THEN tp / "P"::DOUBLE END AS tpr, CASE WHEN "N" > 0 THEN fp / "N"::DOUBLE END AS fpr FROM cum),
auc AS (SELECT {keys}, sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / nullif(max("P" * "N"), 0)::DOUBLE AS auroc FROM cum GROUP BY {keys}),
gm AS (SELECT *, sqrt(tpr * (1 - fpr)) AS g FROM pts),
top AS (SELECT {keys}, g, score, row_number() OVER (PARTITION BY {keys} ORDER BY g DESC NULLS LAST, score DESC) AS rn FROM gm),
thr AS (SELECT {keys}, CASE WHEN g IS NULL THEN NULL WHEN g = 0 THEN 'inf'::DOUBLE ELSE score END AS threshold FROM top WHERE rn = 1)"""


def _pcc(x: str = "similarity", y: str = "score") -> str:
    return f"covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0)"


DOC_ROWS = _melt_sql(V.SCORED_DOCS, "label, similarity")


def _doc_scores(spark, sf):
    return H.orient_and_melt(V.scored_docs(spark, sf), ["label", "similarity"])


# --- labels -------------------------------------------------------------------------


@query("correctness_rouge", f"""
SELECT id, round({f_measure('l', 'len(p)', 'len(r)')}, 6) AS similarity, CAST({f_measure('l', 'len(p)', 'len(r)')} > 0.5 AS INT) AS label
FROM (SELECT *, {lcs('p', 'r')} AS l FROM (SELECT id, {tokens('prediction')} AS p, {tokens('answer')} AS r FROM ({V.RECORDS})))""")
def _rouge(spark, sf):
    out = H.correctness(V.records(spark, sf), "rouge", stem=False, prediction="prediction")
    return out.select("id", r6(F.col("similarity")).alias("similarity"), "label")


@query("correctness_rouge_stemmed", f"""
WITH {stem_ctes(f"SELECT DISTINCT unnest({tokens('prediction')} || {tokens('answer')}) AS token FROM ({V.RECORDS})")},
k AS ({stemmed(f'({V.RECORDS})', 'id', ['prediction', 'answer'])}),
s AS (SELECT id, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l FROM (SELECT id, prediction_s AS p, answer_s AS r FROM k)))
SELECT id, round(f, 6) AS similarity, CAST(f > 0.5 AS INT) AS label FROM s""")
def _rouge_stemmed(spark, sf):
    out = H.correctness(V.records(spark, sf), "rouge", prediction="prediction")
    return out.select("id", r6(F.col("similarity")).alias("similarity"), "label")


@query("correctness_exact", f"""
WITH r AS (SELECT id, most_likely_generation AS p, unnest([answer] || additional_answers) AS ref FROM ({V.RECORDS}))
SELECT id, max(CAST({_normal('p')} = {_normal('ref')} AS INT)) + 0.0::DOUBLE AS similarity, max(CAST({_normal('p')} = {_normal('ref')} AS INT)) AS label FROM r GROUP BY 1""")
def _exact(spark, sf):
    out = H.correctness(V.records(spark, sf), "exact", multi_reference=True)
    return out.select("id", "similarity", "label")


@query("correctness_cosine", f"""
SELECT a.sample_id, b.gen_id, round(list_cosine_similarity(a.vec, b.vec), 6) + 0 AS similarity, CAST(list_cosine_similarity(a.vec, b.vec) > 0.9 AS INT) AS label
FROM ({V.SPECTRAL_SAMPLES}) a JOIN ({V.SPECTRAL_SAMPLES}) b ON a.sample_id = b.sample_id AND a.gen_id = 0""")
def _cosine(spark, sf):
    v = V.spectral_samples(spark, sf)
    first = v.filter("gen_id = 0").select("sample_id", F.col("vec").alias("best"))
    out = H.correctness(v.join(first, "sample_id"), "cosine", prediction="best", answer="vec")
    return out.select("sample_id", "gen_id", r6(F.col("similarity")).alias("similarity"), "label")


@query("accuracy", f"SELECT lang, round(avg(label), 6) AS accuracy FROM ({V.SCORED_DOCS}) GROUP BY 1")
def _accuracy(spark, sf):
    return H.accuracy(V.scored_docs(spark, sf), ["lang"]).select("lang", r6(F.col("accuracy")).alias("accuracy"))


@query("orient_and_melt", f"SELECT doc_id, method, round(score, 6) + 0 AS score FROM ({_melt_sql(V.SCORED_DOCS, 'doc_id')})")
def _melt(spark, sf):
    out = H.orient_and_melt(V.scored_docs(spark, sf), ["doc_id"])
    return out.select("doc_id", "method", r6(F.col("score")).alias("score"))


# --- curves -------------------------------------------------------------------------


@query("roc_curve", f"""
WITH {_curve(DOC_ROWS, 'method')}
SELECT method, round(score, 6) + 0 AS threshold, round(fpr, 6) AS fpr, round(tpr, 6) AS tpr FROM pts
UNION ALL SELECT DISTINCT method, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM pts""")
def _roc(spark, sf):
    out = H.roc_curve(_doc_scores(spark, sf), ["method"])
    return out.select("method", r6(F.col("threshold")).alias("threshold"), r6(F.col("fpr")).alias("fpr"), r6(F.col("tpr")).alias("tpr"))


@query("auroc", f"WITH {_curve(DOC_ROWS, 'method')} SELECT method, round(auroc, 6) AS auroc FROM auc")
def _auroc(spark, sf):
    return H.auroc(_doc_scores(spark, sf), ["method"]).select("method", r6(F.col("auroc")).alias("auroc"))


@query("auroc_orders", """
WITH c AS (SELECT o_orderpriority AS priority, o_totalprice AS s, CAST(o_orderstatus = 'F' AS INT) AS y FROM orders),
r AS (SELECT *, rank() OVER (PARTITION BY priority ORDER BY s) + (count(*) OVER (PARTITION BY priority, s) - 1) / 2.0::DOUBLE AS rk FROM c),
a AS (SELECT priority, sum(CASE WHEN y = 1 THEN rk END) AS rs, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS n FROM r GROUP BY 1)
SELECT priority, round((rs - p * (p + 1) / 2) / nullif(p * n, 0), 6) AS auroc FROM a""")
def _auroc_orders(spark, sf):
    """The same curve over a large table; the oracle uses rank sums instead."""
    o = V.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("score"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    return H.auroc(o, ["priority"]).select("priority", r6(F.col("auroc")).alias("auroc"))


@query("best_threshold", f"WITH {_curve(DOC_ROWS, 'method')} SELECT method, round(threshold, 6) + 0 AS threshold FROM thr")
def _threshold(spark, sf):
    out = H.best_threshold(_doc_scores(spark, sf), ["method"], digits=None)
    return out.select("method", r6(F.col("threshold")).alias("threshold"))


@query("best_threshold_rounded", f"WITH {_curve(DOC_ROWS, 'method')} SELECT method, round(threshold, 4) + 0 AS threshold FROM thr")
def _threshold4(spark, sf):
    out = H.best_threshold(_doc_scores(spark, sf), ["method"])
    return out.select("method", (F.col("threshold") + F.lit(0.0)).alias("threshold"))


@query("detection_accuracy", f"""
WITH {_curve(DOC_ROWS, 'method')}
SELECT method, round(avg(CASE WHEN (score >= round(threshold, 4)) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS detection_accuracy
FROM rows_ JOIN thr USING (method) GROUP BY 1""")
def _detection(spark, sf):
    out = H.detection_accuracy(_doc_scores(spark, sf), ["method"])
    return out.select("method", r6(F.col("detection_accuracy")).alias("detection_accuracy"))


@query("pearson", f"SELECT method, round({_pcc()}, 6) AS pcc FROM ({DOC_ROWS}) GROUP BY 1")
def _pearson(spark, sf):
    return H.pearson(_doc_scores(spark, sf), ["method"]).select("method", r6(F.col("pcc")).alias("pcc"))


# --- reports ------------------------------------------------------------------------


@query("evaluate_run", f"""
WITH {_curve(_melt_sql(V.SCORED_DOCS, 'lang, label, similarity'), 'lang, method')},
acc AS (SELECT lang, method, avg(CASE WHEN (score >= round(threshold, 4)) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS a
        FROM rows_ JOIN thr USING (lang, method) WHERE threshold IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT lang, method, {_pcc()} AS pcc FROM rows_ GROUP BY 1, 2)
SELECT lang, method, round(auroc, 6) AS auroc, round(threshold, 4) + 0 AS threshold, round(a, 6) AS detection_accuracy, round(pcc, 6) AS pcc
FROM auc JOIN thr USING (lang, method) LEFT JOIN acc USING (lang, method) JOIN pc USING (lang, method)""")
def _evaluate_run(spark, sf):
    out = H.evaluate_run(V.scored_docs(spark, sf), ["lang"])
    return out.select(
        "lang", "method", r6(F.col("auroc")).alias("auroc"), (F.col("threshold") + F.lit(0.0)).alias("threshold"),
        r6(F.col("detection_accuracy")).alias("detection_accuracy"), r6(F.col("pcc")).alias("pcc"),
    )


def _measures(spark, sf):
    """Both correctness measures of every document, one row each; documents are read and scored once."""
    d = V.scored_docs(spark, sf)
    scores = V.SCORES
    row = lambda name, similarity, label: F.struct(
        F.lit(name).alias("measure"), F.col(similarity).alias("similarity"), F.col(label).cast("int").alias("label")
    )
    both = F.explode(F.array(row("rouge", "similarity", "label"), row("cosine", "other_similarity", "other_label")))
    return d.select("lang", *scores, both.alias("m")).select("m.measure", "lang", "m.similarity", "m.label", *scores)


_MEASURES = f"""
SELECT 'rouge' AS measure, lang, similarity, label, {NAMES} FROM ({V.SCORED_DOCS})
UNION ALL SELECT 'cosine', lang, other_similarity, other_label, {NAMES} FROM ({V.SCORED_DOCS})"""


def _table_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
WITH {_curve(_melt_sql(_MEASURES, 'measure, lang, label, similarity'), f'{k}measure, method')},
pc AS (SELECT {k}measure, method, {_pcc()} AS pcc FROM rows_ GROUP BY ALL),
both_ AS (SELECT * FROM auc JOIN pc USING ({k}measure, method)),
piv AS (SELECT {k}method, max(CASE WHEN measure = 'cosine' THEN auroc END) AS s, max(CASE WHEN measure = 'rouge' THEN auroc END) AS r,
               max(CASE WHEN measure = 'cosine' THEN pcc END) AS p FROM both_ GROUP BY ALL)"""


_PLACES = ", ".join(f"({i}, '{m}', '{n}')" for i, (m, n) in enumerate(H.PAPER_ROWS, 1))


@query("paper_table", f"""
{_table_sql('')}
SELECT place, printed AS method, round(s * 100, 1) AS auc_s, round(r * 100, 1) AS auc_r, round(p * 100, 1) + 0 AS pcc
FROM piv JOIN (VALUES {_PLACES}) AS o(place, name, printed) ON piv.method = o.name""")
def _paper(spark, sf):
    return H.paper_table(_measures(spark, sf)).withColumn("pcc", F.col("pcc") + F.lit(0.0))


@query("compare_runs", f"""
{_table_sql('lang')}
SELECT lang AS run, method, round(s * 100, 1) AS auc_s, round(r * 100, 1) AS auc_r, round(p * 100, 1) + 0 AS pcc FROM piv WHERE method = 'spectral_score'""")
def _compare(spark, sf):
    """Languages stand in for runs."""
    out = H.compare_runs(_measures(spark, sf).withColumnRenamed("lang", "run"))
    return out.withColumn("pcc", F.col("pcc") + F.lit(0.0))


# --- layer weights ------------------------------------------------------------------

# Fixed weights for the scoring queries: a smooth sign-changing profile over all entries.
WEIGHTS = [((i * 7) % 11 - 5) / 4.0 if i % 3 else 0.0 for i in range(64)]
_W = "[" + ", ".join(f"{w}::DOUBLE" for w in WEIGHTS) + "]"


@query("with_features", f"""
SELECT id, len(generations) AS n FROM ({V.RECORDS}) WHERE len(generations) > 0""")
def _with_features(spark, sf):
    r = V.records(spark, sf)
    lengths = F.transform("generations", lambda g: F.length(g).cast("double"))
    return with_features(r.withColumn("layer_scores", lengths)).select("id", F.size("layer_scores").cast("bigint").alias("n"))


@query("features_and_labels", f"""
SELECT id, round(list_sum(list_transform(generations, lambda g: length(g)::DOUBLE)), 6) AS total, round({f_measure('l', 'len(p)', 'len(r)')}, 6) AS similarity,
       CAST({f_measure('l', 'len(p)', 'len(r)')} > 0.5 AS INT) AS label
FROM (SELECT *, {lcs('p', 'r')} AS l FROM (SELECT id, generations, {tokens('prediction')} AS p, {tokens('answer')} AS r FROM ({V.RECORDS}) WHERE len(generations) > 0))""")
def _features_labels(spark, sf):
    lengths = F.transform("generations", lambda g: F.length(g).cast("double"))
    r = V.records(spark, sf).withColumn("layer_scores", lengths).withColumn("most_likely_generation", F.col("prediction"))
    out = I.features_and_labels(r, stem=False)
    return out.select("id", r6(F.aggregate("layer_scores", F.lit(0.0), lambda a, x: a + x)).alias("total"), r6(F.col("similarity")).alias("similarity"), "label")


@query("label_distribution", f"SELECT label, count(*) AS n FROM ({V.LAYER_FEATURES}) GROUP BY 1")
def _labels(spark, sf):
    return I.label_distribution(V.layer_features(spark, sf))


@query("weighted_score", f"""
SELECT id, round(list_dot_product(layer_scores, {_W}), 6) + 0 AS weighted, round(list_avg(layer_scores), 6) + 0 AS baseline FROM ({V.LAYER_FEATURES})""")
def _weighted(spark, sf):
    f = F.col("layer_scores")
    return V.layer_features(spark, sf).select(
        "id", r6(I.weighted_score(f, WEIGHTS)).alias("weighted"), r6(I.mean_layer_score(f)).alias("baseline")
    )


@query("weight_stats", f"""
SELECT label, count(*) AS num_features, CAST(sum(CASE WHEN abs(w) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS num_nonzero, round(min(w), 6) AS min_weight, round(max(w), 6) AS max_weight,
       round(avg(w), 6) + 0 AS mean_weight, round(stddev_pop(w), 6) AS std_weight
FROM (SELECT label, unnest(layer_scores) AS w FROM ({V.LAYER_FEATURES})) GROUP BY 1""")
def _stats(spark, sf):
    long = V.layer_features(spark, sf).select("label", F.posexplode("layer_scores").alias("layer", "weight"))
    out = I.weight_stats(long, ["label"])
    return out.select("label", "num_features", "num_nonzero", *[r6(F.col(f"{c}_weight")).alias(f"{c}_weight") for c in ("min", "max", "mean", "std")])


@query("weighted_vs_mean", f"""
WITH f AS (SELECT list_dot_product(layer_scores, {_W}) AS weighted, list_avg(layer_scores) AS baseline, * FROM ({V.MEASURED_FEATURES})),
m AS (SELECT 'rouge' AS measure, rouge_score AS similarity, y_rouge AS label, weighted, baseline FROM f
      UNION ALL SELECT 'cosine', sim_score, y_sim, weighted, baseline FROM f),
{_curve("SELECT measure, similarity, label, kind, score FROM m UNPIVOT (score FOR kind IN (weighted, baseline))", 'measure, kind')},
pc AS (SELECT measure, kind, {_pcc()} AS pcc FROM rows_ GROUP BY 1, 2),
j AS (SELECT * FROM auc JOIN thr USING (measure, kind) JOIN pc USING (measure, kind))
SELECT measure, round(w.auroc, 6) AS auc_weighted, round(b.auroc, 6) AS auc_baseline, round(w.threshold, 6) + 0 AS threshold_weighted, round(b.threshold, 6) + 0 AS threshold_baseline,
       round(w.pcc, 6) AS pcc_weighted, round(b.pcc, 6) AS pcc_baseline, round(w.auroc - b.auroc, 6) + 0 AS improvement
FROM (SELECT * FROM j WHERE kind = 'weighted') w JOIN (SELECT * FROM j WHERE kind = 'baseline') b USING (measure)""")
def _weighted_vs_mean(spark, sf):
    out = I.weighted_vs_mean(V.measured_features(spark, sf), WEIGHTS)
    return out.select("measure", *[r6(F.col(c)).alias(c) for c in out.columns if c != "measure"])


def split_ctes(source: str) -> str:
    """CTEs ending in ``parted``: ``source`` (id, label, ...) with its 80:20 split."""
    return f"""
split_n AS (SELECT label AS s, count(*) AS n FROM ({source}) GROUP BY 1),
split_t AS (SELECT *, ceil(sum(n) OVER () * 0.2::DOUBLE) AS test, sum(n) OVER () AS total FROM split_n),
split_f AS (SELECT s, floor(n * test / total) AS fl, n * test / total - floor(n * test / total) AS frac, test FROM split_t),
split_q AS (SELECT s, fl + CASE WHEN row_number() OVER (ORDER BY frac DESC, s) <= test - sum(fl) OVER () THEN 1 ELSE 0 END AS quota FROM split_f),
split_r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || id)) AS rn FROM ({source})),
parted AS (SELECT r.*, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM split_r r JOIN split_q q ON r.label = q.s)"""


SPLIT = split_ctes(V.LAYER_FEATURES)
_TRAIN = "SELECT * FROM parted WHERE split = 'train'"


def metrics_ctes(name: str, out: str) -> str:
    """CTEs ending in ``out(split, accuracy, n, auroc)`` of a fitted model ``name``."""
    rows = f"SELECT split, label, 1 / (1 + exp(-(list_dot_product(layer_scores, w) + b))) AS score FROM parted, {name}"
    return f"""
{out}_rows AS ({rows}),
{out} AS (SELECT * FROM (SELECT split, avg(CAST((score > 0.5) = (label = 1) AS INT)) AS accuracy, count(*) AS n FROM {out}_rows GROUP BY 1)
  JOIN (SELECT p.split, avg(CASE WHEN p.score > q.score THEN 1.0::DOUBLE WHEN p.score = q.score THEN 0.5 ELSE 0 END) AS auroc
        FROM {out}_rows p JOIN {out}_rows q ON p.split = q.split AND p.label = 1 AND q.label = 0 GROUP BY 1) USING (split))"""


def _fitted(spark, sf, penalty):
    df = stratified_split(V.layer_features(spark, sf), "label", 0.2, 42)
    return df, I.fit_layer_weights(df.filter("split = 'train'"), penalty, C=10.0)


@query("fit_layer_weights", f"""
WITH RECURSIVE {SPLIT}, {logistic_ctes(_TRAIN, 64, 10.0, 0.5, 'net')}, {logistic_ctes(_TRAIN, 64, 10.0, 0.0, 'ridge')}
SELECT 'elasticnet' AS penalty, CAST(generate_subscripts(w, 1) - 1 AS INT) AS layer, round(unnest(w), 3) + 0 AS weight FROM net
UNION ALL SELECT 'l2', CAST(generate_subscripts(w, 1) - 1 AS INT), round(unnest(w), 3) + 0 FROM ridge""")
def _fit(spark, sf):
    """Fitted weights in long form, for two penalties."""
    rows = []
    for penalty in ("elasticnet", "l2"):
        rows += [(penalty, i, w) for i, w in enumerate(I.weights_of(_fitted(spark, sf, penalty)[1]))]
    out = spark.createDataFrame(rows, "penalty string, layer int, weight double")
    return out.select("penalty", "layer", (F.round("weight", 3) + F.lit(0.0)).alias("weight"))


@query("fit_metrics", f"""
WITH RECURSIVE {SPLIT}, {logistic_ctes(_TRAIN, 64, 10.0, 0.5, 'net')}, {metrics_ctes('net', 'm')}
SELECT split, round(accuracy, 6) AS accuracy, n, round(auroc, 3) AS auroc FROM m""")
def _fit_metrics(spark, sf):
    df, model = _fitted(spark, sf, "elasticnet")
    out = I.fit_metrics(model, df)
    return out.select("split", r6(F.col("accuracy")).alias("accuracy"), "n", F.round("auroc", 3).alias("auroc"))


# --- masks --------------------------------------------------------------------------

M = V.MATRIX


def _r4(df):
    return df.select("row", "col", r6(F.col("weight")).alias("weight"))


@query("mask_bottom_k_per_row", f"""
WITH m AS ({M}), k AS (SELECT row, CAST(floor(20 / 100.0::DOUBLE * count(*)) AS BIGINT) AS k FROM m GROUP BY 1),
r AS (SELECT row, importance, row_number() OVER (PARTITION BY row ORDER BY importance) AS rn FROM m),
t AS (SELECT row, importance AS t FROM r JOIN k USING (row) WHERE rn = k)
SELECT row, col, CASE WHEN importance <= t THEN 0.0::DOUBLE ELSE weight END AS weight FROM m LEFT JOIN t USING (row)""")
def _mask_row(spark, sf):
    return _r4(J.mask_bottom_k_per_row(V.matrix(spark, sf), 20.0))


@query("mask_bottom_k_global", f"""
WITH m AS ({M}), r AS (SELECT importance, row_number() OVER (ORDER BY importance) AS rn, count(*) OVER () AS n FROM m),
t AS (SELECT importance AS t FROM r WHERE rn = CAST(floor(10 / 100.0::DOUBLE * n) AS BIGINT))
SELECT row, col, CASE WHEN importance <= (SELECT t FROM t) THEN 0.0::DOUBLE ELSE weight END AS weight FROM m""")
def _mask_global(spark, sf):
    return _r4(J.mask_bottom_k_global(V.matrix(spark, sf), 10.0))


@query("mask_weak_columns", f"""
WITH m AS ({M}), n AS (SELECT col, sqrt(sum(importance * importance)) AS norm FROM m GROUP BY 1),
r AS (SELECT col, row_number() OVER (ORDER BY norm, col) AS rn, count(*) OVER () AS c FROM n)
SELECT row, m.col, CASE WHEN rn <= floor(12 / 100.0::DOUBLE * c) THEN 0.0::DOUBLE ELSE weight END AS weight FROM m JOIN r USING (col)""")
def _mask_cols(spark, sf):
    return _r4(J.mask_weak_columns(V.matrix(spark, sf), 12.0))
