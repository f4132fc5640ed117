"""Registered queries: whole jobs over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.operators.groups import positions
from answerscope.plans import jobs, token_queries
from answerscope.plans import views as V
from answerscope.operators.prompts import rating_block
from answerscope.plans.registry import ORACLES, query, r6
from answerscope.plans.evaluation_queries import _PLACES, _TRAIN, NAMES, _curve, _melt_sql, _pcc, split_ctes
from answerscope.plans.spectral_queries import MID
from answerscope.plans.text_queries import _bare, _caseless, _clean, _quote
from answerscope.plans.sql import f_measure, lcs, logistic_ctes, tokens
from answerscope.session import scratch_path
from answerscope.sources import results as R

def _rating_text(question: str, answer: str, text: str) -> str:
    """A rating prompt of the first question set in SQL."""
    stripped = f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"
    return f"({_quote(rating_block('coqa'))} || chr(10) || 'Question: ' || {question} || chr(10) || 'Reference: ' || {answer} || chr(10) || 'Answer: ' || {stripped} || chr(10) || 'Rating:')"


_PARTS = {
    "perplexity": "perplexity", "energy": "energy", "length_normalized_entropy": "entropy",
    "lexical_similarity": "lexical_similarity", "spectral_score_last_token": "spectral_score",
    "output_spectral_score": "output_spectral_score",
}
_JOINS = " ".join(f"LEFT JOIN ({ORACLES[q]}) USING (sample_id)" for q in _PARTS)


@query("score_run", f"""
SELECT sample_id, {", ".join(_PARTS.values())}, layers, layer_total
FROM (SELECT sample_id FROM ({V.HIDDEN_STATES}) UNION SELECT sample_id FROM ({V.TOKEN_SCORES})
      UNION SELECT sample_id FROM ({V.CONV_ANSWERS}) UNION SELECT sample_id FROM ({V.SPECTRAL_SAMPLES})) {_JOINS}
LEFT JOIN (SELECT sample_id, CAST(count(*) AS INT) AS layers, round(sum(score), 4) AS layer_total FROM ({ORACLES['layer_spectral_scores']}) GROUP BY 1) USING (sample_id)""")
def _score_run(spark, sf):
    """All scores of every sample that any of the inputs knows."""
    hidden, scores = V.hidden_states(spark, sf), V.token_scores(spark, sf)
    inputs = (hidden, scores, V.conv_answers(spark, sf), V.spectral_samples(spark, sf))
    known = reduce(DataFrame.unionByName, [df.select("sample_id") for df in inputs]).distinct()
    out = jobs.score_run(
        known, scores, scores, V.score_counts(spark, sf), hidden, V.token_counts(spark, sf),
        V.conv_answers(spark, sf), V.spectral_samples(spark, sf), MID, 0, V.NUM_LAYERS - 1, stem=False,
    )
    total = F.aggregate("layer_scores", F.lit(0.0), lambda a, x: a + F.round(x, 6))
    return out.select(
        "sample_id", *[r6(F.col(c)).alias(c) for c in _PARTS.values()],
        F.when(F.col("layer_scores").isNotNull(), F.size("layer_scores")).alias("layers"), F.round(total, 4).alias("layer_total"),
    )


def _auc(score: str, label: str) -> str:
    return f"(SELECT round(avg(CASE WHEN p.{score} > n.{score} THEN 1.0::DOUBLE WHEN p.{score} = n.{score} THEN 0.5 ELSE 0 END), 3) FROM held p JOIN held n ON p.{label} = 1 AND n.{label} = 0)"


def _corr(score: str, x: str) -> str:
    return f"(SELECT round({_pcc(x, score)}, 3) FROM held)"


_COMPARED = {
    f"{value}_{short}_{kind}": make(kind, column)
    for short, label, x in (("r", "label", "similarity"), ("s", "y_sim", "sim_score"))
    for kind in ("weighted", "baseline")
    for value, make, column in (("auc", _auc, label), ("pcc", _corr, x))
}


@query("learn_and_compare", f"""
WITH RECURSIVE src AS (
  SELECT id, [perplexity, entropy, lexical_similarity, output_spectral_score, spectral_score / 10] AS layer_scores, f AS similarity, CAST(f > 0.5 AS INT) AS label, sim_score
  FROM (SELECT *, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l
        FROM (SELECT *, 0.8::DOUBLE + lexical_similarity * 0.2 AS sim_score, {tokens('prediction')} AS p, {tokens('answer')} AS r FROM ({V.RECORDS}))))),
{split_ctes('SELECT * FROM src')}, {logistic_ctes(_TRAIN, 5, 1.0, 0.5)},
held AS (SELECT list_dot_product(layer_scores, w) AS weighted, list_avg(layer_scores) AS baseline, similarity, label, sim_score, CAST(sim_score > 0.9 AS INT) AS y_sim
         FROM parted, fit WHERE split = 'test')
SELECT 'm7' AS model_name, 'squad' AS dataset_name, {", ".join(f"{sql} AS {name}" for name, sql in _COMPARED.items())}""")
def _learn(spark, sf):
    """Fit on labelled records, stored, and compared on held-out ones with the stored weights."""
    base = scratch_path(spark, "learn")
    records = V.records(spark, sf).withColumn("most_likely_generation", F.col("prediction"))
    scores = F.array(*[F.col(c) for c in ("perplexity", "entropy", "lexical_similarity", "output_spectral_score")], F.col("spectral_score") / 10)
    records = records.withColumn("layer_scores", scores)
    jobs.learn_layer_weights(spark, records, base, "m7", "squad", C=1.0, stem=False)
    test = spark.read.parquet(f"{base}/m7_squad/test")
    sims = records.select("id", (F.lit(0.8) + F.col("lexical_similarity") * 0.2).alias("sim_score"))
    out = jobs.compare_scores(spark, test, sims, base, "m7", "squad")
    names = [F.col(c).cast("string").alias(c) for c in ("model_name", "dataset_name")]
    return out.select(*names, *[(F.round(c, 3) + F.lit(0.0)).alias(c) for c in _COMPARED])


@query("clean_generations", f"""
SELECT id, gen_id, {_clean('g')} AS cleaned
FROM (SELECT id, unnest(generations) || '. Q: more' AS g, CAST(generate_subscripts(generations, 1) - 1 AS INT) AS gen_id FROM ({V.RECORDS}))""")
def _clean_generations(spark, sf):
    """Generations that run on into the next question are cut."""
    r = V.records(spark, sf).withColumn("generations", F.transform("generations", lambda g: F.concat(g, F.lit(". Q: more"))))
    return jobs.clean_records(r).select("id", F.posexplode("cleaned").alias("gen_id", "cleaned"))


@query("offline_stages", f"""
WITH g AS (SELECT id, {_clean('s')} AS text, gen_id, [answer] || additional_answers AS refs
           FROM (SELECT *, unnest(generations) AS s, generate_subscripts(generations, 1) - 1 AS gen_id FROM ({V.RECORDS}))),
u AS (SELECT id, gen_id, {_caseless('text')} AS pred, unnest(list_distinct(list_transform(refs, lambda x: {_caseless('x')}))) AS ref FROM g),
s AS (SELECT *, {lcs('p', 'r')} AS l FROM (SELECT *, {tokens('pred')} AS p, {tokens('ref')} AS r FROM u)),
best AS (SELECT id, gen_id, max(CAST({_bare('pred')} = {_bare('ref')} AS INT)) + 0.0::DOUBLE AS em, max({f_measure('l', 'len(p)', 'len(r)')}) AS f FROM s GROUP BY 1, 2),
refs AS (SELECT id, count(*) AS n, round(avg(em), 6) AS exact_match, round(avg(f), 6) AS "rougeL" FROM best GROUP BY 1),
k AS (SELECT id, gen_id, {tokens('text')} AS t FROM g),
pr AS (SELECT a.id, a.t AS p, b.t AS r FROM k a JOIN k b ON a.id = b.id AND a.gen_id < b.gen_id),
lex AS (SELECT id, round(avg({f_measure('l', 'len(p)', 'len(r)')}), 6) AS lexical FROM (SELECT *, {lcs('p', 'r')} AS l FROM pr) GROUP BY 1),
q AS (SELECT g.id, g.gen_id, g.text, r.question, r.answer, count(DISTINCT g.text) OVER (PARTITION BY g.id) AS d FROM g JOIN ({V.RECORDS}) r USING (id)),
nums AS (SELECT id, CAST(max(d) * (max(d) - 1) AS BIGINT) AS judged, CAST(sum(length({_rating_text('question', 'answer', 'text')})) AS BIGINT) AS rating_chars,
                CAST(sum(length(text)) AS BIGINT) AS asked_chars FROM q GROUP BY 1),
jud AS (SELECT a.id, CAST(sum(length(a.question) * 2 + length(a.text) + length(b.text) + 9) AS BIGINT) AS judge_chars
        FROM (SELECT DISTINCT id, question, text FROM q) a JOIN (SELECT DISTINCT id, text FROM q) b ON a.id = b.id AND a.text <> b.text GROUP BY 1)
SELECT id, n, exact_match, "rougeL", lexical, judged, coalesce(judge_chars, 0) AS judge_chars, rating_chars, asked_chars
FROM refs JOIN nums USING (id) LEFT JOIN lex USING (id) LEFT JOIN jud USING (id)""")
def _offline(spark, sf):
    """What every stored stage holds of each record."""
    records = V.records(spark, sf).withColumn("dataset", F.lit("coqa"))
    stages = jobs.offline_stages(spark, scratch_path(spark, "offline"), "m7_coqa_0", 0, records)
    chars = lambda df, text, out, key="id": df.groupBy(F.col(key).alias("id")).agg(F.sum(F.length(text)).alias(out))
    judged = stages["judge_inputs"].groupBy(F.col("sample_id").alias("id")).agg(
        F.count(F.lit(1)).alias("judged"), F.sum(F.length("nli_text")).alias("judge_chars")
    )
    scores = stages["reference_scores"].groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("exact_match")).alias("exact_match"), r6(F.avg("rougeL")).alias("rougeL")
    )
    lexical = stages["lexical"].select(F.col("sample_id").alias("id"), r6(F.col("lexical_similarity")).alias("lexical"))
    return (
        scores.join(chars(stages["ratings"], "prompt", "rating_chars"), "id")
        .join(chars(stages["self_evaluation"], "answer", "asked_chars"), "id")
        .join(lexical, "id", "left")
        .join(judged, "id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("judged", "judge_chars")})
    )


_NUMBERED = f"SELECT *, row_number() OVER (ORDER BY id) - 1 AS sample_id FROM ({V.RECORDS})"


@query("offline_scores", f"""
WITH r AS ({_NUMBERED}), t AS {token_queries.ROWS},
g AS (SELECT id, sample_id, unnest(generations) AS text, CAST(generate_subscripts(generations, 1) - 1 AS INT) AS gen_id FROM r),
lik AS (SELECT sample_id, gen_id, sum(CASE WHEN token_pos <> 0 THEN {token_queries._NLL} END) AS nll, count(*) FILTER (token_pos <> 0) AS length,
               sum(CASE WHEN token_pos = 0 THEN {token_queries._NLL} END) AS free FROM t WHERE gen_id < 3 GROUP BY ALL),
told AS (SELECT sample_id, gen_id, 1 / (1 + exp(logits[10] - logits[4])) AS p_true FROM t WHERE token_pos = 0)
SELECT id, gen_id, round(nll, 6) AS neg_log_likelihood, length, round(free, 6) AS unconditioned_neg_log_likelihood, round(p_true, 6) AS p_true,
       CASE gen_id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS rating
FROM g LEFT JOIN lik USING (sample_id, gen_id) LEFT JOIN told USING (sample_id, gen_id)""")
def _offline_scores(spark, sf):
    """Likelihoods, verdicts and parsed ratings of every generation beside its reference scores; records and samples meet by number."""
    records = V.records(spark, sf).withColumn("dataset", F.lit("coqa"))
    numbers = positions(records.select("id"), [], ["id"]).select("id", (F.col("position") - 1).alias("sample_id"))
    named = V.token_scores(spark, sf).join(numbers, "sample_id").drop("sample_id").withColumnRenamed("id", "sample_id")
    scores = named.withColumn("gen_id", F.when(F.col("gen_id") < 3, F.col("gen_id"))).withColumn("conditioned", F.col("token_pos") != 0)
    said = F.element_at(F.array(F.lit("Yes. It agrees."), F.lit(" No"), F.lit(".")), (F.col("gen_id") % 3 + 1).cast("int"))
    responses = records.select(F.col("id").alias("sample_id"), F.posexplode("generations").alias("gen_id", "_g")).select("sample_id", "gen_id", said.alias("response"))
    stages = jobs.offline_stages(
        spark, scratch_path(spark, "offline"), "m7_coqa_0", 0, records, token_scores=scores,
        verdict_logits=named.filter("token_pos = 0").select("sample_id", "gen_id", "logits"), responses=responses, verdict_ids=(3, 9),
    )
    numbers_of = ("neg_log_likelihood", "unconditioned_neg_log_likelihood", "p_true")
    return stages["generation_scores"].select(F.col("sample_id").alias("id"), "gen_id", "length", "rating", *[r6(F.col(c)).alias(c) for c in numbers_of])


_BEST = f"""
base AS (SELECT *, (length(question) % 11) / 10.0::DOUBLE AS sim_score FROM ({V.RECORDS})),
refs AS (SELECT id, prediction, unnest(list_distinct([answer] || additional_answers)) AS ref FROM base),
best AS (SELECT id, max({f_measure('l', 'len(p)', 'len(r)')}) AS sim
         FROM (SELECT *, {lcs('p', 'r')} AS l FROM (SELECT id, {tokens('prediction')} AS p, {tokens('ref')} AS r FROM refs)) GROUP BY 1),
labelled AS (SELECT 'rouge' AS measure, sim AS similarity, CAST(sim > 0.5 AS INT) AS label, {NAMES} FROM base JOIN best USING (id)
             UNION ALL SELECT 'cosine', sim_score, CAST(sim_score > 0.9 AS INT), {NAMES} FROM base)"""


def _stored_run(spark, sf):
    base = scratch_path(spark, "evaluated")
    records = V.records(spark, sf).withColumn("most_likely_generation", F.col("prediction"))
    R.write_results(records.filter("conv_id % 2 = 0"), base, "m7", "squad", "base", 0, 0, 2)
    R.write_results(records.filter("conv_id % 2 = 1"), base, "m7", "squad", "base", 0, 1, 2)
    similar = records.select("id", (F.length("question") % 11 / 10.0).alias("sim_score"))
    return base, similar


@query("evaluate_stored", f"""
WITH {_BEST}, {_curve(_melt_sql('SELECT * FROM labelled', 'measure, label, similarity'), 'measure, method')},
acc AS (SELECT measure, method, avg(CASE WHEN (score >= round(threshold, 4)) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS a
        FROM rows_ JOIN thr USING (measure, method) WHERE threshold IS NOT NULL GROUP BY 1, 2),
pc AS (SELECT measure, method, {_pcc()} AS pcc FROM rows_ GROUP BY 1, 2)
SELECT 'squad' AS dataset, measure, method, round(auroc, 6) AS auroc, round(threshold, 4) + 0 AS threshold, round(a, 6) AS detection_accuracy, round(pcc, 6) AS pcc
FROM auc JOIN thr USING (measure, method) LEFT JOIN acc USING (measure, method) JOIN pc USING (measure, method)""")
def _evaluate_stored(spark, sf):
    """Both shards of a stored run under both correctness measures."""
    base, similar = _stored_run(spark, sf)
    jobs.evaluate_stored(spark, base, similar.withColumn("sim_score", F.lit(0.5)), stem=False, model="m7")  # other similarities before
    report = jobs.evaluate_stored(spark, base, similar, stem=False, model="m7")[1]
    return report.select(
        F.col("dataset").cast("string").alias("dataset"), "measure", "method", r6(F.col("auroc")).alias("auroc"),
        (F.col("threshold") + F.lit(0.0)).alias("threshold"), r6(F.col("detection_accuracy")).alias("detection_accuracy"), r6(F.col("pcc")).alias("pcc"),
    )


@query("evaluate_stored_table", f"""
WITH {_BEST}, {_curve(_melt_sql('SELECT * FROM labelled', 'measure, label, similarity'), 'measure, method')},
pc AS (SELECT measure, method, {_pcc()} AS pcc FROM rows_ GROUP BY ALL),
piv AS (SELECT method, max(CASE WHEN measure = 'cosine' THEN auroc END) AS s, max(CASE WHEN measure = 'rouge' THEN auroc END) AS r,
               max(CASE WHEN measure = 'cosine' THEN pcc END) AS p FROM auc JOIN pc USING (measure, method) GROUP BY ALL)
SELECT place, printed AS method, round(s * 100, 1) AS auc_s, round(r * 100, 1) AS auc_r, round(p * 100, 1) + 0 AS pcc
FROM piv JOIN (VALUES {_PLACES}) AS o(place, name, printed) ON piv.method = o.name""")
def _evaluate_stored_table(spark, sf):
    base, similar = _stored_run(spark, sf)
    table = jobs.evaluate_stored(spark, base, similar, stem=False, model="m7", run_id=0)[0]
    return table.drop("dataset").withColumn("pcc", F.col("pcc") + F.lit(0.0))


@query("score_and_store", f"""
SELECT id, answer, round(perplexity, 6) AS perplexity, CAST(least((row_number() OVER (ORDER BY id) - 1) // (count(*) OVER () // 3), 2) AS INT) AS shard_id FROM ({V.RECORDS})""")
def _score_and_store(spark, sf):
    """Texts and scores become result records in three shards, read back as one run."""
    r = V.records(spark, sf)
    base = scratch_path(spark, "scored")
    store = lambda scores: jobs.score_and_store(spark, base, r.select("id", "answer"), scores, "m7", "squad", "base", 3)
    store(r.select("id", (-F.col("perplexity")).alias("perplexity")))  # an earlier run
    merged = store(r.select("id", "perplexity"))
    return merged.select("id", "answer", r6(F.col("perplexity")).alias("perplexity"), "shard_id")
