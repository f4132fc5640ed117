"""Registered queries: token-level uncertainty and token id arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions import arrays as A
from answerscope.functions import ids as I
from answerscope.operators import tokens as T
from answerscope.operators.prompts import true_false_logits
from answerscope.plans import views as V
from answerscope.plans.registry import query, r6

TS, SC = V.TOKEN_SCORES, V.SCORE_COUNTS
LSE = "(list_max(logits) + ln(list_sum(list_transform(logits, lambda v: exp(v - list_max(logits))))))"
ROWS = f"(SELECT *, {LSE} AS z FROM ({TS}))"


@query("softmax_family", f"""
SELECT sample_id, gen_id, token_pos, round(z, 6) AS lse, round(exp(list_max(logits) - z), 6) AS max_prob,
       round(list_sum(list_transform(logits, lambda v: exp(v - z))), 6) AS total,
       round(exp(logits[1] - z), 6) AS p0, round(logits[1] - z, 6) AS lp0
FROM {ROWS}""")
def _softmax(spark, sf):
    x = F.col("logits")
    return V.token_scores(spark, sf).select(
        "sample_id", "gen_id", "token_pos",
        r6(A.logsumexp(x)).alias("lse"), r6(A.max_prob(x)).alias("max_prob"),
        r6(A.array_sum(A.softmax(x))).alias("total"),
        r6(A.softmax(x)[0]).alias("p0"), r6(A.log_softmax(x)[0]).alias("lp0"),
    )


@query("perplexity", f"SELECT sample_id, round(-avg(list_max(logits) - z), 6) AS perplexity FROM {ROWS} GROUP BY 1")
def _perplexity(spark, sf):
    return T.perplexity(V.token_scores(spark, sf)).select("sample_id", r6(F.col("perplexity")).alias("perplexity"))


@query("energy", f"SELECT sample_id, round(-avg(z), 6) AS energy FROM {ROWS} GROUP BY 1")
def _energy(spark, sf):
    return T.energy(V.token_scores(spark, sf)).select("sample_id", r6(F.col("energy")).alias("energy"))


@query("predictive_entropy", f"""
SELECT sample_id, round(-sum(ln(exp(list_max(logits) - z) + 1e-6)) / count(DISTINCT gen_id), 6) AS predictive_entropy
FROM {ROWS} GROUP BY 1""")
def _predictive(spark, sf):
    out = T.predictive_entropy(V.token_scores(spark, sf))
    return out.select("sample_id", r6(F.col("predictive_entropy")).alias("predictive_entropy"))


@query("length_normalized_entropy", f"""
WITH g AS (SELECT sample_id, gen_id, any_value(num_tokens) AS n, sum(CASE WHEN token_pos < num_tokens THEN list_max(logits) - z END) AS s
           FROM {ROWS} JOIN ({SC}) USING (sample_id, gen_id) GROUP BY 1, 2)
SELECT sample_id, round(-avg(s / n), 6) AS entropy FROM g GROUP BY 1""")
def _lne(spark, sf):
    out = T.length_normalized_entropy(V.token_scores(spark, sf), V.score_counts(spark, sf))
    return out.select("sample_id", r6(F.col("entropy")).alias("entropy"))


@query("length_normalized_entropy_last_batch", f"""
WITH g AS (SELECT sample_id, gen_id, any_value(num_tokens) AS n, sum(CASE WHEN token_pos < num_tokens THEN list_max(logits) - z END) AS s
           FROM (SELECT *, max(batch_id) OVER (PARTITION BY sample_id) AS top FROM {ROWS}) JOIN ({SC}) USING (sample_id, gen_id)
           WHERE batch_id = top GROUP BY 1, 2)
SELECT sample_id, round(-avg(s / n), 6) AS entropy FROM g GROUP BY 1""")
def _lne_last(spark, sf):
    out = T.length_normalized_entropy(V.token_scores(spark, sf), V.score_counts(spark, sf), scope="last_batch")
    return out.select("sample_id", r6(F.col("entropy")).alias("entropy"))


_NLL = "z - logits[target_id + 1]"
_ENT = "-list_sum(list_transform(logits, lambda v: CASE WHEN exp(v - z) > 0 THEN exp(v - z) * (v - z) ELSE 0 END))"


@query("token_nll", f"SELECT sample_id, gen_id, token_pos, round({_NLL}, 6) AS nll FROM {ROWS}")
def _nll(spark, sf):
    t = V.token_scores(spark, sf)
    return t.select("sample_id", "gen_id", "token_pos", r6(T.token_nll(F.col("logits"), F.col("target_id"))).alias("nll"))


@query("token_entropy", f"SELECT sample_id, gen_id, token_pos, round({_ENT}, 6) AS entropy FROM {ROWS}")
def _entropy(spark, sf):
    t = V.token_scores(spark, sf)
    return t.select("sample_id", "gen_id", "token_pos", r6(T.token_entropy(F.col("logits"))).alias("entropy"))


@query("token_entropy_masked", f"""
SELECT sample_id, gen_id, token_pos, round(list_max(logits) + ln(s), 6) AS lse, round(ln(s) - e / s, 6) AS entropy
FROM (SELECT sample_id, gen_id, token_pos, logits, list_sum(list_transform(kept, lambda v: exp(v - m))) AS s,
             list_sum(list_transform(kept, lambda v: exp(v - m) * (v - m))) AS e
      FROM (SELECT *, list_max(logits) AS m, list_filter(logits, lambda v: v >= 0) AS kept FROM ({TS})))""")
def _entropy_masked(spark, sf):
    """Logits cut off by sampling are -infinity and must count as probability 0."""
    cut = F.transform("logits", lambda v: F.when(v < 0, F.lit(float("-inf"))).otherwise(v))
    t = V.token_scores(spark, sf).withColumn("logits", cut)
    x = F.col("logits")
    return t.select("sample_id", "gen_id", "token_pos", r6(A.logsumexp(x)).alias("lse"), r6(A.entropy(x)).alias("entropy"))


@query("sequence_embedding", f"""
SELECT sample_id, gen_id, CAST(d - 1 AS INT) AS dim, round(avg(x), 6) + 0 AS value
FROM (SELECT sample_id, gen_id, unnest(vec) AS x, generate_subscripts(vec, 1) AS d
      FROM (SELECT *, max(token_pos) OVER (PARTITION BY sample_id, gen_id) AS top FROM ({V.HIDDEN_STATES}) WHERE layer = 4)
      WHERE token_pos < top) GROUP BY 1, 2, d""")
def _sequence(spark, sf):
    out = T.sequence_embedding(V.hidden_states(spark, sf), V.NUM_LAYERS - 1, ["sample_id", "gen_id"])
    rows = out.select("sample_id", "gen_id", F.posexplode("embedding").alias("dim", "value"))
    return rows.select("sample_id", "gen_id", "dim", r6(F.col("value")).alias("value"))


@query("likelihood_summary", f"""
SELECT sample_id, CASE WHEN gen_id < 3 THEN gen_id ELSE -1 END AS gen_id, token_pos <> 0 AS conditioned, round(sum({_NLL}), 6) AS neg_log_likelihood,
       count(*) + max(CASE WHEN gen_id < 3 THEN 0 ELSE 1 END) AS length, round(avg({_ENT}), 6) AS mean_token_entropy
FROM {ROWS} GROUP BY 1, 2, 3""")
def _likelihood(spark, sf):
    """Generation 3 of each sample stands for the prompt, position 0 for the unconditioned pass."""
    t = V.token_scores(spark, sf).select(
        "sample_id", F.when(F.col("gen_id") < 3, F.col("gen_id")).alias("gen_id"),
        (F.col("token_pos") != 0).alias("conditioned"), "token_pos", "target_id", "logits",
    )
    out = T.likelihood_summary(t)
    return out.select(
        "sample_id", F.coalesce("gen_id", F.lit(-1)).alias("gen_id"), "conditioned", r6(F.col("neg_log_likelihood")).alias("neg_log_likelihood"),
        "length", r6(F.col("mean_token_entropy")).alias("mean_token_entropy"),
    )


@query("token_likelihoods", f"SELECT sample_id, gen_id, token_pos, round({_NLL}, 6) AS nll, round({_ENT}, 6) AS token_entropy FROM {ROWS}")
def _token_likelihoods(spark, sf):
    """The token arrays behind the likelihood summary, one row a token."""
    t = T.token_likelihoods(V.token_scores(spark, sf), ["sample_id", "gen_id", "token_pos"])
    return t.select("sample_id", "gen_id", "token_pos", r6(F.col("nll")).alias("nll"), r6(F.col("token_entropy")).alias("token_entropy"))


@query("true_false_logits", f"""
SELECT sample_id, gen_id, token_pos, round(logits[4], 6) + 0 AS true_logit, round(logits[10], 6) + 0 AS false_logit,
       round(logits[4] - z, 6) + 0 AS true_logp, round(logits[10] - z, 6) + 0 AS false_logp FROM {ROWS}""")
def _true_false(spark, sf):
    t = V.token_scores(spark, sf)
    raw, logp = true_false_logits(F.col("logits"), 3, 9), true_false_logits(F.col("logits"), 3, 9, True)
    return t.select(
        "sample_id", "gen_id", "token_pos",
        r6(raw["true_logit"]).alias("true_logit"), r6(raw["false_logit"]).alias("false_logit"),
        r6(logp["true_logit"]).alias("true_logp"), r6(logp["false_logit"]).alias("false_logp"),
    )


# --- id arrays ----------------------------------------------------------------------


def _joined(col):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), ",")


def _sql_joined(expr: str) -> str:
    return f"array_to_string({expr}, ',')"


@query("num_tokens", f"SELECT sample_id, gen_id, CAST(len(list_filter(ids, lambda x: x > 2)) + 1 AS INT) AS num_tokens FROM ({V.TOKEN_IDS})")
def _num_tokens(spark, sf):
    return T.token_counts(V.token_ids(spark, sf))


@query("strip_special", f"SELECT sample_id, gen_id, {_sql_joined('list_filter(ids, lambda x: x <> 1 AND x <> 2)')} AS ids FROM ({V.TOKEN_IDS})")
def _strip(spark, sf):
    return V.token_ids(spark, sf).select("sample_id", "gen_id", _joined(I.strip_special(F.col("ids"), 1, 2)).alias("ids"))


@query("mask_labels", f"SELECT sample_id, gen_id, {_sql_joined('list_transform(ids, lambda x: CASE WHEN x = 1 THEN -100 ELSE x END)')} AS ids FROM ({V.TOKEN_IDS})")
def _mask(spark, sf):
    return V.token_ids(spark, sf).select("sample_id", "gen_id", _joined(I.mask_labels(F.col("ids"), 1)).alias("ids"))


@query("split_completion", f"SELECT sample_id, gen_id, {_sql_joined('ids[gen_id + 2:]')} AS ids FROM ({V.TOKEN_IDS})")
def _completion(spark, sf):
    return V.token_ids(spark, sf).select(
        "sample_id", "gen_id", _joined(I.split_completion(F.col("ids"), F.col("gen_id") + 1)).alias("ids")
    )


@query("pad_generations", f"""
WITH r AS (SELECT id, list_transform(generations, lambda g: list_transform(string_split(g, ' '), lambda w: CAST(length(w) AS INT))) AS gens FROM ({V.RECORDS})),
p AS (SELECT id, list_transform(gens, lambda g: g || list_transform(range(list_max(list_transform(gens, lambda h: len(h))) - len(g)), lambda q: 1::INT)) AS gens FROM r)
SELECT id, array_to_string(list_transform(gens, lambda g: array_to_string(g, ',')), ';') AS ids FROM p""")
def _pad(spark, sf):
    gens = F.transform("generations", lambda g: F.transform(F.split(g, " "), lambda w: F.length(w)))
    padded = I.pad_generations(gens, 1, F.size("generations"))
    return V.records(spark, sf).select("id", F.array_join(F.transform(padded, _joined), ";").alias("ids"))
