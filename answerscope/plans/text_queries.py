"""Registered queries: answer texts, prompts and overlap scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from answerscope.functions import overlap as O
from answerscope.functions import text as X
from answerscope.operators import pairs as G
from answerscope.operators import prompts as C
from answerscope.operators import similarity as D
from answerscope.operators.sampling import collect_generations, explode_generations, few_shot_block
from answerscope.plans import views as V
from answerscope.plans.registry import query, r6
from answerscope.plans.sql import f_measure, lcs, stem_ctes, stemmed, tokens


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _bare(expr: str) -> str:
    return f"translate({expr}, {_quote(X.PUNCTUATION)}, '')"


def _normal(expr: str) -> str:
    """Normalised text by splitting on white space and dropping the articles."""
    return f"array_to_string(list_filter(string_split_regex({_bare(f'lower({expr})')}, '\\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


def _clean(expr: str) -> str:
    for marker in X.ANSWER_MARKERS:
        expr = f"string_split({expr}, {'chr(10)' if marker == chr(10) else _quote(marker)})[1]"
    return expr


def _caseless(expr: str) -> str:
    return f"lower(regexp_replace({expr}, '^\\s+', ''))"


# --- normalisation and comparison ---------------------------------------------------


@query("normalize_text", f"SELECT doc_id, {_normal('text')} AS normalized FROM documents")
def _normalize(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


@query("exact_match", f"SELECT id, CAST({_normal('most_likely_generation')} = {_normal('answer')} AS INT) AS exact_match FROM ({V.RECORDS})")
def _exact(spark, sf):
    return V.records(spark, sf).select("id", X.exact_match(F.col("most_likely_generation"), F.col("answer")).alias("exact_match"))


_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("exact_match_ci", f"""
SELECT id, CAST({_bare(_caseless(f"' ' || translate(answer, '{_LOW}', '{_UP}')"))} = {_bare(_caseless('answer'))} AS INT) AS shouted,
       CAST({_bare(_caseless('most_likely_generation'))} = {_bare(_caseless('answer'))} AS INT) AS exact_match FROM ({V.RECORDS})""")
def _exact_ci(spark, sf):
    loud = F.concat(F.lit(" "), F.translate("answer", _LOW, _UP))
    return V.records(spark, sf).select(
        "id", X.exact_match_ci(loud, F.col("answer")).alias("shouted"),
        X.exact_match_ci(F.col("most_likely_generation"), F.col("answer")).alias("exact_match"),
    )


@query("clean_answer", f"SELECT conv_id, turn, {_clean('text')} AS cleaned FROM conversations")
def _cleaned(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", X.clean_answer(F.col("text")).alias("cleaned"))


@query("rouge_tokens", f"SELECT doc_id, array_to_string({tokens('text')}, ' ') AS tokens FROM documents")
def _tokens(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.array_join(X.rouge_tokens(F.col("text")), " ").alias("tokens"))


@query("stem_vocabulary", f"WITH {stem_ctes(f'SELECT DISTINCT unnest({tokens("text")}) AS token FROM documents')} SELECT token, stem FROM stems")
def _stems(spark, sf):
    return D.stem_vocabulary(V.table(spark, sf, "documents"), "text")


_TOK = f"(SELECT id, {tokens('prediction')} AS p, {tokens('answer')} AS r FROM ({V.RECORDS}))"


@query("rouge_l", f"SELECT id, round({f_measure('l', 'len(p)', 'len(r)')}, 6) AS rouge_l FROM (SELECT *, {lcs('p', 'r')} AS l FROM {_TOK})")
def _rouge_l(spark, sf):
    return V.records(spark, sf).select("id", r6(O.rouge_l(F.col("prediction"), F.col("answer"))).alias("rouge_l"))


@query("rouge_l_documents")
def _rouge_l_docs(spark, sf):
    """Whole documents against the next document; the quadratic SQL is too slow for these."""
    d = V.table(spark, sf, "documents").select("doc_id", "text")
    after = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next_text"))
    return d.join(after, "doc_id").select("doc_id", r6(O.rouge_l(F.col("text"), F.col("next_text"), stem=True)).alias("rouge_l"))


def _grams(col: str, n: int) -> str:
    return f"list_transform(range(1, len({col}) - {n} + 2), lambda i: {col}[i:i + {n - 1}])"


def _overlap_sql(n: int) -> str:
    return f"""
WITH t AS {_TOK},
gp AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({_grams('p', n)}) AS g FROM t) GROUP BY 1, 2),
gr AS (SELECT id, g, count(*) AS c FROM (SELECT id, unnest({_grams('r', n)}) AS g FROM t) GROUP BY 1, 2),
m AS (SELECT gp.id, sum(least(gp.c, gr.c)) AS common FROM gp JOIN gr USING (id, g) GROUP BY 1)
SELECT id, round({f_measure('coalesce(common, 0)', f'greatest(len(p) - {n - 1}, 0)', f'greatest(len(r) - {n - 1}, 0)')}, 6) AS rouge_{n}
FROM t LEFT JOIN m USING (id)"""


@query("rouge_1", _overlap_sql(1))
def _rouge_1(spark, sf):
    return V.records(spark, sf).select("id", r6(O.rouge_n(F.col("prediction"), F.col("answer"), 1)).alias("rouge_1"))


@query("rouge_2", _overlap_sql(2))
def _rouge_2(spark, sf):
    return V.records(spark, sf).select("id", r6(O.rouge_n(F.col("prediction"), F.col("answer"), 2)).alias("rouge_2"))


@query("best_over_references", f"""
WITH t AS (SELECT id, unnest(list_distinct([question] || additional_answers)) AS ref, most_likely_generation AS pred FROM ({V.RECORDS})),
k AS (SELECT id, {tokens('pred')} AS p, {tokens('ref')} AS r FROM t),
s AS (SELECT id, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l FROM k))
SELECT id, round(max(f), 6) AS best FROM s GROUP BY 1""")
def _best(spark, sf):
    """The question stands in for the answer, so that the best reference varies."""
    refs = D.reference_array(F.col("question"), F.col("additional_answers"))
    return V.records(spark, sf).select("id", r6(D.best_over_references(F.col("most_likely_generation"), refs, stem=False)).alias("best"))


def _pairs(col: str) -> str:
    """Neighbouring tokens as strings."""
    return f"list_transform(range(1, len({col})), lambda i: {col}[i] || ' ' || {col}[i + 1])"


def _common(a: str, b: str) -> str:
    """Clipped number of common entries of two lists."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


@query("score_generations", f"""
WITH g AS (SELECT id, unnest(generations) AS text, generate_subscripts(generations, 1) - 1 AS gen_id, [answer] || additional_answers AS refs FROM ({V.RECORDS})),
u AS (SELECT id, gen_id, {_caseless('text')} AS pred, unnest(list_distinct(list_transform(refs, lambda x: {_caseless('x')}))) AS ref FROM g),
k AS (SELECT *, {tokens('pred')} AS p, {tokens('ref')} AS r FROM u),
s AS (SELECT *, {lcs('p', 'r')} AS l, {_common('p', 'r')} AS c1, {_common(_pairs('p'), _pairs('r'))} AS c2 FROM k)
SELECT id, CAST(gen_id AS INT) AS gen_id, max(CAST({_bare('pred')} = {_bare('ref')} AS INT)) + 0.0::DOUBLE AS exact_match,
       round(max({f_measure('c1', 'len(p)', 'len(r)')}), 6) AS rouge1, round(max({f_measure('c2', 'greatest(len(p) - 1, 0)', 'greatest(len(r) - 1, 0)')}), 6) AS rouge2, round(max({f_measure('l', 'len(p)', 'len(r)')}), 6) AS "rougeL"
FROM s GROUP BY 1, 2""")
def _score_generations(spark, sf):
    out = D.score_generations(V.records(spark, sf))
    return out.select("id", "gen_id", "exact_match", *[r6(F.col(m)).alias(m) for m in O.MEASURES])


# --- similarity inside a sample -----------------------------------------------------

_PAIRS = f"""
k AS (SELECT sample_id, gen_id, text, {tokens('text')} AS t FROM ({V.CONV_ANSWERS})),
pr AS (SELECT a.sample_id, a.gen_id AS gi, b.gen_id AS gj, a.text AS ti, b.text AS tj, a.t AS p, b.t AS r FROM k a JOIN k b ON a.sample_id = b.sample_id AND a.gen_id < b.gen_id),
sc AS (SELECT *, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l FROM pr))"""


@query("lexical_similarity", f"""
WITH {_PAIRS}
SELECT sample_id, round(avg(f), 6) AS lexical_similarity FROM (SELECT DISTINCT sample_id FROM k) LEFT JOIN sc USING (sample_id) GROUP BY 1""")
def _lexical(spark, sf):
    out = D.lexical_similarity(V.conv_answers(spark, sf), stem=False)
    return out.select("sample_id", r6(F.col("lexical_similarity")).alias("lexical_similarity"))


@query("lexical_similarity_stemmed", f"""
WITH {stem_ctes(f'SELECT DISTINCT unnest({tokens("text")}) AS token FROM ({V.CONV_ANSWERS})')},
k AS ({stemmed(f'({V.CONV_ANSWERS})', 'sample_id, gen_id', ['text'])}),
pr AS (SELECT a.sample_id, a.text_s AS p, b.text_s AS r FROM k a JOIN k b ON a.sample_id = b.sample_id AND a.gen_id < b.gen_id),
sc AS (SELECT sample_id, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l FROM pr))
SELECT sample_id, round(avg(f), 6) AS lexical_similarity FROM (SELECT DISTINCT sample_id FROM k) LEFT JOIN sc USING (sample_id) GROUP BY 1""")
def _lexical_stemmed(spark, sf):
    out = D.lexical_similarity(V.conv_answers(spark, sf))
    return out.select("sample_id", r6(F.col("lexical_similarity")).alias("lexical_similarity"))


@query("lexical_similarity_documents")
def _lexical_docs(spark, sf):
    out = D.lexical_similarity(V.doc_answers(spark, sf), stem=True)
    return out.select("sample_id", r6(F.col("lexical_similarity")).alias("lexical_similarity"))


@query("lexical_similarity_matrix", f"""
WITH d AS (SELECT DISTINCT sample_id, text FROM ({V.CONV_ANSWERS})),
n AS (SELECT sample_id, text, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY text) - 1 AS INT) AS ans_id, {tokens('text')} AS t FROM d),
pr AS (SELECT a.sample_id, a.ans_id, b.ans_id AS j, a.t AS p, b.t AS r FROM n a JOIN n b ON a.sample_id = b.sample_id AND a.ans_id < b.ans_id),
sc AS (SELECT sample_id, ans_id, j, {f_measure('l', 'len(p)', 'len(r)')} AS f FROM (SELECT *, {lcs('p', 'r')} AS l FROM pr))
SELECT sample_id, ans_id, j, round(f, 6) AS similarity FROM sc UNION ALL SELECT sample_id, j, ans_id, round(f, 6) FROM sc
UNION ALL SELECT sample_id, ans_id, ans_id, 1.0::DOUBLE FROM n""")
def _matrix(spark, sf):
    rows = D.lexical_similarity_matrix(V.conv_answers(spark, sf))
    return rows.select("sample_id", "ans_id", F.posexplode("sims").alias("j", "s")).select(
        "sample_id", "ans_id", "j", r6(F.col("s")).alias("similarity")
    )


@query("syntactic_similarity", f"""
WITH {_PAIRS}, u AS (SELECT *, {_common('p', 'r')} AS c1, {_common(_pairs('p'), _pairs('r'))} AS c2 FROM sc WHERE ti <> tj)
SELECT sample_id, round(avg({f_measure('c1', 'len(p)', 'len(r)')}), 6) AS rouge1,
       round(avg({f_measure('c2', 'greatest(len(p) - 1, 0)', 'greatest(len(r) - 1, 0)')}), 6) AS rouge2, round(avg(f), 6) AS "rougeL"
FROM (SELECT DISTINCT sample_id FROM k) LEFT JOIN u USING (sample_id) GROUP BY 1""")
def _syntactic(spark, sf):
    out = D.syntactic_similarity(V.conv_answers(spark, sf))
    return out.select("sample_id", *[r6(F.col(m)).alias(m) for m in O.MEASURES])


@query("answer_mapping", f"""
SELECT id, len(list_distinct(generations)) AS n_answers,
       array_to_string(list_transform(generations, lambda g: list_position(list_sort(list_distinct(generations)), g) - 1), ',') AS mapping
FROM ({V.RECORDS})""")
def _mapping(spark, sf):
    g = F.col("generations")
    return V.records(spark, sf).select(
        "id", F.size(X.answer_set(g)).cast("bigint").alias("n_answers"),
        F.array_join(F.transform(X.answer_mapping(g), lambda i: i.cast("string")), ",").alias("mapping"),
    )


@query("answer_index", f"""
SELECT sample_id, gen_id, CAST(dense_rank() OVER (PARTITION BY sample_id ORDER BY text) - 1 AS INT) AS ans_id FROM ({V.CONV_ANSWERS})""")
def _index(spark, sf):
    return D.answer_index(V.conv_answers(spark, sf), "sample_id", "gen_id", "text")


@query("explode_generations", f"""
SELECT id, CAST(generate_subscripts(generations, 1) - 1 AS INT) AS gen_id, unnest(generations) AS text FROM ({V.RECORDS})""")
def _explode(spark, sf):
    return explode_generations(V.records(spark, sf))


@query("collect_generations", """
SELECT conv_id AS id, CAST(turn // 2 * 2 AS BIGINT) AS first, CAST(turn AS INT) AS gen_id, text FROM conversations""")
def _collect(spark, sf):
    """Collected in parts of two and exploded again: every generation is back in its place."""
    rows = V.table(spark, sf, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("gen_id"), "text")
    parts = collect_generations(rows, part_size=2)
    first = F.col("gen_id") - F.col("gen_id") % 2
    return explode_generations(parts).select("id", first.cast("bigint").alias("first"), "gen_id", "text")


# --- prompts ------------------------------------------------------------------------


@query("context_prompt", f"SELECT id, answer || ' Q: ' || question || ' A:' AS prompt FROM ({V.QA})")
def _context(spark, sf):
    return V.qa(spark, sf).select("id", C.context_prompt(F.col("answer"), F.col("question")).alias("prompt"))


_BLOCK = f"""(SELECT string_agg(chr(10) || 'Q: ' || question || chr(10) || 'A: ' || answer, '' ORDER BY d) AS block
FROM (SELECT question, answer, md5('42:' || id) AS d FROM ({V.QA}) ORDER BY d LIMIT 5))"""


@query("few_shot_block", f"SELECT block FROM {_BLOCK}")
def _block(spark, sf):
    return few_shot_block(V.qa(spark, sf), 5, 42)


@query("few_shot_prompt", f"""
SELECT id, 'Answer these questions:' || block || chr(10) || 'Q: ' || question || chr(10) || 'A:' AS prompt FROM ({V.QA}), {_BLOCK}""")
def _few_shot(spark, sf):
    q = V.qa(spark, sf)
    return C.with_few_shot_prompt(q, few_shot_block(q, 5, 42)).select("id", "prompt")


@query("trivia_prompt", f"""
SELECT id, {_quote('Answer these questions:' + C.TRIVIA_EXAMPLE)} || chr(10) || 'Q: ' || question || chr(10) || 'A:' AS prompt FROM ({V.QA})""")
def _trivia(spark, sf):
    return V.qa(spark, sf).select("id", C.trivia_prompt(F.col("question")).alias("prompt"))


_FIRST_SEEN = "list_filter(g, lambda x, i: list_position(g, x) = i)[:10]"


@query("self_eval_prompt", f"""
WITH r AS (SELECT id, question, answer AS story, list_transform(generations, lambda s: regexp_replace(s, '^\\s+', '')) AS g FROM ({V.RECORDS})),
e AS (SELECT id, question, story, array_to_string({_FIRST_SEEN}, chr(10)) AS ideas, unnest(g) AS answer, CAST(generate_subscripts(g, 1) - 1 AS INT) AS gen_id FROM r)
SELECT id, gen_id, answer, story || chr(10) || 'Question: ' || question || {_quote(chr(10) + C.IDEAS)} || ideas || chr(10) || 'Possible Answer: ' || answer || {_quote(chr(10) + C.CHOICES)} AS prompt
FROM e""")
def _self_eval(spark, sf):
    r = V.records(spark, sf)
    return C.self_eval_prompts(r, r.select("id", F.col("answer").alias("story")))


def _rating_sql(name: str) -> str:
    return _quote(C.rating_block(name))


def _rated(spark, sf):
    """Records with the question set that picks the examples."""
    names = F.array(F.lit("coqa"), F.lit("triviaqa"), F.lit("nq_open"))
    return V.records(spark, sf).withColumn("dataset", F.get(names, (F.col("conv_id") % 3).cast("int")))


@query("rating_prompt", f"""
SELECT id, CASE conv_id % 3 WHEN 0 THEN {_rating_sql('coqa')} WHEN 1 THEN {_rating_sql('triviaqa')} ELSE {_rating_sql('nq_open')} END
  || chr(10) || 'Question: ' || question || chr(10) || 'Reference: ' || answer || chr(10) || 'Answer: ' || regexp_replace(regexp_replace(generations[2], '^\\s+', ''), '\\s+$', '') || chr(10) || 'Rating:' AS prompt
FROM ({V.RECORDS})""")
def _rating(spark, sf):
    return C.rating_prompts(_rated(spark, sf), 1)


@query("rating_prompts", f"""
WITH g AS (SELECT id, conv_id, question, answer, unnest(generations) AS g, CAST(generate_subscripts(generations, 1) - 1 AS INT) AS gen_id FROM ({V.RECORDS}))
SELECT id, gen_id, CASE conv_id % 3 WHEN 0 THEN {_rating_sql('coqa')} WHEN 1 THEN {_rating_sql('triviaqa')} ELSE {_rating_sql('nq_open')} END
  || chr(10) || 'Question: ' || question || chr(10) || 'Reference: ' || answer || chr(10) || 'Answer: ' || regexp_replace(regexp_replace(g, '^\\s+', ''), '\\s+$', '') || chr(10) || 'Rating:' AS prompt
FROM g""")
def _ratings(spark, sf):
    return C.rating_prompts(_rated(spark, sf))


@query("parse_rating", """
SELECT conv_id, turn, nullif(regexp_extract(split_part(text, '.', 1), '[^\\s]+', 0), '') AS rating FROM conversations""")
def _parse(spark, sf):
    return V.table(spark, sf, "conversations").select("conv_id", "turn", C.parse_rating(F.col("text")).alias("rating"))


_NUMBERED = f"""
n AS (SELECT sample_id, text, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY text) - 1 AS INT) AS ans_id
      FROM (SELECT DISTINCT sample_id, text FROM ({V.CONV_ANSWERS})))"""


@query("answer_pairs", f"""
WITH {_NUMBERED} SELECT a.sample_id, a.ans_id AS i, b.ans_id AS j, a.text AS text_i, b.text AS text_j
FROM n a JOIN n b ON a.sample_id = b.sample_id AND a.ans_id <> b.ans_id""")
def _answer_pairs(spark, sf):
    return G.answer_pairs(D.numbered_answers(V.conv_answers(spark, sf), "sample_id", "text"))


@query("answer_pairs_unordered", f"""
WITH {_NUMBERED} SELECT a.sample_id, a.ans_id AS i, b.ans_id AS j, a.text AS text_i, b.text AS text_j
FROM n a JOIN n b ON a.sample_id = b.sample_id AND a.ans_id < b.ans_id""")
def _answer_pairs_once(spark, sf):
    return G.answer_pairs(D.numbered_answers(V.conv_answers(spark, sf), "sample_id", "text"), ordered=False)


@query("nli_pair_text", f"""
WITH {_NUMBERED}, q AS (SELECT conv_id AS sample_id, min_by(text, turn) AS question FROM conversations GROUP BY 1)
SELECT a.sample_id, a.ans_id AS i, b.ans_id AS j, question || ' ' || a.text || ' [SEP] ' || question || ' ' || b.text AS nli_text
FROM n a JOIN n b ON a.sample_id = b.sample_id AND a.ans_id <> b.ans_id JOIN q ON q.sample_id = a.sample_id""")
def _nli(spark, sf):
    a = V.conv_answers(spark, sf)
    questions = a.groupBy("sample_id").agg(F.min_by("text", "gen_id").alias("question"))
    return G.nli_inputs(D.numbered_answers(a, "sample_id", "text"), questions)


# --- judged pairs -------------------------------------------------------------------

_DEC = f"""
p AS (SELECT sample_id, i, j, list_position(logits, list_max(logits)) - 1 AS best,
             list_transform(logits, lambda v: exp(v - list_max(logits)) / list_sum(list_transform(logits, lambda w: exp(w - list_max(logits))))) AS pr FROM ({V.PAIR_LOGITS})),
dec AS (SELECT f.sample_id, f.i, f.j, CAST(f.best AS INT) AS forward_class, CAST(b.best AS INT) AS backward_class,
               CAST(least(f.best, b.best) <> 0 AS INT) AS decision, (f.pr[1] + b.pr[1]) / 2 AS prob_0, (f.pr[2] + b.pr[2]) / 2 AS prob_1, (f.pr[3] + b.pr[3]) / 2 AS prob_2
        FROM p f JOIN p b ON f.sample_id = b.sample_id AND f.i = b.j AND f.j = b.i WHERE f.i < f.j)"""


def _decisions(spark, sf):
    return G.pair_decision(V.pair_logits(spark, sf))


@query("similarity_tensor", f"""
WITH c AS (SELECT sample_id, i, j, logits FROM ({V.PAIR_LOGITS})
           UNION ALL SELECT sample_id, gen_id, gen_id, [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] FROM ({V.SPECTRAL_SAMPLES}))
SELECT sample_id, i, j, round(logits[1], 6) + 0 AS l0, round(logits[2], 6) + 0 AS l1, round(logits[3], 6) + 0 AS l2 FROM c""")
def _tensor(spark, sf):
    rows = G.similarity_tensor(V.pair_logits(spark, sf), V.answer_sizes(spark, sf))
    cells = rows.select("sample_id", "i", F.posexplode("cells").alias("j", "c"))
    return cells.select("sample_id", "i", "j", *[r6(F.col("c")[k]).alias(f"l{k}") for k in range(3)])


@query("pair_decision", f"""
WITH {_DEC} SELECT sample_id, i, j, forward_class, backward_class, decision, round(prob_0, 6) AS prob_0, round(prob_1, 6) AS prob_1, round(prob_2, 6) AS prob_2 FROM dec""")
def _decision(spark, sf):
    d = _decisions(spark, sf)
    return d.select(
        "sample_id", "i", "j", "forward_class", "backward_class", "decision", *[r6(F.col(f"prob_{k}")).alias(f"prob_{k}") for k in range(3)]
    )


@query("has_different_answers", f"WITH {_DEC} SELECT sample_id, max(1 - decision) AS has_different FROM dec GROUP BY 1")
def _different(spark, sf):
    return G.has_different_answers(_decisions(spark, sf))


@query("semantic_sets", f"""
WITH RECURSIVE {_DEC},
par AS (SELECT s.sample_id, s.gen_id AS ans_id, coalesce(max(d.i), s.gen_id) AS parent
        FROM ({V.SPECTRAL_SAMPLES}) s LEFT JOIN dec d ON d.sample_id = s.sample_id AND d.j = s.gen_id AND d.decision = 1 GROUP BY 1, 2),
up AS (SELECT sample_id, ans_id, parent FROM par
       UNION SELECT u.sample_id, u.ans_id, p.parent FROM up u JOIN par p ON p.sample_id = u.sample_id AND p.ans_id = u.parent)
SELECT sample_id, ans_id, min(parent) AS set_id FROM up GROUP BY 1, 2""")
def _sets(spark, sf):
    return G.semantic_sets(_decisions(spark, sf), V.answer_sizes(spark, sf))


@query("pair_audit", f"""
WITH {_DEC} SELECT sample_id, 'Q' || sample_id AS question, 'answer ' || i AS ans1, 'answer ' || j AS ans2, decision FROM dec""")
def _audit(spark, sf):
    s = V.spectral_samples(spark, sf)
    answers = s.select("sample_id", F.col("gen_id").alias("ans_id"), F.concat(F.lit("answer "), F.col("gen_id").cast("string")).alias("text"))
    questions = s.select("sample_id").distinct().withColumn("question", F.concat(F.lit("Q"), F.col("sample_id").cast("string")))
    return G.pair_audit(_decisions(spark, sf), answers, questions)
