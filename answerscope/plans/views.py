"""Engine tables derived from the given tables, each with its SQL twin.

``TABLES[name]`` is a function (spark, sf_dir) -> DataFrame; ``SQL[name]`` the matching
SELECT for the oracle. Every view reads its whole source table and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _div(col: str, n: int):
    return F.expr(f"{col} div {n}")


# --- vectors ------------------------------------------------------------------------


def spectral_samples(spark, sf):
    """Ten vectors per sample."""
    return table(spark, sf, "embeddings").select(
        _div("vec_id", 10).alias("sample_id"),
        (F.col("vec_id") % 10).cast("int").alias("gen_id"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


SPECTRAL_SAMPLES = """
SELECT vec_id // 10 AS sample_id, CAST(vec_id % 10 AS INT) AS gen_id, CAST(embedding AS DOUBLE[]) AS vec
FROM embeddings"""


def hidden_states(spark, sf):
    """5 generations x 5 layers x 4 steps per sample, written with the lengths of its generations.

    Vectors are numbered without gaps; only the last generation can be short.
    """
    e = table(spark, sf, "embeddings")
    last = e.agg(F.max("vec_id")).first()[0]
    e = e.select(_div("vec_id", 100).alias("sample_id"), (F.col("vec_id") % 100).alias("r"), "vec_id", "embedding")
    held = F.lit(last) - F.col("vec_id") + F.col("r") % 20  # place of the table's last vector in this generation
    return e.select(
        "sample_id",
        F.expr("cast(r div 40 as int)").alias("batch_id"),
        F.expr("cast(r div 20 as int)").alias("gen_id"),
        F.expr("cast(r % 20 div 4 as int)").alias("layer"),
        F.expr("cast(r % 4 as int)").alias("token_pos"),
        F.col("embedding").cast("array<double>").alias("vec"),
        (F.lit(1) + (F.col("sample_id") + F.expr("r div 20")) % 5).cast("int").alias("num_tokens"),
        F.least(F.lit(3), held).cast("int").alias("last_step"),
    )


HIDDEN_STATES = """
SELECT vec_id // 100 AS sample_id, CAST(vec_id % 100 // 40 AS INT) AS batch_id,
       CAST(vec_id % 100 // 20 AS INT) AS gen_id, CAST(vec_id % 20 // 4 AS INT) AS layer,
       CAST(vec_id % 4 AS INT) AS token_pos, CAST(embedding AS DOUBLE[]) AS vec
FROM embeddings"""
NUM_LAYERS = 5


def token_counts(spark, sf):
    return (
        hidden_states(spark, sf)
        .select("sample_id", "gen_id", "num_tokens")
        .distinct()
    )


TOKEN_COUNTS = f"""
SELECT DISTINCT sample_id, gen_id, CAST(1 + (sample_id + gen_id) % 5 AS INT) AS num_tokens
FROM ({HIDDEN_STATES})"""


def token_scores(spark, sf):
    """Logits over a 64-way vocabulary: 4 generations x 5 positions per sample."""
    return table(spark, sf, "embeddings").select(
        _div("vec_id", 20).alias("sample_id"),
        F.expr("cast(vec_id % 20 div 10 as int)").alias("batch_id"),
        F.expr("cast(vec_id % 20 div 5 as int)").alias("gen_id"),
        F.expr("cast(vec_id % 5 as int)").alias("token_pos"),
        F.expr("cast(vec_id * 7 % 64 as int)").alias("target_id"),
        F.expr("transform(embedding, x -> cast(x as double) * 10)").alias("logits"),
    )


TOKEN_SCORES = """
SELECT vec_id // 20 AS sample_id, CAST(vec_id % 20 // 10 AS INT) AS batch_id,
       CAST(vec_id % 20 // 5 AS INT) AS gen_id, CAST(vec_id % 5 AS INT) AS token_pos,
       CAST(vec_id * 7 % 64 AS INT) AS target_id,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS logits
FROM embeddings"""


def score_counts(spark, sf):
    return token_scores(spark, sf).select("sample_id", "gen_id").distinct().withColumn(
        "num_tokens", (F.lit(2) + (F.col("sample_id") + F.col("gen_id")) % 4).cast("int")
    )


SCORE_COUNTS = f"""
SELECT DISTINCT sample_id, gen_id, CAST(2 + (sample_id + gen_id) % 4 AS INT) AS num_tokens
FROM ({TOKEN_SCORES})"""


def pair_logits(spark, sf):
    """Judgements of ordered answer pairs: three logits per pair, products of every third entry summed."""
    v = spectral_samples(spark, sf)
    a = v.select("sample_id", F.col("gen_id").alias("i"), F.col("vec").alias("x"))
    b = v.select("sample_id", F.col("gen_id").alias("j"), F.col("vec").alias("y"))
    both = a.join(b, "sample_id").filter("i <> j")
    return both.select(
        "sample_id", "i", "j",
        F.array(*[
            F.expr(f"aggregate(zip_with(x, y, (a, b) -> a * b), named_struct('s', 0D, 'd', 1), "
                   f"(t, v) -> named_struct('s', t.s + if(t.d % 3 = {k}, v, 0D), 'd', t.d + 1), t -> t.s) * 10 + (i - j) * 0.01D")
            for k in (1, 2, 0)
        ]).alias("logits"),
    )


PAIR_LOGITS = f"""
SELECT a.sample_id, a.gen_id AS i, b.gen_id AS j,
       list_transform([1, 2, 0], lambda k: list_sum(list_transform(range(1, len(a.vec) + 1), lambda d: CASE WHEN d % 3 = k THEN a.vec[d] * b.vec[d] ELSE 0 END)) * 10
         + (a.gen_id - b.gen_id) * CAST(0.01 AS DOUBLE)) AS logits
FROM ({SPECTRAL_SAMPLES}) a JOIN ({SPECTRAL_SAMPLES}) b ON a.sample_id = b.sample_id AND a.gen_id <> b.gen_id"""


def answer_sizes(spark, sf):
    return spectral_samples(spark, sf).groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def layer_features(spark, sf):
    """One labelled sample per vector, every entry a layer score."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("layer_scores"),
        (F.col("label") >= 5).cast("int").alias("label"),
    )


LAYER_FEATURES = """
SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS layer_scores, CAST(label >= 5 AS INT) AS label
FROM embeddings"""


def measured_features(spark, sf):
    """Layer features with the two correctness measures of the comparison."""
    e = table(spark, sf, "embeddings")
    x = F.col("embedding").cast("array<double>")
    return e.select(
        x.alias("layer_scores"),
        (F.col("label") / 10.0 + x[40]).alias("rouge_score"),
        (F.col("label") >= 5).cast("int").alias("y_rouge"),
        (F.col("label") / 10.0 + x[41]).alias("sim_score"),
        (F.col("label") >= 8).cast("int").alias("y_sim"),
    )


MEASURED_FEATURES = """
SELECT CAST(embedding AS DOUBLE[]) AS layer_scores,
       label / 10.0::DOUBLE + CAST(embedding[41] AS DOUBLE) AS rouge_score, CAST(label >= 5 AS INT) AS y_rouge,
       label / 10.0::DOUBLE + CAST(embedding[42] AS DOUBLE) AS sim_score, CAST(label >= 8 AS INT) AS y_sim
FROM embeddings"""


# --- texts --------------------------------------------------------------------------


def qa(spark, sf):
    """User turns with the assistant turn that follows directly."""
    c = table(spark, sf, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"]).select(
        F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"),
        "conv_id", "turn", "question", "answer",
    )


QA = """
SELECT u.conv_id || '_' || u.turn AS id, u.conv_id, u.turn, u.text AS question, a.text AS answer
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'"""

SCORES = [
    "perplexity", "energy", "entropy", "lexical_similarity", "sent_bertscore", "spectral_score", "output_spectral_score",
]


def records(spark, sf):
    """Result records: the answer's sentences are the generations, its first line the most likely one.

    ``prediction`` only overlaps with the answer: the question and the answer's last sentence.
    """
    q = qa(spark, sf).withColumn("lines", F.split("answer", "\n"))
    sentences = F.filter(F.transform(F.split("answer", r"[.\n]"), lambda s: F.trim(s)), lambda s: s != "")
    a, n = F.length("answer"), F.length("question")
    return q.select(
        "id", "conv_id", "question", "answer",
        F.slice(F.col("lines"), F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("additional_answers"),
        F.col("lines")[0].alias("most_likely_generation"),
        F.concat_ws(" ", "question", F.try_element_at(sentences, F.lit(-1))).alias("prediction"),
        sentences.alias("generations"),
        (n / (a + 1.0)).alias("perplexity"),
        (-a / 100.0).alias("energy"),
        (1.0 / (F.size(sentences) + 1)).alias("entropy"),
        (F.size(F.array_distinct(F.split("answer", " "))) / F.size(F.split("answer", " "))).alias("lexical_similarity"),
        F.lit(1.0).alias("sent_bertscore"),
        (-F.ln(a + 1.0)).alias("spectral_score"),
        ((n % 7) / 7.0).alias("output_spectral_score"),
    )


RECORDS = f"""
SELECT id, conv_id, question, answer, string_split(answer, chr(10))[2:] AS additional_answers,
       string_split(answer, chr(10))[1] AS most_likely_generation, concat_ws(' ', question, generations[-1]) AS prediction, generations,
       length(question) / (length(answer) + 1.0::DOUBLE) AS perplexity, -length(answer) / 100.0::DOUBLE AS energy,
       1.0::DOUBLE / (len(generations) + 1) AS entropy,
       len(list_distinct(string_split(answer, ' '))) / len(string_split(answer, ' ')) AS lexical_similarity,
       1.0::DOUBLE AS sent_bertscore, -ln(length(answer) + 1.0::DOUBLE) AS spectral_score,
       (length(question) % 7) / 7.0::DOUBLE AS output_spectral_score
FROM (SELECT *, list_filter(list_transform(string_split_regex(answer, '[.\\n]'), lambda s: trim(s)), lambda s: s <> '') AS generations
      FROM ({QA}))"""


def scored_docs(spark, sf):
    """Labelled documents with seven text-derived scores; whole texts."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    words = F.split("text", " ")
    n = F.length("text")
    return d.select(
        "doc_id", "lang", F.col("quality").alias("label"),
        (F.col("quality") * 0.6 + F.col("toxic") * 0.1 + 0.2).alias("similarity"),
        (1.0 - F.col("toxic") * 0.7).alias("other_similarity"),
        (F.lit(1) - F.col("toxic")).alias("other_label"),
        (F.col("n_chars") / 1000.0).alias("perplexity"),
        (-F.size(words) / 100.0).alias("energy"),
        (F.size(F.split("text", "\n")) / F.size(words)).alias("entropy"),
        (F.size(F.array_distinct(words)) / F.size(words)).alias("lexical_similarity"),
        F.lit(1.0).alias("sent_bertscore"),
        ((F.col("doc_id") * 37 % 101) / 101.0).alias("spectral_score"),
        ((n - F.length(F.regexp_replace("text", "[,.]", ""))) / (n + 1.0)).alias("output_spectral_score"),
    )


SCORED_DOCS = """
SELECT doc_id, lang, quality AS label, quality * 0.6::DOUBLE + toxic * 0.1::DOUBLE + 0.2::DOUBLE AS similarity,
       1.0::DOUBLE - toxic * 0.7::DOUBLE AS other_similarity, 1 - toxic AS other_label,
       n_chars / 1000.0::DOUBLE AS perplexity, -len(string_split(text, ' ')) / 100.0::DOUBLE AS energy,
       len(string_split(text, chr(10))) / len(string_split(text, ' ')) AS entropy,
       len(list_distinct(string_split(text, ' '))) / len(string_split(text, ' ')) AS lexical_similarity,
       1.0::DOUBLE AS sent_bertscore, (doc_id * 37 % 101) / 101.0::DOUBLE AS spectral_score,
       (length(text) - length(regexp_replace(text, '[,.]', '', 'g'))) / (length(text) + 1.0::DOUBLE) AS output_spectral_score
FROM documents JOIN labels USING (doc_id)"""


def conv_answers(spark, sf):
    """Every turn of a conversation as one answer of a sample, whole texts."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sample_id"), F.col("turn").cast("int").alias("gen_id"), "text"
    )


CONV_ANSWERS = "SELECT conv_id AS sample_id, CAST(turn AS INT) AS gen_id, text FROM conversations"


def doc_answers(spark, sf):
    """Documents in groups of five, whole texts."""
    return table(spark, sf, "documents").select(
        _div("doc_id", 5).alias("sample_id"), (F.col("doc_id") % 5).cast("int").alias("gen_id"), "text"
    )


DOC_ANSWERS = "SELECT doc_id // 5 AS sample_id, CAST(doc_id % 5 AS INT) AS gen_id, text FROM documents"


# --- matrix and token ids -----------------------------------------------------------


def matrix(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("row"), (F.col("l_partkey") % 50).alias("col"))
        .agg(
            F.round(F.sum("l_extendedprice"), 2).alias("importance"), F.round(F.sum("l_quantity"), 2).alias("weight")
        )
    )


MATRIX = """
SELECT l_suppkey AS row, l_partkey % 50 AS col, round(sum(l_extendedprice), 2) AS importance,
       round(sum(l_quantity), 2) AS weight
FROM lineitem GROUP BY ALL"""


def token_ids(spark, sf):
    """Word lengths of a turn stand in for its token ids."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("sample_id"), F.col("turn").cast("int").alias("gen_id"),
        F.transform(F.split("text", " "), lambda w: F.length(w)).alias("ids"),
    )


TOKEN_IDS = """
SELECT conv_id AS sample_id, CAST(turn AS INT) AS gen_id,
       list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INT)) AS ids
FROM conversations"""
