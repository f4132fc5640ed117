"""Whole jobs: score a run, learn layer weights, compare scores, offline post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answerscope.functions.text import clean_answer
from answerscope.operators import evaluate, pairs, prompts, regress, sampling, similarity, spectral, tokens
from answerscope.session import stored
from answerscope.sources import results as R

SAMPLE = "sample_id"


def score_run(
    questions: DataFrame,
    greedy_scores: DataFrame,
    sampled_scores: DataFrame,
    score_counts: DataFrame,
    hidden: DataFrame,
    counts: DataFrame,
    answers: DataFrame,
    answer_vectors: DataFrame,
    layer: int,
    lo: int,
    hi: int,
    scope: str = "all",
    stem: bool = True,
) -> DataFrame:
    """Every uncertainty score of every question, one row per question.

    Each score is one aggregation per sample; the per-sample tables are then joined on the
    sample, whose scores are a few numbers wide. ``scope='last_batch'`` restricts entropy
    and the single-layer score to the last batch of generations.
    """
    rows = stored(spectral.layer_score_rows(hidden, counts, lo, hi), "layer-scores")
    if scope == "all" and lo <= layer <= hi:
        score = rows.filter(F.col("layer") == layer).select(SAMPLE, "spectral_score")
    else:
        chosen = hidden if scope == "all" else tokens.last_batch(hidden)
        last = spectral.pool_last_token(chosen, counts, [layer])
        score = spectral.spectral_score(last, probe=counts.select(SAMPLE))
    single = spectral.with_short_samples(score, hidden)
    layers = spectral.layer_score_array(rows)
    output = spectral.spectral_score(answer_vectors).withColumnRenamed("spectral_score", "output_spectral_score")
    parts = [
        tokens.greedy_scores(greedy_scores),
        tokens.length_normalized_entropy(sampled_scores, score_counts, scope=scope),
        similarity.lexical_similarity(answers, stem=stem),
        single,
        output,
        layers,
    ]
    out = questions
    for part in parts:
        out = out.join(part, SAMPLE, "left")
    return out


def learn_layer_weights(
    spark: SparkSession,
    results: DataFrame,
    base: str,
    model_name: str,
    dataset: str,
    penalty: str = "elasticnet",
    C: float = 1.0,
    l1_ratio: float = 0.5,
    test_size: float = 0.2,
    seed: int = 42,
    stem: bool = True,
) -> DataFrame:
    """Label, split, fit, measure and store; returns accuracy and AUROC per split.

    The labelled split is written once below ``base`` and read back, so the text
    comparison behind the labels is not repeated for fitting and measuring.
    """
    labelled = regress.features_and_labels(results, evaluate.uses_references(dataset), stem)
    path = f"{base.rstrip('/')}/{model_name}_{dataset}"
    labelled.write.mode("overwrite").parquet(f"{path}/labelled")
    split = sampling.stratified_split(spark.read.parquet(f"{path}/labelled"), "label", test_size, seed)
    R.save_test_split(split, f"{path}/test")
    model = regress.fit_layer_weights(split.filter("split = 'train'"), penalty, C, l1_ratio)
    weights = regress.weights_of(model)
    metrics = {r["split"]: (r["accuracy"], r["auroc"], r["n"]) for r in regress.fit_metrics(model, split).collect()}
    R.save_weights(spark, f"{path}/weights", weights, model_name, dataset)
    record = R.model_record(model_name, dataset, penalty, C, l1_ratio, metrics, len(weights))
    R.append_registry(spark.createDataFrame([record], R.MODEL_SCHEMA), f"{base.rstrip('/')}/models")
    return spark.createDataFrame([(s, *m) for s, m in metrics.items()], "split string, accuracy double, auroc double, n bigint")


def compare_scores(
    spark: SparkSession, test: DataFrame, similarities: DataFrame, base: str, model_name: str, dataset: str, id_col: str = "id"
) -> DataFrame:
    """Learnt weights against the layer mean on held-out rows, appended to the registry.

    ``similarities``: id, sim_score (semantic similarity of answer and reference). Rows are
    matched by id.
    """
    path = f"{base.rstrip('/')}/{model_name}_{dataset}"
    weights = R.load_weights(spark, f"{path}/weights", model_name, dataset)
    rows = test.join(similarities, id_col).select(
        "layer_scores",
        F.col("similarity").alias("rouge_score"),
        F.col("label").alias("y_rouge"),
        "sim_score",
        (F.col("sim_score") > evaluate.COSINE_CUTOFF).cast("int").alias("y_sim"),
    )
    out = regress.weighted_vs_mean(rows, weights)
    record = R.evaluation_record(out, model_name, dataset)
    R.append_registry(record, f"{base.rstrip('/')}/evaluations")
    return R.read_registry(spark, f"{base.rstrip('/')}/evaluations", model_name=model_name, dataset_name=dataset)


def clean_records(records: DataFrame) -> DataFrame:
    """Adds ``cleaned``: every generation cut at the answer markers."""
    return records.withColumn("cleaned", F.transform("generations", lambda g: clean_answer(g)))


def offline_stages(
    spark: SparkSession, base: str, specs: str, run: int, records: DataFrame, pair_logits: DataFrame | None = None,
    token_scores: DataFrame | None = None, verdict_logits: DataFrame | None = None, responses: DataFrame | None = None,
    verdict_ids: tuple[int, int] = (0, 1), clean: bool = True, stem: bool = False,
) -> dict[str, DataFrame]:
    """Post-processing of a stored run, each stage computed once and kept under its key and the inputs' content.

    cleaned texts -> judge inputs and verdicts -> rating prompts and true/false prompts for
    every generation -> lexical similarity -> reference scores. ``records`` has id, question,
    answer, additional_answers, generations and dataset.

    What models said about the generations comes in as tables by (sample_id, gen_id):
    ``token_scores`` (as ``tokens.likelihood_summary`` takes them), ``verdict_logits`` (``logits`` of the
    answer to the true/false prompt; ``verdict_ids`` are the entries of true and false) and
    ``responses`` (``response`` to the rating prompt). Each is a stage, and ``generation_scores`` holds one
    row a generation with all of it beside the reference scores.
    """

    given = {"pairs": pair_logits, "tokens": token_scores, "verdicts": verdict_logits, "responses": responses}
    content = R.content_key(records, stem, verdict_ids, *[x for k, v in given.items() if v is not None for x in (k, v)])

    def stage(name: str, build) -> DataFrame:
        return R.stage_cache(spark, base, f"{R.cache_key(specs, run, clean=clean)}_{content}_{name}", build)

    cleaned = stage("texts", lambda: clean_records(records))
    used = cleaned.withColumn("generations", F.col("cleaned")) if clean else cleaned
    long = sampling.explode_generations(used).withColumnRenamed("id", SAMPLE)
    out = {"texts": cleaned}
    numbered = stage("answers", lambda: similarity.numbered_answers(long, SAMPLE, "text"))
    questions = cleaned.select(F.col("id").alias(SAMPLE), "question")
    out["judge_inputs"] = stage("judge", lambda: pairs.nli_inputs(numbered, questions))
    if pair_logits is not None:
        out["decisions"] = stage("decisions", lambda: pairs.pair_decision(pair_logits))
    out["ratings"] = stage("ratings", lambda: prompts.rating_prompts(used))
    out["self_evaluation"] = stage("self-evaluation", lambda: prompts.self_eval_prompts(used))
    out["lexical"] = stage("lexical", lambda: similarity.lexical_similarity(long, stem=stem))
    out["reference_scores"] = stage("rouge", lambda: similarity.score_generations(used, stem=stem))
    if token_scores is not None:
        out["likelihoods"] = stage("likelihoods", lambda: tokens.likelihood_summary(token_scores))
    if verdict_logits is not None:
        out["verdicts"] = stage("verdicts", lambda: prompts.verdicts(verdict_logits, *verdict_ids))
    if responses is not None:
        out["rated"] = stage("rated", lambda: responses.select(SAMPLE, "gen_id", prompts.parse_rating(F.col("response")).alias("rating")))
    out["generation_scores"] = stage("generation-scores", lambda: generation_scores(out))
    return out


def generation_scores(stages: dict[str, DataFrame]) -> DataFrame:
    """One row a generation: its reference scores, and what the stages that are there say of it.

    Joins of rows a few numbers wide on (sample_id, gen_id).
    """
    scores = stages["reference_scores"].withColumnRenamed("id", SAMPLE)
    keys = [SAMPLE, "gen_id"]
    parts = [stages[name] for name in ("verdicts", "rated") if name in stages]
    if "likelihoods" in stages:
        rows = stages["likelihoods"].filter("gen_id IS NOT NULL")
        of = lambda conditioned, c: F.max(F.when(F.col("conditioned") == conditioned, F.col(c)))
        parts.append(rows.groupBy(*keys).agg(
            of(True, "neg_log_likelihood").alias("neg_log_likelihood"), of(True, "length").alias("length"),
            of(True, "mean_token_entropy").alias("mean_token_entropy"), of(False, "neg_log_likelihood").alias("unconditioned_neg_log_likelihood"),
        ))
    for part in parts:
        scores = scores.join(part, keys, "left")
    return scores


def continue_run(
    spark: SparkSession, base: str, identity: dict, pending: DataFrame, process, id_col: str = "id"
) -> int:
    """Finishes a run: records found in earlier whole runs are taken over, the rest is processed.

    ``identity`` names model, dataset and project; ``process`` maps pending records to result
    records. Of an id stored several times the newest record counts; with nothing stored,
    all is processed. The whole is stored as a new unsharded run, whose claimed number is returned and whose
    configuration is registered beside the results.
    """
    done = R.stored_results(spark, base, **identity)
    run = R.claim_run(spark, base, **identity)
    if done is None:
        records = process(pending)
    else:
        records = sampling.resume_union(pending, R.latest_records(done, id_col).drop(*R.RUN_COLUMNS, "partial"), process, id_col)
    R.write_results(records, base, *identity.values(), run)
    R.register_run(spark, f"{base.rstrip('/')}-configurations", identity | {"shard_id": 0, "run_id": run})
    return run


def score_and_store(
    spark: SparkSession, base: str, records: DataFrame, scores: DataFrame, model: str, dataset: str, project: str, num_shards: int = 1
) -> DataFrame:
    """Result records with their scores, stored shard by shard under the next run number and merged again.

    ``records`` has id and the texts, ``scores`` id and the score columns. Every call is a run of
    its own, whose configuration is registered beside the results.
    """
    results = f"{base.rstrip('/')}/results"
    run = R.claim_run(spark, results, model, dataset, project)
    numbered = sampling.with_shard_id(stored(records.join(scores, "id"), "scored"), num_shards, ["id"])
    for shard in range(num_shards):
        part = numbered.filter(F.col("shard_id") == shard).drop("shard_id")
        R.write_results(part, results, model, dataset, project, run, shard, num_shards)
    config = {"model": model, "dataset": dataset, "project": project, "shard_id": 0, "run_id": run, "num_shards": num_shards}
    R.register_run(spark, f"{base.rstrip('/')}/configurations", config)
    return R.merge_shards(spark, results, model, dataset, project, list(range(num_shards)), run)


def evaluate_stored(
    spark: SparkSession, base: str, similarities: DataFrame, keys: tuple[str, ...] = ("dataset",), stem: bool = True, **identity
) -> tuple[DataFrame, DataFrame]:
    """(summary table, full report) of stored runs under both correctness measures.

    Results are labelled by text overlap and by ``similarities`` (id, sim_score); both measures
    stand in one table of rows, kept under the content of both: new runs, other similarities or
    another ``stem`` are labelled anew, unchanged ones are not.
    """
    results = R.read_results(spark, base, **identity).join(similarities, "id")
    scored = evaluate.correctness(results, "rouge", multi_reference=True, stem=stem)
    measures = F.array(
        F.struct(F.lit("rouge").alias("measure"), F.col("similarity").alias("similarity"), F.col("label").alias("label")),
        F.struct(
            F.lit("cosine").alias("measure"), F.col("sim_score").alias("similarity"),
            (F.col("sim_score") > evaluate.COSINE_CUTOFF).cast("int").alias("label"),
        ),
    )
    flat = scored.select(*keys, *evaluate.ORIENTATION, F.explode(measures).alias("m")).select(*keys, *evaluate.ORIENTATION, "m.*")
    name = "_".join(map(str, identity.values())) or "all"
    rows = R.stage_cache(spark, base.rstrip("/") + "-labelled", name, lambda: flat, (results, keys, stem))
    return evaluate.paper_table(rows, list(keys)), evaluate.evaluate_run(rows, [*keys, "measure"])
