import json

import pytest
from pyspark.sql import functions as F

from answerscope.functions import ids as I
from answerscope.operators import prompts as C
from answerscope.sources import questions as Q
from answerscope.sources import results as R


def write(path, doc):
    path.write_text(doc if isinstance(doc, str) else json.dumps(doc))
    return str(path)


def test_coqa(spark, tmp_path):
    turn = lambda *xs: [{"input_text": x} for x in xs]
    doc = {"version": "1", "data": [{
        "id": "s1", "story": "Once.", "questions": turn("Who?", "Where?"),
        "answers": [{"input_text": "A fox", "span_start": 3}, {"input_text": "Here", "span_start": -1}],
        "additional_answers": {"0": turn("fox", "here"), "1": turn("a fox", "in"), "2": turn("the fox", "at home")},
    }]}
    rows = sorted(Q.read_coqa(spark, write(tmp_path / "c.json", doc)).collect())
    assert [r["id"] for r in rows] == ["s1_0", "s1_1"]
    assert rows[1]["answer"].asDict() == {"text": "Here", "answer_start": -1}
    assert rows[1]["additional_answers"] == ["here", "in", "at home"] and rows[0]["story"] == "Once."


def test_squad(spark, tmp_path):
    qa = lambda i, bad, answers: {"id": i, "question": "q" + i, "is_impossible": bad, "answers": [{"text": a, "answer_start": n} for n, a in enumerate(answers)]}
    doc = {"data": [{"title": "t", "paragraphs": [{"context": "ctx", "qas": [qa("1", False, ["x", "y"]), qa("2", True, [])]}]}]}
    rows = Q.read_squad(spark, write(tmp_path / "s.json", doc)).collect()
    assert len(rows) == 1 and rows[0]["answer"]["text"] == "x" and rows[0]["additional_answers"] == ["x", "y"]
    assert Q.contexts(Q.read_squad(spark, str(tmp_path / "s.json"))).collect()[0].asDict() == {"id": "1", "story": "ctx"}


def test_nq_open(spark, tmp_path):
    lines = [{"question": "a", "answer": ["1", "2"]}, {"question": "b", "answer": ["3"]}, {"question": "a", "answer": ["4", "5", "6"]}]
    path = write(tmp_path / "nq.json", "\n".join(json.dumps(x) for x in lines))
    rows = sorted((r["answer"]["text"], r["id"], r["additional_answers"]) for r in Q.read_nq_open(spark, path).collect())
    assert rows == [("1", "2", ["2"]), ("3", "1", []), ("4", "2", ["5", "6"])]


def test_lines_are_numbered_across_files_and_splits(spark, tmp_path):
    for name, lo, hi in (("b.json", 700, 1000), ("a.json", 0, 700)):
        write(tmp_path / name, "\n\n".join(f"line {i:05d} " + "x" * (i % 50) for i in range(lo, hi)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = Q.number_lines(spark, str(tmp_path)).collect()
        assert Q.number_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["row_idx"], int(r["value"][5:10])) for r in rows) == [(i, i) for i in range(1000)]


def test_trivia(spark, tmp_path):
    lines = [{"question_id": "t1", "question": "q", "answer": {"value": "v"}, "search_results": {"a": 1}}] * 2 + [
        {"question_id": "t2", "question": "r", "answer": {"value": "w"}}
    ]
    path = write(tmp_path / "t.json", "\n".join(json.dumps(x) for x in lines))
    rows = sorted((r["id"], r["question"], r["answer"]["text"]) for r in Q.read_triviaqa(spark, path).collect())
    assert rows == [("t1", "q", "v"), ("t2", "r", "w")]


def test_save_load(spark, tmp_path):
    path, calls = str(tmp_path / "qa"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert Q.load_qa(spark, path, build).count() == 3 and Q.load_qa(spark, path, build).count() == 3
    assert calls == [1]


def test_runs(spark, tmp_path):
    base = str(tmp_path / "results")
    rows = spark.createDataFrame([("a", -1.5)], "id string, eigenIndicator double")
    R.write_results(rows, base, "m", "nq_open", "p", 0, 0, 2)
    R.write_results(rows.withColumn("id", F.lit("b")), base, "m", "nq_open", "p", 0, 1, 2)
    df = R.read_results(spark, base, dataset="nq_open")
    assert sorted((r["id"], r["shard_id"], r["spectral_score"]) for r in df.collect()) == [("a", 0, -1.5), ("b", 1, -1.5)]
    with pytest.warns(UserWarning, match="shard 2"):
        assert R.merge_shards(spark, base, "m", "nq_open", "p", [0, 1, 2]).count() == 2
    with pytest.raises(FileNotFoundError):
        with pytest.warns(UserWarning):
            R.merge_shards(spark, base, "m", "other", "p", [0])
    with pytest.raises(FileNotFoundError):
        R.merge_shards(spark, str(tmp_path / "none"), "m", "nq_open", "p", [0])
    identity = {"model": "m", "dataset": "nq_open", "project": "p", "shard_id": 0}
    assert R.next_run_id(df, **identity) is None and R.run_exists(df, **identity)
    assert R.next_run_id(df, overwrite=True, **identity) == 1
    assert R.next_run_id(df, model="new") == 0 and R.next_run_id(None) == 0
    partial = df.withColumn("partial", F.lit(True))
    assert R.next_run_id(partial, **identity) == 0


def test_foreign_layout(spark, tmp_path):
    folder = tmp_path / "m7_SQuAD_base_2"
    spark.range(2).withColumnRenamed("id", "n").write.parquet(str(folder / "0.parquet"))
    df = R.with_run_from_path(spark.read.parquet(str(folder / "0.parquet")))
    row = df.first()
    assert (row["model"], row["dataset"], row["project"], row["shard_id"], row["run_id"]) == ("m7", "SQuAD", "base", 2, 0)


def test_registries(spark, tmp_path):
    path = str(tmp_path / "w")
    R.save_weights(spark, path, [0.5, 0.0, -1.25], "m", "coqa")
    R.save_weights(spark, path, [9.0], "m", "squad")
    assert R.load_weights(spark, path, "m", "coqa") == [0.5, 0.0, -1.25]
    doc = write(tmp_path / "w.json", json.dumps({"weights": [1.0, 2.0], "model_name": "m", "dataset_name": "d"}, indent=1))
    assert [(r["layer"], r["weight"]) for r in R.read_weights_json(spark, doc).orderBy("layer").collect()] == [(0, 1.0), (1, 2.0)]
    runs = str(tmp_path / "runs")
    R.register_run(spark, runs, {"model": "m", "dataset": "d", "project": "p", "shard_id": 0, "run_id": 3, "top_k": 10})
    assert json.loads(R.run_config(spark, runs, run_id=3).first()["config"])["top_k"] == 10


def test_cache_key_and_stage_cache(spark, tmp_path):
    assert R.cache_key("m_coqa_0", 3, model="org/nli", clean=True) == "m_coqa_0_3_model=org#nli_cleaned"
    assert R.cache_key("m_coqa_0", 3, ith=2) == "m_coqa_0_3_2"
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert R.stage_cache(spark, str(tmp_path), "k", lambda: build(4)).count() == 4
    assert R.stage_cache(spark, str(tmp_path), "k", lambda: build(5)).count() == 4 and built == [4]


def test_prompts(spark):
    df = spark.createDataFrame(
        [("s_0", "Who?", "A fox", [" fox", "dog", "fox"], "coqa")], "id string, question string, answer string, generations array<string>, dataset string"
    )
    stories = spark.createDataFrame([("s_0", "Once.")], "id string, story string")
    rows = C.self_eval_prompts(df, stories).orderBy("gen_id").collect()
    assert len(rows) == 3
    assert rows[1]["prompt"] == (
        "Once.\nQuestion: Who?\nHere are some brainstormed ideas: fox\ndog\nPossible Answer: dog\nIs the possible answer:\n"
        "(A) True\n(B) False\nThe possible answer is: ("
    )
    assert C.self_eval_prompts(df).first()["prompt"].startswith("Question: Who?")
    judge = C.rating_prompts(df, 0).first()["prompt"]
    assert judge.startswith("Rate the level of consistency") and judge.endswith("Question: Who?\nReference: A fox\nAnswer: fox\nRating:")
    assert "Rating: 100.\n\nQuestion: what is the library for?" in judge and "Rating: 0.\n\nQuestion: Who?" in judge
    assert C.rating_prompts(df, 7).first()["prompt"] is None
    ratings = spark.createDataFrame([(i, t) for i, t in enumerate(["85. Good", " 90 of 100", ".", "", "7.5"])], "k int, t string")
    assert [r["r"] for r in ratings.select("k", C.parse_rating(F.col("t")).alias("r")).orderBy("k").collect()] == ["85", "90", None, None, "7"]
    few = df.select(C.trivia_prompt(F.col("question")).alias("p")).first()["p"]
    assert few == "Answer these questions:\nQ: In Scotland a bothy/bothie is a?\nA: House\nQ: Who?\nA:"


def test_id_arrays(spark):
    df = spark.createDataFrame([([5, 1, 9, 2, 0], [[7, 8], [9], []])], "ids array<int>, gens array<array<int>>")
    ids = F.col("ids")
    r = df.select(
        I.num_tokens(ids).alias("n"), I.strip_special(ids, 1, 2).alias("s"), I.mask_labels(ids, 1).alias("m"),
        I.split_completion(ids, F.lit(2)).alias("c"), I.split_completion(ids, F.lit(9)).alias("e"), I.pad_generations(F.col("gens"), 1, 2).alias("p"),
    ).first()
    assert (r["n"], r["s"], r["m"], r["c"], r["e"], r["p"]) == (3, [5, 9, 0], [5, -100, 9, 2, 0], [9, 2, 0], [], [[7, 8], [9, 1]])


def test_a_run_written_twice_is_read_once(spark, tmp_path):
    """A job that runs again replaces its own run and leaves the others."""
    base = str(tmp_path / "runs")
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, spectral_score double")
    for run in (0, 1, 1):
        R.write_results(df, base, "m", "coqa", "p", run)
    assert R.read_results(spark, base).count() == 4
    assert R.read_results(spark, base, model="m", dataset="coqa", project="p", shard_id=0, run_id=1).count() == 2
    assert {r["run_id"] for r in R.read_results(spark, base, run_id=1).collect()} == {1}


def test_runs_without_the_partial_mark_count(spark):
    rows = [("m", "d", "p", 0, 0, None), ("m", "d", "p", 0, 1, False), ("m", "d", "p", 0, 2, True)]
    df = spark.createDataFrame(rows, "model string, dataset string, project string, shard_id int, run_id int, partial boolean")
    assert R.finished_runs(df).first()["next_run_id"] == 2
    assert R.next_run_id(df, overwrite=True) == 2 and R.run_exists(df)


def test_an_unfinished_question_set_is_written_again(spark, tmp_path):
    path = str(tmp_path / "qa")
    spark.range(3).write.parquet(path)
    (tmp_path / "qa" / "_SUCCESS").unlink()
    (tmp_path / "qa" / "._SUCCESS.crc").unlink(missing_ok=True)
    assert Q.load_qa(spark, path, lambda: spark.range(5)).count() == 5
    assert Q.load_qa(spark, path, lambda: spark.range(9)).count() == 5


def test_line_numbers_are_one_numbering(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(f"{k}-{i}\n" + "\n" * (i % 2) for i in range(50)))
    got = Q.number_lines(spark, str(tmp_path)).orderBy("row_idx").collect()
    assert [(r["value"], r["row_idx"]) for r in got] == [(f"{k}-{i}", k * 50 + i) for k in range(3) for i in range(50)]
