"""What must hold of the physical plans: pushed filters, narrow shuffles, checked broadcasts."""

import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from answerscope import session
from answerscope.operators import evaluate as H
from answerscope.operators import sampling as B
from answerscope.operators import similarity as D
from answerscope.operators import spectral as S
from answerscope.operators import tokens as T
from answerscope.plans import views as V

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged(text: str) -> list[str]:
    """What feeds each shuffle: the line below every Exchange."""
    lines = text.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines[:-1]) if " Exchange " in line]


def test_a_shard_is_a_pushed_range_filter(spark):
    orders = V.table(spark, SF, "orders").select("o_orderkey", "o_totalprice")
    text = plan(B.shard(orders, 4, 1, ["o_orderkey"]))
    assert "Exchange" not in text
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderkey.*LessThan\(o_orderkey", text)


@pytest.mark.parametrize("score", [T.perplexity, T.energy])
def test_logits_are_reduced_before_the_shuffle(spark, score):
    text = plan(score(V.token_scores(spark, SF)))
    assert text.count(" Exchange ") == 1
    assert all("partial_avg" in line for line in exchanged(text))


def shuffled_columns(df) -> list[set[str]]:
    """The columns that go through each shuffle of rows; partial aggregates are named as such."""
    out = []

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.initialPlan())
        if node.nodeName() == "Exchange":
            below = node.child()
            attributes = below.output()
            partial = "Aggregate" in below.nodeName() and "partial_" in below.toString().splitlines()[0]
            out.append({"partial"} if partial else {attributes.apply(i).name() for i in range(attributes.size())})
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return out


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """As with tables far beyond every broadcast bound."""
    from answerscope.operators import groups

    monkeypatch.setattr(groups, "NARROW_BROADCAST_ROWS", 0)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_vectors_of_other_steps_are_dropped_at_the_scan(spark, no_broadcast):
    h, c = V.hidden_states(spark, SF), V.token_counts(spark, SF)
    text = plan(S.pool_last_token(h, c, [2]))
    assert "Exchange" not in text and "Join" not in text


def test_no_vector_or_logit_is_shuffled(spark, no_broadcast):
    h, c = V.hidden_states(spark, SF), V.token_counts(spark, SF)
    t, n = V.token_scores(spark, SF), V.score_counts(spark, SF)
    queries = [
        S.pool_last_token(h, c), S.pool_mean_tokens(h, c), T.sequence_embedding(h, 4, ["sample_id", "gen_id"]),
        T.length_normalized_entropy(t, n), T.length_normalized_entropy(t, n, scope="last_batch"),
    ]
    for df in queries:
        for columns in shuffled_columns(df):
            assert not columns & {"vec", "logits", "embedding"}, columns


def test_lengths_carried_in_the_table_change_no_result(spark):
    h, c = V.hidden_states(spark, SF), V.token_counts(spark, SF)
    bare = h.drop("num_tokens", "last_step")
    rows = lambda df: sorted((tuple(map(str, r)) for r in df.collect()))
    for pool in (S.pool_last_token, S.pool_mean_tokens):
        for compat in (False, True):
            kept = lambda df: df.select("sample_id", "gen_id", "layer", F.transform("vec", lambda x: F.round(x, 9) + 0.0))
            want = rows(kept(pool(bare, c, [1, 2], compat)))
            assert rows(kept(pool(h, c, [1, 2], compat))) == want
            assert rows(kept(pool(S.with_lengths(bare, c), c, [1, 2], compat))) == want


def test_counts_per_score_are_combined_before_the_shuffle(spark):
    rows = V.table(spark, SF, "orders").select(
        F.lit("m").alias("method"), F.col("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").cast("int").alias("label")
    )
    assert any("partial_sum" in line for line in exchanged(plan(H.auroc(rows, ["method"]))))


def test_reference_scores_need_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "records")
    V.records(spark, SF).write.parquet(path)
    assert " Exchange " not in plan(D.score_generations(spark.read.parquet(path)))


def test_copies_of_an_answer_merge_before_the_shuffle(spark):
    text = plan(D.distinct_answers(V.table(spark, SF, "conversations"), "conv_id", "text"))
    assert all("partial_count" in line for line in exchanged(text))


def test_narrow_tables_above_the_bound_are_not_broadcast(spark, monkeypatch):
    from answerscope.operators import groups

    monkeypatch.setattr(groups, "NARROW_BROADCAST_ROWS", 3)
    hinted = groups.broadcast_narrow(spark.range(10), 10)
    assert "ResolvedHint" not in hinted._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in groups.broadcast_narrow(spark.range(2), 2)._jdf.queryExecution().analyzed().toString()


CONFIGURED = """
import sys
sys.path.insert(0, sys.argv[2])
from answerscope import session
spark = session.local_session(2, "conf", spark__checkpoint__dir=sys.argv[1])
assert session.shared_dir(spark) == sys.argv[1], session.shared_dir(spark)
assert session.scratch_path(spark, "x").startswith(sys.argv[1])
assert session.checkpointed(spark.range(5)).count() == 5
"""


def test_shared_folder_comes_from_the_session(tmp_path):
    """The folder is fixed when a session starts, so this needs a session of its own."""
    folder = tmp_path / "shared"
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", CONFIGURED, str(folder), repo], check=True, timeout=120)
    assert any(p.is_file() for p in folder.rglob("*"))


def test_pairs_are_not_joined_by_sample(spark, no_broadcast):
    """A sample with a third of all answers has most of all pairs: questions and sizes come before pairing."""
    from answerscope.operators import pairs as G

    answers = spark.range(30).select(F.when(F.col("id") < 10, 0).otherwise(F.col("id")).cast("int").alias("sample_id"), F.col("id").cast("int").alias("ans_id"), F.lit("x").alias("text"))
    questions = answers.select("sample_id").distinct().withColumn("question", F.lit("q"))
    text = plan(G.nli_inputs(answers, questions))
    joins = [k for k, line in enumerate(text.splitlines()) if "Join" in line]
    generators = [k for k, line in enumerate(text.splitlines()) if "Generate" in line]
    assert joins and min(joins) > max(generators)  # children are printed below their parents
    logits = spark.range(4).select(F.lit(0).alias("sample_id"), (F.col("id") % 2).alias("i"), (1 - F.col("id") % 2).alias("j"), F.array(F.lit(0.0)).alias("logits"))
    sizes = spark.createDataFrame([(0, 2)], "sample_id int, n int")
    assert "Join" not in plan(G.similarity_tensor(logits, sizes))


def test_a_sample_of_many_texts_is_numbered_in_pieces(spark):
    """Texts that agree in their first characters included."""
    texts = spark.range(600).select(
        F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 5).alias("sample_id"),
        F.concat(F.repeat(F.lit("same "), 20), ((F.col("id") * 7919) % 601).cast("string")).alias("text"),
    )
    whole = {(r["sample_id"], r["text"]): r["ans_id"] for r in D.numbered_answers(texts, "sample_id", "text").collect()}
    cut = {(r["sample_id"], r["text"]): r["ans_id"] for r in D.numbered_answers(texts, "sample_id", "text", rows_per_bucket=40).collect()}
    assert cut == whole


def test_a_hot_text_is_numbered_without_a_shuffle(spark, no_broadcast):
    """One text is a third of all answers, in a sample that holds most; null texts have no number."""
    n = F.col("id")
    answers = spark.range(900).select(
        F.when(n % 5 < 3, "big").otherwise((n % 7).cast("string")).alias("sample_id"),
        n.cast("int").alias("gen_id"),
        F.when(n % 3 == 0, F.lit("hot")).when(n % 97 == 1, None).otherwise(F.concat(F.lit("t"), (n % 50).cast("string"))).alias("text"),
    )
    whole = D.answer_index(answers, "sample_id", "gen_id", "text")
    cut = D.answer_index(answers, "sample_id", "gen_id", "text", hot_copies=40)
    assert cut.columns == whole.columns
    text = plan(cut)  # as planned, before it runs
    rows = sorted(map(tuple, whole.collect()))
    assert sorted(map(tuple, cut.collect())) == rows and len({r[1] for r in rows}) == answers.filter("text IS NOT NULL").count()
    assert text.count("BroadcastHashJoin") == 2 and text.count("SortMergeJoin") == 1
    hot_side = text[text.rindex("BroadcastHashJoin"):]
    assert "hashpartitioning" not in hot_side
