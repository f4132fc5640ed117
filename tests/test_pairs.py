import random

import pytest

from answerscope.operators import pairs as G

RNG = random.Random(11)


def greedy(n, same):
    ids = list(range(n))
    for i in range(n):
        for j in range(i + 1, n):
            if (i, j) in same:
                ids[j] = ids[i]
    return ids


@pytest.mark.parametrize("limit", [2, 1000])
def test_semantic_sets(spark, limit):
    sizes, rows, want = [], [], {}
    for s in range(12):
        n = RNG.randint(1, 14)
        same = {(i, j) for i in range(n) for j in range(i + 1, n) if RNG.random() < 0.3}
        if s == 0:  # one long chain
            n, same = 30, {(i, i + 1) for i in range(29)}
        sizes.append((s, n))
        rows += [(s, i, j, int((i, j) in same)) for i in range(n) for j in range(i + 1, n)]
        # a set is named by the root of the parent chain
        want[s] = greedy(n, same)
    dec = spark.createDataFrame(rows, "sample_id int, i int, j int, decision int")
    out = G.semantic_sets(dec, spark.createDataFrame(sizes, "sample_id int, n int"), limit).collect()
    for s, n in sizes:
        assert [r["set_id"] for r in sorted(out, key=lambda r: r["ans_id"]) if r["sample_id"] == s] == want[s]


@pytest.mark.parametrize("limit", [3, 1000])
def test_answer_pairs(spark, limit):
    rows = [(1, i, f"t{i}") for i in range(9)] + [(2, 0, "alone")]
    answers = spark.createDataFrame(rows, "sample_id int, ans_id int, text string")
    both = G.answer_pairs(answers, True, limit).collect()
    assert sorted((r["i"], r["j"]) for r in both) == [(i, j) for i in range(9) for j in range(9) if i != j]
    assert all(r["text_i"] == f"t{r['i']}" and r["text_j"] == f"t{r['j']}" for r in both)
    half = G.answer_pairs(answers, False, limit).collect()
    assert sorted((r["i"], r["j"]) for r in half) == [(i, j) for i in range(9) for j in range(i + 1, 9)]


def test_decisions_and_tensor(spark):
    logits = [
        (1, 0, 1, [0.0, 1.0, 2.0]), (1, 1, 0, [0.0, 3.0, 1.0]),  # entailment, neutral: same
        (1, 0, 2, [5.0, 5.0, 1.0]), (1, 2, 0, [0.0, 1.0, 0.0]),  # first maximum is contradiction: different
        (1, 1, 2, [0.0, 1.0, 0.0]), (1, 2, 1, [0.0, 0.0, 1.0]),
    ]
    df = spark.createDataFrame(logits, "sample_id int, i int, j int, logits array<double>")
    dec = {(r["i"], r["j"]): r for r in G.pair_decision(df).collect()}
    assert {k: r["decision"] for k, r in dec.items()} == {(0, 1): 1, (0, 2): 0, (1, 2): 1}
    assert abs(sum(dec[0, 1][f"prob_{c}"] for c in range(3)) - 1) < 1e-12
    sizes = spark.createDataFrame([(1, 3), (2, 1)], "sample_id int, n int")
    tensor = {(r["sample_id"], r["i"]): r["cells"] for r in G.similarity_tensor(df, sizes).collect()}
    assert tensor[1, 0] == [[0.0] * 3, [0.0, 1.0, 2.0], [5.0, 5.0, 1.0]] and tensor[2, 0] == [[0.0] * 3]
    with pytest.raises(Exception, match="lacks the judgement"):
        G.similarity_tensor(df.filter("j <> 2"), sizes).collect()
