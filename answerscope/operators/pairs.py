"""Semantic comparison of a sample's distinct answers.

The judge model's verdicts arrive as ``pair_logits`` (sample_id, i, j, logits), one row per
ordered pair, logits = (contradiction, neutral, entailment).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerscope.functions.arrays import argmax, softmax
from answerscope.operators.groups import GROUP_LIMIT, pair_tiles, split_by_size
from answerscope.operators.prompts import nli_joined, nli_side
from answerscope.operators.similarity import TEXT_TILE
from answerscope.session import checkpointed

SAMPLE = "sample_id"


def answer_pairs(answers: DataFrame, ordered: bool = True, limit: int = TEXT_TILE) -> DataFrame:
    """The pairs a judge has to look at: (sample, i, j, text_i, text_j).

    ``answers`` holds numbered distinct answers (sample_id, ans_id, text). The pair list is
    itself the result here; it is unrolled from tiles, so a large sample is spread over
    many tasks. ``ordered=False`` keeps i < j only.
    """
    item = F.struct("ans_id", "text")
    tiles = pair_tiles(answers, [SAMPLE], item, F.col("ans_id"), limit, probe=answers.select(SAMPLE))
    left = tiles.select(SAMPLE, "lo", "hi", "right_items", F.explode("left_items").alias("a"))
    both = left.select(SAMPLE, "lo", "hi", "a", F.explode("right_items").alias("b"))
    a, b = F.col("a"), F.col("b")
    first = F.when(a["ans_id"] < b["ans_id"], a).otherwise(b)
    second = F.when(a["ans_id"] < b["ans_id"], b).otherwise(a)
    # a diagonal tile meets every pair twice, the others once
    once = both.filter(
        F.when(F.col("lo") == F.col("hi"), a["ans_id"] < b["ans_id"]).otherwise(F.lit(True))
    ).select(SAMPLE, first.alias("x"), second.alias("y"))
    if ordered:
        ways = F.explode(F.array(F.struct(F.col("x"), F.col("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
        once = once.select(SAMPLE, ways.alias("p")).select(SAMPLE, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return once.select(
        SAMPLE,
        F.col("x.ans_id").alias("i"), F.col("y.ans_id").alias("j"),
        F.col("x.text").alias("text_i"), F.col("y.text").alias("text_j"),
    )


def nli_inputs(answers: DataFrame, questions: DataFrame, ordered: bool = True) -> DataFrame:
    """Judge input text per pair of numbered answers; ``questions``: sample_id, question.

    Each answer gets its question before pairing: the join has a row for each answer, not
    for each pair.
    """
    asked = answers.join(questions, SAMPLE).select(SAMPLE, "ans_id", nli_side(F.col("question"), F.col("text")).alias("text"))
    return answer_pairs(asked, ordered).select(SAMPLE, "i", "j", nli_joined(F.col("text_i"), F.col("text_j")).alias("nli_text"))


def similarity_tensor(pair_logits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the n x n x 3 tensor: (sample, i, cells), zeros on the diagonal.

    ``sizes``: sample_id, n (number of distinct answers). One output row per tensor row, so
    no sample is assembled in one place.
    """
    lines = sizes.select(SAMPLE, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    zero = F.array(*[F.lit(0.0)] * 3)
    diagonal = lines.select(SAMPLE, F.col("i").cast("int").alias("i"), F.col("i").cast("int").alias("j"), zero.alias("logits"), "n")
    cells = pair_logits.select(
        SAMPLE, F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "logits", F.lit(None).cast("int").alias("n")
    )
    packed = F.array_sort(F.collect_list(F.struct("j", "logits")))
    rows = diagonal.unionByName(cells).groupBy(SAMPLE, "i").agg(
        F.transform(packed, lambda s: s["logits"]).alias("cells"), F.max("n").alias("n")  # the diagonal brings it
    )
    whole = F.when(F.size("cells") == F.col("n"), F.col("cells")).otherwise(
        F.raise_error(F.lit("a sample lacks the judgement of some answer pair"))
    )
    return rows.select(SAMPLE, "i", whole.alias("cells"))


def pair_decision(pair_logits: DataFrame) -> DataFrame:
    """One row per unordered pair: same answer or not, and the mean class probabilities.

    A pair differs when either direction's best class is 0 (contradiction). Both directions
    meet in one aggregation instead of a self-join.
    """
    rows = pair_logits.select(
        SAMPLE,
        F.least("i", "j").alias("i"),
        F.greatest("i", "j").alias("j"),
        (F.col("i") > F.col("j")).alias("_back"),
        argmax(F.col("logits")).alias("_best"),
        softmax(F.col("logits")).alias("_p"),
    )
    forward, back = ~F.col("_back"), F.col("_back")

    def mean_probability(c: int):
        return F.avg(F.col("_p")[c])

    return (
        rows.groupBy(SAMPLE, "i", "j")
        .agg(
            F.min("_best").alias("_min"),
            F.max(F.when(forward, F.col("_best"))).alias("forward_class"),
            F.max(F.when(back, F.col("_best"))).alias("backward_class"),
            *[mean_probability(c).alias(f"prob_{c}") for c in range(3)],
        )
        .select(
            SAMPLE, "i", "j", "forward_class", "backward_class",
            (F.col("_min") != 0).cast("int").alias("decision"),
            "prob_0", "prob_1", "prob_2",
        )
    )


def has_different_answers(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy(SAMPLE).agg(
        F.max((F.col("decision") == 0).cast("int")).alias("has_different")
    )


def semantic_sets(decisions: DataFrame, sizes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(sample, ans_id, set_id): greedy merge of answers judged the same.

    Answer j joins the set of the largest i < j judged the same, so ``parent(j)`` is one
    aggregate and the set is the root of j's parent chain. Samples of bounded size resolve
    the chain by a fold over their parent array; larger ones by doubling: every round
    replaces each parent by its parent's parent, so r rounds cover chains of 2^r links.
    """
    links = decisions.filter(F.col("decision") == 1).groupBy(SAMPLE, "j").agg(F.max("i").alias("_p"))
    nodes = sizes.select(SAMPLE, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("ans_id"))
    parents = nodes.join(links.withColumnRenamed("j", "ans_id"), [SAMPLE, "ans_id"], "left").select(
        SAMPLE, F.col("ans_id").cast("int").alias("ans_id"), F.coalesce("_p", "ans_id").cast("int").alias("parent")
    )
    small, big = split_by_size(parents, [SAMPLE], limit, probe=nodes)
    ordered = F.array_sort(F.collect_list(F.struct("ans_id", "parent")))
    roots = F.aggregate(
        ordered,
        F.array().cast("array<int>"),
        lambda acc, s: F.concat(
            acc, F.array(F.when(s["parent"] == s["ans_id"], s["ans_id"]).otherwise(F.get(acc, s["parent"])))
        ),
    )
    folded = small.groupBy(SAMPLE).agg(roots.alias("_r")).select(
        SAMPLE, F.posexplode("_r").alias("ans_id", "set_id")
    )
    if big is None:
        return folded
    return folded.unionByName(_resolve_roots(big.drop("group_rows")))


def _resolve_roots(parents: DataFrame) -> DataFrame:
    """Roots of parent chains by pointer doubling, one checkpoint per round.

    Answers that have reached their root leave the loop, so a root with very many answers
    below it is not joined again and again.
    """
    pointers = checkpointed(parents)
    moving, done = pointers, None
    while True:
        above = pointers.select(SAMPLE, F.col("ans_id").alias("parent"), F.col("parent").alias("_up"))
        stepped = checkpointed(moving.join(above, [SAMPLE, "parent"]).select(
            SAMPLE, "ans_id", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")
        ))
        settled = stepped.filter(~F.col("_moved")).drop("_moved")
        done = settled if done is None else done.unionByName(settled)
        moving = stepped.filter("_moved").drop("_moved")
        if moving.isEmpty():
            return done.select(SAMPLE, "ans_id", F.col("parent").alias("set_id"))
        pointers = done.unionByName(moving)


def pair_audit(decisions: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(sample, question, ans1, ans2, decision) rows for reading along.

    The question is attached to the answers, which are fewer than the pairs and not tied to
    one key when a sample has very many.
    """
    asked = answers.join(questions, SAMPLE)
    first = asked.select(SAMPLE, "question", F.col("ans_id").alias("i"), F.col("text").alias("ans1"))
    second = answers.select(SAMPLE, F.col("ans_id").alias("j"), F.col("text").alias("ans2"))
    return (
        decisions.join(first, [SAMPLE, "i"])
        .join(second, [SAMPLE, "j"])
        .select(SAMPLE, "question", "ans1", "ans2", "decision")
    )
