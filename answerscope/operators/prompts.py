"""Prompt tables sent to models and the parsing of what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.functions.arrays import let, log_softmax
from answerscope.functions.text import strip_both, strip_left

# The one example shown before every trivia question.
TRIVIA_EXAMPLE = "\nQ: In Scotland a bothy/bothie is a?\nA: House"

# Two rated examples per question set (question, reference, answer).
RATING_EXAMPLES = {
    "triviaqa": (
        ("In Scotland a bothy/bothie is a?", "House", "House"),
        ("Where in England was Dame Judi Dench born?", "York", "London"),
    ),
    "nq_open": (
        ("who makes up the state council in russia", "governors and presidents", "governors and presidents"),
        ("when does real time with bill maher come back", "November 9, 2018", "September 8, 2000"),
    ),
    "coqa": (
        ("When was the Vat formally opened?", "It was formally established in 1475", "In 1475"),
        ("what is the library for?", "research", "tourism"),
    ),
}

# Wording of the judge prompt and of the true/false prompt.
RATING_HEAD = (
    "Rate the level of consistency between the answer to the question and the reference answer, from 0 to 100."
)
IDEAS = "Here are some brainstormed ideas: "
CHOICES = "Is the possible answer:\n(A) True\n(B) False\nThe possible answer is: ("

PAIR_SEPARATOR = " [SEP] "


def context_prompt(story: Column, question: Column) -> Column:
    return F.concat(story, F.lit(" Q: "), question, F.lit(" A:"))


def few_shot_prompt(question: Column, block: Column) -> Column:
    return F.concat(F.lit("Answer these questions:"), block, F.lit("\nQ: "), question, F.lit("\nA:"))


def with_few_shot_prompt(df: DataFrame, block: DataFrame) -> DataFrame:
    """Adds ``prompt`` from a one-row ``block`` table (see ``sampling.few_shot_block``).

    The block is a fixed handful of examples, so it is read once and becomes a literal.
    """
    text = block.first()["block"]
    return df.withColumn("prompt", few_shot_prompt(F.col("question"), F.lit(text)))


def trivia_prompt(question: Column) -> Column:
    return few_shot_prompt(question, F.lit(TRIVIA_EXAMPLE))


def self_eval_prompts(
    records: DataFrame, contexts: DataFrame | None = None, id_col: str = "id", ideas: int = 10
) -> DataFrame:
    """One prompt per generation asking whether it is true.

    Shows up to ``ideas`` distinct answers in first-seen order (the list is part of the
    prompt's wording, not a limit on what is evaluated: every generation gets its prompt).
    ``contexts`` (id, story) is joined for story-based question sets.
    """
    answers = F.transform("generations", strip_left)
    rows = records.select(id_col, "question", answers.alias("_a"))
    rows = rows.withColumn("_shown", F.array_join(F.slice(F.array_distinct("_a"), 1, ideas), "\n"))
    if contexts is not None:
        rows = rows.join(contexts.select(id_col, "story"), id_col, "left")
        lead = F.coalesce(F.concat("story", F.lit("\n")), F.lit(""))
    else:
        lead = F.lit("")
    rows = rows.select(id_col, "question", "_shown", lead.alias("_lead"), F.posexplode("_a").alias("gen_id", "answer"))
    prompt = F.concat(
        F.col("_lead"),
        F.lit("Question: "), F.col("question"), F.lit("\n" + IDEAS), F.col("_shown"),
        F.lit("\nPossible Answer: "), F.col("answer"), F.lit("\n" + CHOICES),
    )
    return rows.select(id_col, "gen_id", "answer", prompt.alias("prompt"))


def rating_block(dataset: str) -> str:
    """The head of the judge prompt: instruction and the two rated examples."""
    parts = [RATING_HEAD]
    for (q, ref, ans), rating in zip(RATING_EXAMPLES[dataset], ("100", "0")):
        parts.append(f"Question: {q}\nReference: {ref}\nAnswer: {ans}\nRating: {rating}.\n")
    return "\n".join(parts)


def rating_prompt(question: Column, reference: Column, answer: Column, block: Column) -> Column:
    return F.concat(
        block,
        F.lit("\nQuestion: "), question,
        F.lit("\nReference: "), reference,
        F.lit("\nAnswer: "), strip_both(answer), F.lit("\nRating:"),
    )


def rating_prompts(
    records: DataFrame, ith: int | None = None, id_col: str = "id", dataset_col: str = "dataset"
) -> DataFrame:
    """Judge prompt for the ``ith`` generation (0-based) of every record, NULL where absent.

    Without ``ith`` every generation has its row (id, gen_id, prompt).

    Which examples are shown depends on the record's question set (three fixed rows).
    """
    block = F.lit(None).cast("string")
    for name in RATING_EXAMPLES:
        block = F.when(F.col(dataset_col) == name, F.lit(rating_block(name))).otherwise(block)
    if ith is None:
        rows = records.select("*", F.posexplode("generations").alias("gen_id", "_g"))
        prompt = rating_prompt(F.col("question"), F.col("answer"), F.col("_g"), block)
        return rows.select(id_col, "gen_id", prompt.alias("prompt"))
    answer = F.get(F.col("generations"), F.lit(ith))
    return records.select(
        id_col, rating_prompt(F.col("question"), F.col("answer"), answer, block).alias("prompt")
    )


def parse_rating(response: Column) -> Column:
    """First word before the first full stop; NULL when there is none."""
    lead = F.substring_index(response, ".", 1)
    word = F.regexp_extract(lead, r"(?U)[^\s\x{1C}-\x{1F}]+", 0)
    return F.nullif(word, F.lit(""))


def nli_side(question: Column, answer: Column) -> Column:
    return F.concat(question, F.lit(" "), answer)


def nli_joined(a: Column, b: Column) -> Column:
    return F.concat(a, F.lit(PAIR_SEPARATOR), b)


def nli_pair_text(question: Column, a: Column, b: Column) -> Column:
    return nli_joined(nli_side(question, a), nli_side(question, b))


def verdicts(logits: DataFrame, true_id: int, false_id: int, sample: str = "sample_id") -> DataFrame:
    """(sample, gen_id, true_logit, false_logit, p_true): what a judge's logits say of each generation."""
    rows = logits.select(sample, "gen_id", true_false_logits(F.col("logits"), true_id, false_id).alias("v")).select(sample, "gen_id", "v.*")
    return rows.withColumn("p_true", 1 / (1 + F.exp(F.col("false_logit") - F.col("true_logit"))))


def true_false_logits(logits: Column, true_id: int, false_id: int, log_probs: bool = False) -> Column:
    """Struct (true_logit, false_logit): two vocabulary entries, optionally log-softmaxed."""

    def pick(x: Column) -> Column:
        return F.struct(
            F.get(x, F.lit(true_id)).alias("true_logit"), F.get(x, F.lit(false_id)).alias("false_logit")
        )

    return let(log_softmax(logits), pick) if log_probs else pick(logits)
