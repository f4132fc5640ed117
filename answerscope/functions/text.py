"""Text normalisation and comparison as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope.functions.arrays import let

# The ASCII punctuation that is deleted before comparing answers.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# An answer ends at the first of these, tried in this order.
ANSWER_MARKERS = (
    ".",
    "\n",
    "Q:",
    "A:",
    "question:",
    "answer:",
    "Question:",
    "Answer:",
    "Questions:",
    "questions:",
    "QUESTION:",
    "ANSWER:",
)

# Letters and digits of any script delimit the articles; separators include the four
# ASCII information separators, which count as white space when splitting words.
_ARTICLE = r"(?<![\p{L}\p{N}])(?:a|an|the)(?![\p{L}\p{N}])"
_SPACE = r"(?U)[\s\x{1C}-\x{1F}]+"


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _SPACE, " "))


def strip_left(text: Column) -> Column:
    return F.regexp_replace(text, "^" + _SPACE, "")


def strip_both(text: Column) -> Column:
    return F.regexp_replace(strip_left(text), _SPACE + "$", "")


def normalize_text(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = drop_punctuation(F.lower(text))
    return collapse_space(F.regexp_replace(bare, _ARTICLE, " "))


def exact_match(prediction: Column, reference: Column) -> Column:
    return (normalize_text(prediction) == normalize_text(reference)).cast("int")


def caseless(text: Column) -> Column:
    """The form used when only case and leading space are ignored."""
    return F.lower(strip_left(text))


def exact_match_ci(prediction: Column, reference: Column) -> Column:
    """Equality up to case and punctuation; articles count."""
    return (
        drop_punctuation(caseless(prediction)) == drop_punctuation(caseless(reference))
    ).cast("int")


def clean_answer(text: Column) -> Column:
    """Cut the text at each marker in turn."""
    return reduce(lambda t, marker: F.substring_index(t, marker, 1), ANSWER_MARKERS, text)


def rouge_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def answer_set(texts: Column) -> Column:
    """Sorted distinct answers of a sample."""
    return F.array_sort(F.array_distinct(texts))


def answer_mapping(texts: Column) -> Column:
    """For every answer its 0-based place among the sorted distinct answers."""
    return let(
        answer_set(texts),
        lambda unique: F.transform(texts, lambda t: (F.array_position(unique, t) - 1).cast("int")),
    )
