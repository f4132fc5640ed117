"""Operations on token id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerscope.functions.arrays import let

# Ids up to 2 are special, -100 marks positions a loss must ignore.
LAST_SPECIAL_ID = 2
IGNORE_INDEX = -100


def num_tokens(ids: Column) -> Column:
    """Ordinary tokens in a generation, plus one."""
    return F.size(F.filter(ids, lambda x: x > F.lit(LAST_SPECIAL_ID))) + F.lit(1)


def strip_special(ids: Column, pad: int, eos: int) -> Column:
    return F.filter(ids, lambda x: (x != F.lit(pad)) & (x != F.lit(eos)))


def mask_labels(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == F.lit(pad), F.lit(IGNORE_INDEX)).otherwise(x))


def pad_generations(generations: Column, pad: int, k: int | Column) -> Column:
    """Pad every id array of a sample to the longest one; ``k`` is the number that was sampled."""
    longest = F.array_max(F.transform(generations, lambda g: F.size(g)))
    padded = let(
        longest,
        lambda n: F.transform(
            generations, lambda g: F.concat(g, F.array_repeat(F.lit(pad), n - F.size(g)))
        ),
    )
    return F.slice(padded, 1, k)


def split_completion(ids: Column, input_length: Column) -> Column:
    """The tokens that follow a prompt of ``input_length`` tokens."""
    return F.slice(ids, input_length + F.lit(1), F.greatest(F.size(ids) - input_length, F.lit(0)))
