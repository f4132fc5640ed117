"""Vectors as columns: group means and user-supplied encoders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def mean_vector(df: DataFrame, keys: list[str], vec: str = "vec", out: str = "vec") -> DataFrame:
    """Element-wise mean of the vectors of a group, combined map-side."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(*keys).agg(vector_to_array(mean).alias(out))


def sum_vector(df: DataFrame, keys: list[str], vec: str = "vec", out: str = "vec", *extra) -> DataFrame:
    """Element-wise sum of the vectors of a group next to further aggregates."""
    total = Summarizer.sum(array_to_vector(F.col(vec).cast("array<double>")))
    return df.groupBy(*keys).agg(vector_to_array(total).alias(out), *extra)


def encode_text(
    df: DataFrame, text: str, make_predict_fn: Callable, out: str = "vec", batch_size: int = 128
) -> DataFrame:
    """Adds a vector column from a user-supplied encoder.

    ``make_predict_fn`` is called once per Python worker (load the model there) and returns
    a function from a batch of strings to a 2-D float array.
    """
    encode = predict_batch_udf(make_predict_fn, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    return df.withColumn(out, encode(F.col(text)))
