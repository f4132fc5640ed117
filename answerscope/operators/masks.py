"""Masking of unimportant weights in a matrix given as rows (row, col, importance, weight)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerscope.operators.groups import ROWS_PER_BUCKET, pinned, positions, running_totals
from answerscope.session import stored


def _quota(pct: float, n):
    return F.floor(F.lit(pct / 100.0) * n).cast("bigint")


def _threshold(cells: DataFrame, keys: list[str], quota: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Per group the k-th smallest importance, from counts per distinct value."""
    counts = cells.groupBy(*keys, "importance").agg(F.count(F.lit(1)).alias("n"))
    cum = running_totals(
        counts, keys, "importance", ["n"], rows_per_bucket, probe=cells.select(*keys), cut_lineage=True
    )
    return (
        cum.join(quota, keys)
        .filter((F.col("k") > 0) & (F.col("cum_n") >= F.col("k")) & (F.col("cum_n") - F.col("n") < F.col("k")))
        .select(*keys, F.col("importance").alias("threshold"))
    )


def _zero_weak(cells: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    return _zeroed(cells.join(thresholds, keys, "left"), F.col("importance") <= F.col("threshold"))


def _zeroed(cells: DataFrame, weak: Column) -> DataFrame:
    return cells.select("row", "col", F.when(weak, F.lit(0.0)).otherwise(F.col("weight")).alias("weight"))


def mask_bottom_k_per_row(cells: DataFrame, pct: float, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """In each row, entries up to the k-th smallest importance become 0, ties included.

    k = floor(pct/100 · entries of the row).
    """
    quota = cells.groupBy("row").agg(F.count(F.lit(1)).alias("_n")).select("row", _quota(pct, F.col("_n")).alias("k"))
    return _zero_weak(cells, pinned(_threshold(cells, ["row"], quota, rows_per_bucket)), ["row"])


def mask_bottom_k_global(cells: DataFrame, pct: float, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The same with one threshold for the whole matrix, which is read once and becomes a literal."""
    counts = cells.groupBy("importance").agg(F.count(F.lit(1)).alias("n"))
    k = math.floor(pct / 100.0 * cells.count())
    cum = running_totals(counts, [], "importance", ["n"], rows_per_bucket)
    row = cum.filter((F.lit(k) > 0) & (F.col("cum_n") >= k) & (F.col("cum_n") - F.col("n") < k)).first()
    threshold = F.lit(None if row is None else row["importance"]).cast(cells.schema["importance"].dataType)
    return _zeroed(cells, F.col("importance") <= threshold)


def mask_weak_columns(cells: DataFrame, pct: float, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Zeroes the floor(pct/100 · columns) columns of smallest L2 importance.

    Equal norms are settled by the smaller column number.
    """
    norms = cells.groupBy("col").agg(F.sqrt(F.sum(F.col("importance") * F.col("importance"))).alias("norm"))
    norms = stored(norms, "norms")
    n = norms.count()
    placed = positions(norms, [], ["norm", "col"], rows_per_bucket=rows_per_bucket, size_bound=n)
    weak = placed.filter(F.col("position") <= math.floor(pct / 100.0 * n)).select("col", F.lit(True).alias("_weak"))
    return _zeroed(cells.join(pinned(weak), "col", "left"), F.col("_weak"))
