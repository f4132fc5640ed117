"""Array expressions that run inside the JVM: softmax family and vector algebra.

Spark evaluates a higher-order function's lambda once per element, so a per-array
value (a maximum, a mean) used inside a lambda must be bound first: see ``let``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def array_mean(x: Column) -> Column:
    """Mean of the entries, NULL for an empty array."""
    return F.try_divide(array_sum(x), F.size(x).cast("double"))


# --- softmax family -------------------------------------------------------------


def logsumexp(x: Column) -> Column:
    """Max-shifted ln Σ exp; entries of -inf (masked out by top-k/top-p) count as 0."""
    return let(F.array_max(x), lambda m: m + F.ln(array_sum(F.transform(x, lambda v: F.exp(v - m)))))


def softmax(x: Column) -> Column:
    return let(logsumexp(x), lambda z: F.transform(x, lambda v: F.exp(v - z)))


def log_softmax(x: Column) -> Column:
    return let(logsumexp(x), lambda z: F.transform(x, lambda v: v - z))


def log_max_prob(x: Column) -> Column:
    """ln of the largest softmax probability."""
    return F.array_max(x) - logsumexp(x)


def max_prob(x: Column) -> Column:
    return F.exp(log_max_prob(x))


def entropy(logits: Column) -> Column:
    """-Σ p ln p with 0·ln 0 = 0, from raw logits."""
    return let(
        logsumexp(logits),
        lambda z: -F.aggregate(
            logits,
            F.lit(0.0),
            lambda acc, v: acc + F.when(F.exp(v - z) > 0, F.exp(v - z) * (v - z)).otherwise(F.lit(0.0)),
        )
        + F.lit(0.0),
    )


# --- vectors --------------------------------------------------------------------


def vec_dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def vec_norm(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def vec_distance(a: Column, b: Column) -> Column:
    return F.sqrt(array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def vec_stride(a: Column, step: int) -> Column:
    """Every ``step``-th entry, starting with the first."""
    return F.filter(a, lambda _, i: i % F.lit(step) == 0)


def vec_scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda x: x * factor)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, NULL when either is zero."""
    return F.try_divide(vec_dot(a, b), vec_norm(a) * vec_norm(b))


def argmax(x: Column) -> Column:
    """0-based index of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def weighted_sum(x: Column, weights: list[float]) -> Column:
    """Σ w_l·x_l with the weights as a literal array (one entry per layer)."""
    return vec_dot(x, F.array(*[F.lit(float(w)) for w in weights]))


def softmax_weighted_mean(x: Column, temperature: float = 1.0) -> Column:
    """Σ softmax(x/T)·x."""
    return vec_dot(softmax(F.transform(x, lambda v: v / F.lit(float(temperature)))), x)


def log10_det(matrix: Column) -> Column:
    """log10 of the determinant of a symmetric positive definite array<array<double>>.

    Plain elimination as a fold over the pivots, without leaving the JVM: each step
    adds the pivot's logarithm and keeps the Schur complement of the first row.
    """
    state = "struct<m:array<array<double>>,ld:double>"

    def step(acc: Column, _: Column) -> Column:
        m = acc["m"]
        pivot_row = m[0]
        rest = F.transform(
            F.slice(m, F.lit(2), F.size(m) - 1),
            lambda row: F.zip_with(
                F.slice(row, F.lit(2), F.size(row) - 1),
                F.slice(pivot_row, F.lit(2), F.size(pivot_row) - 1),
                lambda x, y: x - y * row[0] / pivot_row[0],
            ),
        )
        return F.struct(rest.alias("m"), (acc["ld"] + F.log10(m[0][0])).alias("ld")).cast(state)

    start = F.struct(matrix.alias("m"), F.lit(0.0).alias("ld")).cast(state)
    return F.aggregate(matrix, start, step, lambda acc: acc["ld"])
