"""Similarities of float arrays, summed in double precision; a higher value is closer.

The expressions suit one or a few query vectors; for large comparisons see ``operators.vector``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _total(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _total(a, b, lambda x, y: x * y)


def negative_l2(a: Column, b: Column) -> Column:
    return -F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y)))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is all zeros."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


METRICS = {"cosine": cosine, "l2": negative_l2, "dot": dot}
