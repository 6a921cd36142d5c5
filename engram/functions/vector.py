"""Vector and score arithmetic as Column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RRF_K = 60
LEAST_NORM = 1e-12
DECAY_FACTOR = 0.9
F32_EPSILON = 1.1920929e-07


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 if the lengths differ."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity with the denominator floored."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(LEAST_NORM))


def normalised(a: Column) -> Column:
    """Unit vector; null stays null, a zero vector is an error."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: (x / norm(a)).cast("float"))).when(a.isNotNull(), F.raise_error(F.lit("vector of length zero")).cast("array<float>"))


def rrf(*ranks: Column) -> Column:
    """Reciprocal-rank fusion; a missing rank adds nothing."""
    return sum((F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks[1:]), F.coalesce(1.0 / (RRF_K + ranks[0]), F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    """Logistic function; 0 for NaN."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def decayed(confidence: Column) -> Column:
    return (confidence * DECAY_FACTOR).cast("float")


def changes(before: Column, after: Column) -> Column:
    return F.abs(after - before) >= F32_EPSILON
