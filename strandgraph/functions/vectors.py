"""Column functions on vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    """Null as the empty vector."""
    return F.coalesce(v.cast("array<double>"), F.array().cast("array<double>"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """A vector of length 1; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(v: Column) -> Column:
    return F.transform(v, lambda x: F.greatest(x, F.lit(0.0)))


def leaky_relu(v: Column, slope: float = 0.2) -> Column:
    return F.transform(v, lambda x: F.when(x > 0, x).otherwise(x * slope))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    """Mean 0 and variance 1 (population)."""
    mean = total(v) / F.size(v)
    var = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(v)
    return F.transform(v, lambda x: (x - mean) / F.sqrt(var + eps))


def linear(v: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """weights: a row for each output. The weights are literals of the plan: for small matrices."""
    rows = [dot(v, F.array(*map(F.lit, map(float, w)))) for w in weights]
    return F.array(*(r + float(b) for r, b in zip(rows, bias or [0.0] * len(rows))))


def coerced(attr: Column, width: int) -> Column:
    """An edge's attributes as `width` numbers: ones if null, cut if wider, filled up with ones if narrower."""
    a = as_doubles(attr)
    return F.slice(F.concat(a, F.array_repeat(F.lit(1.0), width)), 1, width)


def mean_vector(v: Column, weight: Column | None = None) -> Column:
    """Aggregate: the (weighted) mean."""
    vector = array_to_vector(v.cast("array<double>"))
    return vector_to_array(Summarizer.mean(vector, weight) if weight is not None else Summarizer.mean(vector))


def sum_vector(v: Column) -> Column:
    """Aggregate: the sum."""
    return vector_to_array(Summarizer.sum(array_to_vector(v.cast("array<double>"))))


def masked_mean(vectors: Column, mask: Column) -> Column:
    """The mean of an array of vectors with weights 0 and 1; the divisor is 1e-9 at least."""
    weighted = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    return F.transform(F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / n)


def residue_mean(vectors: Column, length: Column) -> Column:
    """The mean of vectors 1 to length, without the first (0) and what follows; null for no residue."""
    inner = F.slice(vectors, F.lit(2), length)
    return F.when(length > 0, masked_mean(inner, F.transform(inner, lambda _: F.lit(1.0))))
