"""Column builders for ``ARRAY<DOUBLE>`` vectors; all stay in the JVM."""

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def sq_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


# Up to this many dimensions a fixed point is written out term by term, which generated code runs
# several times faster than a lambda; beyond it the generated method would get too long.
UNROLLED_DIMENSIONS = 128


def _balanced_sum(terms: list[Column]) -> Column:
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2])] + ([terms[-1]] if len(terms) % 2 else [])
    return terms[0]


def _of_length(v: Column, point: list[float], value: Column) -> Column:
    """NULL for a vector of another length than the point, however the value is computed."""
    return F.when(F.size(v) == len(point), value)


def distance_to(v: Column, point: list[float]) -> Column:
    """Euclidean distance to one fixed point."""
    if not 0 < len(point) <= UNROLLED_DIMENSIONS:
        return _of_length(v, point, distance(v, F.lit([float(x) for x in point]).cast("array<double>")))
    gaps = [F.get(v, F.lit(i)) - F.lit(float(x)) for i, x in enumerate(point)]
    return _of_length(v, point, F.sqrt(_balanced_sum([g * g for g in gaps])))


def dot_with(v: Column, point: list[float]) -> Column:
    """Inner product with one fixed point."""
    if not 0 < len(point) <= UNROLLED_DIMENSIONS:
        return _of_length(v, point, dot(v, F.lit([float(x) for x in point]).cast("array<double>")))
    return _of_length(v, point, _balanced_sum([F.get(v, F.lit(i)) * F.lit(float(x)) for i, x in enumerate(point)]))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def with_value(v: Column, value: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """fn(element, value) for each element. A lambda evaluates what it captures once per element, so a
    value that costs something to compute is laid out beside the array instead, computed once per row."""
    return F.zip_with(v, F.array_repeat(value, F.size(v)), fn)


def scaled(v: Column, factor: Column) -> Column:
    return with_value(v, factor, lambda x, f: x * f)


def divided(v: Column, divisor: Column) -> Column:
    return with_value(v, divisor, lambda x, d: x / d)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    length = norm(v)
    return divided(v, F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NULL when either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine with zero norms read as 1, as pairwise distance tables need it."""
    def unit(n: Column) -> Column:
        return F.when(n == 0, F.lit(1.0)).otherwise(n)

    return 1 - dot(a, b) / (unit(norm(a)) * unit(norm(b)))


def vector_mean(v: Column) -> Column:
    """Aggregate: element-wise mean; partial sums of one vector per task reach the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v)))


def vector_variance(v: Column) -> Column:
    """Aggregate: element-wise sample variance."""
    return vector_to_array(Summarizer.variance(array_to_vector(v)))
