"""Column functions on dense vectors (``array<double>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def as_doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column, p: float = 2.0) -> Column:
    if p == 2.0:
        return F.sqrt(dot(a, a))
    return F.pow(_sum(F.transform(a, lambda v: F.pow(F.abs(v), F.lit(p)))), F.lit(1.0 / p))


def scale(a: Column, factor: Column) -> Column:
    return F.transform(a, lambda v: v * factor)


def normalised(a: Column, p: float = 2.0) -> Column:
    n = norm(a, p)
    return F.transform(a, lambda v: F.try_divide(v, n))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


# --- similarity measures; undefined ratios are NULL -------------------------

def cosine_similarity(a: Column, b: Column, power: float = 1.0, **_) -> Column:
    p = F.lit(float(power))
    return F.try_divide(F.pow(dot(a, b), p),
                        F.sqrt(F.pow(dot(a, a), p)) * F.sqrt(F.pow(dot(b, b), p)))


def euclidean_similarity(a: Column, b: Column, power: float = 1.0, **_) -> Column:
    return F.lit(1.0) - F.pow(norm(subtract(normalised(a), normalised(b))), F.lit(float(power)))


def minkowski_similarity(a: Column, b: Column, power: float = 1.0, p: float = 3.0) -> Column:
    return F.lit(1.0) - norm(subtract(normalised(a, p), normalised(b, p)), p)


def cross_correlation_similarity(a: Column, b: Column, power: float = 1.0, **_) -> Column:
    return F.pow(F.try_divide(dot(a, b), dot(a, a) * dot(b, b)), F.lit(float(power)))


def tanimoto_similarity(a: Column, b: Column, power: float = 1.0, **_) -> Column:
    ab = dot(a, b)
    return F.pow(F.try_divide(ab, dot(a, a) + dot(b, b) - ab), F.lit(float(power)))


METRICS = {
    "cosine_sim": cosine_similarity,
    "euclidean": euclidean_similarity,
    "minkowski": minkowski_similarity,
    "cross_correlation": cross_correlation_similarity,
    "tanimoto": tanimoto_similarity,
}


def similarity(a: Column, b: Column, metric: str, power: float = 1.0, p: float = 3.0) -> Column:
    """Similarity by metric name; an unknown name is an error."""
    if metric not in METRICS:
        raise NotImplementedError(f"metric {metric!r} is not one of {sorted(METRICS)}")
    return METRICS[metric](a, b, power=power, p=p)


def dot_kernel(a: Column, b: Column, delta: float = 1.0, xi: float = 1.0) -> Column:
    """Base kernel ``delta^2 * (a.b)^xi``."""
    return F.lit(float(delta) ** 2) * F.pow(dot(a, b), F.lit(float(xi)))


def kernel_distance(k: Column) -> Column:
    """Distance of two normalised structures from their kernel value."""
    return F.sqrt(F.lit(1.0) - k * k + F.lit(1e-10))


# --- reshaping and scaling ---------------------------------------------------

def one_hot(index: Column, n_classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda i: F.when(i == index, F.lit(1.0)).otherwise(F.lit(0.0)))


def reshape_rows(a: Column, width: int) -> Column:
    """Cut a flat array into rows of ``width``; a length that does not fit is an error."""
    rows = F.transform(F.sequence(F.lit(0), (F.size(a) / width).cast("int") - 1),
                       lambda i: F.slice(a, i * width + 1, width))
    return F.when(F.size(a) % width == 0, rows).otherwise(
        F.raise_error(F.lit(f"array length is not a multiple of {width}")).cast("array<array<double>>"))


def min_max(a: Column) -> Column:
    """Scale one row to [0, 1]; a constant row becomes zeros."""
    low, high = F.array_min(a), F.array_max(a)
    return F.transform(a, lambda v: F.coalesce(F.try_divide(v - low, high - low), F.lit(0.0)))


def to_8bit(a: Column) -> Column:
    return F.transform(min_max(a), lambda v: (v * 255).cast("int"))


def argmax(a: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - top))
    total = _sum(e)
    return F.transform(e, lambda v: v / total)


def format_probabilities(a: Column) -> Column:
    """``p0:0.1234 p1:0.5678 `` and so on."""
    return F.concat(F.array_join(F.transform(a, lambda v, i: F.format_string("p%d:%.4f", i, v)), " "),
                    F.lit(" "))


def nan_vector(n: int) -> Column:
    return F.array_repeat(F.lit(float("nan")), n)


def zero_vector(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)
