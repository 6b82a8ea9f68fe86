"""Vector arithmetic on array<double> columns, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL for a zero vector, a NULL element or different lengths."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def cosine_soft(a: Column, b: Column, epsilon: float = 1e-9) -> Column:
    """Cosine with epsilon added to the denominator: a zero vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(epsilon))


def cosine_floored(a: Column, b: Column, floor: float = 1e-9) -> Column:
    """Cosine of rows whose norms are at least ``floor``."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def unit(a: Column, epsilon: float = 1e-8) -> Column:
    """a / (|a| + epsilon)."""
    return F.get(F.transform(F.array(norm(a) + F.lit(epsilon)), lambda n: F.transform(a, lambda x: x / n)), F.lit(0))


def scale(a: Column, by: float) -> Column:
    return F.transform(a, lambda x: x * F.lit(by))


def zscore(a: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std element by element; NaN or NULL elements give 0."""
    z = F.zip_with(F.zip_with(a, mean, lambda x, m: x - m), std, lambda x, s: F.try_divide(x, s))
    return F.transform(z, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))


def window_zscore(a: Column, clip: float = 5.0) -> Column:
    """z-score within the array (population deviation + 1e-5), clipped; non-finite elements give 0."""
    n = F.size(a).cast("double")
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n

    def scaled(m: Column) -> Column:
        sd = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n) + F.lit(1e-5)
        z = lambda s: F.transform(a, lambda x: (x - m) / s)
        return F.get(F.transform(F.array(sd), z), F.lit(0))

    z = F.get(F.transform(F.array(mean), scaled), F.lit(0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(z, lambda x: F.when(bad(x), F.lit(0.0)).otherwise(F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def part(a: Column, low: int, high: int) -> Column:
    """Elements low to high - 1."""
    return F.slice(a, low + 1, high - low)


def missing(a: Column, names: list[str]) -> Column:
    """Names of the elements that are NULL or NaN."""
    flags = F.zip_with(F.array(*[F.lit(n) for n in names]), a, lambda n, x: F.when(x.isNull() | F.isnan(x), n))
    return F.array_compact(flags)
