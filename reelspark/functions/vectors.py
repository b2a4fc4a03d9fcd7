"""Vector and scalar expressions (JVM side).  Vectors are ARRAY<DOUBLE>; NULL and the zero vector differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, f) -> Column:
    """f(value) with the value computed once: inside a lambda an outer expression would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def l2_normalize(a: Column) -> Column:
    """v / (|v| + 1e-8)."""
    return let(norm(a) + TINY, lambda n: F.transform(a, lambda x: x / n))


def vector_resize(a: Column, dim: int) -> Column:
    """Cyclic repeat or cut to ``dim`` elements, then normalised.  An empty vector gives NULL."""
    size = F.size(a)
    return F.when(size > 0, l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.element_at(a, (i % size + 1).cast("int")))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 if either vector is NULL or shorter than 1e-8."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull() | (na < TINY) | (nb < TINY), F.lit(0.0)).otherwise(1 - dot(a, b) / (na * nb))


def similarity_grouping(a: Column, b: Column) -> Column:
    """0 if either is NULL, else 1 - cosine_distance: a zero vector is like anything."""
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(1 - cosine_distance(a, b))


def similarity_strict(a: Column, b: Column) -> Column:
    """Cosine; 0 if either norm is exactly 0; NULL if either is NULL."""
    na, nb = norm(a), norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def clip_norm(v: Column, p25: Column, p75: Column, eps: float = 1e-5) -> Column:
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), (v - p25) / ((p75 - p25) + eps)))


def sigmoid_gate(n_hat: Column, tau: Column, temperature: Column) -> Column:
    x = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), (n_hat - tau) / (temperature + 1e-5)))
    return 1 / (1 + F.exp(-x))


def floor_percentile(values: Column, p: float) -> Column:
    """Element at floor(p (n - 1)) of the sorted list; 0 for an empty list."""
    return let(F.sort_array(values), lambda s: F.coalesce(F.try_element_at(s, (F.floor(F.lit(p) * (F.size(s) - 1)) + 1).cast("int")), F.lit(0.0)))


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """(1 - alpha) a + alpha b, scaled to length one unless its norm is at most 1e-8."""
    mix = F.zip_with(a, b, lambda x, y: (1 - alpha) * x + alpha * y)

    def scaled(m: Column) -> Column:
        return let(norm(m), lambda n: F.when(n > TINY, F.transform(m, lambda x: x / n)).otherwise(m))

    return let(mix, scaled)


def score(scores: Column, key: str) -> Column:
    """Value of a score map, 0 where the map or the key is missing."""
    return F.coalesce(F.try_element_at(scores, F.lit(key)), F.lit(0.0))


def ewma(values: Column, alpha: float) -> Column:
    """Exponential average of a non-empty list, seeded with its first element."""
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0)))
    return F.aggregate(rest, F.element_at(values, 1), lambda s, x: alpha * x + (1 - alpha) * s)
