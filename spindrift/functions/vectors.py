"""Vector and probability expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))


def unit(a) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a, b) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def squared_l2(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def softmax(a) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def entropy(p) -> Column:
    """Normalized entropy of a probability vector; 1 for the uniform one."""
    h = F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log(F.greatest(x, F.lit(1e-12))))
    return h / F.log(F.size(p))


def jensen_shannon(p, q) -> Column:
    """Divergence in [0, 1] of two probability vectors."""
    m = F.zip_with(p, q, lambda x, y: (x + y) / 2)

    def kl(a):
        return F.aggregate(F.zip_with(a, m, lambda x, y: x * F.log(F.greatest(x, F.lit(1e-12)) / F.greatest(y, F.lit(1e-12)))), F.lit(0.0), lambda s, x: s + x)

    return (kl(p) + kl(q)) / 2 / F.log(F.lit(2.0))


def clip(a, limit: float) -> Column:
    return F.transform(a, lambda x: x.cast("double") * F.least(F.lit(1.0), F.lit(limit) / norm(a)))
