"""Vector column functions (native higher-order functions, JVM side).

Sums run as a left fold in index order, so scores are bit-identical to a
plain sequential loop (and to the numpy scorer in operators.search, which
keeps the same order).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filinglens.options import COSINE_EPSILON

EMBED_LANES = 4


def as_double_vector(col: Column) -> Column:
    return col.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length (missing positions count 0)."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """dot / (|a|·|b| + 1e-9); a zero vector scores 0."""
    na = a_norm if a_norm is not None else norm(a)
    nb = b_norm if b_norm is not None else norm(b)
    return dot(a, b) / (na * nb + F.lit(COSINE_EPSILON))


def hash_embedding(text: Column) -> Column:
    """Deterministic 4-lane embedding: four 16-bit lanes of md5(text).

    Stands in for the reference's placeholder embedder (which used the
    process-salted ``hash()`` and so was not reproducible).
    """
    h = F.md5(text)
    return F.transform(
        F.sequence(F.lit(0), F.lit(EMBED_LANES - 1)),
        lambda i: F.conv(F.substring(h, i * 4 + 1, 4), 16, 10).cast("double"),
    )


def l2_normalize(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n)).otherwise(a)
