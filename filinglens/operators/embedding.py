"""Embedding columns (C7) and their variants (X10 dedup, X11 L2 norm).

The default embedder is native (md5 lanes). A user embedder is any
``Column -> Column`` returning ``array<double>``, e.g. an Arrow-batched
``pandas_udf``; it then runs once per distinct text with ``embed_distinct``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filinglens.functions.vectors import hash_embedding, l2_normalize, norm

Embedder = Callable[[Column], Column]


def embed(df: DataFrame, text_col: str = "text", embedder: Embedder | None = None, out_col: str = "embedding") -> DataFrame:
    """Vector in the same row as its text, plus its norm (computed once)."""
    emb = embedder or hash_embedding
    return df.withColumn(out_col, emb(F.col(text_col)).cast("array<double>")).withColumn(
        f"{out_col}_norm", norm(F.col(out_col))
    )


def embed_distinct(
    df: DataFrame, text_col: str = "text", embedder: Embedder | None = None, out_col: str = "embedding"
) -> DataFrame:
    """Embed each distinct text once, then attach the vector to every row.

    The distinct side is keyed by sha2(text); the join back is a shuffle
    join on that key. A text repeated in a third of all rows is a hot key:
    AQE's skew-join split (enabled in the session) breaks that partition
    into pieces and replicates the single matching vector row.
    """
    keyed = df.withColumn("_text_key", F.sha2(F.col(text_col), 256))
    distinct = keyed.select("_text_key", F.col(text_col).alias("_t")).dropDuplicates(["_text_key"])
    vectors = embed(distinct, "_t", embedder, out_col).drop("_t")
    return keyed.join(vectors, "_text_key", "left").drop("_text_key")


def normalize_vectors(df: DataFrame, col: str = "embedding", out_col: str | None = None) -> DataFrame:
    return df.withColumn(out_col or col, l2_normalize(F.col(col).cast("array<double>")))


class UnmatchedVectors(ValueError):
    """Chunks without a vector or vectors without a chunk."""


def attach_vectors(chunks: DataFrame, vectors: DataFrame, key_cols: list[str], vector_col: str = "embedding") -> DataFrame:
    """Attach externally computed vectors by chunk key (J3).

    Both directions are checked with anti joins before anything is returned
    for writing: a chunk without a vector, or a vector without a chunk,
    raises instead of writing a partial batch.
    """
    v = vectors.select(*key_cols, F.col(vector_col).cast("array<double>").alias(vector_col))
    missing = chunks.join(v, key_cols, "left_anti").limit(1).count()
    orphans = v.join(chunks.select(*key_cols), key_cols, "left_anti").limit(1).count()
    if missing or orphans:
        raise UnmatchedVectors(f"chunks without vectors: {bool(missing)}, vectors without chunks: {bool(orphans)}")
    return chunks.join(v, key_cols).withColumn(f"{vector_col}_norm", norm(F.col(vector_col)))
