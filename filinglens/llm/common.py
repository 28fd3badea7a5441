"""Helpers shared by the operators: staged tables and Arrow conversions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from filinglens.session import scratch_path

MASK64 = (1 << 64) - 1


def staged(spark: SparkSession, df: DataFrame, name: str, level: int = 3) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: a
    lost executor rereads the table instead of recomputing its lineage.
    ``level``: of the compression."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under the operator's own names, so
    extra input columns never clash with them."""
    return df.select(*[df[f"`{old}`"].alias(new) for new, old in columns.items()])


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes empty."""
    return [x or "" for x in column.to_pylist()]


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of an Arrow list column as doubles. A row that is null, of another
    length, or holds null or non-finite components comes back as zeros."""
    out = np.zeros((len(column), dims))
    if not len(column):
        return out
    flat = column.flatten()
    lengths = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid())
    lengths = np.where(valid, lengths, 0)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    good = np.flatnonzero(lengths == dims)
    if len(good):
        out[good] = values[starts[good][:, None] + np.arange(dims)]
    out[~np.isfinite(out).all(axis=1)] = 0.0
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
