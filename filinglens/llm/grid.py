"""Vectors as packed rows, and a join of queries with members by bucket whose
hot buckets are cut into a grid of blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from filinglens.llm.common import matrix, renamed, staged


def dims_of(vectors: DataFrame) -> int:
    """The most frequent length of the vectors, the larger of equals; 1 if there are none."""
    top = vectors.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return top["n"] if top else 1


def pack(spark: SparkSession, vectors: DataFrame, dims: int) -> tuple[DataFrame, str]:
    """(vec_id, vec: the components as bytes, norm) of every row, written to
    the shared folder, and the components' numpy type. ``norm`` is 0 for
    vectors that take no part: null, zero, of another length than ``dims``, or
    with a component that is null or not finite."""
    own = renamed(vectors, vec_id="vec_id", embedding="embedding")
    kind = own.schema["embedding"].dataType
    dtype = "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b["embedding"], dims)
            # An inf of a plain overflow can't occur: doubles of the stored type are exact.
            norm = np.sqrt((x * x).sum(axis=1))
            norm[~np.isfinite(norm)] = 0.0
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary()), pa.array(norm)], names=["vec_id", "vec", "norm"])

    id_type = own.schema["vec_id"].dataType.simpleString()
    return staged(spark, own.mapInArrow(run, f"vec_id {id_type}, vec binary, norm double"), "vectors"), dtype


def unpack(column, dims: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(-1, dims).astype(np.float64)


def in_blocks(
    queries: DataFrame, members: DataFrame, keys: list[str], query_rows: int = 2048, member_rows: int = 4096, id: str = "vec_id", weight=None
):
    """Both sides with two more key columns, so that rows of one bucket meet
    in blocks of about ``query_rows`` by ``member_rows`` at most: queries are
    repeated for each block of members and the other way round. ``weight``: what
    a row counts for, default 1. Returns (queries, members, all key columns)."""
    weight = F.lit(1) if weight is None else weight
    count = lambda df, rows, name: df.groupBy(*keys).agg(F.ceil(F.sum(weight) / rows).cast("int").alias(name))
    sizes = count(queries, query_rows, "_nq").join(count(members, member_rows, "_nm"), keys)
    block = lambda df, n: F.pmod(F.xxhash64(F.lit(5), id), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = queries.join(sizes, keys).withColumn("_qb", block(queries, "_nq")).withColumn("_mb", each("_nm")).drop("_nq", "_nm")
    m = members.join(sizes, keys).withColumn("_mb", block(members, "_nm")).withColumn("_qb", each("_nq")).drop("_nq", "_nm")
    return q, m, [*keys, "_qb", "_mb"]


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index reachable from each of n nodes by the links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
