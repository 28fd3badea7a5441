"""Operator 10: nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard
transform) turns a unit vector; its bucket is the nearest signed axis. Each
query visits, in every table, the buckets of its largest signed coordinates;
members met there are ranked by their exact inner product.

Members are hashed by direction, apart by bands of length: within a band the
nearest direction is about the largest inner product. How many tables and
probes a band needs is fitted on a sample of the queries, whose true
neighbours are found by scoring every member; where that would not save half
of the products, the band's members are all scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filinglens.llm.common import staged
from filinglens.llm.grid import dims_of, in_blocks, pack, unpack

MEMBER_ROWS = 4096  # of a block; a band with no more is scored whole
FEW = 100  # pairs to fit a band on


def rotate(x: np.ndarray, seed: int, dims: int) -> np.ndarray:
    """Rows of ``x``, padded with zeros to ``dims`` (a power of two), rotated."""
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], (3, dims))
    y = np.zeros((len(x), dims))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = y * s
        h = 1
        while h < dims:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), dims)
            h *= 2
        y /= np.sqrt(dims)
    return y


def buckets(x: np.ndarray, seed: int, dims: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each row, nearest first."""
    y = rotate(x, seed, dims)
    y = np.concatenate([y, -y], axis=1)
    probes = min(probes, 2 * dims)
    near = np.argpartition(-y, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(y, near, axis=1), axis=1), axis=1)


def best(q: np.ndarray, q_ids: np.ndarray, m: np.ndarray, m_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, member id, score) of each query's k largest inner products
    with other ids, ties to the smaller id. Scores don't depend on the block."""
    order = np.argsort(m_ids, kind="stable")
    m, m_ids = m[order], m_ids[order]
    m_ids, first, many = np.unique(m_ids, return_index=True, return_counts=True)  # rows that repeat an id take one place
    k = min(k, len(m_ids))
    out = []
    for lo in range(0, len(q), 256):
        s = q[lo : lo + 256] @ m.T
        if len(m_ids) < len(m):
            s = np.maximum.reduceat(s, first, axis=1)
        s[q_ids[lo : lo + 256, None] == m_ids[None, :]] = -np.inf
        least = np.partition(s, len(m_ids) - k, axis=1)[:, len(m_ids) - k]
        # A hair of slack: the product of a block may differ in its last bits.
        rows, cols = np.nonzero((s >= (least - 1e-9 * np.maximum(1.0, np.abs(least)))[:, None]) & (s > -np.inf))
        if not len(rows):
            continue
        start = np.cumsum(many[cols]) - many[cols]
        each = np.arange(many[cols].sum()) + np.repeat(first[cols] - start, many[cols])
        score = np.maximum.reduceat((q[lo + np.repeat(rows, many[cols])] * m[each]).sum(axis=1), start)
        at = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[at], cols[at], score[at]
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = rank < k
        out.append((q_ids[lo + rows[keep]], m_ids[cols[keep]], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def fitted(q: np.ndarray, m: np.ndarray, band: np.ndarray, members: list[int], tables: int, probes: int, seed: int, dims: int, recall: float) -> list[tuple[int, int]]:
    """(tables, probes) of each band: the cheapest with which at least
    ``recall`` of the pairs (query, true neighbour) of the band meet, at most
    ``tables`` and at least ``probes``. A band with under ``FEW`` pairs takes
    those of the longer ones too. (0, 0): all its members are scored."""
    rank = np.zeros((len(q), tables), np.int64)
    for t in range(tables):
        y = rotate(q, seed + t, dims)
        y = np.concatenate([y, -y], axis=1)
        rank[:, t] = (y > np.take_along_axis(y, buckets(m, seed + t, dims, 1), axis=1)).sum(axis=1)
    first = np.minimum.accumulate(rank, axis=1)  # probes before the one that meets, with 1, 2, ... tables
    out = []
    for b, n in enumerate(members):
        own = band == b
        if own.sum() < FEW:
            own = band <= b
        if n <= MEMBER_ROWS or own.sum() < FEW:
            out.append((0, 0))
            continue
        need = np.sort(first[own], axis=0)[int(np.ceil(recall * own.sum())) - 1] + 1
        cost, t = min((t * max(int(p), probes), t) for t, p in enumerate(need, 1))
        out.append((t, cost // t) if cost < dims else (0, 0))  # of 2 * dims buckets
    return out


def nearest(
    spark: SparkSession, vectors: DataFrame, queries=None, k: int = 20, tables: int = 6, probes: int = 20, seed: int = 23,
    recall: float = 0.98, sample_queries: int = 128, most_bands: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every query
    among all other ids, by inner product in double precision on the vectors
    as they are; nearest first, ties to the smaller vec_id.

    ``queries``: a condition on vec_id (default: divisible by 20). Every row is
    indexed. Null ids and vectors that are null, zero, of another length than
    most, or with null or non-finite components take no part, neither as
    query nor as candidate. Rows that repeat an id count as one candidate with
    the best of their scores (as a query too). Other columns are not read.
    ``tables`` at most and ``probes`` at least are used in each band of
    lengths, as many as find ``recall`` of the true neighbours of
    ``sample_queries`` queries; a query that so meets fewer than ``k`` is
    scored against all, so it has all candidates if they are fewer. Cost: half of all query-member products or
    less in a band that is probed, all in one that is not, in blocks; buckets
    of any size are cut into blocks, none is capped."""
    dims = dims_of(vectors)
    packed, dtype = pack(spark, vectors, dims)
    packed = packed.where("norm > 0 AND vec_id IS NOT NULL")
    turned = 1 << (dims - 1).bit_length()
    asked = packed.where(F.col("vec_id") % 20 == 0 if queries is None else queries)

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            ids, found, score = best(unpack(left["vec"], dims, dtype), left["vec_id"].to_numpy(), unpack(right["vec"], dims, dtype), right["vec_id"].to_numpy(), k)
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": score})

    def ranked(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """The k best of the members that each query meets by ``keys``."""
        q, m, keys = in_blocks(left, right, keys, member_rows=MEMBER_ROWS)
        met = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(rank, "query_id long, vec_id long, score double")
        once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def exact(some: DataFrame) -> DataFrame:
        side = lambda df: df.select(F.col("vec_id").alias("vec_id"), F.col("vec").alias("vec"), F.lit(0).alias("all"))  # noqa: E731  # columns of its own
        return ranked(side(some), side(packed), ["all"])

    sample = asked.groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(sample_queries + 1)
    sample = staged(spark, sample, "sample-queries")
    if sample.count() <= sample_queries:
        return exact(asked)

    # A band is a step of sqrt(2) in length that has members; the last one takes all that are shorter.
    steps = packed.groupBy(F.floor(2 * F.log2("norm")).alias("step")).agg(F.min("norm").alias("least"), F.count("*").alias("n")).orderBy(F.desc("step")).collect()
    edges = np.array([s["least"] for s in steps[: most_bands - 1]])
    edges = edges[: len(steps) - 1]
    members = [s["n"] for s in steps[: len(edges)]] + [sum(s["n"] for s in steps[len(edges) :])]
    # At most k rows for each query of the sample.
    truth = exact(sample).select("query_id", "vec_id").join(packed.select("vec_id", "vec"), "vec_id").groupBy("query_id", "vec_id").agg(F.min("vec").alias("vec"))
    truth = truth.join(sample.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("query")), "query_id").select("query", "vec").toArrow()
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unpack(truth["vec"], dims, dtype)
    band = (np.sqrt((near * near).sum(axis=1))[:, None] < edges).sum(axis=1)
    plan = fitted(unit(unpack(truth["query"], dims, dtype)), unit(near), band, members, tables, probes, seed, turned, recall)

    def index(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                norm = np.asarray(b["norm"])
                x = unpack(b["vec"], dims, dtype) / norm[:, None]
                band = (norm[:, None] < edges).sum(axis=1)
                for i, (n_tables, n_probes) in enumerate(plan):
                    rows = np.arange(b.num_rows) if as_query else np.flatnonzero(band == i)
                    if not len(rows):
                        continue
                    for t in range(max(n_tables, 1)):
                        near = buckets(x[rows], seed + t, turned, n_probes if as_query else 1) if n_tables else np.zeros((len(rows), 1), np.int32)
                        n = near.shape[1]
                        take = pa.array(np.repeat(rows, n))
                        yield pa.RecordBatch.from_arrays(
                            [b["vec_id"].take(take), b["vec"].take(take), pa.array(np.full(len(take), i, np.int32)), pa.array(np.full(len(take), t, np.int32)),
                             pa.array(near.ravel().astype(np.int32))],
                            names=["vec_id", "vec", "band", "table", "bucket"])
        return run

    id_type = packed.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, vec binary, band int, table int, bucket int"
    probed = staged(spark, ranked(asked.mapInArrow(index(True), schema), packed.mapInArrow(index(False), schema), ["band", "table", "bucket"]), "neighbours")

    # A query that met fewer than k although there are more is scored against all.
    full = min(k, packed.select("vec_id").distinct().count() - 1)
    served = probed.groupBy("query_id").count().where(F.col("count") >= full).select(F.col("query_id").alias("vec_id"))
    short = staged(spark, asked.select("vec_id", "vec").join(served, "vec_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return probed
    again = short.select(F.col("vec_id").alias("query_id")).distinct()
    return probed.join(again, "query_id", "left_anti").unionAll(exact(short))
