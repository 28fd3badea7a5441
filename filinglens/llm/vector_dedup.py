"""Operator 6: near-duplicate vectors by product quantisation.

Vectors go to the inverted list of their nearest coarse centre, as codes of
the residual's subspaces. A vector visits every list that could hold a link
of it; distances to codes come from lookup tables of the exact query
(asymmetric); whatever the code's error leaves possible is ranked by its exact
cosine in double precision.

Which lists suffice: a vector x linked with q lies at most d = sqrt(2 - 2t)
from it. If x is in list j and q in list h, x is on j's side of the plane
between the two centres, so q is at most d beyond that plane (exact). A random
direction takes only about d / sqrt(dims) of a step of length d; lists are
visited up to ``slack`` times that, or further where links need it: all links
of a sample of vectors are computed exactly, and lists are visited up to
``margin`` times what the farthest of them takes, at most d.
The lookup adds no loss: a code is dropped only if its distance plus its own
known error rules out a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import staged
from filinglens.llm.graph import connected_components
from filinglens.llm.grid import dims_of, in_blocks, local_components, pack, unpack

SUBSPACE = 4  # components a code stands for
CODES = 256


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = (2 * x @ c.T - (c * c).sum(axis=1)).argmax(axis=1)
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class Quantiser:
    """Coarse centres and a code book per subspace. Tasks make it from the
    broadcast arrays, so that workers need not import this class."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = list(range(0, centres.shape[1], SUBSPACE))
        square = (centres * centres).sum(axis=1)
        gaps = square[:, None] + square - 2 * centres @ centres.T
        self.gaps = 2 * np.sqrt(np.maximum(gaps, 1e-12))

    @staticmethod
    def fit(sample: np.ndarray, lists: int, seed: int = 3) -> tuple[np.ndarray, list[np.ndarray]]:
        centres = k_means(sample, lists, 8, seed)
        rest = sample - centres[(2 * sample @ centres.T - (centres * centres).sum(axis=1)).argmax(axis=1)]
        return centres, [k_means(rest[:, c : c + SUBSPACE], CODES, 6, seed + 1 + c) for c in range(0, sample.shape[1], SUBSPACE)]

    def distances(self, x: np.ndarray) -> np.ndarray:
        return (x * x).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1) - 2 * x @ self.centres.T

    def beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each row, and how far it is beyond the plane to each list."""
        d = self.distances(x)
        home = d.argmin(axis=1)
        return home, (d - d.min(axis=1, keepdims=True)) / self.gaps[home]

    def homes(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Home list of each row, and which lists it has to visit."""
        home, beyond = self.beyond(x)
        visits = beyond <= reach
        visits[np.arange(len(x)), home] = True
        return home, visits

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals and the length of what they leave out."""
        rest = x - self.centres[home]
        codes = np.empty((len(x), len(self.cuts)), dtype=np.uint8)
        left = np.zeros(len(x))
        for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            part = rest[:, c : c + SUBSPACE]
            codes[:, j] = (2 * part @ book.T - (book * book).sum(axis=1)).argmax(axis=1)
            left += ((part - book[codes[:, j]]) ** 2).sum(axis=1)
        return codes, np.sqrt(left)

    def products(self, q: np.ndarray, codes: np.ndarray, home: int) -> np.ndarray:
        """Approximate inner products of exact queries with coded members of a list."""
        out = np.repeat((q @ self.centres[home])[:, None], len(codes), axis=1)
        for j, (c, book) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c : c + SUBSPACE] @ book.T)[:, codes[:, j]]
        return out


def reach_of_links(spark: SparkSession, classes: DataFrame, shared, threshold: float, dims: int, dtype: str, rows: int, seed: int) -> float:
    """How far beyond a plane the links of ``rows`` of the vectors with any
    other take: a link is found when either end visits the other's list."""
    asked = classes.orderBy(F.xxhash64(F.lit(seed), "vec"), "vec").limit(rows).select("cid", "vec").toArrow()
    asked = spark.sparkContext.broadcast((asked["cid"].to_numpy(), b"".join(asked["vec"].to_pylist())))  # at most rows vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = asked.value
        q = np.frombuffer(q, dtype).reshape(-1, dims).astype(np.float64)
        q /= np.sqrt((q * q).sum(axis=1, keepdims=True))
        own = Quantiser(*shared.value)
        q_home, q_beyond = own.beyond(q)
        far = 0.0
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = unpack(part["vec"], dims, dtype)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                home, beyond = own.beyond(x)
                i, j = np.nonzero((q @ x.T >= threshold) & (ids[:, None] != part["cid"].to_numpy()[None, :]))
                if len(i):
                    far = max(far, float(np.minimum(q_beyond[i, home[j]], beyond[j, q_home[i]]).max()))
        yield pa.RecordBatch.from_arrays([pa.array([far])], names=["far"])

    return classes.select("cid", "vec").mapInArrow(run, "far double").agg(F.max("far")).first()[0]


def near_duplicates(
    spark: SparkSession, vectors: DataFrame, threshold: float = 0.9, rows_per_list: int = 512, sample_rows: int = 16_384,
    most_lists: int = 4096, slack: float = 2.0, seed: int = 17, reach_rows: int = 2048, margin: float = 1.25,
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors``
    (vec_id: long, embedding). n_links: other rows with cosine >= ``threshold``
    found; component_id: the smallest vec_id reachable by links; kept: vec_id is
    its component's.

    Equal vectors are one class with a weight and a number of its own, so copies
    cost no pairs and rows that repeat an id count as vectors of their own. Rows without an id,
    and vectors that are null, zero, of another length than most, or with null
    or non-finite components, link with nothing (0, their own id, kept unless
    the id is null). Other columns are not read.

    The quantiser is fitted on at most ``sample_rows`` vectors (the smallest
    by a seeded hash), the visits on the links of ``reach_rows``; every vector
    is indexed. A link is lost only if it lies farther beyond a plane than
    ``margin`` times every link of those. Pairs are counted where they
    are found and leave the task as counts and one edge per vector."""
    dims = dims_of(vectors)
    packed, dtype = pack(spark, vectors, dims)
    usable = packed.where("norm > 0 AND vec_id IS NOT NULL")
    classes = usable.groupBy("vec").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"))
    classes = staged(spark, classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")  # numbered once: it is written
    n = classes.count()
    sample = classes.orderBy(F.xxhash64(F.lit(seed), "vec"), "vec").limit(sample_rows).select("vec").toArrow()
    if n:
        x = unpack(sample["vec"], dims, dtype)
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        lists = max(1, min(n // rows_per_list, most_lists, len(x) // 8))
        shared = spark.sparkContext.broadcast(Quantiser.fit(x, lists, seed))  # at most most_lists centres
        step = np.sqrt(2 - 2 * threshold)
        reach = max(slack * step / np.sqrt(dims), margin * reach_of_links(spark, classes, shared, threshold, dims, dtype, reach_rows, seed + 1))
        reach = min(reach, step + 1e-9)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Quantiser(*shared.value) if n else None
        for b in batches:
            if not b.num_rows:
                continue
            x = unpack(b["vec"], dims, dtype)
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            home, visits = own.homes(x, reach)
            codes, left = own.encode(x, home)
            yield pa.RecordBatch.from_arrays(
                [b["cid"], b["vec"], b["weight"], pa.array(home.astype(np.int32)), pa.array([np.flatnonzero(v).astype(np.int32) for v in visits], pa.list_(pa.int32())),
                 pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)],
                names=["cid", "vec", "weight", "home", "visits", "codes", "left"])

    coded = staged(spark, classes.select("cid", "vec", "weight").mapInArrow(
        index, "cid long, vec binary, weight long, home int, visits array<int>, codes binary, left double"), "codes")
    visiting = coded.select("cid", "vec", "weight", "home", F.explode("visits").alias("list"))
    members = coded.select(*[F.col(c).alias(c) for c in coded.columns], F.col("home").alias("list"))  # columns of its own for the cogroup
    q, m, keys = in_blocks(visiting, members, ["list"], id="cid")

    def links(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, counts, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if left.num_rows and right.num_rows:
            own = Quantiser(*shared.value)
            here = right["list"][0].as_py()
            unit = lambda t: (x := unpack(t["vec"], dims, dtype)) / np.sqrt((x * x).sum(axis=1, keepdims=True))
            qx, mx = unit(left), unit(right)
            q_id, m_id = left["cid"].to_numpy(), right["cid"].to_numpy()
            q_weight, m_weight = left["weight"].to_numpy(), right["weight"].to_numpy()
            q_home, n_lists = left["home"].to_numpy().astype(np.int64), len(own.centres)
            m_visits = right["visits"].combine_chunks()
            rows_of = np.repeat(np.arange(len(mx)), np.diff(m_visits.offsets.to_numpy()))
            m_visits = np.sort(rows_of * n_lists + m_visits.flatten().to_numpy())  # (member, list) as one number
            codes = np.frombuffer(b"".join(right["codes"].to_pylist()), np.uint8).reshape(len(mx), -1)
            bound = threshold - 1e-9 - right["left"].to_numpy()
            names = np.unique(np.concatenate([q_id, m_id]))
            q_at, m_at = np.searchsorted(names, q_id), np.searchsorted(names, m_id)
            count, pairs = np.zeros(len(names), np.int64), []
            for lo in range(0, len(qx), 128):
                rows, cols = np.nonzero(own.products(qx[lo : lo + 128], codes, here) >= bound)
                rows += lo
                exact = np.concatenate([(qx[rows[i : i + 65536]] * mx[cols[i : i + 65536]]).sum(axis=1) for i in range(0, len(rows), 65536)] or [np.zeros(0)])
                found = (exact >= threshold) & (q_id[rows] != m_id[cols])
                rows, cols = rows[found], cols[found]
                np.add.at(count, q_at[rows], m_weight[cols])
                # Who doesn't visit the other's list back hears of the link here.
                deaf = np.flatnonzero(q_home[rows] != here)
                back = cols[deaf] * n_lists + q_home[rows[deaf]]
                deaf = deaf[m_visits[np.minimum(np.searchsorted(m_visits, back), len(m_visits) - 1)] != back]
                np.add.at(count, m_at[cols[deaf]], q_weight[rows[deaf]])
                if len(rows):
                    a, b = q_at[rows], m_at[cols]
                    label = local_components(a, b, len(names))
                    hit = np.flatnonzero(label != np.arange(len(names)))
                    pairs.append(np.stack([hit, label[hit]]))
            root = np.arange(len(names))
            if pairs:
                a, b = np.concatenate(pairs, axis=1)
                root = local_components(a, b, len(names))
            hit = np.flatnonzero((count > 0) | (root != np.arange(len(names))))
            ids, counts, roots = [names[hit]], [count[hit]], [names[root[hit]]]
        return pa.table({"id": ids[0], "n": counts[0], "root": roots[0]})

    if n:
        met = q.groupBy(*keys).cogroup(m.groupBy(*keys)).applyInArrow(links, "id long, n long, root long")
    else:
        met = spark.createDataFrame([], "id long, n long, root long")
    met = staged(spark, met, "vector-links")
    counts = met.groupBy("id").agg(F.sum("n").alias("n"))
    parts = connected_components(spark, met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = parts.join(classes.select(F.col("cid").alias("id"), "vec_id"), "id")
    low = named.groupBy("component").agg(F.min("vec_id").alias("low"))
    parts = parts.join(low, "component").select("id", "low")
    told = classes.join(counts, classes["cid"] == counts["id"], "left").drop("id").join(parts, F.col("cid") == parts["id"], "left")
    told = told.select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("low", "vec_id").alias("component_id"))
    linked = usable.join(told, "vec").select("vec_id", "n_links", "component_id")
    alone = packed.where("NOT (norm > 0 AND vec_id IS NOT NULL)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
