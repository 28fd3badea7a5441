"""Operator 1: quality classifier, a linear model on Naive Bayes features.

n-gram indicators are scaled by the log ratio of their smoothed class
counts; a hinge-loss linear model is fitted on the scaled rows by dual
coordinate descent; every document is scored in one pass without a shuffle.

Features are byte 3- and 5-grams of the whole text, hashed into a fixed
number of slots, and n-grams of one word repeated (a run of at least n), so
the model has one size whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import renamed, strings

HASH_BITS = 18
ORDERS = (3, 5)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
RUNS = (2, 3, 5, 8, 13)
SLOTS = (1 << HASH_BITS) + len(RUNS)


@dataclass
class QualityModel:
    weight: np.ndarray  # of each slot, class ratio included
    square: np.ndarray  # squared class ratio, for the length of a row
    bias: float


def indicators(raw: bytes, flags: np.ndarray) -> np.ndarray:
    """Slots of the n-grams a text holds. ``flags``: an all-False scratch
    array of SLOTS, handed back all False."""
    b = np.frombuffer(b" " + raw + b" ", dtype=np.uint8).astype(np.uint64)
    for n, k in zip(ORDERS, MULTIPLIERS, strict=True):
        if len(b) < n:
            continue
        code = b[: len(b) - n + 1].copy()
        for i in range(1, n):
            code |= b[i : len(b) - n + 1 + i] << np.uint64(8 * i)
        flags[((code * np.uint64(k)) >> np.uint64(64 - HASH_BITS)).astype(np.int64)] = True
    words = raw.split()
    # Where a word differs from the one before it; gaps are the runs.
    change = np.flatnonzero([True, *map(ne, words[1:], words[:-1]), True]) if words else np.zeros(1)
    longest = int(np.diff(change).max(initial=0))
    for i, n in enumerate(RUNS):
        flags[(1 << HASH_BITS) + i] = longest >= n
    ids = np.flatnonzero(flags)
    flags[ids] = False
    return ids.astype(np.int32)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text leaves remainder 1 by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _class_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float) -> np.ndarray:
    counts = np.full((2, SLOTS), alpha)
    for ids, label in zip(rows, y, strict=True):
        counts[int(label > 0)][ids] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def fit_rows(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, alpha: float = 1.0, epochs: int = 12) -> QualityModel:
    """Dual coordinate descent for the L1 hinge loss, y in {-1, +1}. Each row
    is the class ratios of its slots at length 1, plus a constant for the bias."""
    ratio = _class_ratio(rows, y, alpha)
    x = []
    for ids in rows:
        v = ratio[ids]
        x.append(v / max(np.sqrt(v @ v), 1e-12))
    w, bias, dual = np.zeros(SLOTS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(7)
    # Each class weighs half of all rows, so a rare class is not given up.
    upper = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            ids, v = rows[i], x[i]
            gradient = y[i] * (w[ids] @ v + bias) - 1.0
            new = min(max(dual[i] - gradient / 2.0, 0.0), upper[i])  # |row|^2 + 1 = 2
            step = (new - dual[i]) * y[i]
            if step:
                w[ids] += step * v
                bias += step
                dual[i] = new
    return QualityModel(w * ratio, ratio * ratio, bias)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flags = np.zeros(SLOTS, dtype=bool)
    for b in batches:
        ids = [indicators(t.encode(), flags).tobytes() for t in strings(b["text"])]
        yield pa.RecordBatch.from_arrays([b["quality"], pa.array(ids, pa.binary())], names=["quality", "ids"])


def fit(docs: DataFrame, labels: DataFrame, max_fit_rows: int = 3000, seed: int = 11) -> QualityModel:
    """Fit on at most ``max_fit_rows`` labelled rows outside the held-out
    third, the smallest by a seeded hash of doc_id. Null ids or labels take no
    part; of several labels of one id the smallest counts, of several texts
    the smallest. Without rows of both classes the model is constant."""
    chosen = (
        renamed(labels, doc_id="doc_id", quality="quality")
        .where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_fit_rows)
    )
    rows = (
        renamed(docs, doc_id="doc_id", text="text")
        .join(F.broadcast(chosen), "doc_id")  # at most max_fit_rows rows
        .groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))
        .select("quality", "text").mapInArrow(_features, "quality int, ids binary")
        .toPandas()
    )
    y = np.where(rows["quality"].to_numpy() > 0, 1.0, -1.0) if len(rows) else np.zeros(0)
    ids = [np.frombuffer(x, dtype=np.int32) for x in rows["ids"]] if len(rows) else []
    if len(set(y)) < 2:
        zero = np.zeros(SLOTS)
        return QualityModel(zero, zero, float(y[0]) if len(y) else 1.0)
    key = sorted(range(len(ids)), key=lambda i: (y[i], ids[i].tobytes()))  # any task order gives the same model
    return fit_rows([ids[i] for i in key], y[key])


def margins(texts: list[str], model: QualityModel, flags: np.ndarray) -> np.ndarray:
    out = np.empty(len(texts))
    for i, t in enumerate(texts):
        ids = indicators(t.encode(), flags)
        length = float(model.square[ids].sum())
        out[i] = model.bias + (float(model.weight[ids].sum()) / np.sqrt(length) if length > 0 else 0.0)
    return out


def score_quality(spark: SparkSession, docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5)
    added, whatever columns it has (columns of those names are replaced). A
    null text scores as an empty one. One pass, no shuffle; the model that is
    broadcast has a fixed size (two arrays of SLOTS doubles)."""
    shared = spark.sparkContext.broadcast((model.weight, model.square, model.bias))
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    docs = docs.select(*[docs[f"`{c}`"] for c in keep])
    schema = docs.limit(0).withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(1)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flags = QualityModel(*shared.value), np.zeros(SLOTS, dtype=bool)
        for b in batches:
            parts = [margins(strings(b["text"].slice(lo, 512)), own, flags) for lo in range(0, b.num_rows, 512)]
            m = np.concatenate(parts) if parts else np.zeros(0)
            s = 1.0 / (1.0 + np.exp(-np.clip(2.0 * m, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"]
            )

    return docs.mapInArrow(run, schema)
