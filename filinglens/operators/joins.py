"""Spreading of inputs whose scan yields too few partitions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SHUFFLE = re.compile(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)")


def _shuffled(df: DataFrame) -> bool:
    """Does the plan already shuffle? (Asking such a plan for its partition
    count would run the shuffle under AQE.)"""
    return bool(_SHUFFLE.search(df._jdf.queryExecution().executedPlan().toString()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-repartition ``df`` over the cluster's parallelism when its scan
    yields fewer partitions than there are cores (a few large row groups of
    long texts); otherwise leave it alone. At scale the input already has
    far more partitions than cores and no shuffle is added. Inputs that
    already went through a shuffle, and streaming inputs, are never touched."""
    if df.isStreaming or _shuffled(df):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:  # a scan: no job is run to answer
        return df
    # Hash partitioning (on all columns when no key is given) is
    # deterministic, so a retried task after a lost executor sees the same rows.
    return df.repartition(cores, *(keys or df.columns))
