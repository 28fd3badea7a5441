"""Connected components of an edge table by contraction, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filinglens.llm.common import staged


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) -> (id, component): for every node of an edge, a
    name that all nodes of its component share (one of their ids).

    Each round points every node at the smallest of itself and its neighbours
    in a seeded hash order, follows the pointers, and keeps the edges between
    what they end at. The random order makes the graph shrink by a constant
    factor each round whatever its shape, so rounds grow with the logarithm of
    the nodes. Hubs cost an aggregation with a map-side minimum; no
    neighbourhood is gathered."""
    two_way = edges.where("a <> b")
    links = staged(spark, two_way.unionAll(two_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels, turn = None, 0
    while not links.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        up = links.groupBy("a").agg(F.min(order("b")).alias("m")).select(
            F.col("a").alias("id"), F.least(F.col("m"), order("a"))["n"].alias("up"))
        up = staged(spark, up, "pointers")
        far = up.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        up = staged(spark, up.join(far, "up", "left").select("id", F.coalesce("upper", "up").alias("up")), "pointers")
        if labels is None:
            labels = up.select("id", F.col("up").alias("component"))
        else:
            labels = labels.join(up.select(F.col("id").alias("component"), "up"), "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        labels = staged(spark, labels, "labels")
        left = links.join(up.select(F.col("id").alias("a"), F.col("up").alias("p")), "a")
        both = left.join(up.select(F.col("id").alias("b"), F.col("up").alias("q")), "b")
        links = staged(spark, both.where("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return labels
