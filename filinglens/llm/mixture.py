"""Operator 4: mixing overlapping sources to target weights.

Documents are aggregated by membership pattern (the set of sources a text
belongs to). A min-cost flow routes each pattern's words to the quotas of its
sources; the k-th repetition of a pattern costs more than the one before it
(convex), so nothing is repeated before everything eligible was used once.
Only pattern sums reach the driver; documents are then taken in the order of
a seeded hash, by prefix sums over hash buckets.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filinglens.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text):
    """How many runs of non-space characters; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), cap: int = 2) -> dict[str | None, Fraction]:
    """Words each source is to give: ``share`` of all words by weight, none
    above ``cap`` times its source; the excess goes to the others by weight,
    until none is above. Sources in code-point order, null last; weights repeat.
    Exact: the shares end at min(cap * size, level * weight)."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, rest, out = share * sum(sizes.values()), set(names), {}
    while rest:
        level = Fraction(left, sum(weight[s] for s in rest))
        full = {s for s in rest if cap * sizes[s] <= level * weight[s]}
        if not full:
            return out | {s: level * weight[s] for s in rest}
        out |= {s: Fraction(cap * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        rest -= full
    return out


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Min-cost flow by cheapest augmenting paths, in whole numbers. Its
    size is that of the pattern table, not of the corpus."""

    def __init__(self, nodes: int):
        self.out: list[list[_Edge]] = [[] for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int, cost: int) -> _Edge:
        self.out[a].append(e := _Edge(b, room, cost, len(self.out[b])))
        self.out[b].append(_Edge(a, 0, -cost, len(self.out[a]) - 1))
        return e

    def run(self, s: int, t: int) -> None:
        while True:
            far, came, queue, waits = {s: 0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                waits.discard(a)
                for e in self.out[a]:
                    if e.room and far[a] + e.cost < far.get(e.to, 1 << 62):
                        far[e.to], came[e.to] = far[a] + e.cost, (a, e)
                        if e.to not in waits:
                            waits.add(e.to)
                            queue.append(e.to)
            if t not in far:
                return
            path, at = [], t
            while at != s:
                at, e = came[at]
                path.append(e)
            amount = min(e.room for e in path)
            for e in path:
                e.room -= amount
                self.out[e.to][e.back].room += amount


def allocate(patterns: dict[tuple, int], quota: dict[str | None, int], cap: int = 2) -> dict[tuple, int]:
    """Words to take from each pattern (a tuple of sources), at most ``cap``
    times its words, so that sources meet their quotas as far as possible at
    the least repetition."""
    names, keys = list(quota), list(patterns)
    flow = Flow(2 + len(keys) + len(names))
    at = {s: 2 + len(keys) + i for i, s in enumerate(names)}
    used = {}
    for i, p in enumerate(keys):
        used[p] = [flow.edge(0, 2 + i, patterns[p], k * k) for k in range(cap)]  # convex: 0, 1, 4, ...
        for s in p:
            flow.edge(2 + i, at[s], cap * patterns[p], 0)
    for s in names:
        flow.edge(at[s], 1, quota[s], 0)
    flow.run(0, 1)
    return {p: sum(patterns[p] - e.room for e in used[p]) for p in keys}


def mix(
    spark: SparkSession, docs: DataFrame, sources=None, size=None, weights: tuple[int, ...] = (3, 1, 2),
    share: Fraction = Fraction(3, 2), cap: int = 2, seed: str = "mix", rows_per_bucket: int = 20_000,
) -> DataFrame:
    """``docs`` plus ``size``, ``source_size``, ``target`` (its first source's)
    and ``taken``: the words the mix takes of the document, repeats counted,
    at most ``cap * size``.

    ``sources``: the array of sources a document belongs to (default: its
    ``source`` alone; null is a source of its own, an empty or null array
    counts as the null source). ``size``: a count column (default: words of
    ``text``; null or empty text has 0 and is never taken). Input columns of
    the four result names are replaced. Each pattern's documents are taken
    whole in the order of md5(seed, doc_id); one document at the edge of each
    pattern is taken in part, so sums meet the flow exactly. Repeated rows of
    one doc_id count each for itself. An empty table gives an empty one."""
    sources = F.array(F.col("source")) if sources is None else sources
    size = n_words(F.col("text")) if size is None else size
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    base = docs.select(*[f"`{c}`" for c in keep], size.alias("_size"),
                       F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))).alias("_p"))
    base = base.withColumn("_p", F.when(F.size("_p") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("_p")))
    base = base.withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    slim = staged(spark, base.select("_p", "_h", "_size"), "mix-sizes")
    found = slim.groupBy("_p").agg(F.sum("_size").alias("s"), F.count("*").alias("n")).collect()  # a row per pattern
    sums = {tuple(r["_p"]): r["s"] for r in found}
    names = {s for p in sums for s in p}
    sizes = {s: sum(v for p, v in sums.items() if s in p) for s in names}
    goal = targets(sizes, weights, share, cap)
    take = allocate(sums, {s: int(goal[s]) for s in goal}, cap)

    rows = [(list(p), n, take[p] // v if v else 0, take[p] - take[p] // v * v if v else 0, sizes[p[0]], float(goal[p[0]]))
            for p, v, n in ((tuple(r["_p"]), r["s"], r["n"]) for r in found)]
    plan = spark.createDataFrame(
        [(p, max(1, n // rows_per_bucket + 1), whole, part, s, t) for p, n, whole, part, s, t in rows],
        "_q array<string>, _buckets long, _whole long, _part long, _source_size long, _target double")
    # Null-safe key: arrays with null compare unequal, their JSON does not.
    key = lambda c: F.to_json(F.struct(F.col(c).alias("k")))
    plan = plan.select(key("_q").alias("_key"), "_buckets", "_whole", "_part", "_source_size", "_target")
    bucket = F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * F.col("_buckets") / F.lit(1 << 32)

    def dealt(df):  # the plan has a row per pattern
        return df.withColumn("_key", key("_p")).join(F.broadcast(plan), "_key").withColumn("_bucket", F.floor(bucket).cast("long"))

    by_bucket = dealt(slim).groupBy("_key", "_bucket").agg(F.sum("_size").alias("_in"))
    before = F.coalesce(F.sum("_in").over(Window.partitionBy("_key").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = by_bucket.withColumn("_before", before).join(F.broadcast(plan.select("_key", "_part")), "_key")
    # One bucket of each pattern holds the edge; it has about rows_per_bucket rows.
    edge = staged(spark, edges.where((F.col("_before") <= F.col("_part")) & (F.col("_part") < F.col("_before") + F.col("_in")))
                  .select("_key", F.col("_bucket").alias("_edge"), "_before"), "mix-edges")
    inside = dealt(slim).join(F.broadcast(edge), "_key").where(F.col("_bucket") == F.col("_edge"))
    inside = inside.groupBy("_key", "_h", "_size").agg(F.count("*").alias("_copies"), F.first("_before").alias("_before"))
    cum = F.coalesce(F.sum(F.col("_size") * F.col("_copies")).over(
        Window.partitionBy("_key").orderBy("_h", "_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("_start", F.col("_before") + cum).select("_key", "_h", "_size", "_start", "_copies")
    cut = staged(spark, dealt_cut(inside, plan), "mix-cut")

    out = dealt(base).join(F.broadcast(edge.select("_key", "_edge")), "_key", "left").join(F.broadcast(cut), "_key", "left")
    order = F.struct(F.col("_bucket"), F.col("_h"), F.col("_size"))
    limit = F.struct(F.col("_edge"), F.col("_cut_h"), F.col("_cut_size"))
    part = (
        F.when(F.col("_cut_h").isNull(), F.lit(0))  # a pattern without words
        .when(order < limit, F.col("_size"))
        .when(order == limit, F.col("_cut_part"))
        .otherwise(F.lit(0))
    )
    return out.select(*[f"`{c}`" for c in keep], F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), (F.col("_whole") * F.col("_size") + part).cast("long").alias("taken"))


def dealt_cut(inside: DataFrame, plan: DataFrame) -> DataFrame:
    """Per pattern the (hash, size) of the documents at the edge and the words
    taken of each; copies of one doc_id and size share what is left."""
    left = F.col("_part") - F.col("_start")
    at = inside.join(F.broadcast(plan.select("_key", "_part")), "_key").where((left >= 0) & (F.col("_size") > 0))
    last = F.max_by(F.struct("_h", "_size", F.floor(left / F.col("_copies")).alias("_left")), F.struct("_h", "_size"))
    return at.groupBy("_key").agg(last.alias("x")).select(
        "_key", F.col("x._h").alias("_cut_h"), F.col("x._size").alias("_cut_size"), F.least(F.col("x._left"), F.col("x._size")).alias("_cut_part"))
