"""Mergeable summaries per batch and cubes over them (A8): row counts, totals,
distinct counts and quantiles of any grouping of the dimensions are
answered from what each batch left, without reading its rows again.

* Distinct counts: a HyperLogLog sketch per cell, united by ``hll_union_agg``;
  its standard error is 1.04 / sqrt(2 ** lg_k).
* Quantiles: numbers of rows by logarithmic bins of the value, merged by sums.
  A quantile comes back within ``alpha`` of the value at its rank, always.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def gamma_of(alpha: float) -> float:
    return (1 + alpha) / (1 - alpha)


def append_summaries(df: DataFrame, path: str, *, batch: str, dims: list[str], distinct_col: str, value_col: str, alpha: float = 0.01, lg_k: int = 12) -> None:
    """Summaries of one batch, added to those in ``path``: ``cells`` (a sketch,
    rows and the total per combination of ``dims``) and ``bins``. A batch that
    is written again replaces itself, so a replay changes nothing. Null dimensions are values; a null
    value has no bin, a null ``distinct_col`` isn't counted as distinct;
    values of 0 and less share one bin."""
    by = [F.col(f"`{d}`").alias(f"d{i}") for i, d in enumerate(dims)]
    own = df.select(*by, F.col(f"`{distinct_col}`").cast("string").alias("_id"), F.col(f"`{value_col}`").cast("long").alias("_value"))
    names = [f"d{i}" for i in range(len(dims))]
    cells = own.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("total"), F.hll_sketch_agg("_id", lg_k).alias("ids"))
    step = math.log(gamma_of(alpha))
    bin_ = F.when(F.col("_value") > 0, F.ceil(F.log("_value") / F.lit(step))).otherwise(F.lit(-1)).cast("int")
    bins = own.where(F.col("_value").isNotNull()).groupBy(*names, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    for name, part in (("cells", cells), ("bins", bins)):
        part.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")


def read_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/bins")


def all_groupings(n: int) -> list[list[int]]:
    return [[i for i in range(n) if not level >> (n - 1 - i) & 1] for level in range(2**n)]


def grouped(df: DataFrame, names: list[str], more: list[str], *aggregates) -> DataFrame:
    """Aggregates of every combination of ``names`` (a cube), each by ``more``
    too; ``level`` as ``grouping_id`` of ``names`` gives it."""
    sets = [[*(F.col(names[i]) for i in keep), *(F.col(m) for m in more)] for keep in all_groupings(len(names))]
    level = sum((F.grouping(x).cast("int") * (1 << (len(names) - 1 - i)) for i, x in enumerate(names)), F.lit(0))
    return df.groupingSets(sets, *names, *more).agg(*aggregates, level.alias("level"))


def at_ranks(binned: DataFrame, names: list[str], value: str, percents: dict[str, int]) -> DataFrame:
    """Per cell of a cube the smallest ``value`` with at least p % of the
    cell's ``n`` at or below it. A cell has as many rows as it has values."""
    cell = Window.partitionBy("level", *names)
    below = F.sum("n").over(cell.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    seen = binned.withColumn("_below", below).withColumn("_all", F.sum("n").over(cell))
    return seen.groupBy("level", *names).agg(
        *[F.min(F.when(F.col("_below") * 100 >= F.col("_all") * p, F.col(value))).alias(name) for name, p in percents.items()])


def cube_of_summaries(cells: DataFrame, bins: DataFrame, dims: list[str], percents: dict[str, int], alpha: float = 0.01) -> DataFrame:
    """``dims``, level, n, total, n_distinct (estimate) and the quantiles
    ``percents`` of every grouping of the dimensions, from the summaries of all
    batches. Bins of a cell are bounded by the range of the values, so the window over them
    stays small however many rows there were; quantiles are null where no value is."""
    names = [f"d{i}" for i in range(len(dims))]
    sums = grouped(cells, names, [], F.sum("n").alias("n"), F.sum("total").alias("total"), F.hll_sketch_estimate(F.hll_union_agg("ids")).alias("n_distinct"))
    merged = grouped(bins, names, ["bin"], F.sum("n").alias("n"))
    g = gamma_of(alpha)
    ranks = at_ranks(merged, names, "bin", percents)
    middle = lambda b: F.when(F.col(b) < 0, 0.0).otherwise(F.lit(2 / (g + 1)) * F.pow(F.lit(g), F.col(b)))
    ranks = ranks.select("level", *[F.col(x).alias(f"_{x}") for x in names], *[F.when(F.col(p).isNotNull(), middle(p)).alias(p) for p in percents])
    same = F.col("_level") == F.col("level")
    for x in names:
        same = same & F.col(x).eqNullSafe(F.col(f"_{x}"))
    out = sums.join(ranks.withColumnRenamed("level", "_level"), same, "left")
    return out.select(*[F.col(x).alias(d) for x, d in zip(names, dims, strict=True)], "level", "n", "total", "n_distinct", *percents)
