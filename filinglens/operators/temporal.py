"""Joins on time: as-of (the latest row known at a moment) and points in intervals.

Neither puts the whole of a hot key in one task, compares every pair of a key's
rows, or broadcasts a side by force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filinglens.session import ensure_checkpoint_dir


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str,
    left_time: str,
    right_time: str,
    carry: list[str],
    strict: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with the columns ``carry`` of the latest row of
    ``right`` that has the same ``by`` and a time not after (``strict``: before) its own;
    nulls where there is none. Both have a column ``by``.

    Rows of both sides are range-partitioned on (key, time), so a key with a third
    of all rows spans many tasks; rows of one key and moment are dealt further by
    a hash. The last known row is carried along inside a partition by a window,
    and from partition to partition by a summary of one row per key and partition. Of
    several rows of ``right`` at one moment the largest (by ``carry``) counts. Null
    keys and times match nothing; repeated rows of ``left`` each keep a row.
    """
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull())
    # One row per key and moment, combined before the shuffle.
    known = known.groupBy(F.col(by).alias("_k"), F.col(right_time).alias("_t")).agg(F.max(F.struct(*carry)).alias("_r"))
    asked = left.select(F.struct("*").alias("_l"), F.col(by).alias("_k"), F.col(left_time).alias("_t"))
    matchable = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    both = known.select("_k", "_t", F.lit(2 if strict else 0).alias("_kind"), F.lit(0).cast("long").alias("_s"), "_r", F.lit(None).cast(asked.schema["_l"].dataType).alias("_l"))
    both = both.unionByName(
        asked.where(matchable).select("_k", "_t", F.lit(1).alias("_kind"), F.xxhash64("_l").alias("_s"), F.lit(None).cast(known.schema["_r"].dataType).alias("_r"), "_l"))
    place = ["_k", "_t", "_kind", "_s"]
    # Written, so that both uses see the same partitions.
    both = both.repartitionByRange(n, *place).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)

    so_far = Window.partitionBy("_pid", "_k").orderBy("_t", "_kind", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = both.withColumn("_r", F.last("_r", ignorenulls=True).over(so_far)).where("_l IS NOT NULL")
    lasts = both.groupBy("_pid", "_k").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_last"))
    earlier = Window.partitionBy("_k").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    brought = lasts.select(F.col("_pid").alias("_p2"), F.col("_k").alias("_k2"), F.last("_last", ignorenulls=True).over(earlier).alias("_brought"))
    brought = brought.where("_brought IS NOT NULL")
    out = here.join(brought, (F.col("_pid") == F.col("_p2")) & (F.col("_k") == F.col("_k2")), "left")
    out = out.select("_l.*", F.coalesce("_r", "_brought").alias("_r")).select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in carry])
    rest = asked.where(~matchable).select("_l.*").select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in carry])
    return out.unionAll(rest)


def _level(length: Column, width: int, fan: int) -> Column:
    """The smallest level whose bins (``width * fan ** level``) are no shorter
    than a ``fan``-th of the length: an interval then covers at most fan + 1 bins."""
    out, size, level = F.lit(0), width * fan, 0
    while size < 1 << 62:
        level += 1
        out = F.when(length > size, F.lit(level)).otherwise(out)
        size *= fan
    return out


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    *,
    by: str,
    time: str,
    start: str,
    end: str,
    width: int,
    fan: int = 8,
) -> DataFrame:
    """Every pair of a row of ``points`` and one of ``intervals`` with the same
    ``by`` and ``start <= time < end`` (integers, such as seconds); all columns of both, ``by`` once.

    Time is cut in bins at several levels, each ``fan`` times as wide as the one
    below, the lowest ``width``. An interval is put at the level of its length and repeated
    for the bins it covers, ``fan + 1`` at most; a point for the levels in use, of which
    there are no more than the logarithm of the longest interval. A pair so meets in
    exactly one bin, whatever the lengths, and rows of a key are compared only within a
    bin. A null ``end`` is open: such intervals stand in one bin of their key. Nulls in
    ``by``, ``time`` or ``start`` match nothing, nor do intervals that end before they begin.
    """
    length = F.col(end) - F.col(start)
    iv = intervals.where(F.col(by).isNotNull() & F.col(start).isNotNull() & (F.col(end).isNull() | (length > 0)))
    iv = iv.withColumn("_level", F.when(F.col(end).isNull(), F.lit(-1)).otherwise(_level(length, width, fan)))
    used = sorted(r[0] for r in iv.select("_level").distinct().collect())  # at most 22 rows

    def bin_of(t: Column, level: int) -> Column:
        return F.lit(0).cast("long") if level < 0 else F.floor(t / F.lit(width * fan**level)).cast("long")

    def by_level(f) -> Column:
        out = F.array().cast("array<bigint>")
        for level in used:
            out = F.when(F.col("_level") == level, f(level)).otherwise(out)
        return out

    covered = by_level(lambda level: F.array(F.lit(0).cast("long")) if level < 0 else F.sequence(bin_of(F.col(start), level), bin_of(F.col(end) - 1, level)))
    iv = iv.withColumn("_bin", F.explode(covered))
    places = [F.struct(F.lit(level).alias("_level"), bin_of(F.col(time), level).alias("_bin")) for level in used]
    pt = points.where(F.col(by).isNotNull() & F.col(time).isNotNull())
    if not used:
        places = [F.struct(F.lit(0).alias("_level"), F.lit(0).cast("long").alias("_bin"))]
    pt = pt.select("*", F.inline(F.array(*places)))
    met = pt.join(iv, [by, "_level", "_bin"])
    inside = (F.col(start) <= F.col(time)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return met.where(inside).drop("_level", "_bin")
