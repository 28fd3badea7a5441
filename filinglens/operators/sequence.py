"""Order-dependent operators that must not put a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filinglens.session import ensure_checkpoint_dir


def previous_in_group(df: DataFrame, group_col: str, order_col: str, partitions: int | None = None) -> DataFrame:
    """(group, order, prior): the previous ``order_col`` value of the same
    group (null is a group too), null for the first and for rows without an order.

    ``Window.partitionBy(group)`` would sort a hot group (say a third of all
    rows) inside one task. Instead the (group, order) pairs are
    range-partitioned on both columns, so a hot group spans many
    partitions; ``lag`` runs per (partition, group), and the first row of a
    group in a partition takes the last value of that group in the previous
    partition holding it, from a small per-(partition, group) summary.
    The partition ids are checkpointed so both uses see the same layout.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(group_col, order_col).where(F.col(order_col).isNotNull())
    ranged = (
        keys.repartitionByRange(n, group_col, order_col)
        .withColumn("_pid", F.spark_partition_id())
        .checkpoint(eager=True)
    )
    local = ranged.withColumn(
        "prior", F.lag(order_col).over(Window.partitionBy("_pid", group_col).orderBy(order_col))
    )
    lasts = ranged.groupBy("_pid", group_col).agg(F.max(order_col).alias("_last"))
    carry = lasts.withColumn("_carry", F.lag("_last").over(Window.partitionBy(group_col).orderBy("_pid"))).select(
        "_pid", group_col, "_carry"
    )
    carry = carry.select(F.col("_pid").alias("_cpid"), F.col(group_col).alias("_cgroup"), "_carry")
    # Null is a group like any other.
    out = local.join(carry, (F.col("_pid") == F.col("_cpid")) & F.col(group_col).eqNullSafe(F.col("_cgroup")), "left")
    out = out.select(group_col, order_col, F.coalesce("prior", "_carry").alias("prior"))
    unordered = df.select(group_col, order_col).where(F.col(order_col).isNull())
    return out.unionAll(unordered.withColumn("prior", F.lit(None).cast(df.schema[order_col].dataType)))


def global_ranks(df: DataFrame, id_col: str, value_col: str, tiles: int, partitions: int | None = None) -> DataFrame:
    """(id, value, position, rank, percent_rank, tile) of every row over the
    whole table, largest value first, nulls last: ``position`` breaks ties by the id,
    ``rank`` and ``percent_rank`` are those of SQL, ``tile`` is its ntile by position.

    No window holds the table: rows are range-partitioned on (value, id), windows run
    inside a partition, and what the driver adds up is a count and the outer values
    of each partition. A value that spans partitions keeps the rank of its first row.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_value").desc_nulls_last(), F.col("_id").asc_nulls_first()]
    ranged = df.select(F.col(id_col).alias("_id"), F.col(value_col).alias("_value")).repartitionByRange(n, *order)
    ranged = ranged.withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    inside = Window.partitionBy("_pid")
    local = ranged.withColumn("_row", F.row_number().over(inside.orderBy(*order))).withColumn("_rank", F.rank().over(inside.orderBy(order[0])))
    outer = local.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("_value"), "_row").alias("first"), F.max_by(F.struct("_value", "_rank"), "_row").alias("last"))
    rows, before, open_value, open_rank = [], 0, None, 0
    for r in outer.orderBy("_pid").collect():  # a row per partition
        goes_on = open_value is not None and open_value[0] == r["first"]["_value"]
        rows.append((r["_pid"], before, open_rank if goes_on else before + 1))
        if not (goes_on and r["last"]["_rank"] == 1):
            open_value, open_rank = (r["last"]["_value"],), before + r["last"]["_rank"]
        before += r["n"]
    total = before
    starts = spark.createDataFrame(rows, "_pid int, _before long, _first long")
    size, more = divmod(total, tiles)
    at = F.col("position")
    wide = more * (size + 1)
    div = lambda a, b: F.call_function("div", a, F.lit(max(b, 1)))
    out = local.join(starts, "_pid").withColumn("position", F.col("_before") + F.col("_row"))
    out = out.withColumn("rank", F.when(F.col("_rank") == 1, F.col("_first")).otherwise(F.col("_before") + F.col("_rank")))
    return out.select(
        F.col("_id").alias(id_col), F.col("_value").alias(value_col), "position", "rank",
        ((F.col("rank") - 1) / F.lit(float(max(total - 1, 1)))).alias("percent_rank"),
        F.when(at <= wide, div(at - 1, size + 1) + 1).otherwise(more + div(at - 1 - wide, size) + 1).cast("int").alias("tile"),
    )
