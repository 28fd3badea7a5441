"""previous_in_group equals a window lag, also when one group dominates."""

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from filinglens.operators.sequence import global_ranks, previous_in_group


def test_previous_in_group_matches_lag_with_hot_group(spark):
    hot = spark.range(0, 3000).select(F.lit("hot").alias("g"), (F.col("id") * 7 % 3001).alias("o"))
    cold = spark.range(0, 500).select(F.concat(F.lit("g"), (F.col("id") % 13).cast("string")).alias("g"), F.col("id").alias("o"))
    df = hot.unionByName(cold)
    got = sorted(tuple(r) for r in previous_in_group(df, "g", "o", partitions=16).collect())
    w = Window.partitionBy("g").orderBy("o")
    want = sorted(tuple(r) for r in df.select("g", "o", F.lag("o").over(w).alias("prior")).collect())
    assert got == want


def test_null_group_and_null_order(spark):
    rows = [(None, i) for i in range(40)] + [("a", 1), ("a", None), ("a", 2)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = [tuple(r) for r in previous_in_group(df, "g", "o", partitions=8).collect()]
    assert len(got) == len(rows)
    assert [o for g, o, p in got if g is None and p is None] == [0]
    assert sorted((str(o), p) for g, o, p in got if g == "a") == [("1", None), ("2", 1), ("None", None)]


def test_changed_since_prior_odd_documents(spark):
    from filinglens.operators.metrics import changed_since_prior

    rows = [
        ("s", 1, "a\nb\nb"), ("s", 2, "b\nc"), ("s", 3, None), ("s", 4, ""), ("s", 5, "c\n\nd"),
        (None, 6, "x"), (None, 7, "x"), ("t", None, "y"),
    ]
    df = spark.createDataFrame(rows, "source string, doc_id long, text string")
    got = {(r.source, r.doc_id): tuple(r)[2:] for r in changed_since_prior(df, "source", "doc_id", "text").collect()}
    assert got == {
        ("s", 1): (None, 2, None, None), ("s", 2): (1, 2, 1, 1), ("s", 3): (2, 0, 0, 2), ("s", 4): (3, 0, 0, 0),
        ("s", 5): (4, 2, 2, 0), (None, 6): (None, 1, None, None), (None, 7): (6, 1, 0, 0), ("t", None): (None, 0, None, None),
    }


def _ranks(rows, tiles):
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    n, out = len(order), []
    size, more = divmod(n, tiles)
    for at, (i, v) in enumerate(order, 1):
        rank = 1 + next(j for j, (_, w) in enumerate(order) if w == v)
        tile = (at - 1) // (size + 1) + 1 if at <= more * (size + 1) else more + (at - 1 - more * (size + 1)) // size + 1
        out.append((i, v, at, rank, (rank - 1) / max(n - 1, 1), tile))
    return sorted(out)


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_global_ranks(spark, partitions):
    cases = [[(i, (i * 7919) % 50) for i in range(200)], [(i, 5 if i % 3 else None) for i in range(90)], [(i, 1) for i in range(25)], [(1, 4)], [(1, None), (2, None)], [], [(i, i // 20) for i in range(100)]]
    for rows in cases:
        got = global_ranks(spark.createDataFrame(rows, "id long, size long"), "id", "size", 7, partitions=partitions)
        assert sorted(map(tuple, got.collect())) == _ranks(rows, 7)
