"""As-of and interval joins against brute force: nulls, ties, hot keys, empty sides."""

import random

import pytest

from filinglens.operators.temporal import asof_join, points_in_intervals

LEFT, RIGHT = "id long, k string, t long, seen string", "k string, at long, acc string, n long"


def asof_brute(left, right, strict):
    out = []
    for row in left:
        known = [r for r in right if None not in (r[0], r[1], row[1], row[2]) and r[0] == row[1] and (r[1] < row[2] if strict else r[1] <= row[2])]
        best = max(known, key=lambda r: (r[1], r[2], r[3]), default=None)
        out.append((*row, *(best[2:] if best else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("partitions", [1, 7])
def test_asof_join(spark, strict, partitions):
    r = random.Random(5)
    keys = ["hot"] * 6 + ["a", "b", "c", None]
    left = [(i, r.choice(keys), r.choice([None, *range(40)]), "x") for i in range(300)] + [(7, "hot", 20, "x")] * 30 + [(8, "hot", 20, "x")] * 30
    right = [(r.choice(keys), r.choice([None, *range(0, 40, 3)]), f"acc{r.randrange(9)}", r.randrange(4)) for _ in range(120)]
    out = asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), by="k", left_time="t", right_time="at", carry=["acc", "n"], strict=strict, partitions=partitions)
    assert out.columns == ["id", "k", "t", "seen", "acc", "n"]
    assert sorted(map(tuple, out.collect()), key=repr) == asof_brute(left, right, strict)


def test_asof_join_spreads_a_hot_key(spark):
    left = spark.range(4000).selectExpr("id", "'one' AS k", "id % 1000 AS t", "'x' AS seen")
    right = spark.range(1000).selectExpr("'one' AS k", "id AS at", "cast(id AS string) AS acc", "id AS n")
    out = asof_join(left, right, by="k", left_time="t", right_time="at", carry=["n"], partitions=8)
    assert out.where("n = t").count() == 4000
    # One key and one moment only: still many partitions, and one window never holds them all.
    same = asof_join(left.selectExpr("id", "k", "5L AS t", "seen"), right, by="k", left_time="t", right_time="at", carry=["n"], partitions=8)
    assert same.where("n = 5").count() == 4000


def test_asof_join_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 3, "x")], LEFT), spark.createDataFrame([("a", 1, "p", 2)], RIGHT)
    args = {"by": "k", "left_time": "t", "right_time": "at", "carry": ["acc"]}
    assert asof_join(left.limit(0), right, **args).count() == 0
    assert [tuple(r) for r in asof_join(left, right.limit(0), **args).collect()] == [(1, "a", 3, "x", None)]


def test_points_in_intervals(spark):
    r = random.Random(6)
    keys = ["hot"] * 5 + ["a", "b", None]
    points = [(i, r.choice(keys), r.choice([None, *range(-50, 6000)])) for i in range(400)] + [(5, "hot", 77)] * 5
    lengths = [None, 0, -4, 1, 2, 9, 64, 65, 600, 4000, 10**9]
    intervals = [(j, r.choice(keys), s, None if (n := r.choice(lengths)) is None else s + n) for j, s in enumerate(r.choices(range(-60, 5000), k=200))] + [(900, "a", None, 4)]
    want = sorted((i, j) for i, k, t in points for j, q, s, e in intervals if None not in (k, t, s) and k == q and s <= t and (e is None or t < e))
    out = points_in_intervals(spark.createDataFrame(points, "id long, k string, t long"), spark.createDataFrame(intervals, "iv long, k string, s long, e long"), by="k", time="t", start="s", end="e", width=4)
    assert sorted((x["id"], x["iv"]) for x in out.collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_long_intervals_cover_few_bins(spark):
    points = spark.range(100).selectExpr("'a' AS k", "id * 1000 AS t")
    intervals = spark.createDataFrame([("a", 0, 10**9), ("a", 5, 6)], "k string, s long, e long")
    out = points_in_intervals(points, intervals, by="k", time="t", start="s", end="e", width=1)
    assert out.count() == 100
    none = points_in_intervals(points, intervals.limit(0), by="k", time="t", start="s", end="e", width=1)
    assert none.count() == 0 and points_in_intervals(points.limit(0), intervals, by="k", time="t", start="s", end="e", width=1).count() == 0
