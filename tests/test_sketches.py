"""Summaries of batches: merged cubes against exact figures; windows that
the watermark closes against the batch aggregation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from filinglens.operators import sketches
from filinglens.streaming.ingest import stream_closed_windows

SCHEMA = "kind string, place string, id string, size long"
PERCENTS = {"p1": 1, "p50": 50, "p99": 99}


def cube(spark, path):
    out = sketches.cube_of_summaries(*sketches.read_summaries(spark, path), ["kind", "place"], PERCENTS)
    return {(r["level"], r["kind"], r["place"]): r for r in out.collect()}


def write(spark, rows, path, batch):
    sketches.append_summaries(spark.createDataFrame(rows, SCHEMA), path, batch=batch, dims=["kind", "place"], distinct_col="id", value_col="size")


def test_cube_of_batches_is_within_its_bounds(spark, tmp_table):
    r = random.Random(3)
    pick = lambda: ("hot" if r.random() < 0.4 else r.choice(["a", "b", None]), r.choice(["x", None]), f"i{r.randrange(900)}", r.choice([0, 1, 1, 7, r.randrange(1, 10**6), None]))
    batches = [[pick() for _ in range(n)] for n in (1500, 700, 1)]
    path = tmp_table("summaries")
    for i, rows in enumerate(batches):
        write(spark, rows, path, str(i))
    write(spark, batches[1], path, "1")  # a replay
    rows, got = sum(batches, []), cube(spark, path)
    want = {}
    for row in rows:
        for level in range(4):
            want.setdefault((level, None if level & 2 else row[0], None if level & 1 else row[1]), []).append(row)
    assert set(got) == set(want)
    for key, some in want.items():
        values = sorted(x[3] for x in some if x[3] is not None)
        assert got[key]["n"] == len(some) and got[key]["total"] == (sum(values) if values else None)
        n = len({x[2] for x in some})
        assert abs(got[key]["n_distinct"] - n) <= max(0.06 * n, 0)
        for name, p in PERCENTS.items():
            exact = values[max(math.ceil(len(values) * p / 100) - 1, 0)] if values else None
            assert got[key][name] == exact if exact is None else abs(got[key][name] - exact) <= 0.01 * exact + 1e-6


def test_cube_of_an_empty_table_and_of_nulls(spark, tmp_table):
    path = tmp_table("summaries")
    write(spark, [], path, "0")
    assert all(r["n"] in (0, None) for r in cube(spark, path).values())
    write(spark, [(None, None, None, None)], path, "1")
    got = cube(spark, path)
    assert set(got) == {(level, None, None) for level in range(4)}
    assert all(r["n"] == 1 and r["n_distinct"] == 0 and r["p50"] is None and r["total"] is None for r in got.values())


@pytest.mark.parametrize("hot", [False, True])
def test_closed_windows_equal_batch_and_leave_the_state(spark, tmp_table, hot):
    folder, out, ckpt = tmp_table("arrivals"), tmp_table("closed"), tmp_table("ckpt")
    schema = "ts timestamp, event_type string, value double"
    hours = 24 * 8
    part = lambda lo, hi: spark.range(lo * 4, hi * 4).select(
        (F.lit(1_700_000_000) + F.col("id") * 900).cast("timestamp").alias("ts"), F.lit("a").alias("event_type") if hot else F.concat(F.lit("t"), F.col("id") % 3).alias("event_type"),
        (F.col("id") % 10 / 4).alias("value"))
    states = []
    for day in range(8):  # a run per day, each from the checkpoint
        part(day * 24, day * 24 + 24).coalesce(1).write.mode("append").parquet(folder)
        if day == 6:  # late: its window was closed long ago; and a row without a time
            part(0, 1).union(spark.createDataFrame([(None, "a", 1.0)], schema)).coalesce(1).write.mode("append").parquet(folder)
        states += stream_closed_windows(spark, spark.readStream.schema(schema).parquet(folder), out, checkpoint=ckpt)
    everything = part(0, hours)
    last = everything.agg(F.max("ts")).first()[0]
    batch = everything.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(
        F.count("*").alias("n_events"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents"))
    want = batch.where(F.col("w.end") <= F.lit(last) - F.expr("INTERVAL 2 DAYS"))
    rows = lambda df: sorted(map(str, df.select("w", "event_type", "n_events", "value_cents").collect()))
    assert rows(spark.read.parquet(out)) == rows(want)
    assert states[-1]["state"] <= (1 if hot else 3) * 50 and sum(s["late"] for s in states) > 0
    before = rows(spark.read.parquet(out))
    stream_closed_windows(spark, spark.readStream.schema(schema).parquet(folder), out, checkpoint=ckpt)
    assert rows(spark.read.parquet(out)) == before
